"""Token ids of whole texts with the public tokenizer files, each distinct chunk of text encoded once per worker."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

# White space in the sense of the tokenizers' patterns (Unicode White_Space).
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
# str.split() also cuts at these four, which the tokenizers treat as ordinary characters.
SEPARATORS = "\x1c\x1d\x1e\x1f"
STOPS = ",."
MAX_CHUNKS = 1_000_000
ENCODE_STEP = 50_000


def _ends_in_word(chunk: str) -> bool:
    """Whether the last character is, and stays when a tokenizer normalises it, a letter or digit."""
    last = chunk[-1:]
    if last.isascii():
        return last.isalnum()
    return unicodedata.category(unicodedata.normalize("NFC", last).lower()[-1])[0] in "LN"


class _Numbers(dict):
    """Piece to running number; a new piece gets the next one and is listed in ``new``."""

    def __init__(self, known=()):
        super().__init__((piece, i) for i, piece in enumerate(known))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class ChunkedEncoder:
    """``ids(texts)``: what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives, for many texts at once.

    A text is cut at single spaces and newlines (``keep_spaces``, byte-level vocabularies) or at white space that the
    tokenizer drops, and before commas and full stops.  Where no pre-token reaches over a cut, the ids of the text are
    those of its chunks in order, and chunks seen before are looked up.  A text in which a cut could part a run of
    punctuation is cut at white space only; one in which a cut would part a run of white space, or that holds a special
    token's string, goes to the library as a whole.  ``max_chunks`` bounds the memory: of a fuller table the first half
    stays, as frequent chunks come early.
    """

    def __init__(self, tokenizer: str, keep_spaces: bool, max_chunks: int = MAX_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.library = Tokenizer.from_file(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.keep_spaces = keep_spaces
        self.max_chunks = max_chunks
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.numbers = _Numbers()
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)
        # per chunk: ends in white space; is or begins with two blanks; ends in a letter or digit; begins with a stop
        self.flags = np.zeros((4, 0), bool)

    def _shrink(self) -> None:
        kept = self.max_chunks // 2
        self.numbers = _Numbers(list(self.numbers)[:kept])
        self.starts = self.starts[: kept + 1]
        self.flat = self.flat[: self.starts[-1]]
        self.flags = self.flags[:, :kept]

    def _pieces(self, text: str, at_stops: bool) -> list[str]:
        """The chunks in the form in which they are looked up, see ``_chunk``."""
        if not self.keep_spaces:
            return (text.replace(",", " ,").replace(".", " .") if at_stops else text).split()
        spaced = text.replace("\n", " \n")
        if at_stops:
            pieces = spaced.replace(",", " ,").replace(".", " .").split(" ")
        else:
            pieces = ["  " + p if p[:1] in STOPS and p else p for p in spaced.split(" ")]
        pieces[0] = pieces[0] if pieces[0][:1] == " " else " " + pieces[0]
        if not at_stops and pieces[0][:2] == "  ":
            pieces[0] = pieces[0][1:]
        return pieces

    def _chunk(self, piece: str) -> str:
        """The chunk as it stands in the text.

        A blank precedes a plain piece.  None precedes a newline or a stop; a piece that begins with a blank (which no
        plain piece does) is the chunk after it.
        """
        if not self.keep_spaces or piece[:1] in ("\n", ",", "."):
            return piece
        return piece[1:] if piece[:1] == " " else " " + piece

    def _learn(self) -> None:
        """Encode the pieces that were numbered since the last call."""
        if not self.numbers.new:
            return
        pieces, self.numbers.new = self.numbers.new, []
        new = [self._chunk(p) for p in pieces]
        ids: list[int] = []
        counts: list[int] = []
        for at in range(0, len(new), ENCODE_STEP):
            for found in self.library.encode_batch_fast(new[at : at + ENCODE_STEP], add_special_tokens=False):
                some = found.ids
                ids += some
                counts.append(len(some))
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts, dtype=np.int64)])
        flags = np.array(
            [
                [c[-1:] in SPACES for c in new],
                [len(c) < 2 or c[1] in SPACES for c in new],
                [_ends_in_word(c) for c in new],
                [p[:1] in STOPS and p != "" for p in pieces],
            ],
            bool,
        )
        self.flags = np.concatenate([self.flags, flags], axis=1)

    def _needs_library(self, text: str) -> bool:
        if any(s in text for s in self.specials):
            return True
        return not self.keep_spaces and any(s in text for s in SEPARATORS)

    def _cuts_stops(self, text: str) -> bool:
        """A stop after a blank belongs to the blank, unless blanks are dropped."""
        return not self.keep_spaces or not (" ," in text or " ." in text)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _numbered(self, texts: list[str], at_stops: bool) -> list[np.ndarray]:
        number = self.numbers.__getitem__
        found = [np.fromiter(map(number, self._pieces(t, at_stops)), np.int32) for t in texts]
        self._learn()
        return found

    def _parts_punctuation(self, chunks: np.ndarray) -> bool:
        return bool(np.any(self.flags[3][chunks[1:]] & ~self.flags[2][chunks[:-1]]))

    def _parts_blanks(self, chunks: np.ndarray) -> bool:
        if not self.keep_spaces:
            return False
        begins = self.flags[1][chunks[1:]] & ~self.flags[3][chunks[1:]]
        return bool(np.any(self.flags[0][chunks[:-1]] & begins))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids per text."""
        if len(self.numbers) > self.max_chunks:
            self._shrink()
        out: list[np.ndarray | None] = [None] * len(texts)
        left = [i for i, t in enumerate(texts) if not self._needs_library(t)]
        for at_stops in (True, False):
            some = [i for i in left if not at_stops or self._cuts_stops(texts[i])]
            for i, chunks in zip(some, self._numbered([texts[i] for i in some], at_stops)):
                if not (at_stops and self._parts_punctuation(chunks)) and not self._parts_blanks(chunks):
                    out[i] = self._gathered(chunks)
            left = [i for i in left if out[i] is None]
        return [self._whole(t) if found is None else found for t, found in zip(texts, out)]

    def _gathered(self, chunks: np.ndarray) -> np.ndarray:
        first, counts = self.starts[chunks], self.starts[chunks + 1] - self.starts[chunks]
        before = np.cumsum(counts) - counts
        return self.flat[np.repeat(first - before, counts) + np.arange(counts.sum())]


_ENCODERS: dict[tuple[str, bool], ChunkedEncoder] = {}


def encoder(name: str, keep_spaces: bool) -> ChunkedEncoder:
    """The worker's encoder for a public tokenizer file, kept between tasks."""
    key = (name, keep_spaces)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkedEncoder(public_tokenizers.path(name), keep_spaces)
    return _ENCODERS[key]
