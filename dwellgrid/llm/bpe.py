"""Byte-level BPE through a table of distinct words: split in Spark's tasks, encode each word once, join ids by position."""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwellgrid.llm.common import id_and_text, ship_package
from dwellgrid.llm.token_files import from_planes, to_planes

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
# Fixed value: the published pattern of the byte-level vocabulary; white space in the Unicode sense.
WORD_PATTERN = (
    "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\p{White_Space}\\p{L}\\p{N}]+"
    "|\\p{White_Space}+(?!\\P{White_Space})|\\p{White_Space}+"
)
CHUNK_WORDS = 1_500_000  # words of a chunk of documents: bounds the memory of the tasks that handle one
CHUNK_BITS = 33
WORD_PARTS = 128  # parts of the word table that a chunk asks: bounds the rows that a chunk sends
PIECE = 1 << 18  # characters that are split at a time
SLICE_WORDS = 1 << 16  # words that are decoded at a time
ENCODE_STEP = 4096  # words that the library encodes at a time
KNOWN_WORDS = 1 << 19  # words that a part of the table holds before it begins anew

_WORD = regex.compile(WORD_PATTERN)
# Before one blank between two characters that are none, every word ends.
_CUT = regex.compile("(?<=\\P{White_Space})(?= \\P{White_Space})")
_LIBRARIES: dict[str, Tokenizer] = {}


def library(tokenizer: str) -> Tokenizer:
    """The worker's copy of a public tokenizer, loaded once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    if tokenizer not in _LIBRARIES:
        loaded = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        loaded.no_truncation()
        loaded.no_padding()
        _LIBRARIES[tokenizer] = loaded
    return _LIBRARIES[tokenizer]


def unknown_to_java(text: Column) -> Column:
    """Whether the text has a code point that this Java runtime does not know: only for characters younger than that may
    the library's classes and those of regular expressions differ."""
    return (F.octet_length(text) != F.char_length(text)) & text.rlike("\\p{Cn}")


def _stretches(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in stretches of about ``size`` characters, cut only where a word ends in any case."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def words(text: str, odd: bool, tokenizer: str = TOKENIZER, size: int = PIECE) -> Iterator[list[str]]:
    """The pre-tokens of ``text`` in order, a stretch at a time; special tokens stand alone.  An ``odd`` text is cut by
    the library itself."""
    for i, section in enumerate(text.split(SPECIAL)):
        if i:
            yield [SPECIAL]
        if odd:
            yield [section[a:b] for _, (a, b) in library(tokenizer).pre_tokenizer.pre_tokenize_str(section)]
        else:
            for stretch in _stretches(section, size):
                yield _WORD.findall(stretch)


def _pressed(array: np.ndarray) -> bytes:
    return zstandard.compress(array.tobytes(), 3)


def _unpressed(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _pack_words(some: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in some]
    return _pressed(np.array([len(r) for r in raw], np.uint32)), zstandard.compress(b"".join(raw), 3)


def _unpack_words(sizes: bytes, raw: bytes) -> list[str]:
    ends = np.cumsum(_unpressed(sizes, np.uint32), dtype=np.int64).tolist()
    body = zstandard.decompress(raw)
    return [body[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)]


# Word numbers count a chunk's distinct words by part of the word table and, within it, as they first occur.  The check
# is a checksum of these words in order: the requests and the documents of a chunk are made by two passes over the input.
REQUEST_SCHEMA = "chunk long, part int, check long, sizes binary, raw binary"
DOCUMENT_SCHEMA = "chunk long, check long, doc_ids array<long>, n_words array<int>, planes array<binary>"
_REQUEST_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_DOCUMENT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary())]


def _named(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _Numbers(dict):
    """Word to running number by first occurrence."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _ordered(distinct: list[str], parts: int) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """A chunk's distinct words, listed as they first occur, by part of the word table: their order, where each part
    ends, the words in that order, and the check."""
    part = np.fromiter((zlib.crc32(w.encode()) % parts for w in distinct), np.int32, len(distinct))
    order = np.argsort(part, kind="stable")
    ordered = [distinct[i] for i in order]
    return order, np.searchsorted(part[order], np.arange(parts + 1)), ordered, zlib.crc32("\n".join(ordered).encode())


class _Requests:
    """A chunk that only asks: one row per part of the word table in which it has words."""

    schema, kinds = REQUEST_SCHEMA, _REQUEST_TYPES

    def __init__(self, chunk: int):
        self.chunk, self.seen = chunk, {}

    def add(self, some: list[str]) -> None:
        self.seen |= dict.fromkeys(some)

    def end_document(self, doc_id: int | None, n_words: int) -> None:
        pass

    def rows(self, parts: int) -> list[tuple]:
        _, ends, ordered, check = _ordered(list(self.seen), parts)
        spans = zip(range(parts), ends[:-1].tolist(), ends[1:].tolist())
        return [(self.chunk, p, check, *_pack_words(ordered[a:b])) for p, a, b in spans if a < b]


class _Documents:
    """A chunk as one row: its documents as word numbers, in compressed planes."""

    schema, kinds = DOCUMENT_SCHEMA, _DOCUMENT_TYPES

    def __init__(self, chunk: int):
        self.chunk, self.numbers, self.found, self.doc_ids, self.counts = chunk, _Numbers(), array("I"), [], []

    def add(self, some: list[str]) -> None:
        self.found.extend(map(self.numbers.__getitem__, some))

    def end_document(self, doc_id: int | None, n_words: int) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(n_words)

    def rows(self, parts: int) -> list[tuple]:
        order, _, _, check = _ordered(list(self.numbers), parts)
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        return [(self.chunk, check, self.doc_ids, self.counts, to_planes(number[np.frombuffer(self.found, np.uint32)]))]


def _chunked(docs: DataFrame, parts: int, tokenizer: str, chunk_words: int, kind) -> DataFrame:
    """Rows of every chunk of documents (``doc_id, text``); a chunk is a stretch of a partition."""
    names = _named(kind.schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, some = kind(TaskContext.get().partitionId() << CHUNK_BITS), 0, False

        def out() -> pa.RecordBatch:
            columns = list(zip(*chunk.rows(parts))) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind.kinds)], names)

        for batch in batches:
            for at in range(batch.num_rows):
                doc_id, text, odd = (batch.column(i)[at].as_py() for i in range(3))
                n_words = 0
                for found in words(text, odd, tokenizer):
                    chunk.add(found)
                    n_words += len(found)
                chunk.end_document(doc_id, n_words)
                held, some = held + n_words, True
                if held >= chunk_words:
                    yield out()
                    chunk, held, some = kind(chunk.chunk + 1), 0, False
        if some:
            yield out()

    ship_package(docs.sparkSession)
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long"), text, unknown_to_java(text)).mapInArrow(pack, kind.schema)


def word_requests(docs: DataFrame, parts: int, tokenizer: str = TOKENIZER, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Each chunk's distinct words by part of the word table, see ``REQUEST_SCHEMA``."""
    return _chunked(docs, parts, tokenizer, chunk_words, _Requests)


def numbered_documents(
    docs: DataFrame, parts: int, tokenizer: str = TOKENIZER, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """The documents as word numbers, one row per chunk, see ``DOCUMENT_SCHEMA``."""
    return _chunked(docs, parts, tokenizer, chunk_words, _Documents)


class _WordTable:
    """The ids of the words of one part, flat; each word is encoded when it is first asked for."""

    def __init__(self, tokenizer: str):
        self.library = library(tokenizer)
        self.clear()

    def clear(self) -> None:
        self.rows, self.starts, self.flat = _Numbers(), array("q", [0]), array("I")

    def ids(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them one after the other."""
        if len(self.rows) > KNOWN_WORDS:
            self.clear()
        known = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, asked), np.int64, len(asked))
        new = [w for w, row in zip(asked, rows.tolist()) if row >= known]  # words of a request are distinct
        for at in range(0, len(new), ENCODE_STEP):
            for found in self.library.encode_batch_fast(new[at : at + ENCODE_STEP], add_special_tokens=False):
                self.flat.extend(found.ids)
                self.starts.append(len(self.flat))
        starts = np.array(self.starts, np.int64)
        counts = starts[rows + 1] - starts[rows]
        return counts.astype(np.uint32), _gathered(np.array(self.flat, np.uint32), starts[rows], counts)


def encoded_words(requests: DataFrame, parts: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """``chunk, part, check, counts, ids``: the ids of every chunk's distinct words.

    All requests for a word meet in one part of the table, where the library encodes it once; a word that every document
    uses is requested once per chunk only.  Where the session asks for more shuffle partitions than the table has parts,
    the table exists several times, each for a share of the chunks.
    """
    wide = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = max(1, wide // parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _WordTable(tokenizer)
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, part, check, sizes, raw = (batch.column(i)[at].as_py() for i in range(5))
                counts, ids = table.ids(_unpack_words(sizes, raw))
                row = [[chunk], [part], [check], [_pressed(counts)], [_pressed(ids)]]
                arrays = [pa.array(v, k) for v, k in zip(row, _REQUEST_TYPES)]
                yield pa.RecordBatch.from_arrays(arrays, ["chunk", "part", "check", "counts", "ids"])

    share = F.pmod(F.xxhash64("chunk"), F.lit(tables)).cast("int") * parts
    placed = requests.repartitionById(parts * tables, share + F.col("part"))
    return placed.mapInArrow(encode, "chunk long, part int, check long, counts binary, ids binary")


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(tokenizer: str = TOKENIZER) -> pa.Array:
    """The table id to bytes (its size is fixed by the vocabulary file)."""
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as file:
        parsed = json.load(file)
    table = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
    of_char = _byte_of_char()

    def raw(token: str) -> bytes:
        return bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()

    return pa.array([raw(table[i]) if i in table else b"" for i in range(max(table) + 1)], pa.large_binary())


def _gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + counts[i]]`` one after the other."""
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))]


_PIECES: dict[str, pa.Array] = {}


def encoded(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    chunk_words: int = CHUNK_WORDS,
    with_output: bool = False,
    slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, on request, ``ids`` and ``decoded``.

    The distinct words of the chunks meet in the word table, where each is encoded once; their ids return to the chunk,
    where they are joined to the documents, which have become word numbers, by position, and the ids to their pieces.
    What moves is about half of the text's size: planes of word numbers, and each distinct word once per chunk.  A task
    holds one chunk or a bounded share of the distinct words.  Both passes over the input must see the same partitions;
    if they do not, the chunks' checks differ and the job ends with an error.

    Defined cases: null and empty texts have no ids; the text of a special token is encoded as that token, as the library
    does.  Texts with characters that the Java runtime does not know yet are split by the library itself.  A very long
    text is split, joined and decoded a stretch at a time; its word numbers are held whole, four bytes each.  Null and
    repeated ids pass through, row for row.  No rows give no rows.
    """
    spark = docs.sparkSession
    parts = min(WORD_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = id_and_text(docs, id_col, text_col)
    answers = encoded_words(word_requests(rows, parts, tokenizer, chunk_words), parts, tokenizer)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]

    def join(asked: pa.Table, found: pa.Table) -> pa.Table:
        if tokenizer not in _PIECES:
            _PIECES[tokenizer] = pieces(tokenizer)
        piece = _PIECES[tokenizer]
        bodies, ends = np.frombuffer(piece.buffers()[2], np.uint8), np.frombuffer(piece.buffers()[1], np.int64)
        if asked.num_rows != 1 or set(found.column("check").to_pylist()) - {asked.column("check")[0].as_py()}:
            raise RuntimeError("the input changed between two passes over it")
        row = asked.slice(0, 1).to_pylist()[0]
        found = found.sort_by("part")
        counts = [_unpressed(b.as_py(), np.uint32) for b in found.column("counts")]
        flat = [_unpressed(b.as_py(), np.uint32) for b in found.column("ids")]
        none = np.zeros(0, np.uint32)
        counts, flat = np.concatenate([none, *counts]).astype(np.int64), np.concatenate([none, *flat])
        starts = np.cumsum(counts) - counts
        numbers = from_planes(row["planes"], sum(row["n_words"])) if sum(row["n_words"]) else none
        out, at = [], 0
        for doc_id, n in zip(row["doc_ids"], row["n_words"]):
            n_tokens, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            decoder = codecs.getincrementaldecoder("utf-8")("replace")  # a character's bytes may lie in two slices
            all_ids, all_text = [], []
            for first in range(at, max(at + n, at + 1), slice_words):
                some = numbers[first : min(first + slice_words, at + n)]
                ids = _gathered(flat, starts[some], counts[some]).astype("<u4")
                body = _gathered(bodies, ends[ids], ends[ids + 1] - ends[ids]).tobytes()
                text = decoder.decode(body, first + slice_words >= at + n)
                n_tokens += len(ids)
                ids_hash.update(ids.tobytes())
                text_hash.update(text.encode())
                if with_output:
                    all_ids.append(ids.tobytes())
                    all_text.append(text)
            at += n
            output = (b"".join(all_ids), "".join(all_text)) if with_output else (None, None)
            out.append((doc_id, n_tokens, ids_hash.hexdigest(), text_hash.hexdigest(), *output))
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    documents = numbered_documents(rows, parts, tokenizer, chunk_words)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, schema)
