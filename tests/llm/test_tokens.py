"""Token files, packing and the distinct-word table against the tokenizers library."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dwellgrid.llm import bpe, packing, token_files, tokens


def ids_by_library(name, texts):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(name, keep, messy_rows, corpus):
    texts = [t or "" for _, t in messy_rows] + [" ", "\n\n\n x", "a\t b \n c", "  \n \n  y", "end \n "]
    texts += ["ΑΣ.Α ΑΣ, x", "...", "a,.b ,c .d", "e\u0301, é. क़, İ.x", "3.14,15", "\n,", ",", ". ,", "it's, I'd."]
    texts += [t for _, t in corpus[:40]]
    encoder = tokens.ChunkedEncoder(public_tokenizers.path(name), keep, max_chunks=50)
    for _ in range(2):
        for text, mine, theirs in zip(texts, encoder.ids(texts), ids_by_library(name, texts)):
            assert mine.tolist() == theirs.tolist(), text[:80]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes(kind):
    ids = np.random.default_rng(1).integers(0, 2**32, 1001, dtype=np.uint32)
    for some in (ids, ids[:1], ids % 50257):
        planes = token_files.to_planes(some, kind)
        assert len(planes) == (4 if kind == "byte" else 32)
        assert token_files.from_planes(planes, len(some)).tolist() == some.tolist()


@pytest.mark.parametrize("options", [{}, {"block_ids": 64, "planes": "bit"}])
def test_token_files(messy, messy_rows, options):
    files = token_files.write_token_files(messy, **options)
    found = sorted(map(tuple, token_files.read_documents(files).collect()), key=lambda r: r[1])
    order = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc_id, _), ids, row in zip(order, ids_by_library("byte_bpe_50k.json", [t for _, t in order]), found):
        ids = np.append(ids, 0).astype("<u4")
        assert row == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    index = sorted(map(tuple, token_files.chunk_index(files).select("start", "n_ids").collect()))
    assert [a + n for a, n in index] == [a for a, _ in index[1:]] + [at]


def test_token_files_of_nothing(nothing):
    assert token_files.read_documents(token_files.write_token_files(nothing)).collect() == []


def check_pieces(rows, ids_of, length):
    """``ids_of``: one list of ids per id; every id lies in one piece, sequences are gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, (ids, times) in ids_of.items():
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == times * len(ids)
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()
            assert (r["ids_crc32"], r["doc_tokens"]) == (zlib.crc32(part), len(ids))
            assert r["ids"] is None or bytes(r["ids"]) == part
    assert not by_doc
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence)


@pytest.mark.parametrize("length, group", [(2048, 2048), (64, 8)])
def test_packing(messy, messy_rows, length, group):
    rows = packing.packed(messy, length=length, group_sequences=group, with_ids=True).collect()
    ids_of = {}
    for (doc_id, _), ids in zip(messy_rows, ids_by_library("word_bpe_49k.json", [t for _, t in messy_rows])):
        ids_of[doc_id] = np.append(ids, 1), ids_of.get(doc_id, (0, 0))[1] + 1
    check_pieces(rows, ids_of, length)


def test_packing_of_nothing(nothing):
    assert packing.packed(nothing).collect() == []


def test_assignment_wastes_less_than_one_sequence_and_balances():
    lengths = np.random.default_rng(2).integers(1, 5000, 400)
    pieces = packing.assign(lengths, 2048)
    used, cost = defaultdict(int), defaultdict(float)
    for _, _, n, sequence, offset in pieces:
        assert offset == used[sequence]
        used[sequence] += n
        cost[sequence] += packing.attention_cost(n)
    assert sum(used.values()) == lengths.sum() and len(used) == -(-lengths.sum() // 2048)
    assert max(used.values()) <= 2048
    packed = [c for s, c in cost.items() if not any(p[2] == 2048 for p in pieces if p[3] == s)]
    assert np.std(packed) < 0.25 * np.mean(packed)


def test_longest_goes_to_the_lowest_cost():
    assert packing.assign(np.array([3, 9, 5]), 10) == [(1, 0, 9, 0, 0), (2, 0, 5, 1, 0), (0, 0, 3, 1, 5)]
    assert packing.assign(np.array([], int)) == []


@pytest.mark.parametrize("chunk_words,slice_words", [(11, 1 << 16), (1_500_000, 1), (1_500_000, 1 << 16)])
def test_distinct_word_table(messy, messy_rows, chunk_words, slice_words):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for (doc_id, _), ids in zip(messy_rows, ids_by_library("byte_bpe_50k.json", [t for _, t in messy_rows])):
        text = library.decode(ids.tolist(), skip_special_tokens=False)
        raw = ids.astype("<u4").tobytes()
        expected.append((doc_id, len(ids), *(hashlib.sha256(x).hexdigest() for x in (raw, text.encode())), raw, text))
    found = [tuple(r) for r in bpe.encoded(messy, chunk_words=chunk_words, with_output=True, slice_words=slice_words).collect()]

    def key(row):
        return row[0] is not None, row[0] or 0

    assert [(*r[:4], bytes(r[4]), r[5]) for r in sorted(found, key=key)] == sorted(expected, key=key)


@pytest.mark.parametrize("size", [1, 5, 64])
def test_words_are_those_of_the_library(messy_rows, corpus, size):
    """Stretches of any size give the library's words; so do all code points that the database of Unicode 13 knows."""
    split = bpe.library("byte_bpe_50k.json").pre_tokenizer.pre_tokenize_str

    def by_library(text):
        out = []
        for i, section in enumerate(text.split("<|endoftext|>")):
            out += ["<|endoftext|>"] if i else []
            out += [section[a:b] for _, (a, b) in split(section)]
        return out

    for text in [t for _, t in messy_rows + corpus[:60] if t and len(t) < 20000] + [" ", "a  b", "  a b", "x \u3000 y z", "a \n b"]:
        assert [w for part in bpe.words(text, False, size=size) for w in part] == by_library(text)
    every = [chr(c) for c in range(0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    for at in range(0, len(every), 997):
        text = "".join(f"a{c}b 1{c}2 {c}  {c}" for c in every[at : at + 997])
        assert [w for part in bpe.words(text, False) for w in part] == by_library(text)


def test_a_word_table_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    monkeypatch.setattr(bpe, "ENCODE_STEP", 2)
    table, library = bpe._WordTable("byte_bpe_50k.json"), bpe.library("byte_bpe_50k.json")
    for asked in (["a", " hello", " antidisestablish"], [" hello", " x", " zzzzz"], ["a", " hello"], []):
        counts, ids = table.ids(asked)
        expected = [library.encode(w, add_special_tokens=False).ids for w in asked]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == sum(expected, [])


def test_distinct_word_table_of_nothing(nothing):
    assert bpe.encoded(nothing).collect() == []


def test_a_changed_input_is_noticed(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string").coalesce(1)
    answers = bpe.encoded_words(bpe.word_requests(docs, 4), 4).drop("check").selectExpr("*", "1L AS check")
    original = bpe.encoded_words
    bpe.encoded_words = lambda *_: answers.select("chunk", "part", "check", "counts", "ids")
    try:
        with pytest.raises(Exception, match="input changed"):
            bpe.encoded(docs).collect()
    finally:
        bpe.encoded_words = original


def test_each_word_is_asked_for_once_per_chunk(spark):
    rows = [(i, "same words here, same words there") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    requests = bpe.word_requests(docs.coalesce(1), 4).collect()
    asked = [w for r in requests for w in bpe._unpack_words(r["sizes"], r["raw"])]
    assert sorted(asked) == sorted({"same", " words", " here", ",", " same", " there"})
