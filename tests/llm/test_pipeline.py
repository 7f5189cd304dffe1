"""The pipeline's stages one by one, against the operators' own brute-force checks."""

from __future__ import annotations

import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from test_native import key, lines_by_hand
from test_similarity import fingerprint_by_hand, near_by_hand, roots_by_hand
from test_tokens import check_pieces, ids_by_library

import __spark_entry__ as entry
from dwellgrid.llm import queries
from dwellgrid.llm.common import DOCUMENT_COLUMNS

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TYPES = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.queries()}
    assert set(queries.queries()) <= names
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "packing"]


def test_toxic_documents_go(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    kept = pipeline.without_toxic(spark, docs, MEDIUM)
    assert kept.dtypes == TYPES
    rejected = {r["doc_id"] for r in queries.op9_toxicity(spark, MEDIUM).where("predicted = 1").collect()}
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert rejected and left == set(range(1000)) - rejected


def test_lines_go(spark, messy, messy_rows):
    kept = pipeline.without_repeated_lines(spark, messy, SMALL)
    assert kept.dtypes == TYPES
    found = sorted(((r["doc_id"], r["text"], r["n_chars"], r["source"]) for r in kept.collect()), key=key)
    assert found == sorted(((i, t, len(t), "src") for i, _, _, t in lines_by_hand(messy_rows)), key=key)


def test_near_copies_go(spark, messy, messy_rows):
    kept = pipeline.without_near_copies(spark, messy, SMALL)
    assert kept.dtypes == TYPES
    rows = [r for r in messy_rows if r[0] is not None]
    root = roots_by_hand(len(rows), near_by_hand([fingerprint_by_hand(t) for _, t in rows], 2))
    smallest = {}
    for r, (i, _) in zip(root, rows):
        smallest[r] = min(i, smallest.get(r, i))
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key)
    expected = [(i, t) for r, (i, t) in zip(root, rows) if smallest[r] == i] + [(None, "no id at all")]
    assert found == sorted(expected, key=key)


def test_near_copies_of_repeated_and_missing_ids(spark):
    """An id with two texts loses only its copy; of alike rows one stays, also without ids or with equal ids."""
    copy, clean = "one two three four five six seven eight nine ten", "a quite different text about other matters"
    rows = [(1, copy), (2, copy.upper()), (2, clean), (None, copy), (None, "no id here"), (None, "no id here")]
    rows += [(None, "NO  id here"), (5, "same id, copied text"), (5, "Same id, copied  text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], ", ".join(f"{n} {k}" for n, k in TYPES))
    found = [(r["doc_id"], r["text"]) for r in pipeline.without_near_copies(spark, docs.repartition(3), SMALL).collect()]
    assert sorted(i for i, _ in found if i) == [1, 2, 5] and (1, copy) in found and (2, clean) in found
    assert [t.lower().split() for i, t in found if i is None] == [["no", "id", "here"]]


def test_whole_run(spark):
    """The pieces are those of the documents that the stages leave, with whole texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
    left = {r["doc_id"]: r["text"] for r in docs.select(DOCUMENT_COLUMNS).collect()}
    ids = ids_by_library("word_bpe_49k.json", left.values())
    rows = pipeline.STAGES[-1][1](spark, docs, SMALL).selectExpr("*", "CAST(NULL AS binary) AS ids").collect()
    ids_of = {i: ([*x, 1], 1) for i, x in zip(left, ids)}
    ids_of = {i: (np.array(x, np.uint32), n) for i, (x, n) in ids_of.items()}
    check_pieces(rows, ids_of, 2048)
    mine = pipeline.run(spark, SMALL)
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sum(r["length"] for r in mine.collect()) == sum(len(x) for x, _ in ids_of.values())
    assert set(mine.columns) >= set(pieces)


def test_sequences_hold_their_tokens(spark):
    """The pipeline's rows alone give the training sequences."""
    schema = ", ".join(f"{n} {k}" for n, k in TYPES)
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15), (2, None, "en", "s", 0)], schema)
    for r in pipeline.into_sequences(spark, docs, SMALL).collect():
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert "ids" in pipeline.run(spark, SMALL).columns


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_of_nothing(spark, nothing, name, stage):
    assert stage(spark, nothing, SMALL).collect() == []
