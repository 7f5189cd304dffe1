"""The inverted list: recall against brute force, blocks, storage and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import rows

from dwellgrid.operators import retrieval, vector_index

MEDIUM = "/root/testdata/sf0.1"
VECTORS = "vec_id bigint, vec array<float>"


def pairs(df):
    return {(q, v): round(s, 9) for q, _, v, s in rows(df.select("query_id", "place", "vec_id", "score"))}


def unit(df, out="vec_id"):
    return vector_index.unit_vectors(df, "vec_id", "vec", out)


def searched(corpus, asked, **options):
    filed = unit(corpus)
    cells = vector_index.fit_cells(filed)
    return vector_index.search(vector_index.filed_rows(filed, cells), cells, unit(asked, "query_id"), **options), cells


@pytest.mark.parametrize("kind", ["sample", "clusters", "one cell"])
def test_recall(spark, kind):
    """At least nine of ten neighbours, with exact scores; few cells where the data lie in clusters."""
    rng = np.random.default_rng(2)
    if kind == "sample":
        corpus = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").selectExpr("vec_id", "embedding AS vec")
    else:
        centres = rng.normal(size=(40 if kind == "clusters" else 1, 16)) * 4
        vectors = centres[rng.integers(len(centres), size=3000)] + rng.normal(size=(3000, 16))
        corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS)
    asked = corpus.where("vec_id % 50 = 0")
    exact = pairs(retrieval.nearest(corpus, asked.withColumnRenamed("vec_id", "query_id")))
    df, cells = searched(corpus, asked)
    found = pairs(df)
    recall = len(exact.keys() & found.keys()) / len(exact)
    print(kind, "recall", round(recall, 3), "cells visited", cells.visits, "of", len(cells.centres))
    assert recall >= 0.9
    assert all(abs(found[p] - exact[p]) < 1e-6 for p in exact.keys() & found.keys())
    assert cells.visits < len(cells.centres) * (0.25 if kind == "clusters" else 0.7)


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], VECTORS)


@pytest.mark.parametrize("blocks", [(7, 3), (1 << 14, 1 << 12)])
def test_visiting_all_cells_is_exact(small, blocks):
    """Whatever the block sizes, every pair of blocks meets once."""
    asked = small.where("vec_id % 20 = 0")
    df, _ = searched(small, asked, visits=1000, rows_per_block=blocks[0], queries_per_block=blocks[1], gate=None)
    exact = retrieval.nearest(small, asked.withColumnRenamed("vec_id", "query_id"), gate=None)
    assert pairs(df) == pairs(exact)
    assert sorted(rows(df.select("query_id", "place", "vec_id"))) == sorted(rows(exact.select("query_id", "place", "vec_id")))


def test_stored_index(spark, small, tmp_path):
    filed = unit(small)
    cells = vector_index.fit_cells(filed)
    direct = vector_index.filed_rows(filed, cells)
    vector_index.save_index(direct, cells, str(tmp_path / "index"))
    stored, loaded = vector_index.load_index(spark, str(tmp_path / "index"))
    asked = unit(small.where("vec_id < 20"), "query_id")
    assert pairs(vector_index.search(stored, loaded, asked)) == pairs(vector_index.search(direct, cells, asked))
    assert (loaded.visits, loaded.found) == (cells.visits, cells.found)
    with pytest.raises(Exception):
        vector_index.save_index(direct, cells, str(tmp_path / "index"))


def test_copies_nulls_and_nothing(spark):
    copies = [(i, [1.0, 0.0]) for i in range(900)] + [(1000 + i, [0.0, 1.0]) for i in range(50)]
    odd = [(2000, None), (2001, [0.0, 0.0]), (2002, [float("nan"), 1.0]), (2003, [None, 1.0]), (2004, [float("inf"), 1.0])]
    corpus = spark.createDataFrame(copies + odd, VECTORS)
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.1, 3.0]), (3, None)], VECTORS)
    df, _ = searched(corpus, asked, k=3, rows_per_block=100)
    # equal scores go by id
    assert sorted(r[:3] for r in rows(df)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 1, 1000), (2, 2, 1001), (2, 3, 1002)]
    assert vector_index.fit_cells(unit(corpus.where("vec_id >= 2000"))) is None
    none, _ = searched(corpus, asked.where("false"))
    assert rows(none) == []
    mixed = corpus.unionByName(spark.createDataFrame([(9000, [1.0, 2.0, 3.0])], VECTORS))
    with pytest.raises(Exception, match="different lengths"):
        searched(mixed, asked)[0].collect()


def test_no_query_meets_all_rows(small):
    df, _ = searched(small, small.where("vec_id < 20"))
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
