"""What the plans of the catalogue must and must not contain."""

from __future__ import annotations

from dataclasses import replace

import pytest
from helpers import DATA

from dwellgrid.catalog.queries import queries
from dwellgrid.functions.clock import Window
from dwellgrid.operators import dense, latest, rates, retrieval, zones
from dwellgrid.operators.dialogue import last_turns
from dwellgrid.sources import sample_tables

# queries that hand rows to Python, all in Arrow batches
PYTHON = {
    "question_intents", "question_intents_legacy", "question_params", "knn_cosine_gated", "mmr_rerank",
    "context_per_query", "knn_indexed", "document_chunks_by_separator",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_all_pairs_and_no_row_python(spark, name):
    text = plan(queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    python = any(node in text for node in ("ArrowEvalPython", "MapInArrow", "FlatMapGroupsInPandas", "MapInPandas"))
    assert python is (name in PYTHON)


@pytest.fixture(scope="module")
def sample(spark):
    return sample_tables.usage(spark, DATA)


@pytest.mark.parametrize("name", ["knn_cosine_gated", "mmr_rerank", "context_per_query"])
def test_salted_queries_are_not_broadcast(spark, name):
    """Every salt has all queries: by its files that side looks small, but it must not pass through the driver."""
    text = plan(queries()[name](spark, DATA))
    assert "SortMergeJoin [salt#" in text and "BroadcastHashJoin [salt#" not in text


def test_words_are_counted_after_texts_are_dealt(spark):
    """No task counts all words of the file it reads, and no join sends the words through the driver."""
    texts = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id AS vec_id", "text")
    index = retrieval.lexical_index(texts)
    lines = plan(index).splitlines()
    reads = [i for i, line in enumerate(lines) if "FileScan" in line]
    words = [i for i, line in enumerate(lines) if "Generate explode" in line]
    assert words
    for first in words:
        last = min(i for i in reads if i > first)
        assert any("REPARTITION_BY_NUM" in line for line in lines[first:last])
    asked = texts.selectExpr("CAST(vec_id AS STRING) AS query_id", "text")
    unit = retrieval.lexical_queries(index, asked)
    for text in (plan(index), plan(retrieval.lexical_candidates(index, unit, 0.25)).split("Generate explode")[0]):
        assert "SortMergeJoin [term#" in text and "BroadcastHashJoin [term#" not in text


def test_window_reaches_the_scan(sample):
    text = plan(rates.utilization_by_floor(sample, 7))
    assert "GreaterThanOrEqual(ts,ScalarSubquery" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text


def test_large_dimension_is_never_broadcast(sample):
    """Without a size bound the log is reduced per space and hour before the join, and nothing is hinted."""
    large = replace(sample, broadcast_spaces=False)
    for df in (
        rates.utilization_by_floor(large), rates.busiest_rooms(large), latest.status_floor_now(large, 3),
        dense.dense_rates(large, 3), dense.dense_hourly_series(large), zones.facility_features(large),
    ):
        assert "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_latest_and_last_turns_shrink_before_the_shuffle(spark, sample):
    large = replace(sample, broadcast_spaces=False)
    assert "partial_max_by" in plan(latest.latest_states(large, Window(days=7)))
    assert plan(last_turns(sample_tables.table(spark, DATA, "conversations"))).count("WindowGroupLimit") == 2


def test_latest_state_sorts_nothing_but_the_newest_events(sample):
    """The pass over the log is a hash aggregate of one time per space; sorts stand above the join with its result."""
    text = plan(latest.status_floor_now(sample, 3))
    assert "partial_max(ts" in text
    before_aggregate = text[text.index("partial_max(ts") :]
    assert "HashAggregate" in text and " Sort [" not in before_aggregate


def test_rollup_spares_the_log(spark, sample, tmp_path):
    """Over a stored roll-up every event scan is bounded by a time."""
    from dwellgrid.sources import store

    store.write_events(sample.events, str(tmp_path / "log"))
    store.write_rollup(sample.events, str(tmp_path / "rollup"))
    log = replace(sample, events=spark.read.parquet(str(tmp_path / "log")))
    df = rates.utilization_by_floor(log.with_rollup(spark.read.parquet(str(tmp_path / "rollup"))), 7)
    scans = [line for line in plan(df).splitlines() if "FileScan" in line and "occupancy" in line]
    assert scans and all("ScalarSubquery" in line for line in scans)


def test_ranking_gathers_no_texts(sample):
    for df in (zones.rank_zones(sample), zones.ranked_zone_rooms(sample)):
        assert "listagg" not in plan(df)


def test_small_dimension_costs_no_shuffle_of_events(sample):
    """Events meet the broadcast dimension before the first exchange, which carries floor-hour sums only."""
    text = plan(rates.utilization_by_floor(sample))
    assert "hashpartitioning(space_id" not in text
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_date_partitions_are_pruned(spark, sample, tmp_path):
    from dwellgrid.sources import store

    store.write_events(sample.events, str(tmp_path / "log"))
    log = replace(sample, events=spark.read.parquet(str(tmp_path / "log")))
    text = plan(rates.utilization_by_floor(log, 7))
    assert "PartitionFilters: [isnotnull(event_date" in text and "event_date" in text
    df = rates.utilization_by_floor(log, 7)
    df.collect()
    final = plan(df)
    assert final.count("event_date") > 0
