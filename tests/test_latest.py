"""Latest states from stored newest events and the log's tail."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import at, rows

from dwellgrid.functions.clock import Window
from dwellgrid.operators import latest, profile
from dwellgrid.sources import store


@pytest.fixture(scope="module")
def model(site):
    rng = np.random.default_rng(8)
    hours = np.sort(rng.integers(0, 24 * 9, 500))
    events = [("hot" if i % 2 else f"s{i % 23}", f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00", ("occupied", "unoccupied", None)[i % 3])
              for i, h in enumerate(hours.tolist())]
    events += [("hot", events[-1][1], "tied")]
    spaces = [(f"s{i}", f"1.{i:03d}") for i in range(20)] + [("hot", "1.100"), ("hot", "1.101")]
    return site.usage(events, spaces)


@pytest.mark.parametrize("age", [None, Window(days=3)])
@pytest.mark.parametrize("until", ["2024-01-05 12:00:00", "2024-01-09 23:00:00", "2023-01-01 00:00:00"])
def test_stored_states_change_nothing(spark, model, tmp_path, until, age):
    states = latest.newest_events(model.events.where(f"ts <= timestamp_ntz'{until}'"))
    states.write.parquet(str(tmp_path / "states"))
    stored = spark.read.parquet(str(tmp_path / "states"))
    assert sorted(rows(latest.latest_states(model.with_states(stored), age)), key=repr) == sorted(rows(latest.latest_states(model, age)), key=repr)
    every = sorted(rows(latest.newest_events(model.events)), key=repr)
    assert sorted(rows(latest.refreshed(stored, model.events)), key=repr) == every


def test_only_the_tail_is_read(spark, model, tmp_path):
    store.write_events(model.events, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    states = spark.createDataFrame([("s1", "occupied", at("2024-01-08 00:00:00"), at("2024-01-08 00:00:00"), 1)],
                                   "space_id string, occupancy string, event_time timestamp_ntz, ts timestamp_ntz, event_order bigint")
    found = latest.refreshed(states, log)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_ten_thousand_types_are_counted_not_listed(site):
    many = site.usage([], [(f"u{i}", "1.001", f"type {i:05d}") for i in range(10_000)])
    (context,) = rows(profile.category_context(many))[0]
    assert context.endswith("type 00049 (10000 in all)") and len(context) < 1000
    (row,) = profile.data_profile(many, many.events, many.events).collect()
    assert row["space_types"].endswith("type 00049 (10000 in all)")
    few = site.usage([], [(f"u{i}", "1.001", f"type {i}") for i in range(3)])
    assert rows(profile.category_context(few))[0][0].endswith("Space types: type 0, type 1, type 2")
