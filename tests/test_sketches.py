"""Mergeable summaries against exact counts and quantiles."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from dwellgrid.operators import sketches
from dwellgrid.sources import sample_tables

MEDIUM = "/root/testdata/sf0.1"


def test_rank_error_of_merged_quantiles(spark, tmp_path):
    """Many values per day, few entries per sketch, stored and merged: the ranks stay within the stated error."""
    n, size = 200_000, 200
    log = spark.range(n).selectExpr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(id % 60 AS INT)) AS ts",
        "IF(id % 3 = 0, 7, CAST(abs(hash(id)) % 100000 AS BIGINT)) AS late",
    )
    daily = sketches.lateness_sketches(log.repartition(9), F.col("ts"), F.col("late"), "day", size)
    daily.write.parquet(str(tmp_path / "daily"))
    stored = spark.read.parquet(str(tmp_path / "daily"))
    assert stored.count() == 60 and stored.agg(F.max(F.octet_length("sketch"))).first()[0] < 32 * size
    merged = {r["bucket"].month: r for r in sketches.lateness_profile(stored, "month", (0.25, 0.5, 0.9), size).collect()}
    for month in (1, 2):
        values = np.sort([r[0] for r in log.where(F.month("ts") == month).select("late").collect()])
        found = merged[month]
        assert (found["n"], found["least"], found["most"]) == (len(values), values[0], values[-1])
        for share, name in ((0.25, "p25"), (0.5, "p50"), (0.9, "p90")):
            low, high = np.searchsorted(values, found[name], "left"), np.searchsorted(values, found[name], "right")
            assert low / len(values) - 0.03 <= share <= high / len(values) + 0.03


def test_small_sketches_are_exact_and_skip_nulls(spark):
    values = [("2024-01-01 00:00:00", 5), ("2024-01-01 01:00:00", -2), ("2024-01-31 00:00:00", 9), (None, 1),
              ("2024-01-02 00:00:00", None)]
    log = spark.createDataFrame(values, "t string, late int").selectExpr("CAST(t AS timestamp_ntz) AS ts", "late")
    daily = sketches.lateness_sketches(log, F.col("ts"), F.col("late"))
    assert [r[1:] for r in rows(sketches.lateness_profile(daily))] == [(3, -2, 9, 5, 9, 9)]
    assert rows(sketches.lateness_profile(sketches.lateness_sketches(log.where("false"), F.col("ts"), F.col("late")))) == []


def test_distinct_rooms(spark, site):
    events = [(f"r{i % 40}", f"2024-01-{1 + i % 14:02d} {i % 24:02d}:00:00", "occupied" if i % 5 else "unoccupied") for i in range(800)]
    events += [("r1", "2024-01-03 05:00:00", "occupied")] * 300
    spaces = [(f"r{i}", f"{i % 3}.{i:03d}") for i in range(38)]
    first, second = F.col("hour") < F.to_timestamp_ntz(F.lit("2024-01-08")), F.col("hour") >= F.to_timestamp_ntz(F.lit("2024-01-08"))
    expected = {}
    for floor in range(3):
        on = [{s for s, t, state in events if state == "occupied" and int(s[1:]) < 38 and int(s[1:]) % 3 == floor and half(t)}
              for half in (lambda t: t < "2024-01-08", lambda t: t >= "2024-01-08")]
        expected[floor] = (len(on[0]), len(on[1]), len(on[0] & on[1]))
    for limit in (1 << 25, 0):  # with and without a bounded dimension
        hourly = sketches.room_sketches(site.usage(events, spaces, broadcast_bytes=limit))
        found = sketches.distinct_rooms(hourly, ("floor_n",), {"a": first, "b": second})
        assert {r[0]: r[1:] for r in rows(found)} == expected
    none = sketches.distinct_rooms(hourly, ("floor_n",), {"a": first, "b": F.lit(False)})
    assert {r[2:] for r in rows(none)} == {(0, 0)}


@pytest.mark.parametrize("entries", [12, 8])
def test_error_of_the_estimate(spark, entries):
    model = sample_tables.usage(spark, MEDIUM)
    hourly = sketches.room_sketches(model, ("building_name",), entries)
    everything = {"used": F.lit(True)}
    found = {r[0]: r[1] for r in rows(sketches.distinct_rooms(hourly, ("building_name",), everything, "seen", entries))}
    exact = rows(model.events.join(model.dimension("building_name"), "space_id").groupBy("building_name").agg(F.count_distinct("space_id")))
    for name, n in exact:
        assert abs(found[name] - n) <= (0 if n <= 1 << entries else 4 * n / 2 ** (entries / 2))
