from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from dwellgrid.operators import rates
from dwellgrid.sources import sample_tables, store
from dwellgrid.streaming import incremental
from dwellgrid.usage import Usage


COLUMNS = ["space_id", "hour", "n_events", "n_occupied"]


def test_streamed_rollup_equals_batch_for_closed_hours(spark, tmp_path):
    events = sample_tables.usage(spark, "/root/testdata/sf0.001").events
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    events.repartition(3).write.parquet(log)

    def run():
        stream = incremental.hourly_rollup(incremental.read_event_stream(spark, log))
        incremental.append_rollup(stream, out, checkpoint).awaitTermination()
        return sorted(rows(spark.read.parquet(out).select(*COLUMNS)))

    newest = events.agg(F.max("ts")).first()[0]
    open_from = (newest - dt.timedelta(minutes=30)).replace(minute=0, second=0, microsecond=0)
    batch = sorted(rows(store.hourly_rollup(events).select(*COLUMNS)))
    first = run()
    assert first == [r for r in batch if r[1] < open_from] and len(first) > 900
    # nothing new: nothing changes
    assert run() == first
    # later events close the remaining hours, and the roll-up continues where it stopped
    later = events.limit(1).withColumn("ts", F.lit(newest + dt.timedelta(days=1)).cast("timestamp_ntz"))
    later.write.mode("append").parquet(log)
    assert run() == batch


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "Europe/Amsterdam"])
def test_rates_over_a_streamed_rollup(spark, site, tmp_path, kind, zone):
    """The open hours come from the log; hours are those of the batch side, also across a clock change."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        first = dt.datetime(2025, 3, 28, 22, 5)
        log = [(f"s{i % 7}", str(first + dt.timedelta(minutes=13 * i)), ("occupied", "unoccupied")[i % 3 == 0])
               for i in range(400)]
        events = site.events(log).withColumn("ts", F.col("ts").cast(kind))
        path, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
        events.repartition(2).write.parquet(path)
        stream = incremental.hourly_rollup(incremental.read_event_stream(spark, path))
        incremental.append_rollup(stream, out, checkpoint).awaitTermination()
        streamed = spark.read.parquet(out)
        batch = store.hourly_rollup(events)
        closed = streamed.agg(F.max("hour")).first()[0]
        until = F.lit(str(closed)).cast(kind) if kind == "timestamp_ntz" else F.lit(closed)
        assert sorted(rows(streamed.select(*COLUMNS))) == sorted(rows(batch.where(F.col("hour") <= until).select(*COLUMNS)))
        assert streamed.count() < batch.count()
        usage = Usage.of(events, site.spaces([(f"s{i}", f"{i % 3}.{i} R") for i in range(7)]))
        with_stream = usage.with_rollup(streamed)
        for query in (
            lambda u: rates.kpis(u, 24), lambda u: rates.utilization_by_floor(u, 2),
            lambda u: rates.busiest_rooms(u, days=1, limit=9), lambda u: rates.peak_hours(u, 1, 9),
            lambda u: rates.busiest_rooms(u, hours=1, limit=9),
        ):
            assert rows(query(with_stream)) == rows(query(usage))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_late_events_are_found(spark, site):
    on_time = [("a", "2025-03-10 10:00", "occupied"), ("a", "2025-03-10 12:00", "occupied")]
    rollup = store.hourly_rollup(site.events(on_time))
    late = site.events([*on_time, ("a", "2025-03-10 10:30", "occupied"), ("b", "2025-03-10 11:00", "occupied")])
    found = sorted(rows(store.rollup_gaps(late, rollup)))
    assert [(r[0], r[2], r[3]) for r in found] == [("a", 2, 1), ("b", 1, 0)]


def test_streamed_latest_state(spark, tmp_path):
    events = sample_tables.usage(spark, "/root/testdata/sf0.001").events
    log = str(tmp_path / "log")
    events.repartition(4).write.parquet(log)
    stream = incremental.latest_states(incremental.read_event_stream(spark, log, 2))
    query = (
        stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = {r["space_id"]: (r["ts"], r["occupancy"]) for r in spark.table("latest").collect()}
    newest = {}
    for r in events.collect():
        key = (r["ts"], r["event_order"])
        if r["space_id"] not in newest or key > newest[r["space_id"]][0]:
            newest[r["space_id"]] = (key, r["occupancy"])
    assert found == {s: (k[0], o) for s, (k, o) in newest.items()}
