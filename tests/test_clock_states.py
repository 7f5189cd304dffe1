from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from dwellgrid.sources import sample_tables
from dwellgrid.streaming import clock_states, incremental


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(clock_states.STORE_SETTING)
    clock_states.use_rocksdb(spark)
    yield spark
    spark.conf.set(clock_states.STORE_SETTING, before)


class Log:
    """An event log that grows between runs of one stream."""

    def __init__(self, spark, site, folder, kind="timestamp_ntz"):
        self.spark, self.site, self.kind = spark, site, kind
        self.log, self.out, self.checkpoint = (str(folder / n) for n in ("log", "out", "checkpoint"))
        self.last = None

    def run(self, events):
        """Changes of this run alone."""
        frame = events if hasattr(events, "write") else self.site.events(events)
        frame = frame.withColumn("ts", F.col("ts").cast(self.kind))
        frame.coalesce(1).write.mode("append").parquet(self.log)
        stream = clock_states.clocked_states(incremental.read_event_stream(self.spark, self.log, 1), 2)
        query = clock_states.append_states(stream, self.out, self.checkpoint)
        query.awaitTermination()
        self.last = [p for p in query.recentProgress if p.get("stateOperators")]
        return self.spark.read.parquet(self.out)

    def states(self):
        changes = self.spark.read.parquet(self.out)
        return {r["space_id"]: (r["state"], str(r["ts"])[11:16]) for r in clock_states.current_states(changes).collect()}


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_late_stale_and_revived_spaces(rocksdb, site, tmp_path, kind):
    log = Log(rocksdb, site, tmp_path, kind)
    log.run([
        ("a", "2025-03-10 08:00", "occupied"), ("b", "2025-03-10 08:00", "occupied"), ("b", "2025-03-10 08:10", "unoccupied"),
        ("c", "2025-03-10 08:20", "occupied"), ("c", "2025-03-10 08:20", None), (None, "2025-03-10 08:20", "occupied"),
    ])
    assert log.states() == {"a": ("occupied", "08:00"), "b": ("unoccupied", "08:10"), "c": (None, "08:20")}
    # an older event within the lateness changes nothing; at 10:35 the watermark is 10:05, two hours after a's last event
    log.run([("b", "2025-03-10 08:05", "occupied"), ("d", "2025-03-10 10:35", "occupied")])
    assert log.states() == {
        "a": ("stale", "08:00"), "b": ("unoccupied", "08:10"), "c": (None, "08:20"), "d": ("occupied", "10:35"),
    }
    # b has an event in time, c turns stale, an event of a before the watermark is dropped
    log.run([("b", "2025-03-10 10:30", "occupied"), ("a", "2025-03-10 09:00", "occupied"), ("e", "2025-03-10 11:00", "occupied")])
    assert log.states() == {
        "a": ("stale", "08:00"), "b": ("occupied", "10:30"), "c": ("stale", "08:20"), "d": ("occupied", "10:35"),
        "e": ("occupied", "11:00"),
    }
    # a is revived; a day later all but the newest are stale, and each turned stale once per life
    log.run([("a", "2025-03-10 11:05", "unoccupied")])
    assert log.states()["a"] == ("unoccupied", "11:05")
    changes = log.run([("e", "2025-03-11 12:00", "unoccupied")])
    assert {s: v[0] for s, v in log.states().items()} == {
        "a": "stale", "b": "stale", "c": "stale", "d": "stale", "e": "unoccupied",
    }
    times = {r["space_id"]: r["n"] for r in changes.where("state = 'stale'").groupBy("space_id").agg(F.count("*").alias("n")).collect()}
    assert times == {"a": 2, "b": 1, "c": 1, "d": 1}


def test_state_rows_are_bounded(rocksdb, site, tmp_path):
    """Five hundred spaces, each heard of once: the store holds those of the last hours, not all."""
    log = Log(rocksdb, site, tmp_path)
    first = dt.datetime(2025, 3, 10)
    held = []
    for part in range(5):
        events = [(f"s{i}", str(first + dt.timedelta(minutes=6 * i)), "occupied") for i in range(100 * part, 100 * part + 100)]
        log.run(events)
        held.append(max(p["stateOperators"][0]["numRowsTotal"] for p in log.last[-1:]))
    states = log.states()
    assert len(states) == 500
    newest = first + dt.timedelta(minutes=6 * 499) - dt.timedelta(minutes=30)
    alive = sum(first + dt.timedelta(minutes=6 * i) + dt.timedelta(hours=2) > newest for i in range(500))
    assert sum(v[0] != "stale" for v in states.values()) == alive == 25
    # one value and one timer (kept by key and by time) for each space that lives
    assert held[-1] <= 4 * alive and held[-1] <= held[0] + 4, held


def test_states_of_the_sample_log(rocksdb, tmp_path):
    """Without late events the states that are not stale are the newest events of the last hours."""
    events = sample_tables.usage(rocksdb, "/root/testdata/sf0.001").events
    log, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    events.orderBy("ts").coalesce(1).write.parquet(log)
    stream = clock_states.clocked_states(incremental.read_event_stream(rocksdb, log), 24)
    clock_states.append_states(stream, out, checkpoint).awaitTermination()
    found = {r["space_id"]: r for r in clock_states.current_states(rocksdb.read.parquet(out)).collect()}
    newest = {}
    for r in events.collect():
        key = (r["ts"], r["event_order"])
        if r["space_id"] not in newest or key > newest[r["space_id"]][0]:
            newest[r["space_id"]] = (key, r["occupancy"])
    until = max(k for k, _ in newest.values())[0] - dt.timedelta(minutes=30, hours=24)
    assert {s: (r["state"], r["ts"], r["event_order"]) for s, r in found.items()} == {
        s: (o if key[0] > until else "stale", *key) for s, (key, o) in newest.items()
    }


def test_no_events(rocksdb, site, tmp_path):
    log = Log(rocksdb, site, tmp_path)
    events = site.events([("a", "2025-03-10 08:20", "occupied"), (None, "2025-03-10 08:20", "occupied")])
    log.run(events.withColumn("ts", F.when(F.col("space_id").isNull(), F.col("ts"))))
    assert rows(log.spark.read.parquet(log.out)) == []
