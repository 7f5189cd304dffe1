"""Latest states with a clock: a space without events for some hours turns stale and its state is dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dwellgrid.functions.clock import whole
from dwellgrid.streaming.incremental import LATENESS

# Timers and dropped state need the RocksDB state store.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALE = "stale"
# Stored changes of a log without zone.
CHANGES = "space_id string, state string, ts timestamp_ntz, event_order long"


def _newest_of_batch():
    """Newest row per space of an Arrow batch, so that a busy space sends one row per batch through the shuffle."""

    def newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(["at", "event_order"]).drop_duplicates("space_id", keep="last")

    return newest


def _processor(stale_ms: int) -> StatefulProcessor:
    """Keeps the newest event per space; defined in a function, so that executors need no copy of this package."""

    class Clocked(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getValueState("newest", "at long, event_order long, occupancy string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            import pandas as pd

            known = self.newest.get() if self.newest.exists() else None
            best = known = tuple(known) if known is not None else None
            for part in rows:
                if part.empty:
                    continue
                top = part.sort_values(["at", "event_order"]).iloc[-1]
                state = None if pd.isna(top["occupancy"]) else str(top["occupancy"])
                found = (int(top["at"]), int(top["event_order"]), state)
                if best is None or found[:2] > best[:2]:
                    best = found
            if best == known:
                return
            if known is not None:
                self.handle.deleteTimer(known[0] // 1000 + stale_ms)
            # a moment that the watermark has passed already would never come
            due = max(best[0] // 1000 + stale_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.newest.update(best)
            yield pd.DataFrame({"space_id": [key[0]], "state": [best[2]], "at": [best[0]], "event_order": [best[1]]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            import pandas as pd

            if not self.newest.exists():
                return
            at, order, _ = self.newest.get()
            if at // 1000 + stale_ms > timerValues.getCurrentWatermarkInMs():
                return  # a newer event has come; its own timer follows
            self.newest.clear()
            yield pd.DataFrame({"space_id": [key[0]], "state": [STALE], "at": [at], "event_order": [order]})

        def close(self) -> None:
            pass

    return Clocked()


def clocked_states(events: DataFrame, stale_after_hours: int = 12, lateness: str = LATENESS) -> DataFrame:
    """Changes of the latest states as a stream: ``space_id, state, ts, event_order``.

    ``state`` is the occupancy of a space's newest event, at its ``ts``; when the watermark (the newest event of all less
    ``lateness``) has passed that moment by ``stale_after_hours``, one row with the state ``stale`` follows, with the
    moment of the last event, and the space leaves the state store.  So the store holds the spaces of the last hours only,
    however many there ever were.  A later event revives the space.  Of one space's rows the last written holds.

    Defined cases: events without space or time are left out.  Events before the watermark are dropped.  Of events at one
    moment the largest ``event_order`` counts, a missing one is the smallest.  A NULL occupancy is a state like any other.
    An event older than the known one changes nothing.  The session must use the RocksDB state store
    (:func:`use_rocksdb`).
    """
    local = events.schema["ts"].dataType.simpleString() == "timestamp_ntz"
    # watermarks need a zoned time: for one without zone, the moment that reads the same in UTC
    moment = F.expr("CAST(concat(CAST(ts AS STRING), 'Z') AS TIMESTAMP)") if local else F.col("ts")
    order = F.coalesce(F.col("event_order").cast("long"), F.lit(-(2**63)))
    rows = events.where("space_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("space_id").cast("string").alias("space_id"), F.unix_micros(moment).alias("at"),
        order.alias("event_order"), "occupancy",
    )
    thinned = rows.mapInPandas(_newest_of_batch(), "space_id string, at long, event_order long, occupancy string")
    marked = thinned.withColumn("moment", F.timestamp_micros("at")).withWatermark("moment", lateness)
    states = marked.groupBy("space_id").transformWithStateInPandas(
        _processor(whole(stale_after_hours, "stale_after_hours") * 3_600_000),
        "space_id string, state string, at long, event_order long",
        "Update",
        "EventTime",
    )
    ts = F.timestamp_micros("at")
    if local:
        ts = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(at AS DECIMAL(20, 0)) / 1000000)")
    return states.select("space_id", "state", ts.alias("ts"), F.nullif("event_order", F.lit(-(2**63))).alias("event_order"))


def use_rocksdb(spark: SparkSession) -> None:
    """Choose the state store that timers need, for the streams that this session starts from now on."""
    spark.conf.set(STORE_SETTING, STORE)


def append_states(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available and append the changes, with the number of their batch, as Parquet.

    A batch that is run again after a failure replaces its own folder, so every change is there once.  ``checkpoint`` must
    be on storage that all executors reach.
    """

    def store(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return query.foreachBatch(store).trigger(availableNow=True).start()


def current_states(changes: DataFrame) -> DataFrame:
    """The last change of every space in the stored changes (columns of ``clocked_states`` and ``batch``)."""
    newest = F.max_by(F.struct("state", "ts", "event_order"), F.struct("batch", "ts", F.col("state") == STALE))
    return changes.groupBy("space_id").agg(newest.alias("newest")).select("space_id", "newest.*")
