"""The hourly roll-up and the latest state, kept up to date from a stream of events.

The operators of this package are batch operators; these two spare them from re-reading the log.  There is no final
newest timestamp in a stream, so trailing windows stay with the batch side, which reads the stored roll-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dwellgrid.functions.clock import minutes_past_the_hour, session_zone
from dwellgrid.functions.measures import OCCUPIED

# Events may arrive about a quarter of an hour after they happened.
LATENESS = "30 minutes"


def read_event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of a stored event log as a stream; the schema is taken from the files already there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def hourly_rollup(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming counterpart of :func:`dwellgrid.sources.store.hourly_rollup`, same columns and ``zone``.

    A row is final once the watermark has passed its hour; state holds open hours only.  Events later than
    ``lateness`` stay in the log alone, where :func:`dwellgrid.sources.store.rollup_gaps` finds them.  Hours are those of
    the batch side: times without zone are counted as they stand, zoned ones from the minute at which the hours of the
    session zone begin.  A zone in which that minute has changed is refused.
    """
    if events.schema["ts"].dataType.simpleString() == "timestamp_ntz":
        # watermarks need a zoned time: the one that reads the same in UTC, which no clock change of the session zone enters
        epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        moment, first = F.expr("CAST(concat(CAST(ts AS STRING), 'Z') AS TIMESTAMP)"), 0
        hour = F.expr(f"{epoch} + make_dt_interval(0, CAST(unix_seconds(span.start) DIV 3600 AS INT))")
    else:
        moment, hour, first = F.col("ts"), F.col("span.start"), minutes_past_the_hour(session_zone(events))
        if first is None:
            raise ValueError(f"the hours of {session_zone(events)} have no fixed beginning")
    return (
        events.withColumn("moment", moment)
        .withWatermark("moment", lateness)
        .groupBy("space_id", F.window("moment", "1 hour", "1 hour", f"{first} minutes").alias("span"))
        .agg(F.expr("count(*) AS n_events"), F.expr(f"sum({OCCUPIED}) AS n_occupied"))
        .select("space_id", hour.alias("hour"), "n_events", "n_occupied")
        .withColumns({"event_date": F.to_date("hour"), "zone": F.current_timezone()})
    )


def latest_states(events: DataFrame) -> DataFrame:
    """Newest state per space; one row of state per space.  Write it in update mode and replace rows by key."""
    best = "max_by(struct(occupancy, event_time, ts, event_order), struct(ts, event_order)) AS newest"
    return events.groupBy("space_id").agg(F.expr(best)).select("space_id", "newest.*")


def append_rollup(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available and append closed hours to the stored roll-up, by date.

    ``checkpoint`` must be on storage that all executors reach; a restart continues where the last run stopped.
    """
    return (
        rollup.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("event_date")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
