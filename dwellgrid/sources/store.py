"""Stored layouts: the event log and its hourly roll-up by date, and the chunk vector table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.functions import clock
from dwellgrid.functions.measures import OCCUPIED
from dwellgrid.schema import COLLECTION


def _utc_date(events: DataFrame):
    """UTC date of ``ts``; times without zone are taken as UTC."""
    if events.schema["ts"].dataType.simpleString() == "timestamp_ntz":
        return F.to_date("ts")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")).cast("date")


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Canonical events as Parquet, one folder per UTC date.

    The rebalance hint lets adaptive execution split a busy date over several writers and join quiet ones.
    """
    dated = events.withColumn("event_date", _utc_date(events)).hint("rebalance", "event_date")
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def hourly_rollup(events: DataFrame) -> DataFrame:
    """``space_id, hour, n_events, n_occupied, event_date``: counts per space and calendar hour of the session zone."""
    return (
        events.selectExpr("space_id", f"{clock.hour(events)} AS hour", f"{OCCUPIED} AS flag")
        .groupBy("space_id", "hour")
        .agg(F.expr("count(*) AS n_events"), F.expr("sum(flag) AS n_occupied"))
        .withColumn("event_date", F.to_date("hour"))
    )


def write_rollup(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the roll-up by date, with the session zone it was built in; rates over zoned times check the zone."""
    rollup = hourly_rollup(events).withColumn("zone", F.current_timezone())
    rollup.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def rollup_gaps(events: DataFrame, rollup: DataFrame) -> DataFrame:
    """``space_id, hour, log_events, rollup_events`` where a roll-up lacks events of the log in hours it has closed.

    These are events that reached the log after a stream had closed their hour; none of them is lost.  Rebuild the dates
    named here with :func:`write_rollup`.
    """
    last = rollup.agg(F.max("hour")).scalar()
    theirs = rollup.selectExpr("space_id", "hour", "0L AS log_events", "n_events AS rollup_events")
    ours = hourly_rollup(events).selectExpr("space_id", "hour", "n_events AS log_events", "0L AS rollup_events")
    both = ours.unionByName(theirs).where(F.col("hour") < last).groupBy("space_id", "hour")
    sums = both.agg(F.sum("log_events").alias("log_events"), F.sum("rollup_events").alias("rollup_events"))
    return sums.where("log_events <> rollup_events")


def vector_path(folder: str, collection: str = COLLECTION) -> str:
    return f"{folder.rstrip('/')}/{collection}"


def save_vectors(vectors: DataFrame, folder: str, collection: str = COLLECTION, replace: bool = False) -> None:
    """Write one collection of chunk vectors; an existing one is replaced only on request."""
    vectors.write.mode("overwrite" if replace else "errorifexists").parquet(vector_path(folder, collection))


def load_vectors(spark: SparkSession, folder: str, build: Callable[[], DataFrame], collection: str = COLLECTION,
                 rebuild: bool = False) -> DataFrame:
    """The stored collection; built and stored first where nothing lies under its path or a rebuild is asked for.

    A path that holds something else, or files that cannot be read, raise: nothing is overwritten unasked.  A rebuild is
    written beside the collection before it replaces it, as building may read the old one.
    """
    path = vector_path(folder, collection)
    if rebuild:
        save_vectors(build(), folder, f"{collection}-next", replace=True)
        save_vectors(spark.read.parquet(f"{path}-next"), folder, collection, replace=True)
    elif not _exists(spark, path):
        save_vectors(build(), folder, collection)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies under a path, in whatever store."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True
