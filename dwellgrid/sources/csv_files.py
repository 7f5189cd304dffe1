"""CSV folder of one building: two event logs and the space dimension, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid import schema


def read_csv(spark: SparkSession, path: str, columns: T.StructType, corrupt_column: str | None = None) -> DataFrame:
    """Header CSV under an explicit schema.

    The header must name the schema's columns; quotes inside quoted values are doubled.  Values that do not parse become NULL; with ``corrupt_column`` the
    offending line is kept in that column.
    """
    wanted = columns.add(corrupt_column, T.StringType()) if corrupt_column else columns
    reader = spark.read.schema(wanted).option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    if corrupt_column:
        return reader.option("columnNameOfCorruptRecord", corrupt_column).csv(path)
    return reader.option("enforceSchema", False).csv(path)


def parse_lines(lines: DataFrame, columns: T.StructType) -> DataFrame:
    """The column ``line`` of CSV text under an explicit schema, by the rules of :func:`read_csv`."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    parsed = F.from_csv("line", ddl, {"mode": "PERMISSIVE", "escape": '"'})
    return lines.select(parsed.alias("row")).select("row.*")


def _one_log(spark: SparkSession, folder: str, pattern: str, building: str) -> DataFrame:
    """The log whose file name begins with ``building``; several such files are logs of several buildings."""
    path = f"{folder.rstrip('/')}/{building}{pattern}"
    found = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"{path} names several logs, among them {found}; say which building is meant")
    return read_csv(spark, path, schema.EVENT_SCHEMA)


def read_office_events(spark: SparkSession, folder: str, building: str = "") -> DataFrame:
    return _one_log(spark, folder, schema.OFFICE_FILE, building)


def read_meeting_events(spark: SparkSession, folder: str, building: str = "") -> DataFrame:
    return _one_log(spark, folder, schema.MEETING_FILE, building)


def read_spaces(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, f"{folder.rstrip('/')}/{schema.SPACE_FILE}", schema.SPACE_SCHEMA)


def canonical_events(events: DataFrame) -> DataFrame:
    """Building events in canonical form: ``ts`` from the epoch milliseconds, arrival as tie-breaker."""
    return events.select(
        "space_id",
        F.timestamp_millis("event_timestamp").alias("ts"),
        "occupancy",
        "event_time",
        F.unix_micros(F.col("arrival_time").cast("timestamp")).alias("event_order"),
    )
