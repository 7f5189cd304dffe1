"""Union and time enrichment of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import clock


def union_events(office: DataFrame, meeting: DataFrame) -> DataFrame:
    """Both logs, matched by column name; a column only one of them has is NULL for the other."""
    return office.unionByName(meeting, allowMissingColumns=True)


def enrich_events(events: DataFrame) -> DataFrame:
    """Adds ``ts`` (from ``event_timestamp`` unless present), ``hour`` and ``day``.

    Buckets follow the session time zone, so a building's local days need that zone in the session.
    """
    timed = events if "ts" in events.columns else events.withColumn("ts", F.timestamp_millis("event_timestamp"))
    return timed.withColumns({unit: F.expr(clock.bucket(timed, unit)) for unit in ("hour", "day")})
