"""Time anchor, trailing windows and calendar buckets.

The anchor of every trailing window is the newest timestamp in the log, not the wall clock.  It enters a plan as a
scalar subquery with the interval arithmetic *inside*, so that the file scan receives a plain comparison which it
can push into row-group statistics and, on a date-partitioned log, into partition pruning.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(value, name: str, minimum: int = 0) -> int:
    """Validate an integer argument; strings, fractions and too small values are refused."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an int, got {value!r}")
    if value < minimum:
        raise ValueError(f"{name} must be at least {minimum}, got {value}")
    return value


@dataclass(frozen=True)
class Window:
    """A trailing window ending at the anchor.

    Its length is calendar days plus absolute hours, which differ across a clock change.  ``open_start`` makes the
    start exclusive; the end is always inclusive.
    """

    days: int = 0
    hours: int = 0
    open_start: bool = False

    def __post_init__(self):
        whole(self.days, "days")
        whole(self.hours, "hours")

    def before(self, moment: str) -> str:
        """SQL for the start of the window that ends at ``moment``."""
        return f"({moment} - make_interval(0, 0, 0, {self.days}, {self.hours}))"


def trailing(days: int, hours: int | None = None) -> Window:
    """The window of the last ``hours`` where they are given, else of the last ``days``."""
    return Window(days=days) if hours is None else Window(hours=whole(hours, "hours", 1))


def _kind(events: DataFrame) -> str:
    return events.schema["ts"].dataType.simpleString()


def literal(events: DataFrame, at: dt.datetime) -> str:
    """A given moment as SQL, in the type of the log's ``ts``."""
    return f"CAST('{at.isoformat(sep=' ')}' AS {_kind(events)})"


def _newest_partition(events: DataFrame) -> DataFrame:
    """Rows that can hold the newest timestamp: with an ``event_date`` partition column, the last date only."""
    if "event_date" in events.columns:
        newest = events.agg(F.max("event_date")).scalar()
        return events.where(F.col("event_date") >= newest)
    return events


def from_anchor(events: DataFrame, at: dt.datetime | None, value, newest: DataFrame | None = None) -> Column:
    """A value computed from the anchor; ``value`` maps the anchor's SQL to the SQL of the result.

    ``newest`` is a part of the log that is known to hold its newest event.
    """
    if at is not None:
        return F.expr(value(literal(events, at)))
    return _newest_partition(events if newest is None else newest).agg(F.expr(value("max(ts)")).alias("anchored")).scalar()


def window_start(events: DataFrame, window: Window, at: dt.datetime | None = None, then="{}",
                 newest: DataFrame | None = None) -> Column:
    """Start of a trailing window.  Day steps are calendar days of the session time zone.

    ``then`` is a SQL template that derives another value from the start inside the same subquery.
    """
    return from_anchor(events, at, lambda moment: then.replace("{}", window.before(moment)), newest)


def within(events: DataFrame, window: Window, at: dt.datetime | None = None,
           newest: DataFrame | None = None) -> DataFrame:
    """Events inside a trailing window.

    Without ``at`` the upper bound is the maximum itself and needs no test.  A date-partitioned log is pruned as well.
    """
    start, ts = window_start(events, window, at, newest=newest), F.col("ts")
    inside = ts > start if window.open_start else ts >= start
    if at is not None:
        inside &= F.expr(f"ts <= {literal(events, at)}")
    if "event_date" in events.columns:
        # event_date is the UTC date of ts; one day of slack covers any session time zone
        inside &= F.col("event_date") >= window_start(
            events, window, at, "date_sub(CAST({} AS DATE), 1)", newest
        )
    return events.where(inside)


@lru_cache(maxsize=64)
def minutes_past_the_hour(zone: str) -> int | None:
    """Minutes of UTC at which a zone's hours begin, or None where they changed since 1970 or the zone is unknown."""
    try:
        rules = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return None
    months = (dt.datetime(year, month, 1, tzinfo=rules) for year in range(1970, 2038) for month in range(1, 13))
    starts = {-moment.utcoffset().total_seconds() % 3600 for moment in months}
    return int(starts.pop() // 60) if len(starts) == 1 else None


def session_zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone")


def hour(events: DataFrame) -> str:
    """SQL for the calendar hour of ``ts``, in its own type; events without a time belong to no hour.

    A one-hour tumbling window is plain arithmetic on the stored value, several times cheaper than ``date_trunc``.  It
    starts on whole hours of the epoch, which are calendar hours for times without zone and in every session zone
    whose offsets are whole hours; other zones use ``date_trunc``.
    """
    if _kind(events) == "timestamp_ntz" or minutes_past_the_hour(session_zone(events)) == 0:
        return "window(ts, '1 hour').start"
    return bucket(events)


def bucket(events: DataFrame, unit: str = "hour") -> str:
    """SQL for the calendar bucket of ``ts``, in its own type (``date_trunc`` alone would widen a time without zone)."""
    return f"CAST(date_trunc('{unit}', ts) AS {_kind(events)})"


def wall_clock(events: DataFrame) -> DataFrame:
    """Log with ``ts`` as local wall-clock time (no zone); dense grids count wall-clock hours."""
    return events if _kind(events) == "timestamp_ntz" else events.withColumn("ts", F.expr("CAST(ts AS timestamp_ntz)"))
