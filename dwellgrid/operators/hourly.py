"""Hourly roll-up of the event log: the table every observed rate derives from.

One event per row is the only large input.  It is reduced to counts per key and calendar hour, so a space that
produces a third of all events still contributes at most one row per hour and task to a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import clock
from dwellgrid.functions.measures import OCCUPIED
from dwellgrid.usage import Usage

# Counts per bucket as SQL over one event: all events, and events in the state ``occupied``.
COUNTS = {"n_events": "1", "n_occupied": OCCUPIED}

# SQL over buckets: 1 when a bucket holds an occupied event; share of occupied events over grouped buckets.
ANY_OCCUPIED = "CAST(n_occupied > 0 AS INT)"
EVENT_SHARE = "sum(n_occupied) / sum(n_events)"


def _from_log(events: DataFrame, counts: dict[str, str | Column]) -> DataFrame:
    values = [(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in counts.items()]
    return events.select("space_id", F.expr(clock.hour(events)).alias("hour"), *values)


def _from_rollup(usage: Usage, window: clock.Window | None) -> DataFrame:
    """Whole hours from the roll-up, plus log rows of the hours that the roll-up or the window leaves open.

    The roll-up's last hour may be unfinished, and a stream has not closed the hours after it: from that hour on the log
    counts.  Its tail also holds the newest event, so the anchor needs no pass over the whole log.  At the start of the
    window, and at a given end, the log fills the hour that the window cuts.
    """
    columns = ["space_id", "hour", *COUNTS]
    kind = usage.events.schema["ts"].dataType.simpleString()
    rollup = usage.rollup
    if "zone" in rollup.columns and kind != "timestamp_ntz":
        same = F.col("zone") == F.current_timezone()
        rollup = rollup.where(F.assert_true(same, "the roll-up was built in another time zone").isNull())
    open_from = rollup.agg(F.expr(f"coalesce(max(hour), CAST('0001-01-01' AS {kind}))").alias("open_from")).scalar()
    tail = usage.events.where(F.col("ts") >= open_from)
    if "event_date" in usage.events.columns:
        tail = tail.where(F.col("event_date") >= F.date_sub(open_from.cast("date"), 1))
    kept = rollup.where(F.col("hour") < open_from)
    if window is None:
        return kept.select(*columns).unionByName(_from_log(tail, COUNTS))
    cut = "date_trunc('hour', {})"
    following = f"{cut} + INTERVAL '1' HOUR"
    # an exclusive start always cuts its hour, an inclusive one only when it is not on the hour
    whole_hour = following if window.open_start else f"if({cut} = {{}}, {cut}, {following})"
    first_whole = clock.window_start(usage.events, window, usage.at, f"CAST({whole_hour} AS {kind})", tail)
    kept = kept.where(F.col("hour") >= first_whole)
    from_log = (F.col("ts") < first_whole) | (F.col("ts") >= open_from)
    if usage.at is not None:
        last = F.expr(f"CAST(date_trunc('hour', {clock.literal(usage.events, usage.at)}) AS {kind})")
        kept = kept.where(F.col("hour") < last)
        from_log = from_log | (F.col("ts") >= last)
    if "event_date" in kept.columns:
        first_day = clock.window_start(usage.events, window, usage.at, "date_sub(CAST({} AS DATE), 1)", tail)
        kept = kept.where(F.col("event_date") >= first_day)
    edges = clock.within(usage.events, window, usage.at, tail).where(from_log)
    return kept.select(*columns).unionByName(_from_log(edges, COUNTS))


def hourly_counts(usage: Usage, keys: list[str], window: clock.Window | None = None,
                  counts: dict[str, str | Column] | None = None) -> DataFrame:
    """Sums of ``counts`` per ``keys`` and ``hour``, over events that belong to a space of the model.

    ``keys`` are dimension columns; ``space_id`` stands for the space itself.  A space listed twice counts its events
    twice, as an inner join does.  With a bounded dimension the join comes first and the aggregate shuffles only its
    result; otherwise the log is reduced per space and hour before it meets the dimension.
    """
    if usage.rollup is not None and counts is None:
        rows, names = _from_rollup(usage, window), list(COUNTS)
    else:
        counts = counts or COUNTS
        events = usage.events if window is None else clock.within(usage.events, window, usage.at)
        rows, names = _from_log(events, counts), list(counts)
    sums = [F.expr(f"sum({n}) AS {n}") for n in names]
    if not usage.broadcast_spaces:
        rows = rows.groupBy("space_id", "hour").agg(*sums)
    return rows.join(usage.dimension(*keys), "space_id").groupBy(*keys, "hour").agg(*sums)


def space_hours(usage: Usage, window: clock.Window) -> DataFrame:
    """``space_id, occupied_hours, hours``: observed hours of every space with events in the window."""
    return (
        hourly_counts(usage, ["space_id"], window)
        .groupBy("space_id")
        .agg(F.expr(f"sum({ANY_OCCUPIED}) AS occupied_hours"), F.expr("count(*) AS hours"))
    )
