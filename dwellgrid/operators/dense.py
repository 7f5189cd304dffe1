"""Dense rates and series: every hour of the window counts, an hour without events is 0.

The window runs over wall-clock hours from the hour of its start to the hour of the anchor, both included, which is
``24 * days + 1`` buckets.  Because a missing hour adds nothing to a sum, the rate needs no grid: it is the number of
occupied room-hours over the number of possible ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions import clock
from dwellgrid.functions.clock import Window, trailing, whole
from dwellgrid.functions.measures import OCCUPIED, percent
from dwellgrid.operators.rates import on_floor_only
from dwellgrid.usage import Usage


def hours_in_window(days: int, hours: int | None = None) -> int:
    """Wall-clock hour buckets touched by a trailing window of whole days, or of ``hours``."""
    return 1 + (24 * whole(days, "days") if hours is None else whole(hours, "hours", 1))


def _window_hours(usage: Usage, days: int, scoped: bool, hours: int | None = None) -> DataFrame:
    """Events of the window as ``space_id, hour, state`` on the wall clock, limited to the model's spaces if asked."""
    rows = clock.within(clock.wall_clock(usage.events), trailing(days, hours), usage.at)
    rows = rows.selectExpr("space_id", f"{clock.hour(rows)} AS hour", f"{OCCUPIED} AS state")
    if scoped and usage.broadcast_spaces:
        rows = rows.join(usage.dimension(), "space_id", "left_semi")
    return rows


def dense_rates(usage: Usage, floor: int | str | None = None, days: int = 30, hours: int | None = None) -> DataFrame:
    """``code, room_name, occ_rate``: share of occupied hours over all hours of all sensor spaces of a room.

    Rooms without any event are present with 0.  Occupied hours are deduplicated per space first; rooms and hours
    then meet in one aggregate per room, without a grid and without an outer join.
    """
    scoped = on_floor_only(usage, floor)
    found = _window_hours(scoped, days, floor is not None, hours).where("state = 1").select("space_id", "hour").distinct()
    if usage.broadcast_spaces:
        found = found.selectExpr("space_id", "1L AS occupied_hours")
    else:
        found = found.groupBy("space_id").agg(F.expr("count(*) AS occupied_hours"))
    found = found.join(scoped.dimension("code", "room_name"), "space_id")
    listed = scoped.spaces.selectExpr("code", "room_name", "1 AS spaces", "0L AS occupied_hours")
    return (
        listed.unionByName(found.selectExpr("code", "room_name", "0 AS spaces", "occupied_hours"))
        .groupBy("code", "room_name")
        .agg(F.expr(f"sum(occupied_hours) / (sum(spaces) * {hours_in_window(days, hours)}) AS occ_rate"))
    )


def underused_rooms(usage: Usage, floor: int | str | None = None, days: int = 30, threshold: float | None = 0.10,
                    limit: int | None = None, hours: int | None = None) -> DataFrame:
    """Rooms with a dense rate below the threshold, or, without a threshold, the ``limit`` least used ones.

    The threshold tests the unrounded rate.  Sorted by rounded rate, code and name.
    """
    rates = dense_rates(usage, floor, days, hours)
    if threshold is not None:
        rates = rates.where(F.col("occ_rate") < F.lit(float(threshold)))
    listed = rates.select("code", "room_name", percent("occ_rate").alias("occ_rate_percent")).orderBy(
        F.asc_nulls_last("occ_rate_percent"), "code", "room_name"
    )
    return listed if threshold is not None or limit is None else listed.limit(whole(limit, "limit"))


def all_rooms_with_occ_rate(usage: Usage, floor: int | str | None = None, days: int = 30,
                            hours: int | None = None) -> DataFrame:
    """Every room with its dense rate in percent, busiest first, then by code and name."""
    return (
        dense_rates(usage, floor, days, hours)
        .select("code", "room_name", percent("occ_rate").alias("occ_rate_percent"))
        .orderBy(F.desc_nulls_last("occ_rate_percent"), "code", "room_name")
    )


def dense_hourly_series(usage: Usage, floor: int | str | None = None, days: int = 30) -> DataFrame:
    """``space_id, code, room_name, hour, occ``: one row per listed space and hour of the window.

    Only observed hours are shuffled.  Each space also contributes one marker before the first hour; ``lead`` then
    tells every row how long its gap is, and the zero hours are generated in place.
    """
    scoped = on_floor_only(usage, floor)
    n = hours_in_window(days)
    first = clock.window_start(
        clock.wall_clock(usage.events), Window(days=days), usage.at, "CAST(date_trunc('hour', {}) AS timestamp_ntz)"
    )
    identity = ["space_id", "code", "room_name"]
    listed = scoped.spaces.selectExpr("uuid AS space_id", "code", "room_name").distinct()
    observed = (
        _window_hours(scoped, days, floor is not None)
        .groupBy("space_id", "hour")
        .agg(F.expr("max(state) AS occ"))
        .join(F.broadcast(listed) if usage.broadcast_spaces else listed, "space_id")
        .select(*identity, F.timestamp_diff("HOUR", first, F.col("hour")).cast("int").alias("i"), "occ")
    )
    markers = listed.selectExpr("*", "-1 AS i", "0 AS occ")
    upcoming = F.lead("i", 1, n).over(W.partitionBy(*identity).orderBy("i"))
    gaps = markers.unionByName(observed).withColumn("until", upcoming).where("greatest(i, 0) < until")
    filled = gaps.selectExpr(*identity, "i", "occ", "explode(sequence(greatest(i, 0), until - 1)) AS j")
    return filled.select(
        *identity,
        F.timestamp_add("HOUR", "j", first).cast("timestamp_ntz").alias("hour"),
        F.expr("if(i = j, occ, 0) AS occ"),
    )


def unaligned_rates(usage: Usage, floor: int | str | None = None, days: int = 30) -> DataFrame:
    """Parity switch: rates on a grid whose ticks start at the raw window start instead of its hour.

    Ticks then carry the anchor's minutes and meet an observed (truncated) hour only if the anchor is exactly on the
    hour; otherwise every room has 0.
    """
    on_the_hour = clock.window_start(
        clock.wall_clock(usage.events), Window(days=days), usage.at, "date_trunc('hour', {}) = {}"
    )
    return dense_rates(usage, floor, days).withColumn(
        "occ_rate", F.when(on_the_hour, F.col("occ_rate")).otherwise(F.lit(0.0))
    )
