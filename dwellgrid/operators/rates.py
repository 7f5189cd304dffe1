"""Observed rates.

Three different measures, kept apart:

* event rate: share of events in the state ``occupied``;
* floor rate: share of *observed* hours in which any space of the floor was occupied;
* room rate: mean over *observed* space-hours of "any occupied event in that hour".

The dense rate, where missing hours count as zero, lives in :mod:`dwellgrid.operators.dense`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.clock import Window, trailing, whole, window_start
from dwellgrid.functions.floors import floor_token, on_floor
from dwellgrid.functions.measures import occupied, percent
from dwellgrid.operators.hourly import ANY_OCCUPIED, EVENT_SHARE, hourly_counts, space_hours
from dwellgrid.usage import Usage

# Mean of "any occupied event" over grouped buckets, as SQL.
RATE = f"avg({ANY_OCCUPIED})"


def on_floor_only(usage: Usage, floor: int | str | None, source: str = "storey") -> Usage:
    """Model restricted to the spaces of one floor; None keeps all."""
    return usage if floor is None else usage.with_spaces(usage.spaces.where(on_floor(floor, source)))


def with_every_floor(usage: Usage, hours: DataFrame) -> DataFrame:
    """Floor-hour counts plus a row without counts per space, so that a later aggregate sees silent floors too.

    Aggregates skip the NULLs; this replaces an outer join with the list of floors.
    """
    blank = [F.expr(f"CAST(NULL AS BIGINT) AS {c}") for c in hours.columns if c not in ("floor", "hour")]
    return hours.drop("hour").unionByName(usage.spaces.select(F.expr("floor_n AS floor"), *blank))


def in_floor_order(rates: DataFrame) -> DataFrame:
    """One row per floor is a short report: it is sorted in a single task instead of by a range exchange."""
    return rates.repartition(1).sortWithinPartitions(F.asc_nulls_last("floor"))


def _floor_hours(usage: Usage, days: int, hours: int | None = None) -> DataFrame:
    return hourly_counts(usage, ["floor_n"], trailing(days, hours)).withColumnRenamed("floor_n", "floor")


def utilization_by_floor(usage: Usage, days: int = 7, fill_missing_with_zero: bool = False,
                         hours: int | None = None) -> DataFrame:
    """Floor rate in percent for every floor of the dimension, sorted by floor; ``hours`` replaces ``days``.

    A floor without events in the window has NULL, or 0 with ``fill_missing_with_zero``.
    """
    rate = f"coalesce({RATE}, 0.0D)" if fill_missing_with_zero else RATE
    rated = with_every_floor(usage, _floor_hours(usage, days, hours)).groupBy("floor")
    return in_floor_order(rated.agg(percent(rate).alias("occ_rate_percent")))


def utilization_by_floor_windows(usage: Usage, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Floor rates of several trailing windows side by side (``occ_rate_percent_7d`` ...), one pass over the log.

    The log is read for the longest window; each shorter one is a condition inside the same aggregate, including its
    partial first hour.  Every floor is present; a floor silent in a window has NULL there.
    """
    spans = sorted({whole(d, "days") for d in days})
    counts = {}
    for span in spans:
        inside = F.col("ts") >= window_start(usage.events, Window(days=span), usage.at)
        counts[f"events_{span}"] = inside.cast("int")
        counts[f"occupied_{span}"] = F.when(inside, occupied()).otherwise(0)
    hours = hourly_counts(usage, ["floor_n"], Window(days=spans[-1]), counts).withColumnRenamed("floor_n", "floor")
    return in_floor_order(
        with_every_floor(usage, hours)
        .groupBy("floor")
        .agg(
            *[
                percent(f"avg(CASE WHEN events_{s} > 0 THEN CAST(occupied_{s} > 0 AS INT) END)")
                .alias(f"occ_rate_percent_{s}d")
                for s in spans
            ]
        )
    )


def utilization_floor(usage: Usage, floor: int | str, days: int = 7, hours: int | None = None) -> DataFrame:
    """One row: spaces with events in the window and their room rate in percent (0 when there are none)."""
    per_space = space_hours(on_floor_only(usage, floor), trailing(days, hours))
    return per_space.agg(
        F.expr("count(*) AS total_rooms"),
        percent("coalesce(sum(occupied_hours) / sum(hours), 0.0D)").alias("avg_utilization_percent"),
    )


def compare_floors(usage: Usage, floor_a: int | str, floor_b: int | str, days: int = 7,
                   hours: int | None = None) -> DataFrame:
    """Floor rates of two floors, as given and in the given order; a floor without events has 0.

    Both arguments may name the same floor.
    """
    asked = [str(floor_a), str(floor_b)]
    sides = F.array_compact(F.array(*[F.when(on_floor(f), F.lit(i)) for i, f in enumerate(asked)]))
    tagged = usage.with_spaces(usage.spaces.withColumn("side", F.explode(sides)))
    found = hourly_counts(tagged, ["side"], trailing(days, hours))
    # a global aggregate has a row even when nothing matched, and with it both floors
    rates = found.agg(
        *[percent(f"coalesce(avg(CASE WHEN side = {i} THEN {ANY_OCCUPIED} END), 0.0D)").alias(f"r{i}") for i in (0, 1)]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("floor"), F.col(f"r{i}").alias("rate")) for i, f in enumerate(asked)])
    return rates.select(F.inline(pairs)).withColumnRenamed("rate", "occ_rate_percent")


def compare_floors_strict(usage: Usage, floors: list[int], days: int = 7, hours: int | None = None) -> DataFrame:
    """Floor rates of the listed floors by the code's floor number; floors without events are absent."""
    wanted = [whole(int(f), "floor", minimum=-10_000) for f in floors]
    scoped = usage.with_spaces(usage.spaces.where(F.col("floor_n").isin(*wanted)))
    rated = _floor_hours(scoped, days, hours).groupBy("floor").agg(percent(RATE).alias("occ_rate_percent"))
    return in_floor_order(rated)


def busiest_rooms(usage: Usage, floor: int | str | None = None, days: int = 7, limit: int = 5,
                  hours: int | None = None) -> DataFrame:
    """Spaces with the highest room rate; equal rounded rates are ordered by room name, then by space."""
    scoped = on_floor_only(usage, floor)
    rated = space_hours(scoped, trailing(days, hours))
    return (
        rated.select("space_id", percent("occupied_hours / hours").alias("occ_rate_percent"))
        .join(scoped.dimension("room_name"), "space_id")
        .distinct()
        .orderBy(F.desc_nulls_last("occ_rate_percent"), "room_name", "space_id")
        .limit(whole(limit, "limit"))
        .select("room_name", "occ_rate_percent")
    )


def peak_hours(usage: Usage, floor: int | str, top: int = 5, rounded: bool = False) -> DataFrame:
    """Calendar hours with the highest event rate on a floor over the whole history; earlier hours win ties.

    Gives ``occ_rate`` as a share, or with ``rounded`` the code-floor variant ``occ_rate_percent``, which ranks on
    the rounded value.
    """
    if rounded:
        number = floor_token(floor)
        if number is None:
            raise ValueError(f"floor must be an integer, got {floor!r}")
        scoped, value = on_floor_only(usage, number, "code"), percent(EVENT_SHARE).alias("occ_rate_percent")
    else:
        scoped, value = on_floor_only(usage, floor), F.expr(EVENT_SHARE).alias("occ_rate")
    rated = hourly_counts(scoped, []).groupBy("hour").agg(value)
    return rated.orderBy(F.desc_nulls_last(rated.columns[-1]), "hour").limit(whole(top, "top"))


def kpis(usage: Usage, window_hours: int = 24) -> DataFrame:
    """One row over the last hours (start exclusive): spaces seen, event rate, and event rates of 9-12 and 13-16 h.

    A rate without events is NULL.
    """
    window = Window(hours=whole(window_hours, "window_hours"), open_start=True)
    parts = {"": "", "am_": " FILTER (WHERE hour(hour) BETWEEN 9 AND 12)",
             "pm_": " FILTER (WHERE hour(hour) BETWEEN 13 AND 16)"}
    sums = [F.expr(f"sum({c}){of} AS {p}{c}") for p, of in parts.items() for c in ("n_events", "n_occupied")]
    per_space = hourly_counts(usage, ["space_id"], window).groupBy("space_id").agg(*sums)
    return per_space.agg(
        F.expr("count(*) AS rooms_covered"),
        *[
            F.expr(f"sum({p}n_occupied) / sum({p}n_events) AS {name}")
            for p, name in (("", "avg_occ"), ("am_", "am_peak"), ("pm_", "pm_peak"))
        ],
        F.lit(window_hours).alias("window_hours"),
    )
