"""Zone features and ranking of zones for a shared facility.

A zone is the first two characters of the room part of a code, per floor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.functions import codes
from dwellgrid.functions.clock import Window, whole
from dwellgrid.operators.hourly import space_hours
from dwellgrid.operators.rates import on_floor_only
from dwellgrid.schema import QUIET_WORDS, REFRESH_WORDS
from dwellgrid.usage import Usage

COUNT_MODES = ("rooms", "join_rows")

ZONE = ["floor", "zone"]

# Ordered text of the names of a group, as SQL.
NAME_LIST = "listagg(room_name, ', ') WITHIN GROUP (ORDER BY room_name) AS sample_rooms"


def _zoned(usage: Usage, quiet, refresh) -> Usage:
    """Model whose spaces carry ``floor, zone, quiet, refresh`` besides their name."""
    return usage.with_spaces(
        usage.spaces.select(
            "uuid",
            F.expr("floor_n AS floor"),
            codes.zone().alias("zone"),
            "room_name",
            codes.contains_any("spaceType", quiet).cast("int").alias("quiet"),
            codes.contains_any("spaceType", refresh).cast("int").alias("refresh"),
        )
    )


def _window(hours: int | None, days: int) -> Window:
    return Window(hours=whole(hours, "hours")) if hours else Window(days=whole(days, "days"))


def _facts(usage: Usage, floor: int | str | None, hours: int | None, days: int, count_mode: str, quiet,
           refresh) -> DataFrame:
    """Summable rows per zone and room name: ``people_hours, rooms, quiet, refresh``.

    One row per room and one per space with events.  Both kinds only ever meet in sums, so no room fans out over its
    hours and no outer join is needed; ``people_hours`` is NULL on room rows.
    """
    if count_mode not in COUNT_MODES:
        raise ValueError(f"count_mode must be one of {COUNT_MODES}")
    zoned = _zoned(on_floor_only(usage, floor), quiet, refresh)
    names = [*ZONE, "room_name"]
    room = ["space_id", *names, "quiet", "refresh"]
    listed = zoned.spaces.withColumnRenamed("uuid", "space_id").select(*room)
    active = space_hours(zoned, _window(hours, days)).join(zoned.dimension(*room), "space_id")
    if count_mode == "rooms":
        blank = "CAST(NULL AS BIGINT) AS people_hours"
        counted = listed.selectExpr(*names, blank, "1L AS rooms", "quiet", "refresh")
        return counted.unionByName(
            active.selectExpr(*names, "occupied_hours AS people_hours", "0L AS rooms", "0 AS quiet", "0 AS refresh")
        )
    per_room = (
        listed.selectExpr(*room, "CAST(NULL AS BIGINT) AS occupied_hours", "0L AS hours")
        .unionByName(active.select(*room, "occupied_hours", "hours"))
        .groupBy(*room)
        .agg(F.expr("sum(occupied_hours) AS people_hours"), F.expr("greatest(sum(hours), 1) AS rooms"))
    )
    return per_room.selectExpr(*names, "people_hours", "rooms", "quiet * rooms AS quiet", "refresh * rooms AS refresh")


_SUMS = [("people_hours", "people_hours"), ("rooms", "rooms_in_zone"), ("quiet", "quiet_cnt"), ("refresh", "refresh_cnt")]


def zone_measures(usage: Usage, floor: int | str | None = None, hours: int | None = None, days: int = 14,
                  count_mode: str = "rooms", quiet=QUIET_WORDS, refresh=REFRESH_WORDS) -> DataFrame:
    """Numeric features per floor and zone.

    ``people_hours`` sums the occupied space-hours of the window, NULL for a zone without events.  The counts are
    rooms of the zone; with ``count_mode="join_rows"`` a room counts once per hour in which it had events.
    """
    facts = _facts(usage, floor, hours, days, count_mode, quiet, refresh)
    return facts.groupBy(*ZONE).agg(*[F.expr(f"sum({c}) AS {n}") for c, n in _SUMS])


def zone_rooms(usage: Usage, floor: int | str | None = None) -> DataFrame:
    """Distinct ``floor, zone, room_name`` rows: the names behind ``sample_rooms`` without gathering them.

    The form to use where a zone has more names than one text should hold.
    """
    return _zoned(on_floor_only(usage, floor), (), ()).spaces.select(*ZONE, "room_name").distinct()


def facility_features(usage: Usage, floor: int | str | None = None, hours: int | None = None, days: int = 14,
                      count_mode: str = "rooms", quiet=QUIET_WORDS, refresh=REFRESH_WORDS) -> DataFrame:
    """Zone measures plus the distinct names of the zone's rooms, sorted by floor and zone.

    Rows are summed per zone and name first, so the text is built from names that are already distinct.
    """
    facts = _facts(usage, floor, hours, days, count_mode, quiet, refresh)
    by_name = facts.groupBy(*ZONE, "room_name").agg(*[F.expr(f"sum({c}) AS {c}") for c, _ in _SUMS])
    return (
        by_name.groupBy(*ZONE)
        .agg(*[F.expr(f"sum({c}) AS {n}") for c, n in _SUMS], F.expr(NAME_LIST))
        .orderBy(*[F.asc_nulls_last(c) for c in ZONE])
    )


@dataclass(frozen=True)
class PlanOptions:
    """Settings of the ranking; ``hours`` replaces ``days`` when given (1 for "now").

    The defaults are fixed values.
    """

    floor: int | str | None = None
    k: int = 2
    hours: int | None = None
    days: int = 14
    avoid_quiet: bool = True
    quiet_weight: float = 0.6
    downweight_refreshment: float = 0.5


def _best_first() -> list:
    return [F.desc_nulls_last("score"), F.desc_nulls_last("people_hours"), *[F.asc_nulls_last(c) for c in ZONE]]


def rank_zones(usage: Usage, options: PlanOptions = PlanOptions(), count_mode: str = "rooms",
               quiet=QUIET_WORDS, refresh=REFRESH_WORDS) -> DataFrame:
    """The ``k`` best zones for a facility.

    Score: people-hours, lowered by the share of quiet rooms when those are to be avoided, and again where the zone
    already has refreshment rooms; never below 0.  Zones without events have no score and come last.  Ties go to more
    people-hours, then to the smaller floor and zone.  The rooms of the winners are rows of :func:`ranked_zone_rooms`.
    """
    measures = zone_measures(usage, options.floor, options.hours, options.days, count_mode, quiet, refresh)
    quiet_share = "quiet_cnt / rooms_in_zone"
    score = "CAST(people_hours AS DOUBLE)"
    if options.avoid_quiet:
        score += f" * (1D - {float(options.quiet_weight)!r}D * {quiet_share})"
    score += f" * if(refresh_cnt > 0, {float(options.downweight_refreshment)!r}D, 1D)"
    ranked = measures.selectExpr(
        *ZONE,
        "people_hours",
        "rooms_in_zone",
        f"bround({quiet_share} * 100, 1) AS quiet_pct",
        f"if(people_hours IS NOT NULL, greatest({score}, 0D), NULL) AS score",
    )
    return ranked.orderBy(*_best_first()).limit(whole(options.k, "k"))


def ranked_zone_rooms(usage: Usage, options: PlanOptions = PlanOptions(), count_mode: str = "rooms",
                      quiet=QUIET_WORDS, refresh=REFRESH_WORDS) -> DataFrame:
    """``place, floor, zone, room_name``: the rooms of the ``k`` best zones, one row each, best zone first.

    Only the winners' keys, ``k`` short rows, are broadcast; no text is gathered.
    """
    best = rank_zones(usage, options, count_mode, quiet, refresh)
    place = F.row_number().over(W.orderBy(*_best_first())).alias("place")  # over k rows
    return zone_rooms(usage, options.floor).join(F.broadcast(best.select(place, *ZONE)), ZONE).select(
        "place", *ZONE, "room_name"
    )
