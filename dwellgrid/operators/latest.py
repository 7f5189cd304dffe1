"""Latest state per space and per room.

"Now" is the newest event of each space, however old; ``max_age`` narrows it to a trailing window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import clock, codes
from dwellgrid.functions.measures import is_state
from dwellgrid.operators.rates import on_floor_only
from dwellgrid.schema import MEETING_WORDS
from dwellgrid.usage import Usage


PAYLOAD, ORDER = "occupancy, event_time", "ts, event_order"


def _newest(frame: DataFrame, extra: str = "") -> DataFrame:
    best = f"max_by(struct({PAYLOAD}, {ORDER}{extra}), struct({ORDER}{extra})) AS newest"
    return frame.groupBy("space_id").agg(F.expr(best)).select("space_id", "newest.*")


def newest_events(events: DataFrame) -> DataFrame:
    """``space_id, occupancy, event_time, ts, event_order``: the newest event of every space, to be stored.

    One pass: every task keeps one row per space before the only shuffle.  Events without a time are left out.
    """
    return _newest(events.where("ts IS NOT NULL"))


def refreshed(states: DataFrame, events: DataFrame) -> DataFrame:
    """Stored newest events brought up to date from the log's tail alone."""
    return newest_events(_with_tail(states, events))


def _with_tail(states: DataFrame, events: DataFrame) -> DataFrame:
    """Stored states and the events from their newest moment on; the bound reaches the scan, and by date the folders."""
    columns = ["space_id", *PAYLOAD.split(", "), *ORDER.split(", ")]
    kind = events.schema["ts"].dataType.simpleString()
    last = states.agg(F.expr(f"coalesce(max(ts), CAST('0001-01-01' AS {kind}))").alias("last")).scalar()
    tail = events.where(F.col("ts") >= last)
    if "event_date" in events.columns:
        tail = tail.where(F.col("event_date") >= F.date_sub(last.cast("date"), 1))
    return states.select(*columns).unionByName(tail.select(*columns))


def latest_states(usage: Usage, max_age: clock.Window | None = None) -> DataFrame:
    """``space_id, room_name, occupancy, event_time`` of the newest event of every space in the model.

    With stored states only the log's tail is read.  Without, and with a bounded dimension, the newest moment of each
    space is a hash aggregate over two fixed-width columns.  It has one row per space of the model, so it is as bounded as
    the dimension; broadcast to the log it leaves the newest events, in which ties are decided by ``event_order``, then by
    the larger room name where a space is listed twice.  Beyond the bound, ``max_by`` keeps one row per space and task
    before the only shuffle, at the price of a sort there.
    """
    if usage.states is not None:
        rows = _with_tail(usage.states, usage.events)
        if max_age is not None:
            rows = clock.within(rows, max_age, usage.at)  # the newest of all events is among these rows
    else:
        rows = usage.events if max_age is None else clock.within(usage.events, max_age, usage.at)
    if usage.states is None and usage.broadcast_spaces:
        known = rows.join(usage.dimension(), "space_id", "left_semi").where("ts IS NOT NULL")
        moments = known.groupBy("space_id").agg(F.max("ts").alias("newest_ts"))
        rows = rows.join(F.broadcast(moments), "space_id").where("ts = newest_ts").drop("newest_ts")
    else:
        rows = _newest(rows)
    joined = rows.join(usage.dimension("room_name"), "space_id")
    return _newest(joined, ", room_name").select("space_id", "room_name", "occupancy", "event_time")


def status_floor_now(usage: Usage, floor: int | str, max_age: clock.Window | None = None) -> DataFrame:
    """Room name, state and time of the newest event of every space on a floor."""
    return latest_states(on_floor_only(usage, floor), max_age).select("room_name", "occupancy", "event_time")


def free_rooms_now(usage: Usage, floor: int | str, words=MEETING_WORDS,
                   max_age: clock.Window | None = None) -> DataFrame:
    """Spaces of a category whose newest event says unoccupied; an older unoccupied event does not count."""
    scoped = on_floor_only(usage, floor)
    scoped = scoped.with_spaces(scoped.spaces.where(codes.contains_any("spaceType", words)))
    return latest_states(scoped, max_age).where(is_state("unoccupied")).select("room_name", "event_time")


def latest_room_status(usage: Usage, room: str) -> DataFrame:
    """Newest event over all sensor spaces of one room, matched by room key or room id."""
    scoped = usage.with_spaces(usage.spaces.where(codes.matches_room(room)))
    return (
        scoped.events.join(scoped.dimension("room_name"), "space_id")
        .orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("event_order"), F.desc_nulls_last("room_name"))
        .limit(1)
        .selectExpr("occupancy AS occupancy_raw", "event_time", "room_name")
    )
