"""Lookups in the space dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import codes
from dwellgrid.functions.clock import whole
from dwellgrid.functions.floors import on_floor
from dwellgrid.usage import Usage


def list_floors(usage: Usage) -> DataFrame:
    """Distinct (floor, storey name) of the raw dimension, where a storey id is given."""
    return (
        usage.raw_spaces.where(F.col("storey_floorId").isNotNull())
        .select(F.col("storey_floorId").try_cast("int").alias("floor"), "storey_name")
        .distinct()
        .orderBy(F.asc_nulls_last("floor"), F.asc_nulls_last("storey_name"))
    )


def find_rooms_like(usage: Usage, text: str, limit: int = 20) -> DataFrame:
    """Rooms whose code or name contains the text: the first 20 (room, storey) pairs in code order."""
    return (
        usage.spaces.where(codes.resembles_room(text))
        .groupBy("room_name", "storey_name")
        .agg(F.min("display_name").alias("first_code"))
        .orderBy("first_code", F.asc_nulls_last("room_name"), F.asc_nulls_last("storey_name"))
        .limit(whole(limit, "limit"))
        .select("room_name", "storey_name")
    )


def rooms_on_floor(usage: Usage, floor: int | str) -> DataFrame:
    """Distinct (code, room name) of one floor in code order."""
    return (
        usage.spaces.where(on_floor(floor))
        .select(F.col("display_name").alias("code"), "room_name")
        .distinct()
        .orderBy("code", F.asc_nulls_last("room_name"))
    )


def sensors_for_room(usage: Usage, room: str) -> DataFrame:
    """Distinct sensor names of one room, matched by room key or room id."""
    return (
        usage.spaces.where(F.col("sensor_name").isNotNull() & codes.matches_room(room))
        .select("sensor_name")
        .distinct()
    )
