"""Cleaning of the raw space dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dwellgrid.functions import codes


def clean_spaces(raw: DataFrame) -> DataFrame:
    """Raw columns plus ``label, code, room_id, room_key, display_name, floor_n``.

    Rows without a room code, with a floor that is not an integer, or with a device label are dropped; a floor number
    exists only where a code does.
    """
    parsed = raw.withColumns({"label": codes.label(), "code": codes.room_code()})
    derived = parsed.withColumns(
        {
            "room_id": codes.room_id(),
            "room_key": codes.room_key(),
            "display_name": parsed["code"],
            "floor_n": codes.floor_number(),
        }
    )
    return derived.where(derived["floor_n"].isNotNull() & ~codes.is_junk())
