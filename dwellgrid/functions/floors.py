"""Floor tokens and floor predicates over the cleaned space dimension."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.functions.codes import quoted

# Floor of a space: the storey's own id where it is an integer, else the number in the room code.
FLOOR_KEY = "coalesce(try_cast(storey_floorId AS INT), floor_n)"


def floor_token(floor: int | str | None) -> int | None:
    """The integer a floor argument stands for, or None when it is a storey name."""
    text = str("" if floor is None else floor).strip()
    return int(text) if re.match(r"^[+-]?\d+$", text, re.ASCII) else None


def floor_key() -> Column:
    return F.expr(FLOOR_KEY)


def on_floor(floor: int | str, source: str = "storey") -> Column:
    """Predicate on cleaned spaces.

    Numeric arguments compare with the floor key (``source="storey"``) or with the code's floor only
    (``source="code"``); any other text compares with the storey name, ignoring case.
    """
    number = floor_token(floor)
    if number is None:
        return F.expr(f"lower(storey_name) = lower({quoted(str(floor).strip())})")
    return F.expr(f"floor_n = {number}" if source == "code" else f"{FLOOR_KEY} = {number}")
