"""State flags and rounding shared by all rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1 for the state ``occupied`` in any case; 0 for every other value and for NULL.
OCCUPIED = "CASE WHEN lower(occupancy) = 'occupied' THEN 1 ELSE 0 END"


def occupied() -> Column:
    return F.expr(OCCUPIED)


def is_state(value: str, state: str = "occupancy") -> Column:
    """Case-insensitive state test; NULL is not a match."""
    return F.expr(f"coalesce(lower({state}) = '{value}', false)")


def percent(rate: str) -> Column:
    """A share (SQL text) as a percentage with one decimal; NULL stays NULL."""
    return F.expr(f"round(({rate}) * 100, 1)")
