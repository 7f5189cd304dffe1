"""Inputs the catalogue derives from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.plans.building import Building
from dwellgrid.sources import sample_tables

# Phrasings of the derived question log; {f} and {d} stand for a floor and a number of days.
PHRASINGS = (
    "list floors",
    "rooms on floor {f}",
    "free meeting rooms now on floor {f}",
    "utilization by floor last {d} days",
    "busiest rooms on floor {f} last {d} days",
    "busiest rooms last {d} days",
    "underused rooms last month",
    "underused rooms last {d} days threshold 0.15",
    "underused rooms on level {f} below 20 %",
    "Best 2 coffee machine spots on floor {f} now (avoid quiet areas)",
    "coffee machine placement on floor {f} past 3 weeks, ignore quiet areas",
    "utilization floor {f}",
    "compare floors {f} and {d}",
    "find room 3.201",
    "sensors of room 3.201",
    "is room 3.201 occupied now",
    "peak hours for Floor {f}",
    "suggest improvements for floor {f} this month",
    "Status now for Floor {f}",
    "top 10 rooms by occupancy past 24 hours",
    "average occupancy per floor last {d} days",
    "Welke verdiepingen zijn er?",
    "Drukste kamers op verdieping {f}",
    "show me the 3rd  floor",
)


def question_log(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, turn, text``: one question per conversation turn, followed by the whole text of the turn."""
    turns = sample_tables.table(spark, folder, "conversations")
    n = F.col("conv_id") * 5 + F.col("turn")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASINGS]), F.pmod(n, F.lit(len(PHRASINGS))).cast("int"))
    floor = (F.pmod(F.col("conv_id"), F.lit(14)) - 2).cast("string")
    days = (F.pmod(n, F.lit(29)) + 2).cast("string")
    asked = F.replace(F.replace(phrase, F.lit("{f}"), floor), F.lit("{d}"), days)
    text = F.concat(asked, F.lit("\n"), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", text.alias("text"))


def building(spark: SparkSession, folder: str) -> Building:
    return Building(
        spark,
        sample_tables.office_events(spark, folder),
        sample_tables.meeting_events(spark, folder),
        sample_tables.usage(spark, folder),
    )
