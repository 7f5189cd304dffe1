"""Mergeable summaries per floor and hour: distinct rooms by theta sketches, lateness by quantile sketches.

A summary is a small binary column.  It is stored beside the hourly roll-up, and any window is answered by merging the
summaries of its hours, without another pass over the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions import clock
from dwellgrid.functions.clock import whole
from dwellgrid.functions.measures import OCCUPIED
from dwellgrid.usage import Usage

# A theta sketch of 2**12 entries is exact up to 4,096 rooms; beyond them its relative standard error is 1 / sqrt(4096).
ROOM_ENTRIES_LOG2 = 12
# A quantile sketch of this size is exact up to about as many values; beyond them the rank error is below 0.2 %.
QUANTILE_SIZE = 4096


def room_sketches(usage: Usage, keys: tuple[str, ...] = ("floor_n",), entries_log2: int = ROOM_ENTRIES_LOG2) -> DataFrame:
    """``keys, hour, used, seen``: theta sketches of the rooms occupied, and of those with any event, in that hour.

    Sketches are built per task before the shuffle, so a hot space or floor sends one small row per hour and task.
    """
    hour, occupied = F.expr(clock.hour(usage.events)).alias("hour"), F.expr(OCCUPIED) == 1
    rows = usage.events.select("space_id", hour, occupied.alias("occupied")).where("hour IS NOT NULL")
    if not usage.broadcast_spaces:
        rows = rows.groupBy("space_id", "hour").agg(F.max("occupied").alias("occupied"))
    rows = rows.join(usage.dimension(*keys), "space_id")
    size = F.lit(whole(entries_log2, "entries_log2", 4))
    room = F.when(F.col("occupied"), F.col("space_id"))  # null is not counted
    return rows.groupBy(*keys, "hour").agg(
        F.theta_sketch_agg(room, size).alias("used"), F.theta_sketch_agg("space_id", size).alias("seen")
    )


def distinct_rooms(sketches: DataFrame, keys: tuple[str, ...], within: dict[str, Column], column: str = "used",
                   entries_log2: int = ROOM_ENTRIES_LOG2) -> DataFrame:
    """``keys``, one estimated number of rooms per named window, and ``in_all``: rooms that occur in every one of them.

    ``within`` maps a name to a condition on ``hour``.  The windows' sketches are united in one pass; ``in_all`` is the
    estimate of their intersection, whose error is relative to the union.  A window without hours counts 0.
    """
    size = F.lit(entries_log2)
    united = [F.theta_union_agg(F.when(cond, F.col(column)), size).alias(f"s_{name}") for name, cond in within.items()]
    merged = sketches.groupBy(*keys).agg(*united)
    names = [f"s_{name}" for name in within]
    both = F.col(names[0])
    for other in names[1:]:
        both = F.theta_intersection(both, F.col(other))
    counts = [F.theta_sketch_estimate(f"s_{name}").alias(name) for name in within]
    return merged.select(*keys, *counts, F.theta_sketch_estimate(both).alias("in_all"))


def lateness_sketches(rows: DataFrame, when: Column, lateness: Column, unit: str = "day",
                      size: int = QUANTILE_SIZE) -> DataFrame:
    """``bucket, n, least, most, sketch`` per ``unit`` of ``when``: how late rows arrived, as whole numbers.

    Rows without a time or a lateness are not counted.  A sketch has a bounded size whatever the number of rows, and is
    built per task before the shuffle.
    """
    values = rows.select(F.date_trunc(unit, when).alias("bucket"), lateness.cast("bigint").alias("late"))
    values = values.where("bucket IS NOT NULL AND late IS NOT NULL")
    return values.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.min("late").alias("least"),
        F.max("late").alias("most"),
        F.kll_sketch_agg_bigint("late", whole(size, "size", 8)).alias("sketch"),
    )


def lateness_profile(sketches: DataFrame, unit: str = "month", shares: tuple[float, ...] = (0.5, 0.9, 0.99),
                     size: int = QUANTILE_SIZE) -> DataFrame:
    """``bucket, n, least, most`` and a quantile per share (``p50`` and so on), merged from finer sketches.

    Count and extremes are exact.  A quantile is the smallest value whose rank reaches the share.
    """
    merged = sketches.groupBy(F.date_trunc(unit, "bucket").alias("bucket")).agg(
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_bigint("sketch", whole(size, "size", 8)).alias("sketch"),
    )
    found = [F.kll_sketch_get_quantile_bigint("sketch", F.lit(s)).alias(f"p{round(s * 100)}") for s in shares]
    return merged.select("bucket", "n", "least", "most", *found)
