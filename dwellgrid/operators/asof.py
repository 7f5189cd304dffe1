"""State of spaces at given moments: the newest event at or before each moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dwellgrid.usage import Usage

BIN = "day"


def state_at(usage: Usage, moments: DataFrame, bin_unit: str = BIN) -> DataFrame:
    """``space_id, at, occupancy, event_time, since`` per row of ``moments`` (``space_id, at``).

    ``since`` is the time of the newest event of the space with ``ts <= at``; of equal times the larger ``event_order``
    counts.  Before the first event of a space, and for a space without events, the state is null.

    No range join: time is cut into bins.  Moments and events of one space and bin meet in one ordered pass, so a space
    with a third of all events is dealt by its bins.  What a bin does not hold comes from the last event of an earlier
    one; that table has one row per space and bin with events, reduced before its shuffle.

    Defined cases: moments of a null space or a null time have no state; repeated moments give repeated rows; events
    without a time are no one's newest.  No moments give no rows.
    """
    event = F.struct("ts", "event_order", "occupancy", "event_time")
    kind = usage.events.schema["ts"].dataType.simpleString()

    def binned(column: str):
        return F.date_trunc(bin_unit, column).cast(kind)

    log = usage.events.where("ts IS NOT NULL").select("space_id", binned("ts").alias("bin"), event.alias("event"))
    asked = moments.select("space_id", F.col("at").cast(kind).alias("at"))
    asked = asked.select("space_id", binned("at").alias("bin"), "at")
    known = log.select("space_id", "bin", F.col("event.ts").alias("at"), "event")
    both = known.unionByName(asked.withColumn("event", F.lit(None).cast(known.schema["event"].dataType)))
    # at equal times events come before the moment, and the one that counts comes last
    order = [F.col("at").asc_nulls_first(), F.col("event").isNull(), F.col("event.event_order").asc_nulls_first()]
    upto = W.partitionBy("space_id", "bin").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    within = both.withColumn("found", F.last("event", ignorenulls=True).over(upto)).where("event IS NULL")
    # the last event of every bin, and of all bins before: few rows per space
    newest = F.max_by("event", F.struct("event.ts", "event.event_order"))
    lasts = log.groupBy("space_id", "bin").agg(newest.alias("event"))
    wanted = asked.select("space_id", "bin").distinct().withColumn("event", F.lit(None).cast(lasts.schema["event"].dataType))
    earlier = W.partitionBy("space_id").orderBy("bin", F.col("event").isNotNull())
    earlier = earlier.rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = lasts.unionByName(wanted).withColumn("carried", F.last("event", ignorenulls=True).over(earlier))
    carried = carried.where("event IS NULL").select(
        F.concat("space_id", F.lit("")).alias("c_space"), F.col("bin").alias("c_bin"), "carried"
    )
    joined = within.join(carried, (F.col("space_id") == F.col("c_space")) & (F.col("bin") == F.col("c_bin")), "left")
    state = F.coalesce("found", "carried")
    return joined.select(
        "space_id", "at", state["occupancy"].alias("occupancy"), state["event_time"].alias("event_time"), state["ts"].alias("since")
    )
