"""Trailing turns of a dialogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_turns(conversations: DataFrame, turns: int = 8) -> DataFrame:
    """``conv_id, turn, speaker, text``: of the last turns of each dialogue, those by user and assistant.

    The cut comes first and the role filter second, so a system turn among the last ones uses up a place.  The rank
    limit is applied on the map side too: a dialogue sends at most ``turns`` rows per task to the shuffle.
    """
    newest_first = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    speaker = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai")
    return (
        conversations.withColumn("place", F.row_number().over(newest_first))
        .where(F.col("place") <= turns)
        .withColumn("speaker", speaker)
        .where(F.col("speaker").isNotNull())
        .select("conv_id", "turn", "speaker", "text")
    )
