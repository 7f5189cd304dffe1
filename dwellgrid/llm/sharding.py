"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.common import checkpointed, id_and_text, ship_package

SHARDS = 8


def _running_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its partition, its place there and the bytes before it there; holds one batch at a time."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        ends = total + np.cumsum(sizes)
        places = np.arange(rows, rows + len(sizes))
        added = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(places), pa.array(ends - sizes)]
        yield pa.RecordBatch.from_arrays(batch.columns + added, [*batch.schema.names, "part", "place", "before"])
        rows, total = rows + len(sizes), int(ends[-1]) if len(ends) else total


def contiguous_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot, bytes_before``, shards contiguous by id.

    Rows without their text are range-partitioned and sorted by id once and checkpointed with their place.  Each
    partition sums its own sizes in order; the totals, one row per partition, are summed up over all partitions and come back to
    the rows as offsets.  The cut points are equal shares of the total: a row belongs to the share in which its middle
    byte lies, so a shard differs from its target by at most one document at either end.

    Defined cases: the size is the UTF-8 length of the text plus 1, so null and empty texts have size 1.  Null ids come
    first, equal ids are ordered by size and checksum.  Fewer rows than shards leave shards empty; no rows give no rows.
    A document larger than a share fills one alone and may leave neighbours empty.
    """
    rows = id_and_text(docs, id_col, text_col).select(
        F.col("doc_id").cast("long"),
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
    )
    order = ["doc_id", "size", "text_crc32"]
    ship_package(docs.sparkSession)
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "doc_id long, size long, text_crc32 long, part int, place long, before long"
    placed = checkpointed(sorted_rows.mapInArrow(_running_sums, schema))
    # One row per partition: the only rows that meet in one task.
    over_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(over_parts), F.lit(0)).alias("part_bytes"),
        F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("part_rows"),
        F.sum("bytes").over(everything).alias("total"),
    )
    ranked = placed.join(F.broadcast(offsets), "part").select(
        *order,
        (F.col("part_bytes") + F.col("before")).alias("bytes_before"),
        (F.col("part_rows") + F.col("place")).alias("rank"),
        "total",
    )
    middle = F.col("bytes_before").cast("decimal(38,0)") * 2 + F.col("size")
    cut = F.floor(middle * shards / (F.col("total").cast("decimal(20,0)") * 2))
    sharded = ranked.withColumn("shard", F.least(cut.cast("int"), F.lit(shards - 1)))
    firsts = sharded.groupBy("shard").agg(F.min("rank").alias("first"))  # at most one row per shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), "bytes_before"
    )
