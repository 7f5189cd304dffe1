"""Line deduplication: range-partitioned line hashes in, run-length keep bitmaps per document out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.common import BLANKS, id_and_text, lower_ascii, own_shuffle, written

MIN_CHARS = 20
MIN_DOCUMENTS = 3
# Slices of one line's documents; a line in every document is spread over all of them.
SLICES = 4096


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _row_key() -> list[Column]:
    """A document row: its id and a hash of its text, as ids may be null or repeated with other texts."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``hash_a, hash_b, doc_id, text_hash, pos`` of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(*_row_key(), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= min_chars)
    keyed = trimmed.withColumn("key", lower_ascii(F.col("line")))
    return keyed.select(
        F.xxhash64("key").alias("hash_a"),
        F.xxhash64(F.lit("second"), "key").alias("hash_b"),
        "doc_id",
        "text_hash",
        "pos",
    )


def frequent_lines(occurrences: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``hash_a, hash_b, last_id``: lines of at least ``min_documents`` documents and the largest id holding them.

    Hashes are range-partitioned together with a slice of the documents, so the parts of one very common line lie in
    neighbouring partitions instead of one task.  Sorted by document (descending) and position, each slice is streamed
    once and hands on the first occurrence of its first ``min_documents`` documents; these few rows are then counted.
    """
    slice_of = F.pmod(F.xxhash64("doc_id"), F.lit(SLICES))
    ranged = occurrences.select("hash_a", "hash_b", slice_of.alias("slice"), "doc_id", "pos").repartitionByRange(
        "hash_a", "hash_b", "slice"
    )
    stream = Window.partitionBy("hash_a", "hash_b", "slice").orderBy(F.col("doc_id").desc_nulls_last(), "pos")
    seen = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag("doc_id").over(stream)
    opens = (F.row_number().over(stream) == 1) | ~previous.eqNullSafe(F.col("doc_id"))
    first = ranged.withColumn("opens", opens).withColumn("nth", F.sum(F.col("opens").cast("int")).over(seen))
    return (
        first.where(F.col("opens") & (F.col("nth") <= min_documents))
        .groupBy("hash_a", "hash_b")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_id"))
        .where(F.col("n") >= min_documents)
        .select(own_shuffle(F.col("hash_a")).alias("hash_a"), "hash_b", "last_id")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, text_hash, n_dropped, dropped``: run-length bitmaps of the documents that lose lines, no text.

    ``dropped`` lists the runs of zeros in the keep bitmap as (first, last) line positions in ascending order; all other
    lines are kept.  A document that keeps everything has no row.
    """
    occurrences = written(line_occurrences(docs, min_chars), "lines")
    lost = (
        occurrences.join(frequent_lines(occurrences, min_documents), ["hash_a", "hash_b"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_id")))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("p"))
    )
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1) != x + 1, F.lit(True)))
    runs = F.transform(
        F.arrays_zip(starts.alias("first"), ends.alias("last")),
        lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")),
    )
    return lost.select("doc_id", "text_hash", F.size("p").cast("long").alias("n_dropped"), runs.alias("dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines outside the dropped runs, in order."""
    before = F.concat(F.array(F.lit(-1)), F.transform(dropped, lambda r: r["last"]))
    after = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(lines)))
    gaps = F.zip_with(before, after, lambda b, a: F.slice(lines, b + 2, a - b - 1))
    return F.flatten(gaps)


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, text`` (kept lines joined by newline) and ``extra`` columns.

    Defined cases: a null or empty text is one empty line, which is too short to be dropped.  Lines are compared by two
    64-bit hashes.  All rows without an id count as one document, smaller than every other; rows repeated with one id
    are one document.  A document that loses all lines keeps the empty text.  No rows give no rows.
    """
    plain = id_and_text(docs, id_col, text_col)
    bitmaps = keep_bitmaps(plain, min_chars, min_documents).select(
        F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), "n_dropped", "dropped"
    )
    carried = F.struct(*[F.col(c) for c in extra]) if extra else F.lit(None)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried")
    ).select(*_row_key(), "text", "carried")
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash"))
    joined = rows.join(bitmaps, same, "left").withColumn("lines", _lines(F.col("text")))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(kept_lines(F.col("lines"), F.col("dropped")), "\n")
    )
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("text"),
        *[F.col(f"carried.`{c}`").alias(c) for c in extra],
    )
