"""Exact deduplication: 128-bit content hash, bytes compared inside each hash group, smallest id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import id_and_text, own_shuffle, written

# Runs of white space that are not one single space already: those need no replacement.
UNEVEN_BLANKS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
# The filter of repeated hashes: 2^27 bits in maps of 2^15, so at most 4,096 maps of 4 KiB (16 MiB) are broadcast.
FILTER_BITS, MAP_BITS = 27, 15


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; nothing is trimmed and case is kept."""
    return F.regexp_replace(text, UNEVEN_BLANKS, " ")


def two_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits as two 64-bit hashes that start from different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _place(first_half: Column) -> tuple[Column, Column]:
    """Number of the map and of the bit in it that stand for a hash."""
    slot = first_half.bitwiseAND((1 << FILTER_BITS) - 1)
    return F.shiftright(slot, MAP_BITS), slot.bitwiseAND((1 << MAP_BITS) - 1)


def _maybe_repeated(hashed: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``hashed`` whose bit is set by a row of ``repeated``: all whose hash is there, and few others."""
    maps = repeated.select(*(c.alias(n) for c, n in zip(_place(F.col("h1")), ("map", "bit"))))
    maps = maps.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits"))
    number, bit = _place(F.col("h1"))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    is_set = F.expr("get(array(1, 2, 4, 8, 16, 32, 64, 128), CAST(bit % 8 AS INT))").bitwiseAND(byte) > 0
    placed = hashed.withColumns({"map": number, "bit": bit})
    return placed.join(F.broadcast(maps), "map").where(is_set).drop("map", "bit", "bits")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], tuple[Column, Column]] = two_hashes,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Plan: a first pass writes the 128-bit hash of every text, and the SHA-256 that the result shows.  Hashes are counted
    without texts.  A second pass brings the texts of repeated hashes only: they are aggregated by (hash, text), so the
    engine compares the bytes of all members of a hash group, and copies collapse in the map task, however many there
    are.  Which texts those are is told by a bit map of 16 MiB at most; with more repeated hashes than it can tell apart
    (some 10^8) more texts, at worst all, move once, with the same result.  Only hashes then meet the rows again, in a join
    that adaptive execution may split.  ``content_hash`` gives the two halves of the hash; with a weak one the bytes
    still keep different texts apart.

    Defined cases: a null text is the empty text, which is a text like any other.  Null ids never become ``keep_id``
    while the group has an id; such a row is kept only where the whole group has none.  Rows repeated with the same id
    get equal answers, as the id decides.  No rows give no rows.  Two different texts of one hash group are told apart by
    their SHA-256 in the result; should they share that too, the job ends with an error rather than with a wrong group.
    """
    norm = id_and_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    h1, h2 = content_hash(F.col("norm"))
    texts = norm.select("doc_id", "norm", h1.alias("h1"), h2.alias("h2"))
    hashes = written(texts.select("doc_id", "h1", "h2", F.unhex(F.sha2("norm", 256)).alias("sha")), "content-hashes")
    repeated = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = _maybe_repeated(texts, repeated).groupBy("h1", "h2", "norm")
    same = same.agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = same.groupBy("h1", "h2", F.unhex(F.sha2("norm", 256)).alias("sha")).agg(
        F.min("keep_id").alias("keep_id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("n_texts")
    )
    one_text = F.when(F.col("n_texts") > 1, F.raise_error(F.lit("two texts share one SHA-256"))).otherwise(F.col("n"))
    groups = groups.select(
        own_shuffle(F.col("h1")).alias("h1"), "h2", "sha", F.lit(True).alias("found"), F.col("keep_id").alias("least"),
        one_text.cast("long").alias("n"),
    )
    keep_id = F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id"))
    return hashes.join(groups, ["h1", "h2", "sha"], "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
