"""Importance resampling towards a target: hashed word n-grams of both corpora, gains per bucket, Gumbel draw."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from dwellgrid.llm.common import checkpointed, lower_ascii, ship_package, written

BUCKETS = 10_000
ORDERS = (1, 1)  # shortest and longest run of words that is a feature
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # in text whose A-Z are lower-cased; all else belongs to words
PIECE = 1 << 16  # characters that are split at a time
KNOWN_WORDS = 1 << 16  # words whose bucket a worker remembers
ROWS = 512  # rows that a worker turns into arrays at a time
ROW_BITS = 33
_SEPARATOR = re.compile(SEPARATORS)


def splitter() -> pre_tokenizers.PreTokenizer:
    """The tokenizers library's Regex Split, untrained: words with their offsets, separators removed."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    return pre_tokenizers.Split(Regex(SEPARATORS), "removed")


def _pieces(text: str, size: int) -> Iterator[str]:
    """The text in stretches of about ``size`` characters that end before a separator; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SEPARATOR.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def features(text: str, split, orders: tuple[int, int] = ORDERS, size: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """``(n_words, features)`` of each stretch of a text; the features are runs of ``orders`` words joined by one space.

    A window is a pair of offsets, the start of its first word and the end of its last one.  The last words of a stretch
    are seen again before the next one, for the windows that reach over the cut.
    """
    shortest, longest = orders
    carried = ""
    for piece in _pieces(text, size):
        here, known = carried + piece, len(carried)
        spans = [span for _, span in split.pre_tokenize_str(here)] if here else []
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        fresh = sum(1 for b in ends if b > known)
        found = []
        for order in range(shortest, longest + 1):
            pairs = zip(starts, ends[order - 1 :])
            if order == 1:
                found += [here[a:b] for a, b in pairs if b > known]
            else:
                found += [_SEPARATOR.sub(" ", here[a:b]) for a, b in pairs if b > known]
        yield fresh, found
        keep = min(longest - 1, len(starts))
        carried = here[starts[-keep] : ends[-1]] if keep else ""


class _Buckets(dict):
    """Feature to bucket; a bounded memory of what was hashed before."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return bucket


def _few_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time: Arrow's batches hold ten thousand texts, whatever their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _counted(
    batches: Iterator[pa.RecordBatch], place: int, orders: tuple[int, int], buckets: int
) -> Iterator[pa.RecordBatch]:
    """What :func:`feature_counts` says of rows ``doc_id, text_hash, text``; ``place`` is the first row's."""
    split, bucket_of = splitter(), _Buckets(buckets)
    for batch in _few_rows(batches):
        n_words, n_features, listed, counted = [], [], [], []
        for text in batch.column(2):
            words, total, sums = 0, 0, np.zeros(buckets, np.int64)
            for fresh, found in features(text.as_py(), split, orders):
                words, total = words + fresh, total + len(found)
                sums += np.bincount([bucket_of[f] for f in found], minlength=buckets) if found else 0
            used = np.flatnonzero(sums)
            n_words.append(words)
            n_features.append(total)
            listed.append(used.astype("<u4").tobytes())
            counted.append(sums[used].astype("<i8").tobytes())
        places = np.arange(place, place + batch.num_rows, dtype=np.int64)
        place += batch.num_rows
        arrays = [pa.array(places), batch.column(0), batch.column(1), pa.array(n_words, pa.int64())]
        arrays += [pa.array(n_features, pa.int64()), pa.array(listed, pa.binary()), pa.array(counted, pa.binary())]
        names = ["place", "doc_id", "text_hash", "n_words", "n_features", "buckets", "counts"]
        yield pa.RecordBatch.from_arrays(arrays, names)


def feature_counts(
    docs: DataFrame, id_col: str, text_col: str, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS
) -> DataFrame:
    """``place, doc_id, text_hash, n_words, n_features, buckets, counts`` per row, in place without shuffle.

    ``buckets`` and ``counts`` list a text's buckets and how many of its features fall into each, as little-endian
    32- and 64-bit integers; ``place`` tells rows apart.  Texts are split a stretch at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, TaskContext.get().partitionId() << ROW_BITS, orders, buckets)

    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), lower_ascii(text))
    schema = (
        "place long, doc_id long, text_hash long, n_words long, n_features long, buckets binary, counts binary"
    )
    return rows.mapInArrow(count, schema)


def _lists(batch: pa.RecordBatch, listed: int, counted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and counts of all rows one after the other, and where each row ends."""
    blobs = batch.column(listed).to_pylist()
    where = np.frombuffer(b"".join(blobs), "<u4")
    counts = np.frombuffer(b"".join(batch.column(counted).to_pylist()), "<i8")
    return where, counts, np.cumsum([len(b) // 4 for b in blobs])


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: a dense sum per task, then at most one row per bucket for the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in _few_rows(batches):
            where, counts, _ = _lists(batch, 0, 1)
            np.add.at(sums, where, counts)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], ["bucket", "n"])

    parts = counted.select("buckets", "counts").mapInArrow(add, "bucket int, n long")
    total = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's smoothed share of a bucket to the source's, rounded down."""
    size = len(source)
    above = (target + 1.0) * float(source.sum() + size)
    below = (source + 1.0) * float(target.sum() + size)
    return np.floor(1000.0 * np.log(above / below)).astype(np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``place, doc_id, text_hash, n_words, n_features, weight``: the sum of the gains over a text's features."""
    kept = ["place", "doc_id", "text_hash", "n_words", "n_features"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            where, counts, ends = _lists(batch, 5, 6)
            sums = np.concatenate([[0], np.cumsum(counts * gain[where])])
            weight = np.diff(sums[np.concatenate([[0], ends]).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(weight, pa.int64())], [*kept, "weight"])

    schema = "place long, doc_id long, text_hash long, n_words long, n_features long, weight long"
    return counted.select(*kept, "buckets", "counts").mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number, rounded down, from the hash of seed and id; a null id hashes as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, rows = TaskContext.get().partitionId(), 0
    for batch in batches:
        parts = np.full(batch.num_rows, part, np.int32)
        places = np.arange(rows, rows + batch.num_rows, dtype=np.int64)
        rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts), pa.array(places)], ["place", "part", "before"])


def _ranks(candidates: DataFrame, percent: int) -> DataFrame:
    """``place, rank`` of the drawn rows: a range sort, then running numbers from the partitions' sizes."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    placed = candidates.select("place", "score", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpointed(placed.mapInArrow(_numbered, "place long, part int, before long"))
    # one row per partition: the only rows that meet in one task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select(
        "part",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.floor(F.sum("n").over(whole) * percent / 100).alias("drawn"),
    )
    ranked = numbered.join(F.broadcast(offsets), "part")
    ranked = ranked.select("place", (F.col("offset") + F.col("before") + 1).cast("long").alias("rank"), "drawn")
    return ranked.where("rank <= drawn").drop("drawn")


def drawn(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    orders: tuple[int, int] = ORDERS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank, text_hash``; ``rank`` is null if undrawn.

    Texts are split once.  Their bucket counts, a fraction of the text's size, are written to the shared folder and read
    for the histogram and again for the weights.  Of documents with at least ``least_words`` words the ``percent`` with
    the highest scores are drawn, rounded down; ties go to the smaller id.

    Defined cases: null and empty texts have no features, weight 0, a score and no rank.  Null ids share one random
    number and come after all others in a tie; rows with equal ids have ranks of their own.  An empty target gives every
    bucket the gain of its smoothed share.  No documents give no rows.
    """
    counted = written(feature_counts(docs, id_col, text_col, orders, buckets), "bucket-counts")
    wanted = feature_counts(target, target_id, target_text, orders, buckets)
    gain = gains(histogram(counted, buckets), histogram(wanted, buckets))
    scored = weighed(counted, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "scores")
    ranks = _ranks(scored.where(F.col("n_words") >= least_words), percent)
    result = scored.join(ranks, "place", "left")
    return result.select("doc_id", "n_words", "n_features", "weight", "score", "rank", "text_hash")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents, all columns; rows equal in id and text are drawn together."""
    chosen = drawn(docs, target, id_col=id_col, text_col=text_col, **options).where("rank IS NOT NULL")
    chosen = chosen.select(F.col("doc_id").alias("drawn_id"), F.col("text_hash").alias("drawn_hash"))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
    )
    same = F.col("id").eqNullSafe(F.col("drawn_id")) & (F.col("hash") == F.col("drawn_hash"))
    return rows.join(chosen, same, "left_semi").select("row.*")
