"""Homomorphic multiset hash of documents: paragraphs' vectors summed modulo a power of two."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import BLANKS, id_and_text, ship_package

LANES = 256
LOWEST_ID = -(1 << 63)
LONG_LINE = 64  # characters up to which a line is one paragraph
WORDS_PER_PIECE = 8  # of a longer line, on average
LONG_WORD = 256
_TOKEN = re.compile(" *[^ ]{1,%d}| +" % LONG_WORD)


def _line_pieces(line: str) -> list[str]:
    """A long line cut after words whose checksum says so, and within words without end.

    Where a line is cut depends on the word before the cut alone, so an edit changes no piece but those that it touches.
    All pieces but the first begin with a line feed, which no line holds.
    """
    out, held = [], []
    for token in _TOKEN.findall(line):
        held.append(token)
        word = token.lstrip(" ")
        if len(word) >= LONG_WORD or zlib.crc32(word.encode()) % WORDS_PER_PIECE == 0:
            out.append("".join(held))
            held = ["\n"]
    return out + ["".join(held)] if held != ["\n"] else out


def paragraphs(text: str) -> list[bytes]:
    """The lines that hold more than ASCII white space, long ones in pieces; blank lines are no paragraphs."""
    out: list[bytes] = []
    for line in text.split("\n"):
        if line.strip(BLANKS):
            out += [line.encode()] if len(line) <= LONG_LINE else [p.encode() for p in _line_pieces(line)]
    return out


def multiset_hash(parts: list[bytes]) -> np.ndarray:
    """Sum of the paragraphs' vectors: 256 lanes of +1 or -1 from a 256-bit hash, modulo 2**32.

    The sum does not depend on the order; a paragraph is inserted by adding its hash and deleted by subtracting it.
    Equal multisets have equal sums; others meet in all lanes with negligible probability.  No text that Spark can hold
    (2**31 bytes) has paragraphs enough for a lane to wrap.
    """
    total = np.zeros(LANES, np.int64)
    for at in range(0, len(parts), 4096):  # bounds the memory of long texts
        some = b"".join(hashlib.blake2b(p, digest_size=LANES // 8).digest() for p in parts[at : at + 4096])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, LANES // 8), axis=1)
        total += 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    return total.astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common paragraphs, 0 to 1, from two sums alone.

    The squared length of a sum estimates the number of its paragraphs, that of a difference the number of paragraphs
    that only one side has; the estimate's standard deviation is below 0.09.  Equal sums have likeness 1.
    """
    ours, theirs, between = (x.view(np.int32).astype(np.float64) for x in (a, b, a - b))
    both = float((ours * ours).sum() + (theirs * theirs).sum())
    return 1.0 if not both else float(min(1.0, max(0.0, 1.0 - float((between * between).sum()) / both)))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_hash(text: str, whole: np.ndarray, changed: str) -> np.ndarray:
    """Hash of ``changed`` from the hash of ``text``: only paragraphs from the first difference on are exchanged."""
    start = text.rfind("\n", 0, len(text) - len(text) // 2) + 1
    return whole - multiset_hash(paragraphs(text[start:])) + multiset_hash(paragraphs(changed[start:]))


def as_hex(total: np.ndarray) -> str:
    return total.astype("<u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` per row: the whole text's hash as little-endian 32-bit lanes, in place without shuffle.

    Defined cases: null and empty texts, and texts of blank lines, have the hash zero.  Null and repeated ids pass
    through, row for row; very long texts are hashed 4,096 paragraphs at a time.  No rows give no rows.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [multiset_hash(paragraphs(t.as_py())).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "fingerprint"])

    ship_package(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(hashed, "doc_id long, fingerprint binary")


def _ranges(rows: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """Largest place (``key, digest``) of each non-empty range partition, ascending, and the number of partitions asked
    for.  One row per partition reaches the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.select("key", "digest").repartitionByRange(n, "key", "digest").groupBy(F.spark_partition_id().alias("p"))
    lasts = parts.agg(F.max(F.struct("key", "digest")).alias("last")).collect()
    return sorted((r["last"]["key"], r["last"]["digest"]) for r in lasts), n


def _range_number(key: Column, digest: Column, lasts: list[tuple[int, int]]) -> Column:
    @F.pandas_udf("int")
    def number(keys: pd.Series, digests: pd.Series) -> pd.Series:
        found = [bisect_left(lasts, place) for place in zip(keys.tolist(), digests.tolist())]
        return pd.Series(np.minimum(np.array(found, np.int32), len(lasts) - 1))

    return number(key, digest)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text against its edited text and against the next row in descending id order.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  The edited text takes
    its second half from the next row; after the last row comes the first.

    Texts are shuffled once, by ranges of the id and, for rows that share one, the text's hash.  The row that opens a range also goes to the range before it in the
    order, so that every range streams on its own and holds two texts at a time.

    Defined cases: a null text is empty; empty texts and texts of blank lines have the hash zero and are alike (1.0).
    A text of one line is compared by the pieces of the line, one of a single short line only as a whole.
    Null ids come last; rows with equal ids or none are ordered by falling XXH64 of their texts, equal rows being one
    place in that order.  A single row is its own next row.  No
    rows give no rows.
    """
    ship_package(docs.sparkSession)
    key = F.coalesce(F.col("doc_id"), F.lit(LOWEST_ID))
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long"), "text")
    rows = rows.withColumns({"key": key, "digest": F.xxhash64("text")})
    lasts, n = _ranges(rows)
    lasts = lasts or [(0, 0)]
    numbered = rows.withColumn("part", _range_number(F.col("key"), F.col("digest"), lasts))
    own = F.struct(F.col("part"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("part") + 1, F.lit(len(lasts))).alias("part"), F.lit(True).alias("guest"))
    last = F.get(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("digest")) for k, d in lasts]), F.col("part"))
    ends = last == F.struct("key", "digest")
    placed = numbered.withColumn("to", F.explode(F.when(ends, F.array(own, guest)).otherwise(F.array(own))))
    placed = placed.select("to.part", "to.guest", "key", "digest", "doc_id", "text")
    placed = placed.repartitionById(max(n, len(lasts)), "part")
    ordered = placed.sortWithinPartitions("part", "guest", F.desc("key"), F.desc("digest"), "text").drop("digest")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None  # the range that is read, and its last row: id, text, hash
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                here, is_guest, _, doc_id, text = (batch.column(i)[at].as_py() for i in range(5))
                if here == part and held is None:
                    continue  # further rows with the id of the guest that closed the range
                total = multiset_hash(paragraphs(text))
                if here == part and held is not None:
                    before_id, before, ours = held
                    changed = edited(before, text)
                    theirs = edited_hash(before, ours, changed)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    near = likeness(ours, theirs), likeness(ours, total)
                    out.append((before_id, len(before), digest, as_hex(ours), as_hex(theirs), *near))
                part, held = here, None if is_guest else (doc_id, text, total)
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return ordered.mapInArrow(compare, schema)
