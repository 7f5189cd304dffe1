"""SimHash near-duplicates: fingerprints grouped by blocks of equal bits, pairs found through a pivot table, verified."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.common import LOWER, UPPER, checkpointed, id_and_text, own_shuffle, ship_package
from dwellgrid.llm.components import components

SHINGLE_WORDS, MAX_BITS = 3, 2
SEED = 42
BITS = 64
# Groups of up to this many fingerprints are compared at once; larger ones are first divided by further bits.
GROUP = 64
DIVISIONS = 3  # after the last one a group differs in 8 bits at most, so it holds 256 fingerprints at most
N_REFERENCES = 24
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
# Reference fingerprints: hashes of their own numbers.
REFERENCES = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(N_REFERENCES)], np.uint64)


def fingerprint(text: str, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Majority bits of the shingles' XXH64; words are cut at ASCII white space and A-Z is lower-cased."""
    words = text.encode().translate(_LOWERED).split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle))))
    hashes = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the memory of long texts
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row's whole text as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (fingerprint(t.as_py(), words_per_shingle) for t in batch.column(1))
            fps = np.fromiter(found, np.uint64, len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(hashed, "doc_id long, fp long")


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of each text (not null) as a column; ``ship_package`` must have run."""

    @F.arrow_udf("long")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))

    return found(text)


def _blocks(free: list[int], max_bits: int) -> list[list[int]]:
    n = 2 * max_bits
    return [free[i * len(free) // n : (i + 1) * len(free) // n] for i in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _divided(mask: int, max_bits: int) -> list[int]:
    """Masks that add ``max_bits`` of ``2 * max_bits`` blocks of the bits outside ``mask``: of two fingerprints that
    differ in at most ``max_bits`` bits, all lying outside ``mask``, some such mask holds no differing bit."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    chosen = combinations(_blocks(free, max_bits), max_bits)
    return [mask | sum(1 << b for block in blocks for b in block) for blocks in chosen]


def _children(parents: list[int], max_bits: int) -> Column:
    """The masks that divide the groups under ``mask``, one of ``parents``."""
    by_parent = {p: F.array(*[F.lit(_signed(c)) for c in _divided(p, max_bits)]) for p in parents}
    if len(by_parent) == 1:
        return by_parent[parents[0]]
    return F.create_map(*[x for p, c in by_parent.items() for x in (F.lit(_signed(p)), c)])[F.col("mask")]


def _candidate_groups(distinct: DataFrame, max_bits: int, group: int) -> DataFrame:
    """``mask, value, fp``: groups that hold both ends of every link, none larger than the last division allows.

    Groups are fingerprints with equal bits under a mask; ``_divided`` says why no link is lost.  Only groups above
    ``group`` members are divided again.  Which pairs of a group are looked at decides the pivot table.
    """
    held, found, parents = distinct.withColumn("mask", F.lit(0).cast("long")), [], [0]
    for division in range(1, DIVISIONS + 1):
        members = held.select(F.explode(_children(parents, max_bits)).alias("mask"), "fp")
        parents = sorted({c for p in parents for c in _divided(p, max_bits)})
        members = members.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        members = members.distinct() if division > 1 else members
        sizes = members.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sizes = sizes.select(own_shuffle(F.col("mask")).alias("mask"), "value", "n")
        sized = checkpointed(members.join(sizes, ["mask", "value"]))
        last = division == DIVISIONS
        found.append((sized if last else sized.where(F.col("n") <= group)).select("mask", "value", "fp"))
        held = sized.where(F.col("n") > group).select("mask", "fp")
        if not last and held.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, found)


def pairs_by_pivots(groups: np.ndarray, table: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs in one group that the pivot table does not discard, in portions.

    ``table`` holds, a row per reference, the distances of all fingerprints; ``groups`` (whole numbers) and the first of
    its rows ascend.  No distance of a near pair differs by more than ``max_bits``.  So a fingerprint meets only those
    that follow within ``max_bits`` of its distance to the first reference; the other references then discard, one after
    the other, pairs with a larger difference in any coordinate.
    """
    place = groups.astype(np.int64) * (BITS + max_bits + 1) + table[0]  # groups stand further apart than the window
    rows = np.arange(len(place))
    lag = 0
    while True:
        lag += 1
        rows = rows[: np.searchsorted(rows, len(place) - lag)]
        rows = rows[place[rows + lag] - place[rows] <= max_bits]  # distances ascend: who is out here stays out
        if not len(rows):
            return
        near = rows
        for distances in table[1:]:
            near = near[np.abs(distances[near + lag] - distances[near]) <= max_bits]
            if not len(near):
                break
        yield near, near + lag


def pivot_order(groups: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group and by distance to the first reference, and the pivot table in it."""
    order = np.lexsort((np.bitwise_count(fps ^ REFERENCES[0]), groups))
    return order, np.bitwise_count(fps[order][None, :] ^ REFERENCES[:, None]).astype(np.int8)


def near_pairs(groups: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs in one group (equal in ``groups``) that differ in at most ``max_bits`` bits.

    Pairs that the pivot table leaves are verified.
    """
    order, table = pivot_order(groups, fps)
    left, right = [order[:0]], [order[:0]]
    for a, b in pairs_by_pivots(groups[order], table, max_bits):
        a, b = order[a], order[b]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        left.append(a[near])
        right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _stars(a: np.ndarray, b: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(member, smallest member)`` that connect what the pairs connect, at most one per fingerprint."""
    label = np.arange(len(fps))
    while True:
        least = np.minimum(label[a], label[b])
        moved = label.copy()
        np.minimum.at(moved, a, least)
        np.minimum.at(moved, b, least)
        moved = moved[moved]
        if np.array_equal(moved, label):
            break
        label = moved
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """``a, b``: links that connect exactly the fingerprints (column ``fp``, distinct) within ``max_bits`` bits."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 3), np.int64)

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            fps = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
            a, b = _stars(*near_pairs(np.cumsum(new), fps, max_bits), fps)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            rows = np.concatenate([rest, rows])
            if not len(rows):
                continue
            last = (rows[:, :2] == rows[-1, :2]).all(axis=1)
            rest, whole = rows[last], rows[~last]  # the last group may go on in the next batch
            if len(whole):
                yield linked(whole)
        if len(rest):
            yield linked(rest)

    ship_package(distinct.sparkSession)
    groups = _candidate_groups(distinct, max_bits, group).repartition("mask", "value")
    return groups.sortWithinPartitions("mask", "value", "fp").mapInArrow(verify, "a long, b long")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id`` (smallest id reachable over links).

    Texts are read once; from then on only 64-bit numbers move.  Equal fingerprints are one node, so copies cost one row
    per task; linked are distinct fingerprints.

    Defined cases: null and empty texts and texts of blanks have fingerprint zero, which links like any other.  Null ids
    are ignored for the smallest id; a component without any id has a null ``component_id``.  Rows repeated with one id
    each get their answer.  No rows give no rows.
    """
    marked = checkpointed(fingerprints(id_and_text(docs, id_col, text_col), words_per_shingle))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
