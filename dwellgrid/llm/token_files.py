"""Token ids in a binary format: blocks of ids as byte or bit planes, each plane compressed, with a chunk index."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellgrid.llm.common import id_and_text, ship_package, written
from dwellgrid.llm.tokens import encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 0
BLOCK_IDS = 1 << 16
LEVEL = 3
STEP = 1024  # documents that are encoded at once
# A chunk: where it lies (shard, chunk, first id), how many ids it holds, its planes, and the documents in it
# (their ordinal in the shard, id, and how many of their ids lie before and in this chunk and in all).
CHUNK_SCHEMA = (
    "shard int, chunk long, first long, n_ids int, planes array<binary>, ordinals array<long>, doc_ids array<long>, "
    "skips array<long>, counts array<long>, totals array<long>"
)
_CHUNK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary())] + [pa.list_(pa.int64())] * 5
DOCUMENT_LISTS = ["ordinals", "doc_ids", "skips", "counts", "totals"]
PIECE_SCHEMA = "shard int, ordinal long, doc_id long, skip long, total long, first long, crc long, ids binary"


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Transpose a block of unsigned 32-bit ids: four byte planes or 32 bit planes, lowest first, each compressed."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "bit":
        bits = np.unpackbits(by_byte.reshape(4, -1, 1), axis=2, bitorder="little")
        planes = [np.packbits(bits[i // 8, :, i % 8]) for i in range(32)]
    else:
        planes = list(by_byte)
    press = zstandard.ZstdCompressor(level=LEVEL).compress
    return [press(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The block's ids; the number of planes tells their kind."""
    unpress = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(unpress(p), np.uint8) for p in planes]
    if len(raw) == 32:
        bits = np.stack([np.unpackbits(p, count=n_ids) for p in raw], axis=1)
        return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(raw, axis=1)).reshape(-1).view("<u4")


class _Shard:
    """Cuts a stream of documents' ids into blocks of ``size`` ids."""

    def __init__(self, shard: int, size: int, kind: str):
        self.shard, self.size, self.kind = shard, size, kind
        self.chunk = self.first = self.ordinal = self.held = 0
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int, int | None, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.size - self.held]
            self.parts.append(part)
            self.docs.append((self.ordinal, doc_id, at, len(part), len(ids)))
            self.held += len(part)
            at += len(part)
            if self.held == self.size:
                yield self.close()
        self.ordinal += 1

    def close(self) -> tuple:
        ids = np.concatenate(self.parts)
        row = (self.shard, self.chunk, self.first, len(ids), to_planes(ids, self.kind), *map(list, zip(*self.docs)))
        self.chunk, self.first, self.held = self.chunk + 1, self.first + len(ids), 0
        self.parts, self.docs = [], []
        return row


def chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    planes: str = "byte",
) -> DataFrame:
    """The rows of the token files, see ``CHUNK_SCHEMA``: documents in ascending id over the shards and within each.

    Range partitions by id become shards; a task streams its sorted documents and holds one block of ids.
    """
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, True).ids
        shard = _Shard(TaskContext.get().partitionId(), block_ids, planes)

        def out(row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNK_TYPES)], names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), STEP):
                found = ids_of(texts.slice(at, STEP).to_pylist())
                for doc_id, ids in zip(doc_ids[at : at + STEP], found):
                    for row in shard.add(doc_id, np.append(ids, np.uint32(end_id))):
                        yield out(row)
        if shard.held:
            yield out(shard.close())

    ship_package(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, CHUNK_SCHEMA)


def write_token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the chunks as files in the shared folder and return them as read back.

    The files are Parquet written by Spark, one binary column entry per compressed plane: Spark's commit protocol keeps
    lost or repeated tasks from leaving half a file, and any store that Spark can reach will do.
    """
    return written(chunks(docs, **options), "token-files")


def shard_offsets(files: DataFrame) -> DataFrame:
    """``shard, base``: ids before each shard.  Shards' totals, one row each, are all that meets in one task."""
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def chunk_index(files: DataFrame) -> DataFrame:
    """``shard, chunk, first, n_ids, start``: where each chunk's ids lie in its shard and, as ``start``, in the corpus."""
    index = files.select("shard", "chunk", "first", "n_ids").join(F.broadcast(shard_offsets(files)), "shard")
    return index.select("shard", "chunk", "first", "n_ids", (F.col("base") + F.col("first")).alias("start"))


def read_documents(files: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    Every chunk is decoded on its own.  A document within one chunk is finished there; the parts of a document over
    several chunks meet by document and are summed up in order, so a task holds the ids of one document at most.

    Defined cases: null and empty texts consist of the end id.  Null ids come first; rows with equal ids are ordered by
    text and stay apart by their ordinal in the shard.  No rows give no rows.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        kinds = [pa.int32()] + [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            for chunk in batch.to_pylist():
                ids = from_planes(chunk["planes"], chunk["n_ids"])
                rows, at = [], 0
                docs = (chunk[c] for c in DOCUMENT_LISTS)
                for ordinal, doc_id, skip, count, total in zip(*docs):
                    part = ids[at : at + count].tobytes()
                    whole = count == total
                    crc = zlib.crc32(part) if whole else None
                    first = chunk["first"] + at - skip
                    rows.append((chunk["shard"], ordinal, doc_id, skip, total, first, crc, None if whole else part))
                    at += count
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def sum_up(parts: pa.Table) -> pa.Table:
        crc, rows = 0, parts.sort_by("skip")
        for part in rows.column("ids"):
            crc = zlib.crc32(part.as_buffer(), crc)
        kept = rows.slice(0, 1).select(["shard", "doc_id", "total", "first"])
        return kept.append_column("crc", pa.array([crc], pa.int64()))

    ship_package(files.sparkSession)
    pieces = files.select("shard", "first", "n_ids", "planes", *DOCUMENT_LISTS).mapInArrow(decode, PIECE_SCHEMA)
    whole = pieces.where(F.col("ids").isNull()).select("shard", "doc_id", "total", "first", "crc")
    parted = pieces.where(F.col("ids").isNotNull()).groupBy("shard", "ordinal")
    summed = parted.applyInArrow(sum_up, "shard int, doc_id long, total long, first long, crc long")
    offsets = shard_offsets(files)
    return whole.unionByName(summed).join(F.broadcast(offsets), "shard").select(
        "doc_id",
        (F.col("base") + F.col("first")).alias("start"),
        F.col("total").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )
