"""Cost-balanced packing of token ids into sequences of a fixed length."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dwellgrid.llm.common import id_and_text, ship_package
from dwellgrid.llm.tokens import encoder

LENGTH = 2048
TOKENIZER, END_ID = "word_bpe_49k.json", 1
# Sequences that are packed together: bounds the memory of a task and the work of one assignment.
GROUP_SEQUENCES = 2048
TASK_BITS = 33
STEP = 1024  # documents that are encoded at once
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "cost double, ids binary"
)


def attention_cost(length, linear: float = 1.0, quadratic: float = 1.0 / LENGTH):
    """Estimated cost of a piece: a part per token and a part per pair of tokens that attend to each other."""
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of ``lengths`` tokens; ``(document, start, length, sequence, offset)`` per piece.

    As many sequences are opened as the tokens need.  Full stretches of ``capacity`` tokens fill sequences of their own.
    The remaining pieces go, longest first, to the sequence of lowest cost among those with room for the whole piece; if
    none has room, the piece is cut: what the roomiest sequence holds goes there, the rest waits in order of length.
    Equal lengths are taken in document order, equal costs in sequence order.
    """
    pieces, waiting = [], []
    full = 0
    for doc, tokens in enumerate(lengths):
        whole, rest = divmod(int(tokens), capacity)
        pieces += [(doc, i * capacity, capacity, full + i, 0) for i in range(whole)]
        full += whole
        if rest:
            waiting.append((-rest, doc, whole * capacity))
    n = -(-sum(-w[0] for w in waiting) // capacity)
    room, cost = np.full(n, capacity), np.zeros(n)
    heapq.heapify(waiting)
    while waiting:
        negative, doc, start = heapq.heappop(waiting)
        length = -negative
        at = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[at] < length:
            at = int(np.argmax(room))
            heapq.heappush(waiting, (-(length - int(room[at])), doc, start + int(room[at])))
            length = int(room[at])
        pieces.append((doc, start, length, full + at, int(capacity - room[at])))
        room[at] -= length
        cost[at] += attention_cost(length)
    return pieces


def _packed_rows(docs: list, ids: list[np.ndarray], first: int, capacity: int, with_ids: bool) -> tuple[list, int]:
    pieces = assign(np.array([len(i) for i in ids]), capacity)
    rows = []
    for doc, start, length, sequence, offset in pieces:
        part = ids[doc][start : start + length].astype("<u4").tobytes()
        rows.append(
            (
                docs[doc], start, length, zlib.crc32(part), len(ids[doc]), first + sequence, offset,
                float(attention_cost(length)), part if with_ids else None,
            )
        )
    return rows, 1 + max((p[3] for p in pieces), default=-1)


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    group_sequences: int = GROUP_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost, ids``.

    Each task streams its documents, encodes them and packs them in groups of about ``group_sequences`` sequences, so no
    row is shuffled and memory is bounded by the group.  Only the last sequence of a group is padded, by fewer than
    ``length`` tokens.  Sequence ids are unique: the task's number above, a running number below.  ``ids`` (unsigned
    32-bit little-endian) is filled on request only.

    Defined cases: null and empty texts consist of the end id.  Texts longer than a sequence are cut; every id lies in
    exactly one piece.  Equal lengths are packed in input order.  Null and repeated ids are packed like any others, row
    by row.  No rows give no rows.
    """
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"]
    kinds = [pa.int64()] * 7 + [pa.float64(), pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False).ids
        sequence = TaskContext.get().partitionId() << TASK_BITS
        held, arrays, tokens = [], [], 0

        def flush():
            rows, used = _packed_rows(held, arrays, sequence, length, with_ids)
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields), used

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(doc_ids), STEP):
                found = encode(texts.slice(at, STEP).to_pylist())
                for doc, ids in zip(doc_ids[at : at + STEP], found):
                    ids = np.append(ids, np.uint32(end_id))
                    held.append(doc)
                    arrays.append(ids)
                    tokens += len(ids)
                    if tokens >= group_sequences * length:
                        out, used = flush()
                        yield out
                        sequence += used
                        held, arrays, tokens = [], [], 0
        if held:
            yield flush()[0]

    ship_package(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)
