"""An inverted list over unit vectors: coarse cells fitted on a sample, all rows filed, queries sent to their nearest cells.

A query meets only the rows of the cells that it visits.  How many cells that is follows from the data: the fit measures on
its sample how many cells hold the wanted share of true neighbours.  Data in clusters need few, data without any many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.functions.clock import whole
from dwellgrid.schema import RETRIEVAL_K, SCORE_GATE

SAMPLE_ROWS = 8192  # rows that the cells are fitted on, chosen by the hash of their id
SAMPLE_QUERIES = 512  # of them, asked to find out how many cells a query must visit
ROWS_PER_CELL = 32  # of the sample
MOST_CELLS = 1024
COPIES = 2  # cells in which a row is filed
RECALL = 0.95  # share of the sample's true neighbours that the visited cells hold
ROUNDS = 12
ROWS_PER_BLOCK = 1 << 14  # filed rows that one task scores at a time
QUERIES_PER_BLOCK = 1 << 12


@dataclass(frozen=True)
class Cells:
    """``centres``: unit vectors, one per cell.  ``visits``: cells that a query visits.  ``found``: share of the sample's
    true neighbours that lie in them."""

    centres: np.ndarray
    visits: int
    found: float


def unit_vectors(rows: DataFrame, id_col: str, vec_col: str, out: str = "vec_id") -> DataFrame:
    """``out, vec``: vectors of length one; null, zero and non-finite vectors are left out.  Ids keep their type."""
    vec = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    measured = rows.select(F.col(id_col).alias(out), vec.alias("vec")).withColumn("norm", norm)
    usable = measured.where("norm > 0 AND norm < double('infinity')")  # a null entry makes the sum null
    return usable.select(out, F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))


def _nearest_cells(unit: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` cells nearest to each vector, nearest first; equal ones by number."""
    return np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :most]


def fit_cells(unit: DataFrame, k: int = RETRIEVAL_K, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS,
              copies: int = COPIES) -> Cells | None:
    """Cells fitted on a sample of ``vec_id, vec`` by spherical k-means; None without vectors.

    The sample is the rows with the smallest hash of their id, at most ``sample_rows`` in all: the same rows on every run,
    and all that the driver receives.  True neighbours in the sample are farther away than those among all rows, so the
    number of cells to visit errs on the safe side.
    """
    whole(k, "k", 1)
    chosen = unit.select("vec", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec").limit(whole(sample_rows, "sample_rows", 1))
    vectors = [r["vec"] for r in chosen.collect()]
    if not vectors:
        return None
    if len({len(v) for v in vectors}) > 1:
        raise ValueError("vectors of different lengths")
    sample = np.array(vectors)
    n_cells = max(1, min(MOST_CELLS, len(sample) // ROWS_PER_CELL))
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:n_cells]]
    for _ in range(ROUNDS):
        own = _nearest_cells(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    asked = sample[:SAMPLE_QUERIES]
    true = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, : k + 1]  # the query itself is one of them
    filed = _nearest_cells(sample, centres, copies)
    order = np.argsort(_nearest_cells(asked, centres, n_cells), axis=1)  # place of each cell in the query's own order
    first = np.min(np.take_along_axis(order[:, None, :].repeat(true.shape[1], 1), filed[true], axis=2), axis=2)
    first = first[true != np.arange(len(asked))[:, None]]
    shares = np.array([np.mean(first < v) for v in range(1, n_cells + 1)]) if len(first) else np.ones(n_cells)
    visits = int(np.argmax(shares >= min(recall, shares[-1]))) + 1
    return Cells(centres, visits, float(shares[visits - 1]))


def _in_cells(unit: DataFrame, id_name: str, centres: np.ndarray, most: int) -> DataFrame:
    """``cell, id, vec``: every vector once per cell among its ``most`` nearest."""
    id_type = unit.schema[id_name].dataType
    vec_type = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField(id_name, id_type), T.StructField("vec", vec_type)])

    def file(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                vecs = some.column("vec")
                widths = np.unique(np.asarray(vecs.value_lengths()))
                if widths.tolist() != [centres.shape[1]]:
                    raise ValueError(f"vectors of different lengths: {[centres.shape[1], *widths.tolist()]}")
                unit_rows = np.asarray(vecs.flatten()).reshape(some.num_rows, -1)
                near = np.argsort(-(unit_rows @ centres.T), axis=1, kind="stable")[:, :most]
                take = pa.array(np.repeat(np.arange(some.num_rows), near.shape[1]))
                arrays = [pa.array(near.ravel().astype(np.int32)), some.column(id_name).take(take), vecs.take(take)]
                yield pa.RecordBatch.from_arrays(arrays, ["cell", id_name, "vec"])

    return unit.select(id_name, "vec").mapInArrow(file, schema)


def filed_rows(unit: DataFrame, cells: Cells, copies: int = COPIES) -> DataFrame:
    """``cell, vec_id, vec``: the index, every row in the ``copies`` cells nearest to it."""
    return _in_cells(unit, "vec_id", cells.centres, copies)


def save_index(filed: DataFrame, cells: Cells, folder: str) -> None:
    """The filed rows by cell and the cells beside them; an existing index is not overwritten."""
    path = folder.rstrip("/")
    filed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    centres = [(i, c.tolist(), cells.visits, cells.found) for i, c in enumerate(cells.centres)]
    schema = "cell int, centre array<double>, visits int, found double"
    filed.sparkSession.createDataFrame(centres, schema).coalesce(1).write.parquet(f"{path}/cells")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, Cells]:
    """What :func:`save_index` stored; reading a query's cells leaves the folders of all others closed."""
    path = folder.rstrip("/")
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/cells").collect())  # at most MOST_CELLS
    return spark.read.parquet(f"{path}/rows"), Cells(np.array([r[1] for r in rows]), rows[0][2], rows[0][3])


def search(filed: DataFrame, cells: Cells, queries: DataFrame, k: int = RETRIEVAL_K, gate: float | None = SCORE_GATE,
           visits: int | None = None, rows_per_block: int = ROWS_PER_BLOCK,
           queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """``query_id, place, vec_id, score``: the best ``k`` rows by cosine among the visited cells, score at least ``gate``.

    ``queries`` has ``query_id, vec`` as from :func:`unit_vectors`.  A cell with many rows or queries is dealt over several
    tasks: its rows in blocks, its queries in blocks, every pair of blocks once.  So a cell that holds a third of all rows
    costs more tasks and no larger ones; the numbers of blocks come from counts per cell, a row each.  Scores of visited
    rows are exact; equal scores are ordered by ``vec_id``.
    """
    whole(k, "k", 1)
    asked = _in_cells(queries, "query_id", cells.centres, min(visits or cells.visits, len(cells.centres)))

    def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count("*") / whole(size, name, 1)).cast("int").alias(name))

    sizes = blocks(filed, rows_per_block, "row_blocks").join(blocks(asked, queries_per_block, "query_blocks"), "cell")
    sizes = F.broadcast(sizes)  # one row per cell

    def every(last: str):
        return F.explode(F.sequence(F.lit(0), F.col(last) - 1))

    placed = filed.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("row_blocks")).cast("int").alias("r"), every("query_blocks").alias("q"), "vec_id", "vec"
    )
    waiting = asked.join(sizes, "cell").select(
        "cell", every("row_blocks").alias("r"), F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("q"), "query_id", "vec"
    )
    fields = [queries.schema["query_id"], T.StructField("vec_id", filed.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())]

    def score(known, wanted):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "vec_id", "score"]
        kinds = [wanted.schema.field("query_id").type, known.schema.field("vec_id").type, pa.float64()]
        nothing = pa.table([pa.array([], kind) for kind in kinds], names=names)
        if not known.num_rows or not wanted.num_rows:
            return nothing

        def matrix(table):
            vecs = table.column("vec").combine_chunks()
            return np.asarray(vecs.flatten()).reshape(table.num_rows, -1)

        known = known.sort_by("vec_id")  # so that equal scores keep the order of ids
        corpus, asking, found = matrix(known), matrix(wanted), [nothing]
        ids, query_ids = known.column("vec_id"), wanted.column("query_id")
        for at in range(0, len(asking), 256):
            scores = asking[at : at + 256] @ corpus.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(scores, best, axis=1)
            kept = np.ones(value.shape, bool) if gate is None else value >= gate
            q, _ = np.nonzero(kept)
            columns = [query_ids.take(pa.array(at + q)), ids.take(pa.array(best[kept])), pa.array(value[kept])]
            found.append(pa.table(columns, names=names))
        return pa.concat_tables(found)

    keys = ["cell", "r", "q"]
    hits = placed.groupBy(keys).cogroup(waiting.groupBy(keys)).applyInArrow(score, T.StructType(fields))
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a row may lie in two visited cells
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.select("query_id", "place", "vec_id", "score")
