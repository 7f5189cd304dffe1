"""From raw documents to training sequences: toxic documents out, repeated lines out, near copies out, then packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm import line_dedup, packing, simhash, toxicity
from dwellgrid.llm.common import DOCUMENT_COLUMNS, checkpointed, documents, id_and_text, ship_package, table, written
from dwellgrid.llm.components import components


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, unchanged.

    A null text is scored as empty and stays null.  Without labels of both classes nothing is rejected.
    """
    model = toxicity.train(id_and_text(docs), table(spark, sf_dir, "labels"))
    score = toxicity.score(F.coalesce(F.col("text"), F.lit("")), model)
    return docs.select(DOCUMENT_COLUMNS).where(score < toxicity.DECISION)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the lines that it keeps; ``n_chars`` follows the new text.  A null text becomes empty."""
    kept = line_dedup.deduplicated(docs, extra=("lang", "source"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(DOCUMENT_COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, unchanged: the one with the smallest id.

    A row is known by its id and its text, so an id repeated with other texts loses only the rows that are copies.  Within
    a group equal ids are decided by the hash of the text, and rows without an id come after all others.  Of rows without
    an id that are alike one stays; rows repeated with one id and one text are one document and stay as they are.
    """
    ship_package(spark)
    rows = docs.select(DOCUMENT_COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    fp = simhash.fingerprint_of(F.coalesce("text", F.lit("")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    marked = checkpointed(rows.select("doc_id", "text_hash", fp.alias("fp")))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min(place).alias("first")))
    roots = components(simhash.links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    grouped = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("first").alias("first"))
    staying = checkpointed(grouped.select(F.col("first.doc_id").alias("s_id"), F.col("first.text_hash").alias("s_hash")))
    same_text = F.col("text_hash") == F.col("s_hash")
    named = rows.join(staying, (F.col("doc_id") == F.col("s_id")) & same_text, "left_semi")
    nameless = rows.where("doc_id IS NULL").join(staying.where("s_id IS NULL"), same_text, "left_semi")
    one = nameless.groupBy("text_hash").agg(F.min(F.struct(*DOCUMENT_COLUMNS)).alias("row")).select("row.*")
    return named.select(DOCUMENT_COLUMNS).unionByName(one)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence, place and token ids (unsigned 32-bit little-endian)."""
    return packing.packed(docs, with_ids=True).drop("cost")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_copies),
    ("packing", into_sequences),
]

# The model's scores and the fingerprints are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written to the shared folder and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
