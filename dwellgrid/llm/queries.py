"""The numbered queries: each operator over its whole table, in the columns that its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.llm import (
    bpe,
    decontamination,
    exact_dedup,
    line_dedup,
    multiset_hash,
    packing,
    resampling,
    sharding,
    simhash,
    token_files,
    toxicity,
    url_filter,
    whitening,
)
from dwellgrid.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.deduplicated(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_documents(token_files.write_token_files(documents(spark, folder)))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, folder))
    return groups.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.contiguous_shards(documents(spark, folder)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(documents(spark, folder)).drop("cost", "ids")


def op7_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return multiset_hash.edited_neighbours(documents(spark, folder))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(documents(spark, folder)).drop("ids", "decoded")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(documents(spark, folder), table(spark, folder, "labels"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judged(table(spark, folder, "pages"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.judged(documents(spark, folder), table(spark, folder, "benchmark"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.component_rows(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))  # beyond 64 bits an error


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.drawn(documents(spark, folder), table(spark, folder, "benchmark")).drop("n_words", "text_hash")


def queries() -> dict[str, Query]:
    found = (
        op1_exact_dedup,
        op2_line_dedup,
        op3_token_files,
        op4_simhash,
        op5_sharding,
        op6_packing,
        op7_multiset_hash,
        op8_bpe,
        op9_toxicity,
        op10_url_filter,
        op11_decontamination,
        op12_whitening,
        op13_resampling,
    )
    return {query.__name__: query for query in found}
