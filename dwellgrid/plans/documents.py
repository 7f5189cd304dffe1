"""Documents for retrieval and the grounding document, composed from several operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.operators import dense, lookup, profile, rates, retrieval
from dwellgrid.usage import Usage

# How this package reads the data.
NOTES = [
    "Ad-hoc queries run inside a subquery, so they can read the views and nothing else.",
    "The state of a space is that of its newest event, however old, unless an age limit is set.",
    "Trailing windows end at the newest event of the log; ts is its time, event_order decides between equal times.",
    "A rate says which hours it counts: observed hours, or all hours of the window.",
]
# Questions to start from.
EXAMPLE_INTENTS = [
    "free meeting rooms now on floor 3",
    "underused rooms last 30 days threshold 0.15",
    "peak hours last 14 days on floor 2",
    "average occupancy per floor last 7 days",
    "top 10 rooms by occupancy past 24 hours",
    "suggest improvements for floor 1 this month",
]
GROUNDING_TABLES = ("events_all", "events_office", "events_meeting", "events_enriched", "spaces")


def row_documents(usage: Usage) -> DataFrame:
    """``source, text`` for all spaces, floor rates of 7 and 30 days, and the 20 busiest and least used rooms.

    Both floor rates come from one pass over the log.
    """
    by_window = ", ".join(f"'utilization_{d}d', occ_rate_percent_{d}d" for d in (7, 30))
    floors = rates.utilization_by_floor_windows(usage, (7, 30)).selectExpr(
        "floor", f"stack(2, {by_window}) AS (source, occ_rate_percent)"
    )
    sources = {
        "spaces": usage.spaces.select("display_name", "room_name", "storey_name", "spaceType"),
        "busiest_7d": rates.busiest_rooms(usage, days=7, limit=20),
        "least_used_30d": dense.underused_rooms(usage, days=30, threshold=None, limit=20),
    }
    return reduce(
        DataFrame.unionByName,
        [retrieval.documents_of(df, name) for name, df in sources.items()],
        floors.select("source", retrieval.row_text(floors, ["floor", "occ_rate_percent"]).alias("text")),
    )


def document_index(documents: DataFrame) -> DataFrame:
    """``chunk_id, term, weight, idf``: the word index over the chunks of ``source, text`` documents.

    Equal documents of one source are one document; its id is the hash of source and text.  Store it with
    :func:`dwellgrid.sources.store.load_vectors`, search it with :func:`dwellgrid.operators.retrieval.lexical_nearest`.
    """
    named = documents.distinct().withColumn("doc_id", F.md5(F.concat_ws("\n", "source", "text")))
    cut = retrieval.chunks(named)
    chunk_id = F.concat_ws("-", "doc_id", F.col("chunk_no").cast("string"))
    return retrieval.lexical_index(cut.select(chunk_id.alias("chunk_id"), F.col("chunk").alias("text")), "chunk_id")


def grounding_document(spark: SparkSession, usage: Usage, generated_at: dt.datetime | None = None) -> DataFrame:
    """``document``: one JSON text with tables, time span, categories, synonyms and examples, stamped ``generated_at``
    (now, if not given).

    Needs the views of :func:`dwellgrid.sources.views.register_views`.  Every part is a one-row aggregate.
    """
    tables = F.struct(*[
        profile.table_description(spark, name)
        .select(F.struct("name", "exists", F.from_json("schema", _SCHEMA_COLUMNS).alias("schema"),
                         "sample_rows").alias("t"))
        .scalar()
        .alias(name)
        for name in GROUNDING_TABLES
    ])
    floors = lookup.list_floors(usage).where(F.col("floor").isNotNull())
    kinds = profile.space_types(usage)
    document = F.struct(
        F.date_format(F.current_timestamp() if generated_at is None else F.lit(generated_at), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"),
        F.array(*[F.lit(n) for n in NOTES]).alias("notes"),
        F.struct(F.col("ts_min"), F.col("ts_max")).alias("data_window"),
        F.struct(
            floors.agg(F.sort_array(F.collect_list("floor"))).scalar().alias("floors"),
            kinds.agg(F.sort_array(F.collect_list("t"))).scalar().alias("space_types"),
        ).alias("dictionaries"),
        tables.alias("tables"),
        F.struct(*[F.array(*[F.lit(w) for w in words]).alias(term) for term, words in profile.SYNONYMS.items()])
        .alias("synonyms"),
        F.array(*[F.lit(e) for e in EXAMPLE_INTENTS]).alias("example_intents"),
    )
    span = usage.events.agg(F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"))
    return span.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


_SCHEMA_COLUMNS = "array<struct<column:string,dtype:string,nullable:boolean>>"


def write_grounding_document(document: DataFrame, path: str) -> None:
    """Write the document as one JSON line under a folder."""
    document.write.mode("overwrite").text(path)
