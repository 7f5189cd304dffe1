"""Temporary views under the well-known names, and capped ad-hoc SQL over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dwellgrid.functions.clock import whole
from dwellgrid.sources.events import enrich_events, union_events

FILES = "spark.sql.runSQLOnFiles"


def register_views(spark: SparkSession, office: DataFrame, meeting: DataFrame, spaces: DataFrame) -> list[str]:
    """Register ``events_office, events_meeting, spaces, events_all, events_enriched`` and return the names.

    The views are lazy plans; nothing is read until a query asks for it.
    """
    unified = union_events(office, meeting)
    views = {
        "events_office": office,
        "events_meeting": meeting,
        "spaces": spaces,
        "events_all": unified,
        "events_enriched": enrich_events(unified),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def adhoc(spark: SparkSession, sql: str, rows: int | None = None) -> DataFrame:
    """Run one SELECT over the registered views.

    The text is placed inside a subquery, where Spark's own grammar admits queries only: a statement that changes
    anything, or a second statement, is a parse error.  Relations that name a file are refused.  With ``rows`` at most
    that many rows come back, also when the text has a LIMIT of its own, and the column ``more_rows`` tells on each of
    them whether there are others.
    """
    asked = f"SELECT * FROM (\n{sql}\n) AS asked"
    if rows is not None:
        some = f"{asked} LIMIT {whole(rows, 'rows') + 1}"
        asked = f"SELECT *, count(*) OVER () > {rows} AS more_rows FROM ({some}) AS some LIMIT {rows}"
    files = spark.conf.get(FILES)
    spark.conf.set(FILES, "false")
    try:
        return spark.sql(asked)  # relations are resolved here
    finally:
        spark.conf.set(FILES, files)
