"""Generic event and customer tables presented as a building.

Customers play the spaces, nations the storeys and event types the sensor states.  Every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid.usage import Usage

# Event types that count as occupied, and the segments that stand for space categories.
OCCUPIED_TYPES = ("click", "view", "purchase")
MEETING_SEGMENTS = ("building",)
QUIET_SEGMENTS = ("household",)
REFRESH_SEGMENTS = ("machinery",)


# Column types of the tables in use.  Stating them saves a pass over the file footers per read.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "orders": "o_orderkey bigint, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_shipdate timestamp_ntz",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The whole log in canonical form.  Microseconds are kept; times carry no zone."""
    return canonical(table(spark, folder, "events"))


def canonical(log: DataFrame) -> DataFrame:
    """Rows of the sample log, or of a stream of it, as events of spaces."""
    active = ", ".join(f"'{kind}'" for kind in OCCUPIED_TYPES)
    return log.selectExpr(
        "CAST(user_id AS STRING) AS space_id",
        "ts",
        f"CASE WHEN event_type IN ({active}) THEN 'occupied' ELSE 'unoccupied' END AS occupancy",
        "ts AS event_time",
        "event_id AS event_order",
        "user_id % 2 = 1 AS is_meeting",
    )


def office_events(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("NOT is_meeting").drop("is_meeting")


def meeting_events(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("is_meeting").drop("is_meeting")


def raw_spaces(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as raw spaces, with a few device labels and unparsable names as real dimensions have them.

    Nations and regions are code tables of fixed size, which Spark broadcasts by their size.  Being left joined on a
    provably unique key, each one leaves the plan of every query that reads none of its columns.
    """
    region = table(spark, folder, "region").coalesce(1).groupBy("r_regionkey").agg(F.min("r_name").alias("r_name"))
    nation = (
        table(spark, folder, "nation")
        .coalesce(1)
        .groupBy("n_nationkey")
        .agg(F.min("n_name").alias("n_name"), F.min("n_regionkey").alias("n_regionkey"))
    )
    placed = (
        table(spark, folder, "customer")
        .join(nation, F.expr("c_nationkey = n_nationkey"), "left")
        .join(region, F.expr("n_regionkey = r_regionkey"), "left")
    )
    return placed.selectExpr(
        "CAST(c_custkey AS STRING) AS uuid",
        "c_name AS sensor_name",
        """CASE WHEN c_custkey % 89 = 88 THEN 'No code'
                ELSE concat(c_nationkey - 2, '.', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ' - ', c_mktsegment,
                            CASE WHEN c_custkey % 97 = 96 THEN ' dynet sensor' ELSE '' END) END AS room_name""",
        "c_mktsegment AS spaceType",
        "CAST(c_nationkey - 2 AS BIGINT) AS storey_floorId",
        "n_name AS storey_name",
        "r_name AS building_name",
    )


def usage(spark: SparkSession, folder: str, **options) -> Usage:
    return Usage.of(
        events(spark, folder).drop("is_meeting"),
        raw_spaces(spark, folder),
        sized_by=table(spark, folder, "customer"),
        **options,
    )
