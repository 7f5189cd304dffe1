"""Row counts, data profile and table descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.functions.clock import whole
from dwellgrid.operators.lookup import list_floors
from dwellgrid.usage import BROADCAST_BYTES, Usage

# Words users say for the terms of the data.
SYNONYMS = {
    "occupied": ["busy", "taken"],
    "free": ["available", "vacant", "empty"],
    "meeting room": ["conference room", "vergaderruimte"],
    "floor": ["storey", "level"],
}


# What a broadcast row of the term table takes beyond its letters, estimated generously.
ROW_BYTES = 64

# Fixed value: how many space types a text lists.
MOST_TYPES = 50


def table_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """``source, n``: one row per named source."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, df in sources.items()]
    return reduce(DataFrame.unionByName, counted)


def not_blank(column: Column) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) != ""


def space_types(usage: Usage) -> DataFrame:
    """Distinct non-blank space types, trimmed and sorted."""
    return (
        usage.spaces.where(not_blank(F.col("spaceType")))
        .select(F.trim("spaceType").alias("t"))
        .distinct()
        .orderBy("t")
    )


def category_context(usage: Usage, most: int | None = MOST_TYPES) -> DataFrame:
    """One row of text listing the floors and the space types, as a hint for whoever asks questions.

    At most the first ``most`` types are listed, followed by the number of all where some are left out; None lists all.
    """
    floors = _joined(list_floors(usage).where(F.col("floor").isNotNull()).select(F.col("floor").alias("v")))
    types = _listed(space_types(usage).select(F.col("t").alias("v")), most)
    return floors.select(F.concat(F.lit("Floors: "), "text", F.lit("\nSpace types: "), types.scalar()).alias("context"))


def _listed(values: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` of distinct sorted values as one text, with the number of all where that is more.

    The rows that meet in one task are bounded: the rest is only counted.
    """
    if most is None:
        return _joined(values)
    total = values.agg(F.count("*")).scalar()
    rest = F.when(total > most, F.concat(F.lit(" ("), total, F.lit(" in all)"))).otherwise("")
    return _joined(values.orderBy("v").limit(whole(most, "most"))).select(F.concat("text", rest).alias("text"))


def _joined(values: DataFrame) -> DataFrame:
    """The values of a short sorted list as one text; ``v`` keeps its own order, numeric or textual."""
    return values.agg(F.concat_ws(", ", F.sort_array(F.collect_list("v")).cast("array<string>")).alias("text"))


def data_profile(usage: Usage, office: DataFrame, meeting: DataFrame, most: int | None = MOST_TYPES) -> DataFrame:
    """One row: events per source, cleaned rooms, time span, floors and space types (as comma-separated text).

    Both logs are counted and spanned in one pass.  Of many types the first ``most`` are listed, see ``category_context``.
    """
    logs = office.select("ts", F.lit(1).alias("office")).unionByName(meeting.select("ts", F.lit(0).alias("office")))
    floors = _joined(list_floors(usage).where(F.col("floor").isNotNull()).select(F.col("floor").alias("v")))
    types = _listed(space_types(usage).select(F.col("t").alias("v")), most)
    return logs.agg(
        F.count_if(F.col("office") == 1).alias("rows_office"),
        F.count_if(F.col("office") == 0).alias("rows_meeting"),
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
    ).select(
        "rows_office",
        "rows_meeting",
        usage.spaces.agg(F.count("*")).scalar().alias("rooms"),
        "ts_min",
        "ts_max",
        floors.scalar().alias("floors"),
        types.scalar().alias("space_types"),
    )


def synonym_table(spark: SparkSession) -> DataFrame:
    """``term, synonym`` pairs."""
    pairs = [(term, word) for term, words in SYNONYMS.items() for word in words]
    return spark.createDataFrame(pairs, "term string, synonym string")


def map_synonyms(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``terms``: the distinct terms whose synonyms the text contains as words, sorted.

    For this short table the text is split into words once, in place; :func:`mentioned_terms` takes a table of any size.
    """
    lowered = F.lower(F.col(column))
    words = sorted({part for synonyms in SYNONYMS.values() for word in synonyms for part in word.split()})
    said = F.array_intersect(F.split(lowered, "[^a-z0-9]+"), F.array(*map(F.lit, words)))

    def stands(synonym: str) -> Column:
        parts = [F.array_contains("_said", part) for part in synonym.split()]
        if len(parts) > 1:  # the pattern is tried only where all words of the phrase stand alone
            parts.append(lowered.rlike(rf"(^|[^a-z0-9]){synonym}([^a-z0-9]|$)"))
        return reduce(lambda a, b: a & b, parts)

    hits = [F.when(reduce(lambda a, b: a | b, map(stands, ws)), F.lit(term)) for term, ws in SYNONYMS.items()]
    found = texts.withColumn("_said", said).withColumn("terms", F.array_sort(F.array_compact(F.array(*hits))))
    return found.drop("_said")


def plain_phrase(text: Column) -> Column:
    """Words of ASCII letters and digits, lower-cased, one blank between them, whatever stands there in the text."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def mentioned_terms(
    texts: DataFrame, terms: DataFrame, key: list[str], column: str = "text", most_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``*key, term``: the distinct terms of a table (``term, synonym``) that each text mentions as whole words.

    Texts are cut once into their runs of one word up to the words of the longest synonym, which meet the table by
    equality: the work per text does not depend on the number of terms, and no pattern is tried.  The table's rows are
    counted and measured first.  Up to ``most_bytes`` it is broadcast, and only mentions are shuffled; a larger one meets
    the distinct runs of every text in a join by their words, where adaptive execution may split a word that stands in
    very many texts.

    Defined cases: letters are compared as :func:`plain_phrase` has them; synonyms and texts without words mention
    nothing, as do nulls.  Texts with one key count as one text.  A null key is a key like any other.
    """
    phrases = terms.select(F.col("term").alias("_term"), plain_phrase(F.col("synonym")).alias("_run"))
    phrases = phrases.where("_term IS NOT NULL AND _run <> ''").distinct()
    sizes = F.sum(F.octet_length("_run") + F.octet_length(F.col("_term").cast("string")) + ROW_BYTES)
    longest, size = phrases.agg(F.max(F.size(F.split("_run", " "))), sizes).first()
    words = F.split(plain_phrase(F.col(column)), " ")
    runs = [
        F.expr(f"transform(sequence(0, size(_words) - {n}), i -> array_join(slice(_words, i + 1, {n}), ' '))")
        if n > 1 else F.col("_words")
        for n in range(1, (longest or 1) + 1)
    ]
    runs = [F.when(F.size("_words") >= n, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs, 1)]
    cut = texts.select(*key, words.alias("_words"))
    found = cut.select(*key, F.explode(F.array_distinct(F.concat(*runs))).alias("_run"))
    if (size or 0) <= most_bytes:
        met = found.join(F.broadcast(phrases), "_run")
    else:  # an expression of its own, so that the distinct table's partitioning does not bind the join
        met = found.join(phrases.select("_term", F.concat("_run", F.lit("")).alias("_run")), "_run")
    return met.select(*key, F.col("_term").alias("term")).distinct()


def json_safe(df: DataFrame) -> list[Column]:
    """Columns of a frame fit for JSON: times as UTC text with offset, dates as midnight, NaN as NULL."""
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
            value = F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit("+0000"))
        elif isinstance(field.dataType, (T.TimestampNTZType, T.DateType)):
            value = F.concat(F.date_format(value.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), F.lit("+0000"))
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        columns.append(value.alias(field.name))
    return columns


def json_records(df: DataFrame) -> DataFrame:
    """``record``: every row as one JSON object, NULLs kept."""
    return df.select(F.to_json(F.struct(*json_safe(df)), {"ignoreNullFields": "false"}).alias("record"))


def table_description(spark: SparkSession, name: str, rows: int = 5) -> DataFrame:
    """One row describing a view or table: exists flag, schema and a few sample records.

    A missing table gives ``exists = false`` with empty lists.
    """
    if not spark.catalog.tableExists(name):
        return spark.range(1).select(
            F.lit(name).alias("name"),
            F.lit(False).alias("exists"),
            F.lit("[]").cast("string").alias("schema"),
            F.array().cast("array<string>").alias("sample_rows"),
        )
    df = spark.table(name)
    columns = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.lit(True).alias("nullable"))
        for f in df.schema.fields
    ]
    # the first rows in the order of all columns, so that the sample is the same on every run
    sample = json_records(df.orderBy(*df.columns).limit(whole(rows, "rows")))
    return sample.agg(F.sort_array(F.collect_list("record")).alias("sample_rows")).select(
        F.lit(name).alias("name"), F.lit(True).alias("exists"), F.to_json(F.array(*columns)).alias("schema"),
        "sample_rows",
    )
