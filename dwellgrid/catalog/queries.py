"""The catalogue: every operator as a query over the sample tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellgrid import schema
from dwellgrid.catalog.samples import building, question_log
from dwellgrid.operators import asof, dense, dialogue, latest, lookup, profile, questions, rates, retrieval, sketches, vector_index, zones
from dwellgrid.plans import documents, overview
from dwellgrid.schema import ADHOC_ROWS
from dwellgrid.session import shared_folder
from dwellgrid.sources import csv_files, events, sample_tables, store
from dwellgrid.sources.sample_tables import MEETING_SEGMENTS, QUIET_SEGMENTS, REFRESH_SEGMENTS, table, usage
from dwellgrid.streaming import clock_states
from dwellgrid.usage import Usage

Query = Callable[[SparkSession, str], DataFrame]
ZONE_WORDS = {"quiet": QUIET_SEGMENTS, "refresh": REFRESH_SEGMENTS}
STAMP = dt.datetime(2024, 2, 1)  # given, so that the document is the same on every run
ROOM_CODE = "8.003"
ROOM_TEXT = "3.20"
ADHOC_SQL = (
    "SELECT e.space_id, count(*) AS n_events, max(e.hour) AS last_hour, max(s.room_name) AS room_name "
    "FROM events_enriched e JOIN spaces s ON e.space_id = s.uuid "
    "GROUP BY e.space_id ORDER BY n_events DESC, e.space_id"
)


def _events_all(spark: SparkSession, folder: str) -> DataFrame:
    return events.union_events(
        sample_tables.office_events(spark, folder), sample_tables.meeting_events(spark, folder)
    )


def _adhoc(spark: SparkSession, folder: str) -> DataFrame:
    site = building(spark, folder)
    return site.query(ADHOC_SQL, ADHOC_ROWS)


def _with_closed_hours(spark: SparkSession, folder: str) -> Usage:
    """The model with a roll-up as a stream leaves it: the hours that ended half an hour before the newest event."""
    model = usage(spark, folder)
    closed = model.events.agg(F.expr("date_trunc('hour', max(ts) - INTERVAL '30' MINUTE)")).scalar()
    return model.with_rollup(store.hourly_rollup(model.events).where(F.col("hour") < closed))


def _with_stored_states(spark: SparkSession, folder: str) -> Usage:
    """The model with newest events as they stood a day before the log's end, stored and read back."""
    model = usage(spark, folder)
    before = model.events.agg(F.expr("max(ts) - INTERVAL '1' DAY")).scalar()
    path = f"{shared_folder(spark)}/dwellgrid-states/{uuid.uuid4().hex}"
    latest.newest_events(model.events.where(F.col("ts") <= before)).write.parquet(path)
    return model.with_states(spark.read.parquet(path))


def _csv_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event rows as lines of the sensor log's file format, read under its schema."""
    line = F.concat_ws(
        ",",
        F.date_format("ts", "yyyy-MM-dd"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.expr("CAST(timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS STRING)"),
        "space_id",
        F.concat(F.lit('"'), "occupancy", F.lit('"')),
        F.lit(""),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    )
    lines = _events_all(spark, folder).select(line.alias("line"))
    return csv_files.canonical_events(csv_files.parse_lines(lines, schema.EVENT_SCHEMA)).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def _row_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The query side of the vector searches: every row whose id is divisible by 50."""
    rows = table(spark, folder, "embeddings").where(F.col("vec_id") % 50 == 0)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def _hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "place", "vec_id", F.round("score", 6).alias("score"))


def _knn(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(retrieval.nearest(_corpus(spark, folder), _row_queries(spark, folder)))


def _mmr(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(retrieval.diverse_nearest(_corpus(spark, folder), _row_queries(spark, folder)))


def _contexts(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.nearest(_corpus(spark, folder), _row_queries(spark, folder))
    found = retrieval.contexts(hits, table(spark, folder, "documents"))
    return found.select("query_id", "n_texts", "n_without_text", "context")


def _knn_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same search through a stored inverted list; approximate, its recall is measured in the tests."""
    corpus = vector_index.unit_vectors(_corpus(spark, folder), "vec_id", "vec")
    cells = vector_index.fit_cells(corpus)
    if cells is None:
        return _hits(retrieval.nearest(_corpus(spark, folder), _row_queries(spark, folder)))
    path = f"{shared_folder(spark)}/dwellgrid-index/{uuid.uuid4().hex}"
    vector_index.save_index(vector_index.filed_rows(corpus, cells), cells, path)
    asked = vector_index.unit_vectors(_row_queries(spark, folder), "query_id", "vec", "query_id")
    return _hits(vector_index.search(*vector_index.load_index(spark, path), asked))


def _storey_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per listed storey; floors may have several."""
    listed = lookup.list_floors(usage(spark, folder))
    name = F.concat_ws(" ", F.col("floor").cast("string"), "storey_name")
    return listed.select(name.alias("query_id"), F.concat(F.lit("rooms of storey "), "storey_name").alias("text"))


def _row_search(spark: SparkSession, folder: str) -> DataFrame:
    """Room documents nearest to the storey names, by words."""
    model = usage(spark, folder)
    text = retrieval.row_text(model.spaces, ["display_name", "room_name", "storey_name", "spaceType"])
    rooms = model.spaces.select(F.col("uuid").cast("bigint").alias("vec_id"), text.alias("text"))
    hits = retrieval.lexical_nearest(retrieval.lexical_index(rooms), _storey_questions(spark, folder))
    return hits.withColumn("score", F.round("score", 6))


def _indexed_search(spark: SparkSession, folder: str) -> DataFrame:
    """The index as one path: rows to documents, chunks, word vectors and gated search."""
    index = documents.document_index(documents.row_documents(usage(spark, folder)))
    hits = retrieval.lexical_nearest(index, _storey_questions(spark, folder), key="chunk_id")
    return hits.withColumn("score", F.round("score", 6))


def _stored_search(spark: SparkSession, folder: str) -> DataFrame:
    """As ``_indexed_search``, through the vector table: built and stored, replaced by a rebuild, loaded, searched."""

    def build() -> DataFrame:
        return documents.document_index(documents.row_documents(usage(spark, folder)))

    path = f"{shared_folder(spark)}/dwellgrid-vectors/{uuid.uuid4().hex}"
    store.load_vectors(spark, path, build)
    store.load_vectors(spark, path, build, rebuild=True)
    index = store.load_vectors(spark, path, build)
    hits = retrieval.lexical_nearest(index, _storey_questions(spark, folder), key="chunk_id")
    return hits.withColumn("score", F.round("score", 6))


def _state_at_noon(spark: SparkSession, folder: str) -> DataFrame:
    """State of every space at noon of each day with events of it, of the day before and of the day after the next."""
    model = usage(spark, folder)
    days = model.events.where("ts IS NOT NULL").select("space_id", F.date_trunc("day", "ts").alias("day")).distinct()
    noons = F.explode(F.expr("transform(array(-12, 12, 60), h -> CAST(day + make_interval(0, 0, 0, 0, h) AS timestamp_ntz))"))
    return asof.state_at(model, days.select("space_id", noons.alias("at")).distinct())


def _clocked_states(spark: SparkSession, folder: str) -> DataFrame:
    """The log as a stream: the last state of every space, stale after 24 hours without an event."""
    base = f"{shared_folder(spark)}/dwellgrid-clock/{uuid.uuid4().hex}"
    before = spark.conf.get(clock_states.STORE_SETTING)
    clock_states.use_rocksdb(spark)
    try:
        # as a pattern, since a stream takes a single file in no other form
        path = f"{folder.rstrip('/')}/event[s].parquet"
        log = spark.readStream.schema(sample_tables.SCHEMAS["events"]).parquet(path)
        changes = clock_states.clocked_states(sample_tables.canonical(log), 24)
        clock_states.append_states(changes, f"{base}/changes", f"{base}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(clock_states.STORE_SETTING, before)
    stored = spark.read.schema(f"{clock_states.CHANGES}, batch int").parquet(f"{base}/changes")
    return clock_states.current_states(stored)


def _rooms_used(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms in use per floor in the last seven days, in the seven before them, and in both, from hourly sketches."""
    found = sketches.room_sketches(usage(spark, folder))
    last = found.agg(F.max("hour")).scalar()
    week, two = last - F.expr("INTERVAL '7' DAY"), last - F.expr("INTERVAL '14' DAY")
    hour = F.col("hour")
    return sketches.distinct_rooms(
        found, ("floor_n",), {"last_week": hour > week, "week_before": (hour > two) & (hour <= week)}
    ).withColumnRenamed("floor_n", "floor")


def _lateness(spark: SparkSession, folder: str) -> DataFrame:
    """Days from order to shipment by month of the order: sketches per day, merged per month."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    daily = sketches.lateness_sketches(rows, F.col("o_orderdate"), F.date_diff("l_shipdate", "o_orderdate"))
    return sketches.lateness_profile(daily).withColumn("bucket", F.to_date("bucket")).withColumnRenamed("bucket", "month")


def _table_description(spark: SparkSession, folder: str) -> DataFrame:
    building(spark, folder).register_views()
    return profile.table_description(spark, "events_enriched")


def _questions(spark: SparkSession, folder: str, order: str) -> DataFrame:
    return questions.label_questions(question_log(spark, folder), order=order)


def _term_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that questions mention: synonyms, and the names, storeys and types of the spaces with all their words."""
    spaces = usage(spark, folder).spaces
    names = F.explode(F.array("room_name", "storey_name", "spaceType")).alias("synonym")
    own = spaces.select(names).distinct().select(F.col("synonym").alias("term"), "synonym")
    terms = profile.synonym_table(spark).unionByName(own)
    return profile.mentioned_terms(question_log(spark, folder), terms, ["conv_id", "turn"])


def _params(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters read from every question, whatever its intent."""
    log = question_log(spark, folder)
    text = questions.normalise(F.btrim("text", F.lit(questions.BLANKS)))
    values = {
        "days": questions.trailing_days("q"),
        "hours": questions.trailing_hours("q"),
        "threshold": questions.threshold_share("q"),
        "first_number": questions.captured_int("q", questions.FIRST_INT),
        "floor": questions.captured_int("q", questions.FLOOR_OF_ROOMS),
        "room_floor": questions.captured_int("q", questions.SHORT_ROOM_CODE),
        "open_ended": questions.is_open_ended("q"),
    }
    return log.withColumn("q", text).selectExpr("conv_id", "turn", *[f"{v} AS {n}" for n, v in values.items()])


def queries() -> dict[str, Query]:
    """Name to ``(spark, folder) -> DataFrame``."""

    def of_usage(operator, *args, **kwargs) -> Query:
        return lambda spark, folder: operator(usage(spark, folder), *args, **kwargs)

    return {
        # sources and views
        "events_all_union": _events_all,
        "events_from_csv_lines": _csv_events,
        "events_enriched": lambda s, d: events.enrich_events(_events_all(s, d)),
        "spaces_clean": lambda s, d: usage(s, d).spaces,
        "hourly_rollup": lambda s, d: store.hourly_rollup(usage(s, d).events),
        "table_counts": lambda s, d: building(s, d).table_counts(),
        "adhoc_capped": _adhoc,
        # rates
        "utilization_by_floor": of_usage(rates.utilization_by_floor, 7),
        "utilization_by_floor_filled": of_usage(rates.utilization_by_floor, 7, fill_missing_with_zero=True),
        "utilization_floor": of_usage(rates.utilization_floor, 3, 7),
        "compare_floors": of_usage(rates.compare_floors, "3", "nation_7", 7),
        "compare_floors_strict": of_usage(rates.compare_floors_strict, [2, 3], 7),
        "busiest_rooms": of_usage(rates.busiest_rooms, days=7, limit=5),
        "busiest_rooms_24h": of_usage(rates.busiest_rooms, hours=24, limit=5),
        "busiest_rooms_of_floor": of_usage(rates.busiest_rooms, 3, days=14, limit=5),
        "peak_hours_floor": of_usage(rates.peak_hours, 3, 5),
        "peak_hours_by_floor": of_usage(rates.peak_hours, 3, 3, rounded=True),
        "kpis_24h": of_usage(rates.kpis, 24),
        "utilization_by_floor_rollup": lambda s, d: rates.utilization_by_floor(_with_closed_hours(s, d), 7),
        "kpis_24h_rollup": lambda s, d: rates.kpis(_with_closed_hours(s, d), 24),
        # latest state
        "rooms_used_in_two_weeks": _rooms_used,
        "lateness_by_month": _lateness,
        "status_floor_now": of_usage(latest.status_floor_now, 3),
        "status_floor_now_stored": lambda s, d: latest.status_floor_now(_with_stored_states(s, d), 3),
        "free_rooms_now_stored": lambda s, d: latest.free_rooms_now(_with_stored_states(s, d), 8, MEETING_SEGMENTS),
        "latest_states": lambda s, d: latest.latest_states(usage(s, d)),
        "clocked_states": _clocked_states,
        "free_rooms_now": of_usage(latest.free_rooms_now, 8, MEETING_SEGMENTS),
        "state_at_noon": _state_at_noon,
        "latest_room_status": of_usage(latest.latest_room_status, ROOM_CODE),
        # dense rates
        "underused_rooms": of_usage(dense.underused_rooms, days=30, threshold=0.10),
        "least_used_rooms": of_usage(dense.underused_rooms, 3, days=30, threshold=None, limit=20),
        "all_rooms_rate": of_usage(dense.all_rooms_with_occ_rate, days=30),
        "dense_hourly_series": of_usage(dense.dense_hourly_series, 3, days=7),
        # zones
        "facility_measures": of_usage(zones.zone_measures, days=14, **ZONE_WORDS),
        "facility_features": of_usage(zones.facility_features, days=14, **ZONE_WORDS),
        "facility_features_join_rows": of_usage(zones.facility_features, days=14, count_mode="join_rows", **ZONE_WORDS),
        "zone_rooms": of_usage(zones.zone_rooms),
        "rank_zones": of_usage(zones.rank_zones, zones.PlanOptions(k=2, days=14), **ZONE_WORDS),
        "rank_zones_now": of_usage(zones.rank_zones, zones.PlanOptions(k=5, hours=1, avoid_quiet=False), **ZONE_WORDS),
        "ranked_zone_rooms": of_usage(zones.ranked_zone_rooms, zones.PlanOptions(k=2, days=14), **ZONE_WORDS),
        # lookups and profile
        "list_floors": of_usage(lookup.list_floors),
        "find_rooms_like": of_usage(lookup.find_rooms_like, ROOM_TEXT),
        "rooms_on_floor": of_usage(lookup.rooms_on_floor, 3),
        "rooms_on_storey": of_usage(lookup.rooms_on_floor, "nation_4"),
        "sensors_for_room": of_usage(lookup.sensors_for_room, ROOM_CODE),
        "data_profile": lambda s, d: building(s, d).data_profile(),
        "space_types": of_usage(profile.space_types),
        "category_context": of_usage(profile.category_context),
        "overview": of_usage(overview.overview, 14),
        "data_overview_7d_30d": of_usage(overview.data_overview),
        "table_description": _table_description,
        "grounding_document": lambda s, d: building(s, d).grounding_document(STAMP),
        "json_records": lambda s, d: profile.json_records(usage(s, d).spaces),
        "synonym_terms": lambda s, d: profile.map_synonyms(question_log(s, d)).select(
            "conv_id", "turn", F.array_join("terms", ", ").alias("terms")
        ),
        "term_mentions": _term_mentions,
        # question log and dialogue
        "question_intents": lambda s, d: _questions(s, d, "specific"),
        "question_intents_legacy": lambda s, d: _questions(s, d, "legacy"),
        "question_params": _params,
        "dialogue_last8": lambda s, d: dialogue.last_turns(table(s, d, "conversations")),
        # retrieval
        "row_documents": lambda s, d: documents.row_documents(usage(s, d)),
        "document_chunks": lambda s, d: retrieval.chunks(table(s, d, "documents")),
        "document_chunks_by_separator": lambda s, d: retrieval.separator_chunks(table(s, d, "documents")),
        "knn_cosine_gated": _knn,
        "mmr_rerank": _mmr,
        "context_per_query": _contexts,
        "row_search": _row_search,
        "indexed_search": _indexed_search,
        "stored_search": _stored_search,
        "knn_indexed": _knn_indexed,
    }


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship query: floor rate of the last seven days for every floor."""
    return rates.utilization_by_floor(usage(spark, folder), 7)
