"""Equivalent SQL per catalogue query, for an independent engine over the same tables.

The statements are written for clarity, not speed: dense rates use a real room-by-hour grid, latest states a window,
and nearest neighbours all pairs.
"""

from __future__ import annotations

from dwellgrid.catalog.question_oracle import question_intents, question_params, synonym_terms, term_mentions
from dwellgrid.catalog.queries import ROOM_CODE, ROOM_TEXT

BASE = """
WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS space_id, ts,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'occupied' ELSE 'unoccupied' END AS occupancy,
         ts AS event_time, event_id AS event_order, user_id % 2 AS parity
  FROM events
),
raw_spaces AS (
  SELECT CAST(c_custkey AS VARCHAR) AS uuid, c_name AS sensor_name,
         CASE WHEN c_custkey % 89 = 88 THEN 'No code'
              ELSE (c_nationkey - 2) || '.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' - ' || c_mktsegment
                   || CASE WHEN c_custkey % 97 = 96 THEN ' dynet sensor' ELSE '' END END AS room_name,
         c_mktsegment AS "spaceType", CAST(c_nationkey - 2 AS BIGINT) AS "storey_floorId",
         n_name AS storey_name, r_name AS building_name
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
),
coded AS (
  SELECT *, trim(room_name) AS label, NULLIF(regexp_extract(trim(room_name), '^([+-]?\\d+\\.[A-Za-z0-9]+)', 1), '') AS code
  FROM raw_spaces
),
sp AS (
  SELECT *, replace(code, '.', '') AS room_id,
         CASE WHEN code LIKE '-%' THEN '-' ELSE '' END || upper(regexp_replace(code, '[^A-Za-z0-9]', '', 'g')) AS room_key,
         code AS display_name, TRY_CAST(split_part(code, '.', 1) AS INTEGER) AS floor_n
  FROM coded
  WHERE code IS NOT NULL AND TRY_CAST(split_part(code, '.', 1) AS INTEGER) IS NOT NULL
    AND lower(label) NOT LIKE '%dynet%' AND lower(label) NOT LIKE '%sensor%'
),
joined AS (
  SELECT e.*, s.*, date_trunc('hour', e.ts) AS hour, CASE WHEN e.occupancy = 'occupied' THEN 1 ELSE 0 END AS flag,
         COALESCE(TRY_CAST(s."storey_floorId" AS INTEGER), s.floor_n) AS floor_key
  FROM ev e JOIN sp s ON e.space_id = s.uuid
),
last AS (SELECT max(ts) AS t FROM ev)
"""


def _days(n: int) -> str:
    return f"ts >= (SELECT t FROM last) - INTERVAL {n} DAY"


def _floor_rates(name: str, days: int) -> str:
    return f"""{name}_h AS (
  SELECT floor_n AS floor, hour, max(flag) AS occ FROM joined WHERE {_days(days)} GROUP BY ALL
), {name} AS (SELECT floor, round(avg(occ) * 100, 1) AS rate FROM {name}_h GROUP BY floor)"""


def _every_floor(value: str, days: int = 7) -> str:
    return f"""{BASE}, {_floor_rates('r', days)}
SELECT f.floor, {value} AS occ_rate_percent
FROM (SELECT DISTINCT floor_n AS floor FROM sp) f LEFT JOIN r ON r.floor = f.floor"""


def _busiest(window: str, limit: int, where: str = "true") -> str:
    return f"""{BASE}, h AS (
  SELECT uuid, room_name, hour, max(flag) AS occ FROM joined WHERE {window} AND {where} GROUP BY ALL
)
SELECT room_name, occ_rate_percent FROM (
  SELECT uuid, room_name, round(avg(occ) * 100, 1) AS occ_rate_percent FROM h GROUP BY ALL
) ORDER BY occ_rate_percent DESC, room_name, uuid LIMIT {limit}"""


def _latest(where: str) -> str:
    return f"""{BASE}, newest AS (
  SELECT * FROM joined WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY ts DESC, event_order DESC, room_name DESC) = 1
)"""


def _grid(days: int, where: str = "true") -> str:
    return f"""{BASE}, rooms AS (
  SELECT uuid, code, room_name FROM sp WHERE {where}
), win AS (SELECT t AS end_ts, t - INTERVAL {days} DAY AS start_ts FROM last),
ticks AS (
  SELECT unnest(generate_series(date_trunc('hour', start_ts), date_trunc('hour', end_ts), INTERVAL 1 HOUR)) AS hour FROM win
), seen AS (
  SELECT uuid, hour, max(flag) AS occ FROM joined WHERE ts BETWEEN (SELECT start_ts FROM win) AND (SELECT end_ts FROM win)
  GROUP BY ALL
), grid AS (
  SELECT r.uuid, r.code, r.room_name, t.hour, COALESCE(s.occ, 0) AS occ
  FROM rooms r CROSS JOIN ticks t LEFT JOIN seen s ON s.uuid = r.uuid AND s.hour = t.hour
), dense AS (SELECT code, room_name, avg(occ) AS occ_rate FROM grid GROUP BY ALL)"""


ON_FLOOR_3 = "COALESCE(TRY_CAST(\"storey_floorId\" AS INTEGER), floor_n) = 3"


def _zones(window: str, join_rows: bool = False) -> str:
    weight = "GREATEST(COALESCE(a.hours, 0), 1)" if join_rows else "1"
    return f"""{BASE}, active AS (
  SELECT uuid, sum(occ) AS occupied_hours, count(*) AS hours
  FROM (SELECT uuid, hour, max(flag) AS occ FROM joined WHERE {window} GROUP BY ALL) GROUP BY uuid
), rooms AS (
  SELECT uuid, floor_n AS floor, upper(substr(split_part(code, '.', 2), 1, 2)) AS zone, room_name,
         CASE WHEN lower("spaceType") LIKE '%household%' THEN 1 ELSE 0 END AS quiet,
         CASE WHEN lower("spaceType") LIKE '%machinery%' THEN 1 ELSE 0 END AS refresh
  FROM sp
), zoned AS (
  SELECT r.floor, r.zone, CAST(sum(a.occupied_hours) AS BIGINT) AS people_hours,
         CAST(sum({weight}) AS BIGINT) AS rooms_in_zone,
         CAST(sum(quiet * {weight}) AS BIGINT) AS quiet_cnt, CAST(sum(refresh * {weight}) AS BIGINT) AS refresh_cnt,
         string_agg(DISTINCT r.room_name, ', ' ORDER BY r.room_name) AS sample_rooms
  FROM rooms r LEFT JOIN active a ON a.uuid = r.uuid GROUP BY r.floor, r.zone
)"""


def _ranked(window: str, k: int, avoid_quiet: bool) -> str:
    quiet = "(1.0 - CAST(0.6 AS DOUBLE) * (quiet_cnt / rooms_in_zone))" if avoid_quiet else "CAST(1 AS DOUBLE)"
    return f"""{_zones(window)}
SELECT floor, zone, people_hours, rooms_in_zone, round_even(quiet_cnt / rooms_in_zone * 100, 1) AS quiet_pct,
       CASE WHEN people_hours IS NOT NULL THEN GREATEST(CAST(people_hours AS DOUBLE) * {quiet}
         * CASE WHEN refresh_cnt > 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 0) END AS score
FROM zoned ORDER BY score DESC NULLS LAST, people_hours DESC NULLS LAST, floor, zone LIMIT {k}"""


def _document(source: str, columns: list[str], rows: str) -> str:
    lines = ", ".join(f"'{c}: ' || CAST(\"{c}\" AS VARCHAR)" for c in sorted(columns))
    return f"SELECT '{source}' AS source, concat_ws(chr(10), {lines}) AS text FROM ({rows})"


def _row_documents_parts() -> tuple[str, str]:
    """The common tables and the rows of the row documents."""

    def floors(days: int, name: str) -> str:
        return (
            f"SELECT f.floor, {name}.rate AS occ_rate_percent FROM (SELECT DISTINCT floor_n AS floor FROM sp) f "
            f"LEFT JOIN {name} ON {name}.floor = f.floor"
        )

    space_columns = ["display_name", "room_name", "storey_name", "spaceType"]
    rate_columns = ["floor", "occ_rate_percent"]
    busiest = """SELECT room_name, rate AS occ_rate_percent FROM (
      SELECT uuid, room_name, round(avg(occ) * 100, 1) AS rate
      FROM (SELECT uuid, room_name, hour, max(flag) AS occ FROM joined WHERE """ + _days(7) + """ GROUP BY ALL) GROUP BY ALL
    ) ORDER BY rate DESC, room_name, uuid LIMIT 20"""
    least = """SELECT code, room_name, round(occ_rate * 100, 1) AS occ_rate_percent FROM dense
      ORDER BY occ_rate_percent, code, room_name LIMIT 20"""
    parts = [
        _document("spaces", space_columns, "SELECT * FROM sp"),
        _document("utilization_7d", rate_columns, floors(7, "r7")),
        _document("utilization_30d", rate_columns, floors(30, "r30")),
        _document("busiest_7d", ["room_name", "occ_rate_percent"], busiest),
        _document("least_used_30d", ["code", "room_name", "occ_rate_percent"], least),
    ]
    return f"{_grid(30)}, {_floor_rates('r7', 7)}, {_floor_rates('r30', 30)}", "\nUNION ALL ".join(parts)


def _row_documents() -> str:
    return "\n".join(_row_documents_parts())


def _lexical(texts: str, key: str) -> str:
    """Word search over the rows ``key, body`` of ``texts``, asked with the name of every storey."""
    split = "unnest(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+')) AS term"
    return f"""{texts}, storeys AS (
  SELECT DISTINCT CAST("storey_floorId" AS INTEGER) AS floor, storey_name FROM raw_spaces WHERE "storey_floorId" IS NOT NULL
), asked AS (SELECT floor || ' ' || storey_name AS query_id, 'rooms of storey ' || storey_name AS body FROM storeys),
uses AS (SELECT {key}, term, count(*) AS uses FROM (SELECT {key}, {split} FROM texts) WHERE term <> '' GROUP BY ALL),
spread AS (SELECT term, ln((SELECT count(*) FROM texts) / count(*)) AS idf FROM uses GROUP BY term),
weighed AS (SELECT {key}, term, uses * idf AS w FROM uses JOIN spread USING (term) WHERE idf > 0),
unit AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM weighed),
q_uses AS (SELECT query_id, term, count(*) AS uses FROM (SELECT query_id, {split} FROM asked) WHERE term <> '' GROUP BY ALL),
q_weighed AS (SELECT query_id, term, uses * idf AS w FROM q_uses JOIN spread USING (term) WHERE idf > 0),
q_unit AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM q_weighed),
scored AS (SELECT query_id, {key}, round(sum(a.w * b.w), 9) AS score FROM q_unit a JOIN unit b USING (term) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS INTEGER) AS place, {key},
  round(score, 6) AS score FROM scored WHERE score >= 0.25 QUALIFY place <= 8"""


def _row_search() -> str:
    lines = ", ".join(
        f"'{c}: ' || \"{c}\"" for c in sorted(["display_name", "room_name", "storey_name", "spaceType"])
    )
    texts = f"texts AS (SELECT CAST(uuid AS BIGINT) AS vec_id, concat_ws(chr(10), {lines}) AS body FROM sp)"
    return _lexical(f"{BASE}, {texts}", "vec_id")


def _indexed_search() -> str:
    head, parts = _row_documents_parts()
    texts = f"""rows_as_text AS ({parts}),
texts AS (
  SELECT md5(concat_ws(chr(10), source, text)) || '-' || CAST(i AS VARCHAR) AS chunk_id,
         substring(text, CAST(i * 720 + 1 AS BIGINT), 800) AS body
  FROM (SELECT source, text, unnest(range(0, GREATEST(1, CAST(ceil((length(text) - 80) / 720.0) AS BIGINT)))) AS i
        FROM (SELECT DISTINCT source, text FROM rows_as_text) WHERE length(text) > 0)
)"""
    return _lexical(f"{head}, {texts}", "chunk_id")


EVENT_KINDS = {
    "space_id": "string", "ts": "timestamp_ntz", "occupancy": "string", "event_time": "timestamp_ntz", "event_order": "bigint",
}
ENRICHED_KINDS = EVENT_KINDS | {"hour": "timestamp_ntz", "day": "timestamp_ntz"}
SPACE_KINDS = {
    "uuid": "string", "sensor_name": "string", "room_name": "string", "spaceType": "string", "storey_floorId": "bigint",
    "storey_name": "string", "building_name": "string", "label": "string", "code": "string", "room_id": "string",
    "room_key": "string", "display_name": "string", "floor_n": "int",
}
ENRICHED = """SELECT space_id, ts, occupancy, event_time, event_order, date_trunc('hour', ts) AS hour,
  CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM ev"""


def _schema_json(kinds: dict[str, str]) -> str:
    return "[" + ",".join(f'{{"column":"{c}","dtype":"{t}","nullable":true}}' for c, t in kinds.items()) + "]"


def _sample(rows: str, kinds: dict[str, str]) -> str:
    """Subquery: the first five rows in the order of all columns as a list of JSON texts."""

    def value(column: str, kind: str) -> str:
        quoted = f'"{column}"'
        return f"strftime({quoted}, '%Y-%m-%d %H:%M:%S') || '+0000'" if kind == "timestamp_ntz" else quoted

    order = ", ".join(f'"{c}" NULLS FIRST' for c in kinds)
    values = ", ".join(f"'{c}': {value(c, t)}" for c, t in kinds.items())
    return f"""(SELECT list(record ORDER BY record) FROM (
      SELECT CAST(to_json({{{values}}}) AS VARCHAR) AS record FROM (SELECT * FROM ({rows}) ORDER BY {order} LIMIT 5)))"""


def _table_description() -> str:
    return f"""{BASE} SELECT 'events_enriched' AS name, true AS exists, '{_schema_json(ENRICHED_KINDS)}' AS schema,
      {_sample(ENRICHED, ENRICHED_KINDS)} AS sample_rows"""


def _grounding_document() -> str:
    """The document put together as text; its fixed texts are written out here once more."""
    notes = [
        "Ad-hoc queries run inside a subquery, so they can read the views and nothing else.",
        "The state of a space is that of its newest event, however old, unless an age limit is set.",
        "Trailing windows end at the newest event of the log; ts is its time, event_order decides between equal times.",
        "A rate says which hours it counts: observed hours, or all hours of the window.",
    ]
    examples = [
        "free meeting rooms now on floor 3", "underused rooms last 30 days threshold 0.15",
        "peak hours last 14 days on floor 2", "average occupancy per floor last 7 days",
        "top 10 rooms by occupancy past 24 hours", "suggest improvements for floor 1 this month",
    ]
    synonyms = (
        '{"occupied":["busy","taken"],"free":["available","vacant","empty"],'
        '"meeting room":["conference room","vergaderruimte"],"floor":["storey","level"]}'
    )
    events = "SELECT space_id, ts, occupancy, event_time, event_order FROM ev"
    tables = {
        "events_all": (events, EVENT_KINDS),
        "events_office": (f"{events} WHERE parity = 0", EVENT_KINDS),
        "events_meeting": (f"{events} WHERE parity = 1", EVENT_KINDS),
        "events_enriched": (ENRICHED, ENRICHED_KINDS),
        "spaces": ("SELECT * FROM sp", SPACE_KINDS),
    }

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def listed(values: list[str]) -> str:
        return "[" + ",".join(f'"{v}"' for v in values) + "]"

    def described(name: str) -> str:
        rows, kinds = tables[name]
        head = f'"{name}":{{"name":"{name}","exists":true,"schema":{_schema_json(kinds)},"sample_rows":'
        return f"{text(head)} || CAST(to_json({_sample(rows, kinds)}) AS VARCHAR) || '}}'"

    moment = "strftime({}(ts), '%Y-%m-%dT%H:%M:%S.%g')"
    floors = """(SELECT string_agg(CAST(f AS VARCHAR), ',' ORDER BY f) FROM (
      SELECT DISTINCT CAST("storey_floorId" AS INTEGER) AS f, storey_name FROM raw_spaces))"""
    kinds = """(SELECT string_agg('"' || t || '"', ',' ORDER BY t) FROM (SELECT DISTINCT trim("spaceType") AS t FROM sp))"""
    head = f'{{"generated_at":"2024-02-01T00:00:00Z","notes":{listed(notes)},"data_window":{{"ts_min":"'
    parts = [
        text(head), moment.format("min"), text('","ts_max":"'), moment.format("max"),
        text('"},"dictionaries":{"floors":['), floors, text('],"space_types":['), kinds, text(']},"tables":{'),
        " || ',' || ".join(described(name) for name in tables),
        text(f'}},"synonyms":{synonyms},"example_intents":{listed(examples)}}}'),
    ]
    return f"{BASE} SELECT {' || '.join(parts)} AS document FROM ev"


NEAREST = """
WITH asked AS (
  SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id % 50 = 0
), scored AS (
  SELECT q.query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.vec) AS score
  FROM asked q CROSS JOIN embeddings e
), hits AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS place,
         vec_id, score
  FROM scored WHERE score >= 0.25 QUALIFY place <= 8
)
"""


def _diverse(k: int = 8, fetch: int = 24) -> str:
    """Every pick as a step of its own: the best hit first, then the largest of 0.3 score - 0.7 likeness to the picks."""
    steps = ["p1 AS (SELECT query_id, 1 AS pick, place FROM cand WHERE place = 1)"]
    for i in range(2, k + 1):
        steps.append(f"""p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT query_id, {i}, place FROM (
  SELECT c.query_id, c.place, row_number() OVER (PARTITION BY c.query_id
           ORDER BY round(0.3::DOUBLE * c.score - 0.7::DOUBLE * max(s.likeness), 12) DESC, c.place) AS best
  FROM cand c JOIN p{i - 1} p ON p.query_id = c.query_id
  JOIN likeness s ON s.query_id = c.query_id AND s.a = c.place AND s.b = p.place
  WHERE c.place NOT IN (SELECT x.place FROM p{i - 1} x WHERE x.query_id = c.query_id)
  GROUP BY c.query_id, c.place, c.score) WHERE best = 1)""")
    return NEAREST.rstrip() + f""", cand AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
  QUALIFY place <= {fetch}
), likeness AS (
  SELECT a.query_id, a.place AS a, b.place AS b,
         list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS likeness
  FROM cand a JOIN cand b ON a.query_id = b.query_id JOIN embeddings x ON x.vec_id = a.vec_id
  JOIN embeddings y ON y.vec_id = b.vec_id
), {', '.join(steps)}
SELECT query_id, CAST(pick AS INTEGER) AS place, vec_id, round(score, 6) AS score FROM p{k} JOIN cand USING (query_id, place)"""


def oracle_sql() -> dict[str, str]:
    """Query name to SQL."""
    found = {
        "events_all_union": f"{BASE} SELECT space_id, ts, occupancy, event_time, event_order FROM ev",
        "events_from_csv_lines": f"""{BASE} SELECT space_id, date_trunc('millisecond', ts) AS ts, occupancy,
            date_trunc('second', event_time) AS event_time, epoch_us(date_trunc('second', ts)) AS event_order FROM ev""",
        "events_enriched": f"""{BASE} SELECT space_id, ts, occupancy, event_time, event_order,
            date_trunc('hour', ts) AS hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM ev""",
        "spaces_clean": f"{BASE} SELECT * FROM sp",
        "hourly_rollup": f"""{BASE} SELECT space_id, date_trunc('hour', ts) AS hour, count(*) AS n_events,
            CAST(sum(CASE WHEN occupancy = 'occupied' THEN 1 ELSE 0 END) AS BIGINT) AS n_occupied,
            CAST(date_trunc('hour', ts) AS DATE) AS event_date FROM ev GROUP BY ALL""",
        "table_counts": f"""{BASE} SELECT 'events_office' AS source, count(*) AS n FROM ev WHERE parity = 0
            UNION ALL SELECT 'events_meeting', count(*) FROM ev WHERE parity = 1
            UNION ALL SELECT 'spaces', count(*) FROM raw_spaces
            UNION ALL SELECT 'spaces_filtered_count', count(*) FROM sp""",
        "adhoc_capped": f"""{BASE} SELECT space_id, count(*) AS n_events, max(hour) AS last_hour,
            max(room_name) AS room_name, count(*) OVER () > 500 AS more_rows FROM joined GROUP BY space_id
            ORDER BY n_events DESC, space_id LIMIT 500""",
        "utilization_by_floor": _every_floor("r.rate"),
        "utilization_by_floor_filled": _every_floor("COALESCE(r.rate, 0)"),
        "utilization_floor": f"""{BASE}, h AS (
            SELECT uuid, hour, max(flag) AS occ FROM joined WHERE {_days(7)} AND floor_key = 3 GROUP BY ALL)
            SELECT count(DISTINCT uuid) AS total_rooms, COALESCE(round(avg(occ) * 100, 1), 0) AS avg_utilization_percent
            FROM h""",
        "compare_floors": f"""{BASE}, h AS (
            SELECT '3' AS floor, hour, max(flag) AS occ FROM joined WHERE {_days(7)} AND floor_key = 3 GROUP BY ALL
            UNION ALL
            SELECT 'nation_7', hour, max(flag) FROM joined WHERE {_days(7)} AND lower(storey_name) = 'nation_7'
            GROUP BY ALL)
            SELECT f.floor, COALESCE(round(avg(occ) * 100, 1), 0) AS occ_rate_percent
            FROM (SELECT unnest(['3', 'nation_7']) AS floor) f LEFT JOIN h ON h.floor = f.floor GROUP BY f.floor""",
        "compare_floors_strict": f"""{BASE}, {_floor_rates('r', 7)}
            SELECT floor, rate AS occ_rate_percent FROM r WHERE floor IN (2, 3)""",
        "busiest_rooms": _busiest(_days(7), 5),
        "busiest_rooms_24h": _busiest("ts >= (SELECT t FROM last) - INTERVAL 24 HOUR", 5),
        "busiest_rooms_of_floor": _busiest(_days(14), 5, "floor_key = 3"),
        "peak_hours_floor": f"""{BASE} SELECT hour, avg(flag) AS occ_rate FROM joined WHERE floor_key = 3
            GROUP BY hour ORDER BY occ_rate DESC, hour LIMIT 5""",
        "peak_hours_by_floor": f"""{BASE} SELECT hour, round(avg(flag) * 100, 1) AS occ_rate_percent FROM joined
            WHERE floor_n = 3 GROUP BY hour ORDER BY occ_rate_percent DESC, hour LIMIT 3""",
        "kpis_24h": f"""{BASE} SELECT count(DISTINCT uuid) AS rooms_covered, avg(flag) AS avg_occ,
            avg(CASE WHEN extract(hour FROM ts) BETWEEN 9 AND 12 THEN flag END) AS am_peak,
            avg(CASE WHEN extract(hour FROM ts) BETWEEN 13 AND 16 THEN flag END) AS pm_peak, 24 AS window_hours
            FROM joined WHERE ts > (SELECT t FROM last) - INTERVAL 24 HOUR""",
        "rooms_used_in_two_weeks": f"""{BASE}, top AS (SELECT max(hour) AS h FROM joined), of_week AS (
              SELECT floor_n AS floor, uuid, bool_or(hour > h - INTERVAL 7 DAY) AS a,
                     bool_or(hour > h - INTERVAL 14 DAY AND hour <= h - INTERVAL 7 DAY) AS b
              FROM joined, top WHERE flag = 1 GROUP BY ALL)
            SELECT f.floor, count(*) FILTER (a) AS last_week, count(*) FILTER (b) AS week_before,
                   count(*) FILTER (a AND b) AS in_all
            FROM (SELECT DISTINCT floor_n AS floor FROM joined) f LEFT JOIN of_week USING (floor) GROUP BY f.floor""",
        "lateness_by_month": """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n,
              min(d) AS least, max(d) AS most, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.9) AS p90,
              quantile_disc(d, 0.99) AS p99
            FROM (SELECT o_orderdate, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""",
        "clocked_states": f"""{BASE}, newest AS (
              SELECT space_id, ts, event_order, occupancy, max(ts) OVER () AS clock FROM ev
              QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY ts DESC, event_order DESC) = 1)
            SELECT space_id, CASE WHEN epoch_ms(ts) + 24 * 3600000 <= epoch_ms(clock - INTERVAL 30 MINUTE) THEN 'stale'
              ELSE occupancy END AS state, ts, event_order FROM newest""",
        "status_floor_now": f"{_latest('floor_key = 3')} SELECT room_name, occupancy, event_time FROM newest",
        "latest_states": f"{_latest('true')} SELECT uuid AS space_id, room_name, occupancy, event_time FROM newest",
        "free_rooms_now": _latest("floor_key = 8 AND \"spaceType\" ILIKE '%building%'")
        + " SELECT room_name, event_time FROM newest WHERE occupancy = 'unoccupied'",
        "latest_room_status": f"""{BASE} SELECT occupancy AS occupancy_raw, event_time, room_name FROM joined
            WHERE room_key = '{ROOM_CODE.replace('.', '')}' OR room_id = '{ROOM_CODE.replace('.', '')}'
            ORDER BY ts DESC, event_order DESC, room_name DESC LIMIT 1""",
        "state_at_noon": f"""{BASE}, noons AS (
              SELECT DISTINCT space_id, CAST(day + h * INTERVAL 1 HOUR AS TIMESTAMP) AS at
              FROM (SELECT DISTINCT space_id, date_trunc('day', ts) AS day FROM ev), (SELECT unnest([-12, 12, 60]) AS h)
            ), one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY space_id, ts ORDER BY event_order DESC) = 1)
            SELECT n.space_id, n.at, e.occupancy, e.event_time, e.ts AS since
            FROM noons n ASOF LEFT JOIN one e ON n.space_id = e.space_id AND n.at >= e.ts""",
        "underused_rooms": f"""{_grid(30)} SELECT code, room_name, round(occ_rate * 100, 1) AS occ_rate_percent
            FROM dense WHERE occ_rate < 0.10""",
        "least_used_rooms": f"""{_grid(30, ON_FLOOR_3)}
            SELECT code, room_name, round(occ_rate * 100, 1) AS occ_rate_percent FROM dense
            ORDER BY occ_rate_percent, code, room_name LIMIT 20""",
        "all_rooms_rate": f"""{_grid(30)}
            SELECT code, room_name, round(occ_rate * 100, 1) AS occ_rate_percent FROM dense""",
        "dense_hourly_series": f"""{_grid(7, ON_FLOOR_3)}
            SELECT uuid AS space_id, code, room_name, hour, CAST(occ AS INTEGER) AS occ FROM grid""",
        "facility_measures": _zones(_days(14))
        + " SELECT floor, zone, people_hours, rooms_in_zone, quiet_cnt, refresh_cnt FROM zoned",
        "facility_features": _zones(_days(14)) + " SELECT * FROM zoned",
        "facility_features_join_rows": _zones(_days(14), join_rows=True) + " SELECT * FROM zoned",
        "zone_rooms": f"""{BASE} SELECT DISTINCT floor_n AS floor,
            upper(substr(split_part(code, '.', 2), 1, 2)) AS zone, room_name FROM sp""",
        "rank_zones": _ranked(_days(14), 2, True),
        "rank_zones_now": _ranked("ts >= (SELECT t FROM last) - INTERVAL 1 HOUR", 5, False),
        "ranked_zone_rooms": f"""WITH best AS ({_ranked(_days(14), 2, True)}), placed AS (
              SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, people_hours DESC NULLS LAST, floor, zone) AS place
              FROM best), names AS ({BASE} SELECT DISTINCT floor_n AS floor,
              upper(substr(split_part(code, '.', 2), 1, 2)) AS zone, room_name FROM sp)
            SELECT CAST(place AS INTEGER) AS place, floor, zone, room_name FROM placed JOIN names USING (floor, zone)""",
        "list_floors": f"""{BASE} SELECT DISTINCT CAST("storey_floorId" AS INTEGER) AS floor, storey_name
            FROM raw_spaces WHERE "storey_floorId" IS NOT NULL""",
        "find_rooms_like": f"""{BASE} SELECT room_name, storey_name FROM sp
            WHERE upper(regexp_replace(display_name, '[^A-Za-z0-9]', '', 'g')) LIKE '%{ROOM_TEXT.replace('.', '')}%'
               OR room_key LIKE '%{ROOM_TEXT.replace('.', '')}%' OR contains(lower(room_name), '{ROOM_TEXT}')
            GROUP BY ALL ORDER BY min(display_name), room_name, storey_name LIMIT 20""",
        "rooms_on_floor": f"{BASE} SELECT DISTINCT code, room_name FROM sp WHERE {ON_FLOOR_3}",
        "rooms_on_storey": f"{BASE} SELECT DISTINCT code, room_name FROM sp WHERE lower(storey_name) = 'nation_4'",
        "sensors_for_room": f"""{BASE} SELECT DISTINCT sensor_name FROM sp
            WHERE room_key = '{ROOM_CODE.replace('.', '')}' OR room_id = '{ROOM_CODE.replace('.', '')}'""",
        "data_profile": f"""{BASE} SELECT
            (SELECT count(*) FROM ev WHERE parity = 0) AS rows_office,
            (SELECT count(*) FROM ev WHERE parity = 1) AS rows_meeting,
            (SELECT count(*) FROM sp) AS rooms, (SELECT min(ts) FROM ev) AS ts_min, (SELECT max(ts) FROM ev) AS ts_max,
            (SELECT string_agg(CAST(f AS VARCHAR), ', ' ORDER BY f) FROM (
               SELECT DISTINCT CAST("storey_floorId" AS INTEGER) AS f, storey_name FROM raw_spaces)) AS floors,
            (SELECT string_agg(t, ', ' ORDER BY t) FROM (
               SELECT DISTINCT trim("spaceType") AS t FROM sp)) AS space_types""",
        "space_types": f"""{BASE} SELECT DISTINCT trim("spaceType") AS t FROM sp WHERE trim("spaceType") <> ''""",
        "category_context": f"""{BASE} SELECT 'Floors: '
            || (SELECT string_agg(CAST(f AS VARCHAR), ', ' ORDER BY f) FROM (
               SELECT DISTINCT CAST("storey_floorId" AS INTEGER) AS f, storey_name FROM raw_spaces))
            || chr(10) || 'Space types: ' || (SELECT string_agg(t, ', ' ORDER BY t) FROM (
               SELECT DISTINCT trim("spaceType") AS t FROM sp)) AS context""",
        "overview": f"""{BASE}, {_floor_rates('r', 14)},
            best AS (SELECT floor, rate FROM r ORDER BY rate DESC, floor LIMIT 1),
            worst AS (SELECT floor, rate FROM r ORDER BY rate, floor LIMIT 1),
            peaks AS (
              SELECT hour, round(avg(flag) * 100, 1) AS p FROM joined WHERE floor_n = (SELECT floor FROM best)
              GROUP BY hour ORDER BY p DESC, hour LIMIT 3)
            SELECT best.floor AS best_floor, best.rate AS best_rate_percent, worst.floor AS worst_floor,
              worst.rate AS worst_rate_percent,
              (SELECT string_agg(strftime(hour, '%H:%M') || ' (' || p || '%)', ', ' ORDER BY p DESC, hour) FROM peaks)
                AS peak_hours
            FROM best CROSS JOIN worst""",
        "data_overview_7d_30d": f"""{BASE}, {_floor_rates('a', 7)}, {_floor_rates('b', 30)}
            SELECT f.floor, a.rate AS occ_rate_percent_7d, b.rate AS occ_rate_percent_30d
            FROM (SELECT DISTINCT floor_n AS floor FROM sp) f
            LEFT JOIN a ON a.floor = f.floor LEFT JOIN b ON b.floor = f.floor""",
        "json_records": f"""{BASE} SELECT CAST(to_json({{'uuid': uuid, 'sensor_name': sensor_name, 'room_name': room_name,
            'spaceType': "spaceType", 'storey_floorId': "storey_floorId", 'storey_name': storey_name,
            'building_name': building_name, 'label': label, 'code': code, 'room_id': room_id, 'room_key': room_key,
            'display_name': display_name, 'floor_n': floor_n}}) AS VARCHAR) AS record FROM sp""",
        "synonym_terms": synonym_terms(),
        "term_mentions": term_mentions(BASE),
        "question_intents": question_intents("specific"),
        "question_intents_legacy": question_intents("legacy"),
        "question_params": question_params(),
        "dialogue_last8": """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS speaker, text
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations)
            WHERE place <= 8 AND role IN ('user', 'assistant')""",
        "row_documents": _row_documents(),
        "document_chunks": """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, CAST(i * 720 + 1 AS BIGINT), 800) AS chunk
            FROM (SELECT doc_id, text,
                    unnest(range(0, GREATEST(1, CAST(ceil((length(text) - 80) / 720.0) AS BIGINT)))) AS i
                  FROM documents WHERE length(text) > 0)""",
        "knn_cosine_gated": f"{NEAREST} SELECT query_id, place, vec_id, round(score, 6) AS score FROM hits",
        "context_per_query": f"""{NEAREST} SELECT query_id, count(text) AS n_texts, count(*) - count(text) AS n_without_text,
            coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place), '') AS context
            FROM hits LEFT JOIN documents ON doc_id = vec_id GROUP BY query_id""",
        "mmr_rerank": _diverse(),
        "row_search": _row_search(),
        "indexed_search": _indexed_search(),
        "table_description": _table_description(),
        "grounding_document": _grounding_document(),
    }
    return found | {
        "utilization_by_floor_rollup": found["utilization_by_floor"],
        "stored_search": found["indexed_search"],
        "status_floor_now_stored": found["status_floor_now"],
        "free_rooms_now_stored": found["free_rooms_now"],
        "kpis_24h_rollup": found["kpis_24h"],
    }
