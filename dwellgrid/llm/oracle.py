"""SQL for the numbered queries that plain SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH norm AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), grouped AS (
    SELECT doc_id, body, min(doc_id) OVER (PARTITION BY body) AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size
    FROM norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM grouped
"""

LINE_DEDUP = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
    SELECT doc_id, line, pos,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM line
), frequent AS (
    SELECT line_key, max(doc_id) AS last_id FROM keyed WHERE length(line_key) >= 20
    GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.doc_id, k.line, k.pos, f.line_key IS NOT NULL AND k.doc_id <> f.last_id AS dropped
    FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key
)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN dropped THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
item AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
item_window AS (
    SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS body
    FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM item WHERE len(ws) > 0)
), doc_window AS (
    SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS body
    FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
          FROM doc CROSS JOIN (SELECT DISTINCT n FROM item_window) WHERE len(ws) >= n)
), met AS (SELECT rid, i, n, item_id FROM doc_window JOIN item_window USING (n, body)),
hit AS (
    SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS place FROM met) GROUP BY rid
), named AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM met WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

# The checksum is computed from its polynomial, once per distinct word.
RESAMPLING = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
doc_word AS (SELECT rid, unnest(ws) AS word FROM doc),
item_word AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t
), bucketed AS (
    SELECT word, xor(4294967295, list_reduce(range(len(hx) // 2),
        lambda c, k: xor(c >> 8, t[(xor(c, CAST('0x' || substr(hx, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)) & 255) + 1]),
        CAST(4294967295 AS BIGINT))) % 10000 AS bucket
    FROM (SELECT word, hex(encode(word)) AS hx FROM (SELECT word FROM doc_word UNION SELECT word FROM item_word)), crc_table
), source AS (SELECT bucket, count(*) AS s FROM doc_word JOIN bucketed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM item_word JOIN bucketed USING (word) GROUP BY bucket),
total AS (SELECT (SELECT count(*) FROM doc_word) AS s_all, (SELECT count(*) FROM item_word) AS t_all),
gain AS (
    SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (s_all + 10000)
                                / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (t_all + 10000)))) AS BIGINT) AS gain
    FROM (SELECT DISTINCT bucket FROM bucketed) b LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket), total
), weight AS (
    SELECT rid, CAST(sum(gain) AS BIGINT) AS weight
    FROM doc_word JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
    SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)
               + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
    FROM doc LEFT JOIN weight USING (rid)
), ranked AS (
    SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": EXACT_DEDUP,
        "op2_line_dedup": LINE_DEDUP,
        "op11_decontamination": DECONTAMINATION,
        "op13_resampling": RESAMPLING,
    }
