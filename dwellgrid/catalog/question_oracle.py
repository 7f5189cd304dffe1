"""SQL for the question-log queries.

The fixed word lists, patterns and phrasings are written out a second time here, none is imported from the operators; the
labels that they must lead to are written by hand in ``tests/test_questions.py``.
"""

from __future__ import annotations

from dwellgrid.functions.text import plain_word

# Word lists in English, Dutch and Arabic.
LIST_VERBS = (
    "list", "show", "which", "what", "what are", "give me", "display", "enumerate", "all",
    "toon", "laat zien", "welke", "wat zijn", "geef me", "alle",
    "اعرض", "ما هي", "ماهي", "ايش", "كم", "عرض", "عدد", "الكل",
)
FLOOR_WORDS = (
    "floor", "floors", "level", "levels", "storey", "storeys", "story", "stories",
    "verdieping", "verdiepingen", "etage", "etages", "niveau", "niveaus",
    "طابق", "طوابق", "دور", "ادوار", "أدوار", "دوران",
)
ROOM_WORDS = ("room", "rooms", "ruimte", "ruimtes", "kamer", "kamers", "غرفة", "غرف")
FLOOR_ASKS = (
    "floors", "list floors", "levels", "show floors", "welke verdiepingen", "toon verdiepingen", "كم طابق",
    "عدد الطوابق",
)
FREE_WORDS = ("free", "vrij", "متاح")
MEETING_ROOM_WORDS = (
    "meeting room", "meeting rooms", "vergaderruimte", "vergaderruimtes", "غرفة اجتماع", "غرف اجتماع",
)
NOW_WORDS = ("now", "currently", "nu", "الان", "حالياً")
BUSY_WORDS = ("busiest", "top rooms", "drukste", "الاكثر ازدحاما")
UNDERUSED_WORDS = ("underused", "onderbenut", "اقل استخداما")
COFFEE_WORDS = ("coffee", "pantry", "kitchen", "koffie", "keuken", "مطبخ", "قهوة")
PLACE_WORDS = ("machine", "machines", "placement", "spots", "apparaat", "plaatsen", "مكان", "اماكن")
KEEP_QUIET_WORDS = ("ignore quiet", "dont avoid quiet", "don’t avoid quiet", "negeer rustig")
PER_FLOOR_WORDS = ("by floor", "per floor", "per verdieping")
USAGE_WORDS = ("utilization", "bezetting", "benutting")
OPEN_WORDS = ("why", "how", "explain", "recommend", "suggest", "tradeoff")
VAGUE_WORDS = (
    "which rooms are", "what kind of", "describe", "policy", "rules", "definition", "meaning",
)
LONG_QUESTION = 180

# Patterns of the parameters (common to Java and RE2 regular expressions).
NUMBER = r"([+-]?\d+)"
FLOOR_AFTER_WORD = rf"(?:floor|level|storey|verdiep(?:ing)?)\s*{NUMBER}"
FLOOR_OF_ROOMS = rf"(?:floor|level|storey|verdiep(?:ing)?|etage|الدور|طابق|دور)\s*{NUMBER}"
LONE_NUMBER = r"\b([+-]?\d{1,2})\b"
ORDINAL_FLOOR = r"(\d+)(?:st|nd|rd|th|e) (?:floor|level|storey|verdieping|etage)"
SHORT_ROOM_CODE = r"\b(\d)\.(?:\d{2,3})\b"
ROOM_CODE = r"(?:^|[^0-9a-z.+-])([+-]?\d{1,2}\.[0-9a-z]{2,4})(?:[^0-9a-z.]|$)"
SPAN = r"(last|past)\s+(\d+)\s*(day|days|week|weeks|month|months)"
SPAN_HOURS = r"(?:last|past)\s+(\d+)\s*hours?"
BELOW = r"(?:<|below|under)\s*(\d+)\s*%?"
THRESHOLD = r"threshold\s*(?:of\s*)?(\d*\.\d+|\d+)"
COMPARE = rf"compare\s+floors?\s+{NUMBER}\s+(?:and|&)\s+{NUMBER}"
COMPARED_FLOORS = r"compare\s+floors"
FIRST_INT = r"(-?\d+)"
ANY_CODE = r"[+-]?\d+\.[0-9a-z]+"
TOP_ROOMS = r"top \d+ rooms"
USAGE_OF_FLOOR = r"\b(utilization|bezetting|benutting)\b.*\b(floor|level|storey|verdiep|etage)\b"
NOW = r"\b(now|right now|currently|this moment)\b"

# Parameters with their types, synonyms and phrasings.
PARAMETERS = {
    "floor": "int", "other_floor": "int", "room": "string", "days": "int", "hours": "int", "threshold": "double",
    "k": "int", "avoid_quiet": "boolean",
}
SYNONYMS = {
    "occupied": ["busy", "taken"],
    "free": ["available", "vacant", "empty"],
    "meeting room": ["conference room", "vergaderruimte"],
    "floor": ["storey", "level"],
}
PHRASINGS = (
    "list floors",
    "rooms on floor {f}",
    "free meeting rooms now on floor {f}",
    "utilization by floor last {d} days",
    "busiest rooms on floor {f} last {d} days",
    "busiest rooms last {d} days",
    "underused rooms last month",
    "underused rooms last {d} days threshold 0.15",
    "underused rooms on level {f} below 20 %",
    "Best 2 coffee machine spots on floor {f} now (avoid quiet areas)",
    "coffee machine placement on floor {f} past 3 weeks, ignore quiet areas",
    "utilization floor {f}",
    "compare floors {f} and {d}",
    "find room 3.201",
    "sensors of room 3.201",
    "is room 3.201 occupied now",
    "peak hours for Floor {f}",
    "suggest improvements for floor {f} this month",
    "Status now for Floor {f}",
    "top 10 rooms by occupancy past 24 hours",
    "average occupancy per floor last {d} days",
    "Welke verdiepingen zijn er?",
    "Drukste kamers op verdieping {f}",
    "show me the 3rd  floor",
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_text(pattern)})"


def _any(column: str, words) -> str:
    return _matches(column, "|".join(plain_word(w) for w in words))


def _word(column: str, words) -> str:
    return _matches(column, "(^|[^a-z0-9_])(" + "|".join(plain_word(w) for w in words) + ")([^a-z0-9_]|$)")


def _got(column: str, pattern: str, group: int = 1) -> str:
    return f"NULLIF(regexp_extract({column}, {_text(pattern)}, {group}), '')"


def _number(column: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST({_got(column, pattern, group)} AS INTEGER)"


def _without(column: str, *patterns: str) -> str:
    return f"regexp_replace({column}, {_text('|'.join(patterns))}, ' ', 'g')"


def _days(column: str) -> str:
    unit, n = _got(column, SPAN, 3), _number(column, SPAN, 2)
    return f"""(CASE WHEN {_matches(column, NOW)} THEN NULL
      WHEN {unit} LIKE 'week%' THEN TRY_CAST({n}::BIGINT * 7 AS INTEGER)
      WHEN {unit} LIKE 'month%' THEN TRY_CAST({n}::BIGINT * 30 AS INTEGER) WHEN {unit} IS NOT NULL THEN {n}
      WHEN {column} LIKE '%last week%' OR {column} LIKE '%past week%' THEN 7
      WHEN {column} LIKE '%last month%' OR {column} LIKE '%past month%' THEN 30 END)"""


LOG = f"""
WITH phrased AS (
  SELECT conv_id, turn, text AS said, conv_id * 5 + turn AS n,
         replace(replace(list_extract([{', '.join(_text(p) for p in PHRASINGS)}],
           (conv_id * 5 + turn) % {len(PHRASINGS)} + 1), '{{f}}', CAST(conv_id % 14 - 2 AS VARCHAR)),
           '{{d}}', CAST((conv_id * 5 + turn) % 29 + 2 AS VARCHAR)) AS asked
  FROM conversations
), log AS (
  SELECT conv_id, turn, asked || chr(10) || coalesce(said, '') AS text FROM phrased
), prepared AS (
  SELECT *, lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lowered FROM log
), norm AS (
  SELECT *, trim(regexp_replace(translate(strip_accents(lowered), '٠١٢٣٤٥٦٧٨٩', '0123456789'), '\\s+', ' ', 'g')) AS q
  FROM prepared
)
"""

OPEN = (
    f"({_word('q', OPEN_WORDS)} OR {_word('q', VAGUE_WORDS)} OR ({_word('q', ('and',))} AND NOT "
    + _matches("q", r"compare\s+floors") + f") OR length(q) > {LONG_QUESTION})"
)


def question_params() -> str:
    return f"""{LOG} SELECT conv_id, turn, CAST({_days('q')} AS INTEGER) AS days,
      CASE WHEN {_matches('q', NOW)} THEN 1 END AS hours,
      {_number('q', BELOW)} / 100.0::DOUBLE AS threshold, {_number('q', FIRST_INT)} AS first_number,
      {_number('q', FLOOR_OF_ROOMS)} AS floor, {_number('q', SHORT_ROOM_CODE)} AS room_floor, {OPEN} AS open_ended
    FROM norm"""


def synonym_terms() -> str:
    terms = ", ".join(
        f"CASE WHEN {_matches('lower(text)', '(^|[^a-z0-9])(' + '|'.join(words) + ')([^a-z0-9]|$)')} THEN {_text(term)} END"
        for term, words in sorted(SYNONYMS.items())
    )
    return f"{LOG} SELECT conv_id, turn, concat_ws(', ', {terms}) AS terms FROM norm"


def term_mentions(spaces: str) -> str:
    """Terms as whole words of the question; ``spaces`` is a WITH clause that defines ``sp``."""
    pairs = ", ".join(f"({_text(term)}, {_text(word)})" for term, words in SYNONYMS.items() for word in words)
    plain = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"
    return f"""{spaces}, {LOG.strip().removeprefix("WITH ")}, names AS (
      SELECT unnest([room_name, storey_name, "spaceType"]) AS term FROM sp
    ), terms AS (
      SELECT DISTINCT term, {plain.format('synonym')} AS run
      FROM (VALUES {pairs} UNION ALL SELECT DISTINCT term, term FROM names WHERE term IS NOT NULL) AS t(term, synonym)
    ), said AS (SELECT conv_id, turn, {plain.format('text')} AS words FROM log)
    SELECT DISTINCT conv_id, turn, term FROM said JOIN terms ON contains(words, run) WHERE trim(run) <> ''"""


def _pick(name: str, kind: str, rules: list[tuple[str, str | None, str, dict[str, str]]]) -> str:
    cases = " ".join(f"WHEN {i} THEN {r[3][name]}" for i, r in enumerate(rules) if name in r[3])
    return f"CAST({f'CASE decided {cases} END' if cases else 'NULL'} AS {kind}) AS {name}"


SQL_TYPES = {"int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _labelled(helpers: str, rules: list[tuple[str, str | None, str, dict[str, str]]], names: list[str]) -> str:
    decided = "CASE " + " ".join(f"WHEN {r[2]} THEN {i}" for i, r in enumerate(rules)) + " END"
    modes = ", ".join(_text(r[0]) for r in rules)
    intents = ", ".join("NULL" if r[1] is None else _text(r[1]) for r in rules)
    labels = ", ".join(_text(n) for n in names)
    return f"""{LOG}, {helpers}, d AS (SELECT *, {decided} AS decided FROM helped)
    SELECT conv_id, turn, text, [{modes}][decided + 1] AS mode, [{intents}][decided + 1] AS intent,
      [{labels}][decided + 1] AS rule, {', '.join(_pick(n, SQL_TYPES[t], rules) for n, t in PARAMETERS.items())}
    FROM d"""


def _is_floor_ask() -> str:
    return "q IN (" + ", ".join(_text(plain_word(a)) for a in FLOOR_ASKS) + ")"


def _legacy() -> str:
    helpers = f"""helped AS (SELECT *,
      TRY_CAST(COALESCE({_got('q', FLOOR_AFTER_WORD)}, {_got('q', LONE_NUMBER)}) AS INTEGER) AS floor_no,
      CASE WHEN {_any('q', ROOM_WORDS)}
           THEN COALESCE({_number('q', FLOOR_OF_ROOMS)}, {_number('q', SHORT_ROOM_CODE)}) END AS room_floor,
      NULLIF({_days('q')}, 0) AS said_days FROM norm)"""
    open_ended = (
        f"({_any('lowered', OPEN_WORDS)} OR {_any('lowered', VAGUE_WORDS)} OR (lowered LIKE '% and %' AND NOT "
        + _matches("lowered", r"compare\s+floors") + f") OR length(lowered) > {LONG_QUESTION})"
    )
    rules = [
        ("tool", "list_floors", f"{_is_floor_ask()} OR ({_any('q', LIST_VERBS)} AND {_any('q', FLOOR_WORDS)})", {}),
        ("tool", "rooms_on_floor", "room_floor IS NOT NULL", {"floor": "room_floor"}),
        ("tool", "free_meeting_rooms_now",
         f"{_any('q', FREE_WORDS)} AND {_any('q', MEETING_ROOM_WORDS)} AND {_any('q', NOW_WORDS)} "
         "AND floor_no IS NOT NULL", {"floor": "floor_no"}),
        ("tool", "utilization_by_floor", f"q LIKE '%utilization%' AND {_any('q', PER_FLOOR_WORDS)}",
         {"days": "COALESCE(said_days, 7)"}),
        ("tool", "utilization_floor", f"{_matches('q', USAGE_OF_FLOOR)} AND floor_no IS NOT NULL",
         {"floor": "floor_no", "days": "COALESCE(said_days, 7)"}),
        ("tool", "busiest_rooms", _any("q", BUSY_WORDS),
         {"floor": "floor_no", "days": "COALESCE(said_days, 7)", "k": "5"}),
        ("tool", "underused_rooms", f"{_any('q', UNDERUSED_WORDS)} OR (q LIKE '%least%' AND q LIKE '%used%')",
         {"floor": "floor_no", "days": "COALESCE(said_days, 30)",
          "threshold": f"COALESCE(NULLIF({_number('q', BELOW)} / 100.0::DOUBLE, 0), 0.1)"}),
        ("tool", "plan_coffee_machines", f"{_any('q', COFFEE_WORDS)} AND {_any('q', PLACE_WORDS)}",
         {"floor": "floor_no", "days": "COALESCE(said_days, 14)",
          "hours": f"CASE WHEN {_matches('q', NOW)} THEN 1 END",
          "k": f"COALESCE(NULLIF({_number('q', FIRST_INT)}, 0), 2)",
          "avoid_quiet": f"NOT {_any('q', KEEP_QUIET_WORDS)}"}),
        ("sql", "compare_floors", _matches("lowered", COMPARE),
         {"floor": _number("lowered", COMPARE, 1), "other_floor": _number("lowered", COMPARE, 2),
          "days": f"COALESCE(NULLIF({_days('lowered')}, 0), 7)"}),
        ("agent", None, open_ended, {}),
        ("model", None, "true", {}),
    ]
    names = ["floors are listed", "rooms of a floor", "free meeting rooms", "usage of every floor", "usage of a floor",
             "busiest rooms", "underused rooms", "places for a facility", "two floors compared", "open-ended", "no rule"]
    return _labelled(helpers, rules, names)


def _specific() -> str:
    ranked = r"(?:best|top|first)\s+\d+"
    helpers = f"""cut AS (SELECT *, {_without('q', THRESHOLD, BELOW)} AS cut FROM norm),
    roomed AS (SELECT *, {_got('cut', ROOM_CODE)} AS room_code FROM cut),
    bared AS (SELECT *,
      COALESCE({_number('q', FLOOR_OF_ROOMS)}, {_number('q', ORDINAL_FLOOR)},
               TRY_CAST(split_part(room_code, '.', 1) AS INTEGER)) AS said_floor,
      {_without('cut', SPAN, SPAN_HOURS, FLOOR_OF_ROOMS, ORDINAL_FLOOR, ANY_CODE)} AS bare,
      COALESCE({_number('q', SPAN_HOURS)},
               CASE WHEN {_word('q', (*NOW_WORDS, 'this moment'))} THEN 1 END) AS said_hours,
      {_days('q')} AS said_days FROM roomed),
    helped AS (SELECT *, COALESCE(said_floor, {_number(_without('bare', ranked), LONE_NUMBER)}) AS floor_no,
      {_number('bare', r'(?:best|top|first)\s+(\d+)')} AS ranked_no, {_number('bare', FIRST_INT)} AS first_no
      FROM bared)"""

    def span(default: int) -> dict[str, str]:
        return {"days": f"CASE WHEN said_hours IS NULL THEN COALESCE(said_days, {default}) END", "hours": "said_hours"}

    said = f"TRY_CAST({_got('q', THRESHOLD)} AS DOUBLE)"
    threshold = (
        f"COALESCE({_number('q', BELOW)} / 100.0::DOUBLE, CASE WHEN {said} > 1 THEN {said} / 100.0::DOUBLE "
        f"ELSE {said} END, 0.1)"
    )
    rules = [
        ("tool", "compare_floors", _matches("q", COMPARE),
         {"floor": _number("q", COMPARE, 1), "other_floor": _number("q", COMPARE, 2), **span(7)}),
        ("tool", "plan_coffee_machines", f"{_word('q', COFFEE_WORDS)} AND {_word('q', PLACE_WORDS)}",
         {"floor": "said_floor", **span(14), "k": "COALESCE(ranked_no, first_no, 2)",
          "avoid_quiet": f"NOT {_word('q', KEEP_QUIET_WORDS)}"}),
        ("tool", "free_meeting_rooms_now",
         f"{_word('q', FREE_WORDS)} AND {_word('q', MEETING_ROOM_WORDS)} AND floor_no IS NOT NULL",
         {"floor": "floor_no"}),
        ("tool", "underused_rooms",
         f"{_word('q', UNDERUSED_WORDS)} OR ({_word('q', ('least',))} AND {_word('q', ('used',))})",
         {"floor": "said_floor", **span(30), "threshold": threshold}),
        ("tool", "busiest_rooms", f"{_word('q', BUSY_WORDS)} OR {_matches('q', 'top [0-9]+ rooms')}",
         {"floor": "said_floor", **span(7), "k": "COALESCE(ranked_no, 5)"}),
        ("tool", "peak_hours_floor", f"{_word('q', ('peak hour', 'peak hours'))} AND floor_no IS NOT NULL",
         {"floor": "floor_no"}),
        ("tool", "utilization_by_floor",
         f"{_word('q', (*USAGE_WORDS, 'occupancy'))} AND {_word('q', PER_FLOOR_WORDS)}", span(7)),
        ("tool", "utilization_floor",
         f"{_word('q', USAGE_WORDS)} AND {_word('q', FLOOR_WORDS)} AND floor_no IS NOT NULL",
         {"floor": "floor_no", **span(7)}),
        ("tool", "sensors_for_room", f"{_word('q', ('sensor', 'sensors'))} AND room_code IS NOT NULL",
         {"room": "room_code"}),
        ("tool", "find_rooms_like",
         f"{_word('q', ('find', 'search', 'where is', 'zoek'))} AND room_code IS NOT NULL", {"room": "room_code"}),
        ("tool", "latest_room_status",
         f"room_code IS NOT NULL AND {_word('q', ('occupied', 'unoccupied', 'free', 'status', *NOW_WORDS))}",
         {"room": "room_code"}),
        ("tool", "status_floor_now", f"{_word('q', ('status',))} AND floor_no IS NOT NULL", {"floor": "floor_no"}),
        ("tool", "rooms_on_floor", f"{_word('q', ROOM_WORDS)} AND said_floor IS NOT NULL", {"floor": "said_floor"}),
        ("tool", "list_floors",
         f"{_is_floor_ask()} OR ({_word('q', LIST_VERBS)} AND {_word('q', FLOOR_WORDS)} AND said_floor IS NULL)",
         {}),
        ("agent", None, OPEN, {}),
        ("model", None, "true", {}),
    ]
    names = ["two floors compared", "places for a facility", "free meeting rooms", "underused rooms", "busiest rooms",
             "peak hours", "usage of every floor", "usage of a floor", "sensors of a room", "room search",
             "state of a room", "state of a floor", "rooms of a floor", "floors are listed", "open-ended", "no rule"]
    return _labelled(helpers, rules, names)


def question_intents(order: str) -> str:
    return _legacy() if order == "legacy" else _specific()
