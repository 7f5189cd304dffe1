"""Labelling a log of questions with an analytics intent and its parameters.

Every question is text; the result names the operator that answers it.  Two rule orders are offered:

* ``"specific"`` (default) tries narrow intents first and reads words as words;
* ``"legacy"`` tries the generic floor and room listings first and reads words as substrings, so that for instance
  "busiest rooms on floor 3" lists the rooms of floor 3.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellgrid.functions.codes import quoted
from dwellgrid.functions.text import (
    BLANKS, Vocabulary, captured, captured_int, contains_any, has_word, matches, normalise, plain_word, without,
)

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

# Defaults of the answering operators.
DEFAULT_DAYS = {"usage": 7, "busiest": 7, "underused": 30, "plan": 14, "compare": 7}
DEFAULT_THRESHOLD = 0.10
DEFAULT_ROOMS = 5
DEFAULT_SPOTS = 2

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

# Substrings one of which every match of a pattern contains.
FLOOR_NEEDS = ("floor", "level", "storey", "verdiep")
FLOOR_OF_ROOMS_NEEDS = (*FLOOR_NEEDS, "etage", "الدور", "طابق", "دور")
SPAN_NEEDS = ("last", "past")
BELOW_NEEDS = ("<", "below", "under")
THRESHOLD_NEEDS = ("threshold",)
COMPARE_NEEDS = ("compare",)
DIGITS = tuple("0123456789")
CODE_NEEDS = tuple(f"{digit}." for digit in DIGITS)
NOW_NEEDS = ("now", "currently", "this moment")
RANK_NEEDS = ("best", "top", "first")
RANK = r"(?:best|top|first)\s+(\d+)"

RULE_ORDERS = ("specific", "legacy")

# Parameters a rule may fill, with their types; NULL where an intent has no use for one.
PARAMETERS = {
    "floor": "int", "other_floor": "int", "room": "string", "days": "int", "hours": "int", "threshold": "double",
    "k": "int", "avoid_quiet": "boolean",
}


@dataclass(frozen=True)
class Rule:
    """One labelling rule: how the question is answered, when it applies and the parameters it fills (SQL text)."""

    mode: str
    intent: str | None
    when: str
    parameters: dict[str, str]
    name: str


def says_now(text: str) -> str:
    return matches(text, NOW, NOW_NEEDS)


def trailing_days(text: str) -> str:
    """Days of "last 3 weeks", "past month" and the like.

    NULL where none is said, where it says "now", and where the number of days does not fit an INT.
    """
    n, unit = captured_int(text, SPAN, 2), f"regexp_extract({text}, {quoted(SPAN)}, 3)"
    return f"""CASE WHEN {says_now(text)} THEN NULL
        WHEN {matches(text, SPAN, SPAN_NEEDS)}
            THEN try_multiply({n}, CASE left({unit}, 1) WHEN 'w' THEN 7 WHEN 'm' THEN 30 ELSE 1 END)
        WHEN {contains_any(text, ("last week", "past week"))} THEN 7
        WHEN {contains_any(text, ("last month", "past month"))} THEN 30 END"""


def trailing_hours(text: str) -> str:
    """1 for "now" and its synonyms, else NULL."""
    return f"if({says_now(text)}, 1, NULL)"


def threshold_share(text: str) -> str:
    """"below 15 %" as 0.15; NULL where none is said."""
    return f"{captured_int(text, BELOW, 1, BELOW_NEEDS)} / 100D"


def is_open_ended(text: str, says: Callable[[tuple[str, ...]], str] | None = None) -> str:
    """Questions that need more than one operator; words are words here ("show" is not "how").

    ``says`` gives the test for words; by default each is a pattern of its own.
    """
    says = says or partial(has_word, text)
    several = f"({says(('and',))} AND NOT {matches(text, COMPARED_FLOORS, COMPARE_NEEDS)})"
    return f"(length({text}) > {LONG_QUESTION} OR {says(OPEN_WORDS)} OR {says(VAGUE_WORDS)} OR {several})"


def _compared(text: str, place: int) -> str:
    return captured_int(text, COMPARE, place, COMPARE_NEEDS)


def _floor_ask(text: str) -> str:
    return f"{text} IN ({', '.join(quoted(plain_word(a)) for a in FLOOR_ASKS)})"


# A labelling scheme: stages of helper columns (later stages may use earlier ones) and the rules over them.
# Helpers are real columns, so that the optimizer computes each once instead of copying it into every rule.
Stages = list[dict[str, str]]


def _legacy_scheme() -> tuple[Stages, list[Rule]]:
    q, lowered = "q_text", "q_lowered"
    floor_after_word = captured(q, FLOOR_AFTER_WORD, 1, FLOOR_NEEDS)
    floor_of_rooms = captured_int(q, FLOOR_OF_ROOMS, 1, FLOOR_OF_ROOMS_NEEDS)
    stages = [
        {
            "q_floor": f"try_cast(coalesce({floor_after_word}, {captured(q, LONE_NUMBER)}) AS INT)",
            "q_room_floor": f"CASE WHEN {contains_any(q, ROOM_WORDS)} THEN "
                            f"coalesce({floor_of_rooms}, {captured_int(q, SHORT_ROOM_CODE, 1, CODE_NEEDS)}) END",
            # a said zero counts as not said
            "q_days": f"nullif({trailing_days(q)}, 0)",
        }
    ]

    def days(default: int) -> str:
        return f"coalesce(q_days, {default})"

    free = " AND ".join(contains_any(q, words) for words in (FREE_WORDS, MEETING_ROOM_WORDS, NOW_WORDS))
    open_ended = (
        f"{contains_any(lowered, OPEN_WORDS)} OR {contains_any(lowered, VAGUE_WORDS)} "
        f"OR (contains({lowered}, ' and ') AND NOT {matches(lowered, COMPARED_FLOORS, COMPARE_NEEDS)}) "
        f"OR length({lowered}) > {LONG_QUESTION}"
    )
    return stages, [
        Rule("tool", "list_floors",
             f"{_floor_ask(q)} OR ({contains_any(q, LIST_VERBS)} AND {contains_any(q, FLOOR_WORDS)})", {},
             "floors are listed"),
        Rule("tool", "rooms_on_floor", "q_room_floor IS NOT NULL", {"floor": "q_room_floor"}, "rooms of a floor"),
        Rule("tool", "free_meeting_rooms_now", f"{free} AND q_floor IS NOT NULL", {"floor": "q_floor"},
             "free meeting rooms"),
        Rule("tool", "utilization_by_floor",
             f"contains({q}, 'utilization') AND {contains_any(q, PER_FLOOR_WORDS)}",
             {"days": days(DEFAULT_DAYS["usage"])}, "usage of every floor"),
        Rule("tool", "utilization_floor", f"{matches(q, USAGE_OF_FLOOR, USAGE_WORDS)} AND q_floor IS NOT NULL",
             {"floor": "q_floor", "days": days(DEFAULT_DAYS["usage"])}, "usage of a floor"),
        Rule("tool", "busiest_rooms", contains_any(q, BUSY_WORDS),
             {"floor": "q_floor", "days": days(DEFAULT_DAYS["busiest"]), "k": str(DEFAULT_ROOMS)}, "busiest rooms"),
        Rule("tool", "underused_rooms",
             f"{contains_any(q, UNDERUSED_WORDS)} OR (contains({q}, 'least') AND contains({q}, 'used'))",
             {"floor": "q_floor", "days": days(DEFAULT_DAYS["underused"]),
              "threshold": f"coalesce(nullif({threshold_share(q)}, 0D), {DEFAULT_THRESHOLD}D)"}, "underused rooms"),
        Rule("tool", "plan_coffee_machines",
             f"{contains_any(q, COFFEE_WORDS)} AND {contains_any(q, PLACE_WORDS)}",
             {"floor": "q_floor", "days": days(DEFAULT_DAYS["plan"]), "hours": trailing_hours(q),
              "k": f"coalesce(nullif({captured_int(q, FIRST_INT)}, 0), {DEFAULT_SPOTS})",
              "avoid_quiet": f"NOT {contains_any(q, KEEP_QUIET_WORDS)}"}, "places for a facility"),
        Rule("sql", "compare_floors", matches(lowered, COMPARE, COMPARE_NEEDS),
             {"floor": _compared(lowered, 1), "other_floor": _compared(lowered, 2),
              "days": f"coalesce(nullif({trailing_days(lowered)}, 0), {DEFAULT_DAYS['compare']})"},
             "two floors compared"),
        Rule("agent", None, open_ended, {}, "open-ended"),
        Rule("model", None, "true", {}, "no rule"),
    ]


def _specific_scheme() -> tuple[Stages, list[Rule]]:
    q = "q_text"
    vocabulary = Vocabulary(q)
    says = vocabulary.has
    floor_of_rooms = captured_int(q, FLOOR_OF_ROOMS, 1, FLOOR_OF_ROOMS_NEEDS)
    ordinal = captured_int(q, ORDINAL_FLOOR, 1, FLOOR_OF_ROOMS_NEEDS)
    now = says((*NOW_WORDS, "this moment"))
    stages = [
        # numbers that belong to a threshold, a span, a room code or a floor are not free for other readings
        {"q_cut": without(q, (THRESHOLD, BELOW), (*THRESHOLD_NEEDS, *BELOW_NEEDS))},
        {"q_room": captured("q_cut", ROOM_CODE, 1, CODE_NEEDS)},
        {
            "q_said_floor": f"coalesce({floor_of_rooms}, {ordinal}, try_cast(split_part(q_room, '.', 1) AS INT))",
            "q_bare": without(
                "q_cut", (SPAN, SPAN_HOURS, FLOOR_OF_ROOMS, ORDINAL_FLOOR, ANY_CODE),
                (*SPAN_NEEDS, *FLOOR_OF_ROOMS_NEEDS, *CODE_NEEDS),
            ),
            "q_hours": f"coalesce({captured_int(q, SPAN_HOURS, 1, SPAN_NEEDS)}, if({now}, 1, NULL))",
            "q_span": trailing_days(q),
            "q_about_floor": says(FLOOR_WORDS),
        },
        {"q_unranked": without("q_bare", (RANK,), RANK_NEEDS)},
        {
            "q_floor": f"coalesce(q_said_floor, {captured_int('q_unranked', LONE_NUMBER, 1, DIGITS)})",
            "q_ranked": captured_int("q_bare", RANK, 1, RANK_NEEDS),
            "q_number": captured_int("q_bare", FIRST_INT, 1, DIGITS),
        },
    ]
    said_threshold = f"try_cast({captured(q, THRESHOLD, 1, THRESHOLD_NEEDS)} AS DOUBLE)"
    threshold = (
        f"coalesce({threshold_share(q)}, if({said_threshold} > 1D, {said_threshold} / 100D, {said_threshold}), "
        f"{DEFAULT_THRESHOLD}D)"
    )
    least_used = f"({says(('least',))} AND {says(('used',))})"

    def span(default: int) -> dict[str, str]:
        return {"days": f"if(q_hours IS NULL, coalesce(q_span, {default}), NULL)", "hours": "q_hours"}

    rules = [
        Rule("tool", "compare_floors", matches(q, COMPARE, COMPARE_NEEDS),
             {"floor": _compared(q, 1), "other_floor": _compared(q, 2), **span(DEFAULT_DAYS["compare"])},
             "two floors compared"),
        Rule("tool", "plan_coffee_machines", f"{says(COFFEE_WORDS)} AND {says(PLACE_WORDS)}",
             {"floor": "q_said_floor", **span(DEFAULT_DAYS["plan"]),
              "k": f"coalesce(q_ranked, q_number, {DEFAULT_SPOTS})",
              "avoid_quiet": f"NOT {says(KEEP_QUIET_WORDS)}"}, "places for a facility"),
        Rule("tool", "free_meeting_rooms_now",
             f"{says(FREE_WORDS)} AND {says(MEETING_ROOM_WORDS)} AND q_floor IS NOT NULL",
             {"floor": "q_floor"}, "free meeting rooms"),
        Rule("tool", "underused_rooms", f"{says(UNDERUSED_WORDS)} OR {least_used}",
             {"floor": "q_said_floor", **span(DEFAULT_DAYS["underused"]), "threshold": threshold}, "underused rooms"),
        Rule("tool", "busiest_rooms", f"{says(BUSY_WORDS)} OR {matches(q, TOP_ROOMS, ('top ',))}",
             {"floor": "q_said_floor", **span(DEFAULT_DAYS["busiest"]), "k": f"coalesce(q_ranked, {DEFAULT_ROOMS})"},
             "busiest rooms"),
        Rule("tool", "peak_hours_floor", f"{says(('peak hour', 'peak hours'))} AND q_floor IS NOT NULL",
             {"floor": "q_floor"}, "peak hours"),
        Rule("tool", "utilization_by_floor",
             f"{says((*USAGE_WORDS, 'occupancy'))} AND {says(PER_FLOOR_WORDS)}",
             span(DEFAULT_DAYS["usage"]), "usage of every floor"),
        Rule("tool", "utilization_floor",
             f"{says(USAGE_WORDS)} AND q_about_floor AND q_floor IS NOT NULL",
             {"floor": "q_floor", **span(DEFAULT_DAYS["usage"])}, "usage of a floor"),
        Rule("tool", "sensors_for_room", f"{says(('sensor', 'sensors'))} AND q_room IS NOT NULL",
             {"room": "q_room"}, "sensors of a room"),
        Rule("tool", "find_rooms_like",
             f"{says(('find', 'search', 'where is', 'zoek'))} AND q_room IS NOT NULL", {"room": "q_room"},
             "room search"),
        Rule("tool", "latest_room_status",
             f"q_room IS NOT NULL AND {says(('occupied', 'unoccupied', 'free', 'status', *NOW_WORDS))}",
             {"room": "q_room"}, "state of a room"),
        Rule("tool", "status_floor_now", f"{says(('status',))} AND q_floor IS NOT NULL", {"floor": "q_floor"},
             "state of a floor"),
        Rule("tool", "rooms_on_floor", f"{says(ROOM_WORDS)} AND q_said_floor IS NOT NULL",
             {"floor": "q_said_floor"}, "rooms of a floor"),
        Rule("tool", "list_floors",
             f"{_floor_ask(q)} OR ({says(LIST_VERBS)} AND q_about_floor AND q_said_floor IS NULL)", {},
             "floors are listed"),
        Rule("agent", None, is_open_ended(q, says), {}, "open-ended"),
        Rule("model", None, "true", {}, "no rule"),
    ]
    return [vocabulary.stage(), *stages], rules


def label_questions(log: DataFrame, text: str = "text", order: str = "specific") -> DataFrame:
    """The log plus ``mode, intent, rule`` and one column per parameter; the first rule that applies decides.

    A pure projection: no shuffle, one pass over the log, and Python sees only texts that are not ASCII.  The specific
    rules split a text into words once and look them up, whatever the number of rules.
    """
    if order not in RULE_ORDERS:
        raise ValueError(f"order must be one of {RULE_ORDERS}")
    asked = F.btrim(F.col(text), F.lit(BLANKS))
    prepared = log.withColumns({"q_text": normalise(asked), "q_lowered": F.lower(asked)})
    stages, rules = _specific_scheme() if order == "specific" else _legacy_scheme()
    first = " ".join(f"WHEN {rule.when} THEN {i}" for i, rule in enumerate(rules))
    for stage in [*stages, {"q_rule": f"CASE {first} END"}]:
        prepared = prepared.withColumns({name: F.expr(value) for name, value in stage.items()})

    def pick(name: str, kind: str) -> str:
        """Value the deciding rule gives to a parameter."""
        given = " ".join(f"WHEN {i} THEN {r.parameters[name]}" for i, r in enumerate(rules) if name in r.parameters)
        return f"CAST({f'CASE q_rule {given} END' if given else 'NULL'} AS {kind}) AS {name}"

    def named(values: list[str | None], name: str) -> str:
        return f"get(array({', '.join('NULL' if v is None else quoted(v) for v in values)}), q_rule) AS {name}"

    return prepared.selectExpr(
        *log.columns,
        named([r.mode for r in rules], "mode"),
        named([r.intent for r in rules], "intent"),
        named([r.name for r in rules], "rule"),
        *[pick(name, kind) for name, kind in PARAMETERS.items()],
    )
