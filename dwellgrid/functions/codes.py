"""Room labels, room codes and the keys derived from them (column expressions over a named column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellgrid.schema import JUNK_WORDS

# Fixed value: a room code is an optionally signed floor number, a dot and an alphanumeric room part.
CODE_PATTERN = r"^([+-]?\d+\.[A-Za-z0-9]+)"


def quoted(text: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def label(room_name: str = "room_name") -> Column:
    """Room name without surrounding blanks; NULL stays NULL."""
    return F.expr(f"trim({room_name})")


def room_code(room_name: str = "room_name") -> Column:
    """Leading room code of a label (``3.325 - Office`` gives ``3.325``); empty where there is none.

    Cleaning drops rows without a code, so the usual empty-to-NULL step would only evaluate the pattern twice.
    """
    return F.expr(f"regexp_extract(trim({room_name}), {quoted(CODE_PATTERN)}, 1)")


def room_id(code: str = "code") -> Column:
    """Code without the dot; the sign stays."""
    return F.expr(f"replace({code}, '.', '')")


def _kept(text: str, unwanted: str) -> str:
    body = f"upper(regexp_replace({text}, {quoted(unwanted)}, ''))"
    return f"concat(if(startswith(trim({text}), '-') AND {body} <> '', '-', ''), {body})"


def room_key(text: str = "code") -> Column:
    """Upper-case alphanumerics with a leading minus kept, so that -1.200 and 1.200 stay two rooms.

    Stored codes and search text go through this one expression, which is what makes lookups by key exact.
    """
    return F.expr(_kept(text, "[^A-Za-z0-9]"))


def floor_number(code: str = "code") -> Column:
    """Integer before the dot of a room code; NULL when the code is empty or the number does not fit."""
    return F.expr(f"try_cast(split_part({code}, '.', 1) AS INT)")


def zone(code: str = "code") -> Column:
    """First two characters after the dot, upper case (``3.201`` gives ``20``, ``9.T32`` gives ``T3``)."""
    return F.expr(f"upper(substring(split_part({code}, '.', 2), 1, 2))")


def contains_any(column: str, words) -> Column:
    """True when the lower-cased text (NULL counts as empty) contains one of the words."""
    text = f"lower(coalesce({column}, ''))"
    return F.expr(" OR ".join(f"contains({text}, {quoted(w.lower())})" for w in words) or "false")


def is_junk(label_column: str = "label") -> Column:
    """Device labels that are not rooms."""
    return contains_any(label_column, JUNK_WORDS)


def matches_room(room: str) -> Column:
    """Cleaned spaces whose key or id equals the typed room; punctuation alone matches nothing.

    The id side compares the digits of the typed text, leading minus kept.
    """
    typed = quoted(room or "")
    key, digits = _kept(typed, "[^A-Za-z0-9]"), _kept(typed, "[^0-9]")
    return F.expr(f"({key} <> '' AND room_key = {key}) OR ({digits} <> '' AND room_id = {digits})")


def resembles_room(text: str) -> Column:
    """Cleaned spaces whose key or name contains the typed text; blank or punctuation-only keys are ignored."""
    typed = quoted(text or "")
    key = f"upper(regexp_replace({typed}, '[^A-Za-z0-9]', ''))"
    plain = "upper(regexp_replace(display_name, '[^A-Za-z0-9]', ''))"
    return F.expr(
        f"({key} <> '' AND (contains({plain}, {key}) OR contains(room_key, {key})))"
        f" OR (trim({typed}) <> '' AND contains(lower(room_name), lower({typed})))"
    )
