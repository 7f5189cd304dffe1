"""Text normalisation for question logs (column expressions, one Arrow function for accents)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellgrid.functions.codes import quoted

BLANKS = " \t\r\n\f\v"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def plain_word(word: str) -> str:
    """A word-list entry as it looks in normalised text: lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _accent_stripper():
    """Arrow function that removes accents; self-contained, so that executors need not have this package."""

    def strip(texts: pd.Series) -> pd.Series:
        import unicodedata

        decomposed = texts.str.normalize("NFKD")
        used = set().union(*decomposed.dropna())
        return decomposed.str.translate({ord(c): None for c in used if unicodedata.combining(c)})

    return F.pandas_udf(strip, T.StringType())


def normalise(text: Column) -> Column:
    """Lower case, accents removed, Arabic-Indic digits as ASCII digits, blanks collapsed and trimmed.

    Spark has no built-in Unicode decomposition.  Pure ASCII rows, usually most of a log, send NULL instead of their
    text to the Arrow function and keep their own lower-cased text.
    """
    lowered = F.lower(text)
    stripped = _accent_stripper()(F.when(lowered.rlike(r"[^\x00-\x7F]"), lowered))
    plain = F.translate(F.coalesce(stripped, lowered), ARABIC_DIGITS, "0123456789")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


# The helpers below return SQL text over a named column of normalised text; rules are composed from them.


def contains_any(column: str, words) -> str:
    """One of the words occurs anywhere, inside longer words too."""
    return "(" + " OR ".join(f"contains({column}, {quoted(plain_word(w))})" for w in words) + ")"


def has_word(column: str, words) -> str:
    """One of the words or phrases stands alone.

    Boundaries are any character that is not an ASCII letter, digit or underscore, so phrases in other scripts match
    as substrings.  The cheap substring test comes first and spares most texts the regular expression.
    """
    choice = "|".join(plain_word(w) for w in words)
    return matches(column, f"(^|[^a-z0-9_])({choice})([^a-z0-9_]|$)", words)


def said_words(column: str, words) -> str:
    """Those of the words (ASCII, no phrases) that stand alone in the text, as an array: one split, one look-up each."""
    return f"array_intersect(split({column}, '[^a-z0-9_]+'), array({', '.join(map(quoted, sorted(words)))}))"


class Vocabulary:
    """Words that rules look for in one text: the text is split once, and a rule asks what was found in it.

    ``has_word`` gives the same answers one pattern at a time.  The text's column must be joined by the columns that
    ``stage`` names, which are to be made after all rules have been written.
    """

    def __init__(self, column: str, prefix: str = "q_"):
        self.column, self.said, self.wide = column, f"{prefix}said", f"{prefix}wide"
        self.words: set[str] = set()

    def has(self, words) -> str:
        plain = [plain_word(w) for w in words]
        foreign = [w for w in plain if not w.isascii()]
        phrases = [w for w in plain if w.isascii() and " " in w]
        single = [w for w in plain if w.isascii() and " " not in w]
        self.words.update(single, *(w.split() for w in phrases))
        tests = [f"arrays_overlap({self.said}, array({', '.join(map(quoted, single))}))"] if single else []
        for phrase in phrases:  # the pattern is tried only where all words of the phrase stand alone
            parts = " AND ".join(f"array_contains({self.said}, {quoted(w)})" for w in dict.fromkeys(phrase.split()))
            tests.append(f"({parts} AND {has_word(self.column, (phrase,))})")
        if foreign:
            tests.append(f"({self.wide} AND {has_word(self.column, foreign)})")
        return f"({' OR '.join(tests)})"

    def stage(self) -> dict[str, str]:
        return {
            self.said: said_words(self.column, self.words),
            self.wide: f"octet_length({self.column}) > char_length({self.column})",
        }


def matches(column: str, pattern: str, needs) -> str:
    """Regular expression test; ``needs`` are substrings without any of which the pattern cannot match."""
    return f"({contains_any(column, needs)} AND {column} RLIKE {quoted(pattern)})"


def _group(column: str, pattern: str, group: int, needs) -> str:
    value = f"regexp_extract({column}, {quoted(pattern)}, {group})"
    return value if needs is None else f"CASE WHEN {contains_any(column, needs)} THEN {value} END"


def captured(column: str, pattern: str, group: int = 1, needs=None) -> str:
    """A regular expression group; NULL when the pattern does not match or the group is empty."""
    return f"nullif({_group(column, pattern, group, needs)}, '')"


def captured_int(column: str, pattern: str, group: int = 1, needs=None) -> str:
    """A regular expression group as an integer; NULL when there is none."""
    return f"try_cast({_group(column, pattern, group, needs)} AS INT)"


def without(column: str, patterns, needs) -> str:
    """The text with every match of one of the patterns, all of which hold a digit, replaced by a blank."""
    replaced = f"regexp_replace({column}, {quoted('|'.join(patterns))}, ' ')"
    return f"if({contains_any(column, needs)} AND {column} RLIKE '[0-9]', {replaced}, {column})"
