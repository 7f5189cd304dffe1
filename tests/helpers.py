"""What the test modules share besides fixtures."""

from __future__ import annotations

import datetime as dt

DATA = "/root/testdata/sf0.001"


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_key(df, key=0):
    return {r[key]: r for r in rows(df)}
