"""The model every operator works on: an event log, a cleaned space dimension and how they may be joined."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension whose source files are at most this large may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Spark's size estimate of a DataFrame (no job); None where the session does not expose it."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # a remote session has no handle on the plan
        return None


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True only when the size is known and within the bound."""
    size = estimated_bytes(df)
    return size is not None and size <= limit


@dataclass(frozen=True)
class Usage:
    """Events and spaces in canonical form.

    ``events``: ``space_id, ts, occupancy, event_time, event_order`` and optionally the partition column
    ``event_date``; ``event_order`` breaks ties between events of one space with equal ``ts``.
    ``spaces``: the cleaned dimension of :func:`dwellgrid.sources.spaces.clean_spaces`; ``raw_spaces`` before cleaning.
    ``broadcast_spaces``: whether the dimension has a checked size bound.  When False, operators first shrink the
    log to one row per space and hour and then join by key, which needs no bound.
    ``at``: moment that ends all trailing windows; None means the newest event.
    ``rollup``: optional stored hourly roll-up of ``events`` (:func:`dwellgrid.sources.store.hourly_rollup`); rates
    then read whole hours from it and touch the log only for the partial hours at the edges of a window and from the
    roll-up's last hour on, so that a roll-up written by a stream, which has closed hours only, gives the same rates.
    ``states``: optional stored newest events per space (:func:`dwellgrid.operators.latest.newest_events`); the latest
    states then come from it and from the log's tail, the events from its newest moment on.  Events that reach the log
    later with an older time count after the next rebuild only.
    """

    events: DataFrame
    spaces: DataFrame
    raw_spaces: DataFrame
    broadcast_spaces: bool = False
    at: dt.datetime | None = None
    rollup: DataFrame | None = None
    states: DataFrame | None = None

    @classmethod
    def of(cls, events: DataFrame, raw_spaces: DataFrame, *, at: dt.datetime | None = None,
           sized_by: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> "Usage":
        """Model from canonical events and raw spaces.

        ``sized_by`` is the scan whose size bounds the dimension, for dimensions that are themselves joins.
        """
        from dwellgrid.sources.spaces import clean_spaces

        small = fits_broadcast(raw_spaces if sized_by is None else sized_by, broadcast_bytes)
        return cls(events, clean_spaces(raw_spaces), raw_spaces, small, at)

    def with_rollup(self, rollup: DataFrame) -> "Usage":
        return replace(self, rollup=rollup)

    def with_states(self, states: DataFrame) -> "Usage":
        return replace(self, states=states)

    def with_spaces(self, spaces: DataFrame) -> "Usage":
        return replace(self, spaces=spaces)

    def dimension(self, *columns: str) -> DataFrame:
        """Join side of the dimension: the key under its event-side name plus the requested columns."""
        wanted = [c for c in dict.fromkeys(columns) if c != "space_id"]
        side = self.spaces.select(F.col("uuid").alias("space_id"), *wanted)
        return F.broadcast(side) if self.broadcast_spaces else side
