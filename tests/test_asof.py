"""State at given moments against a plain search."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from helpers import at, rows

from dwellgrid.operators import asof


def plainly(events, moments):
    found = []
    for space, moment in moments:
        best = None
        for order, (name, ts, state) in enumerate(events):
            if name == space and name is not None and moment is not None and ts is not None and at(ts) <= moment:
                best = max(best or (at(ts), order, state), (at(ts), order, state))
        found.append((space, moment, best and best[2], best and best[0], best and best[0]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_state_at(spark, site, unit):
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 30)
    times = [start + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 6 * 24 * 60, 300)]
    names = ["hot"] * 200 + [f"s{i % 7}" for i in range(100)]
    events = [(n, t.isoformat(sep=" "), "occupied" if i % 3 else "unoccupied") for i, (n, t) in enumerate(zip(names, times))]
    events += [("hot", events[0][1], "tied"), ("late", "2024-03-01 00:00:00", "occupied")]
    moments = [(n, start + dt.timedelta(hours=int(h))) for n in ("hot", "s1", "s2", "late", "unknown") for h in range(-30, 180, 7)]
    moments += [("hot", times[0]), ("hot", times[0]), ("late", dt.datetime(2024, 3, 1)), (None, start), ("hot", None)]
    model = site.usage(events, [("hot", "1.1")])
    asked = spark.createDataFrame(moments, "space_id string, at timestamp_ntz").repartition(3)
    found = asof.state_at(model, asked, unit)
    assert sorted(rows(found), key=repr) == plainly(events, moments)
    plan = found._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_of_nothing(spark, site):
    moments = spark.createDataFrame([("a", at("2024-01-01 00:00:00"))], "space_id string, at timestamp_ntz")
    assert [r[2:] for r in rows(asof.state_at(site.usage([], []), moments))] == [(None, None, None)]
    model = site.usage([("a", "2024-01-01 00:00:00", "occupied")], [])
    assert rows(asof.state_at(model, moments.where("false"))) == []
