from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dwellgrid.session import local_session  # noqa: E402
from dwellgrid.usage import Usage  # noqa: E402
from helpers import at  # noqa: E402

SPACE_COLUMNS = (
    "uuid string, sensor_name string, room_name string, spaceType string, storey_floorId string, storey_name string"
)
EVENT_COLUMNS = (
    "space_id string, ts timestamp_ntz, occupancy string, event_time timestamp_ntz, event_order bigint"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "dwellgrid-tests")
    yield session
    session.stop()


class Site:
    """Builds small usage models from tuples."""

    def __init__(self, spark):
        self.spark = spark

    def spaces(self, rows):
        """``(uuid, room_name, spaceType, floor id, storey)``, trailing values optional."""
        full = []
        for row in rows:
            uuid, name, kind, floor, storey = (*row, *(None,) * (5 - len(row)))
            full.append((uuid, f"sensor {uuid}", name, kind, floor, storey))
        return self.spark.createDataFrame(full, SPACE_COLUMNS)

    def events(self, rows):
        """``(space, time, state)``; the position breaks ties."""
        full = [(s, at(t), state, at(t), i) for i, (s, t, state) in enumerate(rows)]
        return self.spark.createDataFrame(full, EVENT_COLUMNS)

    def usage(self, events, spaces, **options) -> Usage:
        return Usage.of(self.events(events), self.spaces(spaces), **options)


@pytest.fixture(scope="session")
def site(spark):
    return Site(spark)
