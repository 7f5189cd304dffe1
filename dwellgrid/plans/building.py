"""One building, one object: every named analytics operator as a method."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from dwellgrid.functions.clock import Window
from dwellgrid.operators import dense, latest, lookup, profile, rates, zones
from dwellgrid.plans import documents, overview
from dwellgrid.schema import MEETING_WORDS, QUIET_WORDS, REFRESH_WORDS
from dwellgrid.sources import csv_files, views
from dwellgrid.sources.events import union_events
from dwellgrid.usage import Usage


class Building:
    """Two event logs and a space dimension.  Methods return lazy DataFrames."""

    def __init__(self, spark: SparkSession, office: DataFrame, meeting: DataFrame, usage: Usage,
                 office_raw: DataFrame | None = None, meeting_raw: DataFrame | None = None):
        self.spark, self.office, self.meeting, self.usage = spark, office, meeting, usage
        self._views = (office_raw if office_raw is not None else office,
                       meeting_raw if meeting_raw is not None else meeting)

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, at: dt.datetime | None = None,
                 building: str = "") -> "Building":
        """A folder with the two sensor logs and the space file.  The session time zone is the building's.

        ``building`` begins the names of the logs; it is needed where the folder holds logs of several buildings.
        """
        office_raw = csv_files.read_office_events(spark, folder, building)
        meeting_raw = csv_files.read_meeting_events(spark, folder, building)
        office, meeting = (csv_files.canonical_events(e) for e in (office_raw, meeting_raw))
        usage = Usage.of(union_events(office, meeting), csv_files.read_spaces(spark, folder), at=at)
        return cls(spark, office, meeting, usage, office_raw, meeting_raw)

    def register_views(self) -> list[str]:
        return views.register_views(self.spark, *self._views, self.usage.spaces)

    def query(self, sql: str, rows: int | None = None) -> DataFrame:
        self.register_views()
        return views.adhoc(self.spark, sql, rows)

    def table_counts(self) -> DataFrame:
        return profile.table_counts(
            {
                "events_office": self.office,
                "events_meeting": self.meeting,
                "spaces": self.usage.raw_spaces,
                "spaces_filtered_count": self.usage.spaces,
            }
        )

    def list_floors(self) -> DataFrame:
        return lookup.list_floors(self.usage)

    def find_rooms_like(self, text: str) -> DataFrame:
        return lookup.find_rooms_like(self.usage, text)

    def rooms_on_floor(self, floor: int | str) -> DataFrame:
        return lookup.rooms_on_floor(self.usage, floor)

    def sensors_for_room(self, room: str) -> DataFrame:
        return lookup.sensors_for_room(self.usage, room)

    def status_floor_now(self, floor: int | str, max_age: Window | None = None) -> DataFrame:
        return latest.status_floor_now(self.usage, floor, max_age)

    def free_meeting_rooms_now(self, floor: int | str, words=MEETING_WORDS, max_age: Window | None = None) -> DataFrame:
        return latest.free_rooms_now(self.usage, floor, words, max_age)

    def latest_room_status(self, room: str) -> DataFrame:
        return latest.latest_room_status(self.usage, room)

    def peak_hours_floor(self, floor: int | str) -> DataFrame:
        return rates.peak_hours(self.usage, floor, 5)

    def peak_hours_by_floor(self, floor: int | str, top: int = 3) -> DataFrame:
        return rates.peak_hours(self.usage, floor, top, rounded=True)

    def utilization_floor(self, floor: int | str, days: int = 7, hours: int | None = None) -> DataFrame:
        return rates.utilization_floor(self.usage, floor, days, hours)

    def utilization_by_floor(self, days: int = 7, fill_missing_with_zero: bool = False,
                             hours: int | None = None) -> DataFrame:
        return rates.utilization_by_floor(self.usage, days, fill_missing_with_zero, hours)

    def compare_floors(self, floor_a: int | str, floor_b: int | str, days: int = 7,
                       hours: int | None = None) -> DataFrame:
        return rates.compare_floors(self.usage, floor_a, floor_b, days, hours)

    def compare_floors_strict(self, floors: list[int], days: int = 7) -> DataFrame:
        return rates.compare_floors_strict(self.usage, floors, days)

    def busiest_rooms(self, floor: int | str | None = None, days: int = 7, limit: int = 5,
                      hours: int | None = None) -> DataFrame:
        return rates.busiest_rooms(self.usage, floor, days, limit, hours)

    def underused_rooms(self, floor: int | str | None = None, days: int = 30, threshold: float | None = 0.10,
                        limit: int | None = None, hours: int | None = None) -> DataFrame:
        return dense.underused_rooms(self.usage, floor, days, threshold, limit, hours)

    def all_rooms_with_occ_rate(self, floor: int | str | None = None, days: int = 30) -> DataFrame:
        return dense.all_rooms_with_occ_rate(self.usage, floor, days)

    def dense_hourly_series(self, floor: int | str | None = None, days: int = 30) -> DataFrame:
        return dense.dense_hourly_series(self.usage, floor, days)

    def facility_features(self, floor: int | str | None = None, hours: int | None = None, days: int = 14,
                          count_mode: str = "rooms", quiet=QUIET_WORDS, refresh=REFRESH_WORDS) -> DataFrame:
        return zones.facility_features(self.usage, floor, hours, days, count_mode, quiet, refresh)

    def plan_coffee_machines(self, options: zones.PlanOptions = zones.PlanOptions(), **settings) -> DataFrame:
        return zones.rank_zones(self.usage, options, **settings)

    def coffee_machine_rooms(self, options: zones.PlanOptions = zones.PlanOptions(), **settings) -> DataFrame:
        return zones.ranked_zone_rooms(self.usage, options, **settings)

    def kpis(self, window_hours: int = 24) -> DataFrame:
        return rates.kpis(self.usage, window_hours)

    def overview(self, days: int = 14) -> DataFrame:
        return overview.overview(self.usage, days)

    def data_overview(self) -> DataFrame:
        return overview.data_overview(self.usage)

    def data_profile(self) -> DataFrame:
        return profile.data_profile(self.usage, self.office, self.meeting)

    def space_types(self) -> DataFrame:
        return profile.space_types(self.usage)

    def row_documents(self) -> DataFrame:
        return documents.row_documents(self.usage)

    def grounding_document(self, generated_at: dt.datetime | None = None) -> DataFrame:
        self.register_views()
        return documents.grounding_document(self.spark, self.usage, generated_at)
