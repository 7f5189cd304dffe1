from __future__ import annotations

import datetime as dt

import pytest
from helpers import at, by_key, rows
from pyspark.sql import functions as F

from dwellgrid.functions.clock import Window
from dwellgrid.functions.measures import occupied
from dwellgrid.operators import dense, hourly, latest, profile, rates, zones
from dwellgrid.plans import overview
from dwellgrid.sources import sample_tables, store
from dwellgrid.usage import Usage

SMALL, LARGE = {"broadcast_bytes": 2**63}, {"broadcast_bytes": -1}
BOTH = pytest.mark.parametrize("options", [SMALL, LARGE], ids=["broadcast", "shuffled"])


def test_occupancy_values(site):
    events = site.events([("a", "2025-03-01 10:00", s) for s in ("occupied", "OCCUPIED", "unoccupied", None, "unknown")])
    assert [r[0] for r in rows(events.orderBy("event_order").select(occupied()))] == [1, 1, 0, 0, 0]


# two spaces on floor 3, one without events on floor 4, a meeting room on floor 3
SPACES = [
    ("a", "3.100 A", "office", "3", "Third"), ("b", "3.100 A", "office", "3", "Third"),
    ("c", "3.200 B", "meeting", "3", "Third"), ("d", "4.100 C", "office", "4", "Fourth"),
]
EVENTS = [
    ("a", "2025-03-10 09:00:00", "occupied"), ("a", "2025-03-10 09:30:00", "unoccupied"),
    ("a", "2025-03-10 10:15:00", "unoccupied"), ("c", "2025-03-10 10:45:00", "unoccupied"),
    ("c", "2025-03-10 11:10:00", "occupied"), ("zz", "2025-03-10 11:58:17", "occupied"),
]


@BOTH
def test_the_rates_differ(site, options):
    usage = site.usage(EVENTS, SPACES, **options)
    assert usage.broadcast_spaces is (options == SMALL)
    # floor 3 is occupied in 2 of 3 observed hours; floor 4 is silent
    assert rows(rates.utilization_by_floor(usage)) == [(3, 66.7), (4, None)]
    assert rows(rates.utilization_by_floor(usage, fill_missing_with_zero=True)) == [(3, 66.7), (4, 0.0)]
    # 2 of 4 observed space-hours
    assert rows(rates.utilization_floor(usage, 3)) == [(2, 50.0)]
    assert rows(rates.utilization_floor(usage, "Fourth")) == [(0, 0.0)]
    # 2 of 2 * 25 and 1 of 25 possible space-hours of one day: the unused twin halves the room's rate
    dense_rate = by_key(dense.dense_rates(usage, 3, days=1))
    assert dense_rate["3.100"][2] == pytest.approx(1 / 50)
    assert dense_rate["3.200"][2] == pytest.approx(1 / 25)
    assert rows(rates.compare_floors(usage, "4", "Third")) == [("4", 0.0), ("Third", 66.7)]
    assert rows(rates.compare_floors(usage, "3", "3")) == [("3", 66.7), ("3", 66.7)]
    assert rows(rates.compare_floors_strict(usage, [4, 3])) == [(3, 66.7)]
    assert rows(rates.busiest_rooms(usage)) == [("3.100 A", 50.0), ("3.200 B", 50.0)]
    assert rows(rates.busiest_rooms(usage, 4)) == []
    peaks = rows(rates.peak_hours(usage, 3))
    assert peaks == [(at("2025-03-10 11:00"), 1.0), (at("2025-03-10 09:00"), 0.5), (at("2025-03-10 10:00"), 0.0)]
    assert rows(rates.peak_hours(usage, "3", 1, rounded=True)) == [(at("2025-03-10 11:00"), 100.0)]
    assert rows(rates.kpis(usage, 24)) == [(2, 0.4, 0.4, None, 24)]
    assert rows(rates.kpis(site.usage([], SPACES, **options), 24)) == [(0, None, None, None, 24)]


@BOTH
def test_a_space_listed_twice(site, options):
    usage = site.usage(EVENTS, [*SPACES, SPACES[2]], **options)
    assert rows(rates.busiest_rooms(usage)) == [("3.100 A", 50.0), ("3.200 B", 50.0)]
    assert rows(rates.utilization_floor(usage, 3)) == [(2, 50.0)]
    assert by_key(dense.dense_rates(usage, 3, days=1))["3.200"][2] == pytest.approx(1 / 25)
    assert len(rows(latest.status_floor_now(usage, 3))) == 2


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York"])
def test_hours_follow_the_session_zone(spark, site, zone):
    """Offsets of half hours need another hour bucket than whole ones; both give calendar hours."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        local = site.events([("a", "2025-03-10 10:10", "occupied"), ("a", "2025-03-10 10:50", "unoccupied")])
        events = local.withColumn("ts", F.col("ts").cast("timestamp"))
        for log in (local, events):
            hours = rows(store.hourly_rollup(log).select(F.col("hour").cast("timestamp_ntz"), "n_events", "n_occupied"))
            assert hours == [(at("2025-03-10 10:00"), 2, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rates_of_an_empty_log(site):
    usage = site.usage([], SPACES)
    assert rows(rates.utilization_by_floor(usage)) == [(3, None), (4, None)]
    assert rows(rates.compare_floors(usage, 3, 4)) == [("3", 0.0), ("4", 0.0)]
    assert {r[2] for r in rows(dense.dense_rates(usage))} == {0.0}


@BOTH
def test_window_edges(site, options):
    """The start is inside the window of days and outside the window of hours."""
    spaces = [("a", "1.1 A"), ("b", "1.2 B"), ("c", "1.3 C"), ("d", "1.4 D")]
    events = [
        ("a", "2025-03-09 12:00:00", "occupied"), ("b", "2025-03-09 12:00:00.000001", "occupied"),
        ("c", "2025-03-10 12:00:00", "occupied"), ("d", "2025-03-09 11:59:59.999999", "occupied"),
    ]
    usage = site.usage(events, spaces, **options)
    assert {r[0] for r in rows(rates.busiest_rooms(usage, days=1))} == {"1.1 A", "1.2 B", "1.3 C"}
    assert rows(rates.kpis(usage, 24))[0][0] == 2
    assert {r[0]: r[2] > 0 for r in rows(dense.dense_rates(usage, None, 1))} == {
        "1.1": True, "1.2": True, "1.3": True, "1.4": False
    }
    # an explicit end cuts later events
    ended = site.usage(events, spaces, at=at("2025-03-10 11:00"), **options)
    assert {r[0] for r in rows(rates.busiest_rooms(ended, days=1))} == {"1.1 A", "1.2 B", "1.4 D"}


def test_unaligned_anchor(site):
    usage = site.usage([("a", "2025-03-09 01:58:17", "occupied"), ("a", "2025-03-10 01:58:17", "occupied")], [("a", "1.1")])
    assert rows(dense.dense_rates(usage, None, 1))[0][2] == pytest.approx(2 / 25)
    assert rows(dense.unaligned_rates(usage, None, 1))[0][2] == 0.0
    series = rows(dense.dense_hourly_series(usage, None, 1).orderBy("hour"))
    assert len(series) == 25 == dense.hours_in_window(1)
    assert [r[3] for r in series] == [at("2025-03-09 01:00") + dt.timedelta(hours=i) for i in range(25)]
    assert [i for i, r in enumerate(series) if r[4]] == [0, 24]
    on_the_hour = site.usage([("a", "2025-03-10 02:00:00", "occupied")], [("a", "1.1")])
    assert rows(dense.unaligned_rates(on_the_hour, None, 1))[0][2] == pytest.approx(1 / 25)


def test_threshold_is_on_the_unrounded_rate(site):
    # 1 of 25 hours is 4.0 %; the threshold 0.04 excludes it, 0.0400001 does not
    usage = site.usage([("a", "2025-03-10 02:30:00", "occupied")], [("a", "1.1"), ("b", "1.2")])
    assert rows(dense.underused_rooms(usage, days=1, threshold=0.04)) == [("1.2", "1.2", 0.0)]
    assert len(rows(dense.underused_rooms(usage, days=1, threshold=0.0400001))) == 2
    assert rows(dense.underused_rooms(usage, days=1, threshold=None, limit=1)) == [("1.2", "1.2", 0.0)]
    # a threshold makes the limit irrelevant
    assert len(rows(dense.underused_rooms(usage, days=1, threshold=1.0, limit=1))) == 2
    assert rows(dense.all_rooms_with_occ_rate(usage, days=1)) == [("1.1", "1.1", 4.0), ("1.2", "1.2", 0.0)]


@pytest.mark.parametrize("bad", ["7", 7.5, -1, True, None])
def test_days_must_be_whole(site, bad):
    with pytest.raises((TypeError, ValueError)):
        rates.utilization_by_floor(site.usage(EVENTS, SPACES), bad)


@BOTH
def test_latest_state(site, options):
    events = [
        ("c", "2025-03-10 10:00", "unoccupied"), ("c", "2025-03-10 11:00", "occupied"),
        ("e", "2025-03-10 08:00", "occupied"), ("e", "2025-03-10 09:00", "Unoccupied"),
        ("a", "2025-03-10 12:00", "occupied"), ("a", "2025-03-10 12:00", "unoccupied"),
    ]
    usage = site.usage(events, [*SPACES, ("e", "3.300 E", "Meeting", "3", "Third")], **options)
    assert set(rows(latest.status_floor_now(usage, 3))) == {
        ("3.200 B", "occupied", at("2025-03-10 11:00")), ("3.300 E", "Unoccupied", at("2025-03-10 09:00")),
        ("3.100 A", "unoccupied", at("2025-03-10 12:00")),  # the tie goes to the later arrival
    }
    # a room that was free earlier and is occupied now is not free
    assert rows(latest.free_rooms_now(usage, 3)) == [("3.300 E", at("2025-03-10 09:00"))]
    assert rows(latest.free_rooms_now(usage, 3, max_age=Window(hours=1))) == []
    assert rows(latest.latest_room_status(usage, "3.100")) == [("unoccupied", at("2025-03-10 12:00"), "3.100 A")]
    assert rows(latest.latest_room_status(usage, "4.100")) == []


ZONE_SPACES = [
    ("a", "1.101 A", "office"), ("b", "1.102 B", "Library"), ("c", "1.103 C", "pantry"), ("d", "1.201 D", "office"),
    ("e", "1.202 E", "focus"), ("f", "2.T32 F", "office"),
]
ZONE_EVENTS = [
    ("a", "2025-03-10 09:10", "occupied"), ("a", "2025-03-10 10:10", "occupied"), ("b", "2025-03-10 09:10", "occupied"),
    ("b", "2025-03-10 10:10", "unoccupied"), ("d", "2025-03-10 10:20", "occupied"), ("a", "2025-03-10 10:50", "occupied"),
]


@BOTH
def test_zones(site, options):
    usage = site.usage(ZONE_EVENTS, ZONE_SPACES, **options)
    assert rows(zones.facility_features(usage)) == [
        (1, "10", 3, 3, 1, 1, "1.101 A, 1.102 B, 1.103 C"), (1, "20", 1, 2, 1, 0, "1.201 D, 1.202 E"),
        (2, "T3", None, 1, 0, 0, "2.T32 F"),
    ]
    # join rows: a and b have two active hours each, c none, d one, e none
    assert rows(zones.facility_features(usage, count_mode="join_rows")) == [
        (1, "10", 3, 5, 2, 1, "1.101 A, 1.102 B, 1.103 C"), (1, "20", 1, 2, 1, 0, "1.201 D, 1.202 E"),
        (2, "T3", None, 1, 0, 0, "2.T32 F"),
    ]
    assert [r[:3] for r in rows(zones.facility_features(usage, hours=1))] == [(1, "10", 1), (1, "20", 1), (2, "T3", None)]
    assert [r[:2] for r in rows(zones.facility_features(usage, floor=2))] == [(2, "T3")]
    with pytest.raises(ValueError):
        zones.facility_features(usage, count_mode="other")


@BOTH
def test_rank_zones(site, options):
    usage = site.usage(ZONE_EVENTS, ZONE_SPACES, **options)
    ranked = rows(zones.rank_zones(usage, zones.PlanOptions(k=3)))
    assert [r[:5] for r in ranked] == [(1, "10", 3, 3, 33.3), (1, "20", 1, 2, 50.0), (2, "T3", None, 1, 0.0)]
    assert [r[5] for r in ranked][:2] == pytest.approx([3 * 0.8 * 0.5, 1 * 0.7])
    assert ranked[2][5] is None
    plain = rows(zones.rank_zones(usage, zones.PlanOptions(k=1, avoid_quiet=False, downweight_refreshment=1.0)))
    assert plain[0][5] == 3.0 and len(plain) == 1
    floored = rows(zones.rank_zones(usage, zones.PlanOptions(k=3, quiet_weight=9.0)))
    assert [r[5] for r in floored] == [0.0, 0.0, None]
    assert sorted(rows(zones.ranked_zone_rooms(usage, zones.PlanOptions(k=2)))) == [
        (1, 1, "10", "1.101 A"), (1, 1, "10", "1.102 B"), (1, 1, "10", "1.103 C"), (2, 1, "20", "1.201 D"),
        (2, 1, "20", "1.202 E"),
    ]


def test_category_context_says_what_it_leaves_out(site):
    many = site.usage([], [(f"u{i}", f"1.{i:03d} R", f"kind {i:02d}", "1") for i in range(60)])
    (whole,), (cut,) = rows(profile.category_context(many, None))[0], rows(profile.category_context(many, 3))[0]
    assert whole.count("kind") == 60 and "kind 59" in whole
    assert cut.endswith("kind 00, kind 01, kind 02 (60 in all)")
    assert rows(profile.category_context(many, 60))[0][0] == whole


def test_hours_instead_of_days(sample):
    """A window of 48 hours is one of two days on a log without time zone."""
    assert rows(rates.busiest_rooms(sample, hours=48, limit=30)) == rows(rates.busiest_rooms(sample, days=2, limit=30))
    assert rows(rates.utilization_by_floor(sample, hours=48)) == rows(rates.utilization_by_floor(sample, 2))
    assert rows(rates.utilization_floor(sample, 3, hours=48)) == rows(rates.utilization_floor(sample, 3, 2))
    assert rows(rates.compare_floors(sample, 3, 4, hours=48)) == rows(rates.compare_floors(sample, 3, 4, 2))
    assert rows(rates.compare_floors_strict(sample, [3, 4], hours=48)) == rows(rates.compare_floors_strict(sample, [3, 4], 2))
    assert set(rows(dense.dense_rates(sample, 3, hours=48))) == set(rows(dense.dense_rates(sample, 3, 2)))
    assert rows(rates.busiest_rooms(sample, hours=1)) != rows(rates.busiest_rooms(sample, days=7))
    with pytest.raises((TypeError, ValueError)):
        rates.busiest_rooms(sample, hours=0)


def test_every_labelled_question_can_be_answered(spark, sample):
    """The parameters that the rules read are parameters of the operator that they name."""
    from dwellgrid.catalog.samples import PHRASINGS
    from dwellgrid.operators.questions import label_questions

    log = spark.createDataFrame([(p.format(f=3, d=9),) for p in PHRASINGS], "text string")
    answers = {
        "busiest_rooms": lambda r: rates.busiest_rooms(sample, r["floor"], r["days"], r["k"], r["hours"]),
        "underused_rooms": lambda r: dense.underused_rooms(sample, r["floor"], r["days"], r["threshold"], None, r["hours"]),
        "utilization_by_floor": lambda r: rates.utilization_by_floor(sample, r["days"], hours=r["hours"]),
        "utilization_floor": lambda r: rates.utilization_floor(sample, r["floor"], r["days"], r["hours"]),
        "compare_floors": lambda r: rates.compare_floors(sample, r["floor"], r["other_floor"], r["days"], r["hours"]),
    }
    asked = [r for r in label_questions(log).collect() if r["intent"] in answers]
    assert {r["intent"] for r in asked} == set(answers) and any(r["hours"] for r in asked)
    for row in asked:
        assert answers[row["intent"]](row).columns


def test_rollup_of_another_zone_is_refused(spark, site, tmp_path):
    events = site.events([("a", "2025-03-10 10:00", "occupied")]).withColumn("ts", F.col("ts").cast("timestamp"))
    store.write_rollup(events, str(tmp_path / "rollup"))
    usage = Usage.of(events, site.spaces([("a", "1.1 A")])).with_rollup(spark.read.parquet(str(tmp_path / "rollup")))
    assert rows(rates.kpis(usage, 24))[0][0] == 1
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(Exception, match="another time zone"):
            rates.kpis(usage, 24).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_overview(site):
    usage = site.usage(EVENTS, [*SPACES, ("zz", "5.100 Z", None, "5", "Fifth")])
    assert rows(overview.overview(usage)) == [(5, 100.0, 3, 66.7, "11:00 (100.0%)")]
    assert rows(overview.overview(site.usage([], SPACES))) == [(None, None, None, None, None)]
    assert rows(overview.data_overview(usage)) == [(3, 66.7, 66.7), (4, None, None), (5, 100.0, 100.0)]


def test_two_windows_in_one_pass(site):
    events = [*EVENTS, ("a", "2025-02-20 09:00", "unoccupied"), ("d", "2025-02-25 09:00", "occupied")]
    usage = site.usage(events, SPACES)
    both = by_key(rates.utilization_by_floor_windows(usage, (7, 30)))
    seven, thirty = by_key(rates.utilization_by_floor(usage, 7)), by_key(rates.utilization_by_floor(usage, 30))
    assert both == {f: (f, seven[f][1], thirty[f][1]) for f in (3, 4)}
    assert both[4] == (4, None, 100.0)


@pytest.fixture(scope="module")
def sample(spark):
    return sample_tables.usage(spark, "/root/testdata/sf0.001")


def test_identities_on_the_sample(sample):
    """Dense rates equal the mean of the dense series and bound the room rate from below."""
    closed = {r[:2]: r[2] for r in rows(dense.dense_rates(sample, None, 7))}
    grid = {r[:2]: r[2] for r in rows(
        dense.dense_hourly_series(sample, None, 7).groupBy("code", "room_name").agg(F.avg("occ")))}
    assert closed == pytest.approx(grid)
    below = {r[:2] for r in rows(dense.underused_rooms(sample, days=7, threshold=0.05))}
    assert below == {k for k, v in closed.items() if v < 0.05}
    room = (
        hourly.hourly_counts(sample, ["space_id", "room_name"], Window(days=7))
        .groupBy("space_id", "room_name").agg(F.expr(f"avg({hourly.ANY_OCCUPIED})"))
    )
    by_name = {k[1]: v for k, v in closed.items()}
    assert all(by_name[name] <= rate + 1e-12 for _, name, rate in rows(room))


def test_free_rooms_follow_from_status(sample):
    free = set(rows(latest.free_rooms_now(sample, 3, ("building",))))
    status = rows(latest.status_floor_now(sample, 3))
    assert free == {(n, t) for n, s, t in status if s == "unoccupied" and "BUILDING" in n}


CASES = {
    "by_floor": lambda u: rates.utilization_by_floor(u, 7),
    "busiest": lambda u: rates.busiest_rooms(u, days=7, limit=50),
    "kpis": lambda u: rates.kpis(u, 24),
    "zones": lambda u: zones.facility_features(u, hours=5, count_mode="join_rows"),
}


@pytest.mark.parametrize("end", [None, "2024-01-20 10:30:00", "2024-01-20 10:00:00"])
@pytest.mark.parametrize("case", sorted(CASES))
def test_stored_layouts_give_the_same_rates(spark, sample, stored, case, end):
    """A shuffled dimension, a date-partitioned log and a stored roll-up change plans, never results."""
    from dataclasses import replace

    moment = at(end) if end else None
    query, plain = CASES[case], replace(sample, at=moment)
    expected = rows(query(plain))
    log, rollup = spark.read.parquet(f"{stored}/log"), spark.read.parquet(f"{stored}/rollup")
    assert rows(query(replace(plain, events=log, broadcast_spaces=False))) == expected
    assert rows(query(replace(plain, events=log).with_rollup(rollup))) == expected


@pytest.fixture(scope="module")
def stored(sample, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    store.write_events(sample.events, f"{folder}/log")
    store.write_rollup(sample.events, f"{folder}/rollup")
    return folder


def test_dense_rates_on_a_partitioned_log(spark, sample, stored):
    from dataclasses import replace

    log = replace(sample, events=spark.read.parquet(f"{stored}/log"))
    assert set(rows(dense.dense_rates(log, None, 7))) == set(rows(dense.dense_rates(sample, None, 7)))
    large = replace(sample, broadcast_spaces=False)
    assert set(rows(dense.dense_rates(large, 3, 7))) == set(rows(dense.dense_rates(sample, 3, 7)))
    assert set(rows(dense.dense_hourly_series(large, 3, 2))) == set(rows(dense.dense_hourly_series(sample, 3, 2)))


def test_clock_change(spark, site):
    """Europe/Amsterdam skips an hour on 2025-03-30: days step by the calendar, hours by elapsed time."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        local = [
            ("a", "2025-03-29 12:00"), ("b", "2025-03-29 11:59"), ("a", "2025-03-30 01:30"), ("a", "2025-03-30 03:30"),
            ("c", "2025-03-29 11:00"), ("a", "2025-03-30 12:00"),
        ]
        events = site.events([(s, t, "occupied") for s, t in local]).withColumn("ts", F.col("ts").cast("timestamp"))
        usage = Usage.of(events, site.spaces([("a", "1.1 A"), ("b", "1.2 B"), ("c", "1.3 C")]))
        # one calendar day back is the same wall-clock time
        assert {r[0] for r in rows(rates.busiest_rooms(usage, days=1))} == {"1.1 A"}
        # 24 elapsed hours reach back to 11:00, start excluded
        assert rows(rates.kpis(usage, 24))[0][0] == 2
        hours = rows(store.hourly_rollup(usage.events).where("space_id = 'a'").orderBy("hour").select("hour"))
        assert len(hours) == 4
        dense_rate = by_key(dense.dense_rates(usage, None, 1))
        assert dense_rate["1.1"][2] == pytest.approx(4 / 25)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
