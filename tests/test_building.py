"""A building folder end to end: CSV files, views, profile, documents."""

from __future__ import annotations

import csv
import json
import os

import pytest
from helpers import rows
from pyspark.errors import AnalysisException, ParseException

from dwellgrid import schema
from dwellgrid.operators import profile
from dwellgrid.plans import documents
from dwellgrid.plans.building import Building
from dwellgrid.sources import csv_files

EVENT_HEADER = [f.name for f in schema.EVENT_SCHEMA]
SPACE_HEADER = [f.name for f in schema.SPACE_SCHEMA]


def event(space, millis, state, arrival="2025-03-08 22:14:02"):
    return ["2025-03-08", "2025-03-08 21:57:33", millis, space, state, "2025-03-08", arrival]


def space(uuid, room, floor, storey, kind="occupancy"):
    values = {
        "uuid": uuid, "room_name": room, "storey_floorId": floor, "storey_name": storey, "spaceType": kind,
        "sensor_name": f"DUS #{uuid}", "interiorSpace": "true", "building_address": '{"town":"X, Y"}',
    }
    return [values.get(name, "") for name in SPACE_HEADER]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("building")

    def put(name, header, lines):
        with open(path / name, "w", newline="") as f:
            csv.writer(f).writerows([header, *lines])

    t = 1741471053000  # 2025-03-08 21:57:33 UTC
    put("north_occupancy_sensors_offices.csv", EVENT_HEADER, [event("u1", t, "unoccupied"), event("u1", t + 3600_500, "occupied")])
    put("north_occupancy_sensors_meeting_rooms.csv", EVENT_HEADER, [
        event("u2", t, "occupied"), event("u2", t, "unoccupied", "2025-03-08 22:15:00"), event("u2", "bad", "occupied"),
    ])
    put(schema.SPACE_FILE, SPACE_HEADER, [
        space("u1", "3.325 - Kantoor", "3", "Verdieping 03"), space("u2", "3.400 - Overleg", "3", "Verdieping 03", "meeting"),
        space("u3", "9.T32", "", "Verdieping 09"), space("u4", "dynet thing", "3", "Verdieping 03"),
    ])
    return str(path)


@pytest.fixture(scope="module")
def building(spark, folder):
    return Building.from_csv(spark, folder)


def test_counts_and_floors(building):
    assert dict(rows(building.table_counts())) == {
        "events_office": 2, "events_meeting": 3, "spaces": 4, "spaces_filtered_count": 3
    }
    assert rows(building.list_floors()) == [(3, "Verdieping 03")]
    assert building.usage.broadcast_spaces


def test_values_parse(spark, folder, building):
    first = building.office.orderBy("ts").first()
    assert str(first["ts"]) == "2025-03-08 21:57:33" and str(first["event_time"]) == "2025-03-08 21:57:33"
    assert building.meeting.where("ts IS NULL").count() == 1
    lines = csv_files.read_csv(spark, f"{folder}/{schema.MEETING_FILE}", schema.EVENT_SCHEMA, "broken")
    assert [r["broken"] is not None for r in lines.collect()] == [False, False, True]
    assert building.usage.raw_spaces.where("uuid = 'u1'").first()["building_address"] == '{"town":"X, Y"}'


def test_analytics(building):
    assert rows(building.utilization_by_floor()) == [(3, 100.0), (9, None)]
    assert rows(building.free_meeting_rooms_now(3))[0][0] == "3.400 - Overleg"
    assert {r[:2] for r in rows(building.status_floor_now("verdieping 03"))} == {
        ("3.325 - Kantoor", "occupied"), ("3.400 - Overleg", "unoccupied")
    }
    assert rows(building.latest_room_status("3.325"))[0][0] == "occupied"
    assert rows(building.kpis())[0][0] == 2
    assert len(rows(building.dense_hourly_series(days=1))) == 3 * 25
    assert rows(building.plan_coffee_machines())[0][:3] == (3, "32", 1)
    assert rows(building.data_overview())[0] == (3, 100.0, 100.0)
    assert rows(building.overview())[0][:4] == (3, 100.0, 3, 100.0)
    assert rows(building.compare_floors_strict([3, 9])) == [(3, 100.0)]
    assert rows(building.find_rooms_like("9T3")) == [("9.T32", "Verdieping 09")]


def test_logs_of_several_buildings(spark, folder, tmp_path):
    """One folder may hold several buildings' logs, but one building has one log of each kind."""
    import shutil

    for name in os.listdir(folder):
        shutil.copy(os.path.join(folder, name), tmp_path / name)
        if "sensors" in name:
            shutil.copy(os.path.join(folder, name), tmp_path / name.replace("north", "south"))
    with pytest.raises(ValueError, match="several logs"):
        Building.from_csv(spark, str(tmp_path))
    assert Building.from_csv(spark, str(tmp_path), building="south").office.count() == 2


def test_views_and_adhoc(spark, building):
    assert rows(building.query("SELECT count(*) AS n FROM events_enriched WHERE hour IS NOT NULL")) == [(4,)]
    assert len(rows(building.query("SELECT * FROM range(2000) -- note"))) == 2000
    for text, more in (("SELECT * FROM range(2000) -- note", True), ("SELECT * FROM range(2000) LIMIT 500", False)):
        found = rows(building.query(text, 500))
        assert len(found) == 500 and {r[1] for r in found} == {more}
    assert len(rows(building.query("WITH a AS (SELECT 1 AS x) SELECT * FROM a"))) == 1
    for statement in ("DROP VIEW spaces", "CREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "INSERT INTO spaces SELECT 1"):
        with pytest.raises((ParseException, AnalysisException)):
            building.query(statement)
    for path in ("parquet.`/root/testdata/sf0.001/nation.parquet`", "text.`/etc/hostname`"):
        with pytest.raises(AnalysisException):
            building.query(f"SELECT * FROM {path}")
    assert spark.sql("SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`").count() == 25
    assert "spaces" in {t.name for t in spark.catalog.listTables()}


def test_profile(building):
    row = building.data_profile().first()
    assert (row["rows_office"], row["rows_meeting"], row["rooms"]) == (2, 3, 3)
    assert (row["floors"], row["space_types"]) == ("3", "meeting, occupancy")
    assert rows(profile.category_context(building.usage)) == [("Floors: 3\nSpace types: meeting, occupancy",)]


def test_grounding_document(spark, building, tmp_path):
    frame = building.grounding_document()
    document = json.loads(frame.first()[0])
    assert set(document["tables"]) == {"events_all", "events_office", "events_meeting", "events_enriched", "spaces"}
    enriched = document["tables"]["events_enriched"]
    assert enriched["exists"] and {c["column"] for c in enriched["schema"]} >= {"ts", "hour", "day"}
    record = json.loads(enriched["sample_rows"][0])
    assert record["ts"] == "2025-03-08 21:57:33+0000" and record["event_date"] == "2025-03-08 00:00:00+0000"
    assert record["event_timestamp"] == 1741471053000
    assert document["dictionaries"] == {"floors": [3], "space_types": ["meeting", "occupancy"]}
    assert document["synonyms"]["meeting room"] == ["conference room", "vergaderruimte"]
    documents.write_grounding_document(frame, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["data_window"]["ts_min"]


def test_missing_table(spark):
    assert rows(profile.table_description(spark, "no_such_table")) == [("no_such_table", False, "[]", [])]


def test_json_records(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert rows(profile.json_records(df)) == [('{"a":1,"b":null,"c":null}',)]


def test_row_documents(building):
    found = rows(building.row_documents())
    assert ("utilization_7d", "floor: 3\nocc_rate_percent: 100.0") in found
    assert ("utilization_30d", "floor: 9") in found
    assert ("spaces", "display_name: 9.T32\nroom_name: 9.T32\nspaceType: occupancy\nstorey_name: Verdieping 09") in found
