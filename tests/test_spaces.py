from __future__ import annotations

import pytest
from helpers import by_key, rows
from pyspark.sql import functions as F

from dwellgrid.functions import codes
from dwellgrid.functions.floors import floor_token
from dwellgrid.operators import lookup, profile

NAMES = [
    ("a", "3.325 - Kantoor"), ("b", " 9.T32 "), ("c", "-1.200"), ("d", "+2.10"), ("e", "No code"), ("f", "3.1 dynet"),
    ("g", "3.2 Sensor"), ("h", None), ("i", ""), ("j", "1.200"), ("k", "99999999999.1"),
]


@pytest.fixture(scope="module")
def named(site):
    return site.usage([], NAMES)


def test_cleaning(named):
    found = by_key(named.spaces.select("uuid", "label", "code", "room_id", "room_key", "display_name", "floor_n"))
    assert found == {
        "a": ("a", "3.325 - Kantoor", "3.325", "3325", "3325", "3.325", 3),
        "b": ("b", "9.T32", "9.T32", "9T32", "9T32", "9.T32", 9),
        "c": ("c", "-1.200", "-1.200", "-1200", "-1200", "-1.200", -1),
        "d": ("d", "+2.10", "+2.10", "+210", "210", "+2.10", 2),
        "j": ("j", "1.200", "1.200", "1200", "1200", "1.200", 1),
    }


def test_zone(named):
    zones = dict(rows(named.spaces.select("uuid", codes.zone())))
    assert zones == {"a": "32", "b": "T3", "c": "20", "d": "10", "j": "20"}


@pytest.mark.parametrize(
    "room, expected",
    [("3.325", {"sensor a"}), ("9.t32", {"sensor b"}), ("-1.200", {"sensor c"}), ("1.200", {"sensor j"}),
     ("1200", {"sensor j"}), ("--", set()), ("", set()), ("room 3.325", {"sensor a"}), ("it's 9", set())],
)
def test_sensors_for_room(named, room, expected):
    assert {r[0] for r in rows(lookup.sensors_for_room(named, room))} == expected


@pytest.mark.parametrize(
    "text, expected",
    [("kantoor", {"3.325 - Kantoor"}), ("3.3", {"3.325 - Kantoor"}), ("t3", {" 9.T32 "}), ("--", set()), ("", set()),
     ("  ", set()), ("%", set()), ("200", {"-1.200", "1.200"})],
)
def test_find_rooms_like(named, text, expected):
    assert {r[0] for r in rows(lookup.find_rooms_like(named, text))} == expected


def test_find_rooms_is_in_code_order_and_limited(site):
    usage = site.usage([], [(str(i), f"1.{i:03d} Room", None, "1", "A") for i in range(30, 0, -1)])
    found = rows(lookup.find_rooms_like(usage, "room"))
    assert [r[0] for r in found] == [f"1.{i:03d} Room" for i in range(1, 21)]


@pytest.mark.parametrize("text, number", [("3", 3), (" +3 ", 3), ("-1", -1), (4, 4), ("Verdieping 03", None), ("", None)])
def test_floor_token(text, number):
    assert floor_token(text) == number


FLOORS = [
    ("a", "3.1", None, "4", "Verdieping 04"), ("b", "3.2", None, None, "Verdieping 03"),
    ("c", "3.3", None, "x", "Verdieping 03"), ("d", "4.1", None, "4", "Verdieping 04"),
]


def test_floor_sources(site):
    usage = site.usage([], FLOORS)
    assert {r[0] for r in rows(lookup.rooms_on_floor(usage, 3))} == {"3.2", "3.3"}
    assert [r[0] for r in rows(lookup.rooms_on_floor(usage, "4"))] == ["3.1", "4.1"]
    assert {r[0] for r in rows(lookup.rooms_on_floor(usage, " VERDIEPING 03"))} == {"3.2", "3.3"}
    assert rows(lookup.rooms_on_floor(usage, "o'clock")) == []
    assert rows(lookup.list_floors(usage)) == [(4, "Verdieping 04"), (None, "Verdieping 03")]


def test_space_types(site):
    usage = site.usage([], [("a", "1.1", " meeting "), ("b", "1.2", ""), ("c", "1.3", None), ("d", "1.4", "lab")])
    assert rows(profile.space_types(usage)) == [("lab",), ("meeting",)]


def test_category_ignores_case_and_null(site):
    usage = site.usage([], [("a", "1.1", "Big MEETING room"), ("b", "1.2", None), ("c", "1.3", "lab")])
    flags = dict(rows(usage.spaces.select("uuid", codes.contains_any("spaceType", ("meeting",)))))
    assert flags == {"a": True, "b": False, "c": False}
    assert rows(usage.spaces.where(codes.contains_any("spaceType", ())).agg(F.count("*"))) == [(0,)]
