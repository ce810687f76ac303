from datetime import date

import pytest

from trekmill.operators import live

DAY, BASE = date(2024, 1, 10), 1_704_844_800
TRIPS = "trip_ref int, trip_id string, start_date date, route_id string, direction_id int, start_time int, cancelled boolean, deleted boolean, delay int"
STOPS = "trip_ref int, pos int, stop_id string, time long, delay int, skipped boolean, no_data boolean, from_arrival boolean"
CALLS = "trip_id string, day date, stop_id string, scheduled long, in_minutes int, estimated boolean, route_id string, direction_id int, start_time int"


def call(trip, stop, minute, route=None, direction=None, start=None, estimated=False):
    return (trip, DAY, stop, BASE + minute * 60, minute, estimated, route, direction, start)


def trip(ref, id_, day=DAY, route=None, direction=None, start=None, cancelled=None, deleted=None, delay=None):
    return (ref, id_, day, route, direction, start, cancelled, deleted, delay)


def at(ref, pos, stop, minute=None, delay=None, skipped=None, no_data=None, from_arrival=None):
    return (ref, pos, stop, None if minute is None else BASE + int(minute * 60), delay, skipped, no_data, from_arrival)


def told(spark, calls, trips, stops):
    got = live.resolve(spark.createDataFrame(calls, CALLS), spark.createDataFrame(trips, TRIPS), spark.createDataFrame(stops, STOPS))
    return {(r.trip_id, r.stop_id, r.scheduled): (r.cancelled, r.delay) for r in got.collect()}


CASES = {
    "own delay": ([trip(1, "t")], [at(1, 0, "s", 11, 60)], (False, 1)),
    "half a minute rounds up": ([trip(1, "t")], [at(1, 0, "s", None, 90)], (False, 2)),
    "early by half a minute rounds up": ([trip(1, "t")], [at(1, 0, "s", None, -90)], (False, -1)),
    "time alone, whole minutes down": ([trip(1, "t")], [at(1, 0, "s", 12.9)], (False, 2)),
    "arrival alone says nothing": ([trip(1, "t", delay=240)], [at(1, 0, "s", 15, None, from_arrival=True)], (False, 4)),
    "trip cancelled": ([trip(1, "t", cancelled=True)], [at(1, 0, "s", 11, 60)], (True, None)),
    "stop skipped": ([trip(1, "t")], [at(1, 0, "s", 11, 60, skipped=True)], (True, None)),
    "no data here": ([trip(1, "t", delay=300)], [at(1, 0, "a", 5, 60), at(1, 1, "s", no_data=True)], (False, None)),
    "carried": ([trip(1, "t")], [at(1, 0, "a", 6, 120), at(1, 1, "z", 40, 600)], (False, 2)),
    "carried, last of two": ([trip(1, "t")], [at(1, 0, "a", 6, 120), at(1, 1, "b", 9, 180)], (False, 3)),
    "barrier after the event": ([trip(1, "t", delay=60)], [at(1, 0, "a", 6, 120), at(1, 1, "b", no_data=True)], (False, None)),
    "barrier before the event": ([trip(1, "t")], [at(1, 0, "b", no_data=True), at(1, 1, "a", 6, 120)], (False, 2)),
    "barrier of a stop after this one": ([trip(1, "t")], [at(1, 0, "a", 6, 120), at(1, 9, "z", no_data=True)], (False, None)),
    "only events after": ([trip(1, "t", delay=60)], [at(1, 0, "z", 50, 120)], (False, None)),
    "no events at all": ([trip(1, "t", delay=60)], [], (False, 1)),
    "events without a place in time": ([trip(1, "t", delay=60)], [at(1, 0, "a", None, 500)], (False, 1)),
    "skipped events carry nothing": ([trip(1, "t", delay=60)], [at(1, 0, "a", 5, 500, skipped=True)], (False, 1)),
    "a day or more": ([trip(1, "t")], [at(1, 0, "s", None, 86_400)], (False, None)),
    "the nearest of two passages": ([trip(1, "t")], [at(1, 0, "s", 100, 60), at(1, 1, "s", 13, 180), at(1, 2, "s", None, 900)], (False, 3)),
    "another day's run": ([trip(1, "t", date(2024, 1, 11))], [at(1, 0, "s", 11, 60)], (False, None)),
    "the only undated": ([trip(1, "t", None)], [at(1, 0, "s", 11, 60)], (False, 1)),
    "two undated": ([trip(1, "t", None), trip(2, "t", None)], [at(1, 0, "s", 11, 60)], (False, None)),
    "dated before undated": ([trip(1, "t", None, delay=600), trip(2, "t", delay=60)], [], (False, 1)),
    "first of two dated": ([trip(2, "t", delay=600), trip(1, "t", delay=60)], [], (False, 1)),
    "by route and start": ([trip(1, None, route="r", direction=0, start=600, delay=60)], [], (False, 1)),
    "other direction": ([trip(1, None, route="r", start=600, delay=60)], [], (False, None)),
    "by id before route": ([trip(1, None, route="r", direction=0, start=600, delay=600), trip(2, "t", None, delay=60)], [], (False, 1)),
    "a key needs a date": ([trip(1, None, None, route="r", direction=0, start=600, delay=60)], [], (False, None)),
}


@pytest.fixture(scope="module")
def all_cases(spark):
    """Every case as a trip of its own, so that one run answers all."""
    calls, trips, stops = [], [], []
    for n, (own_trips, own_stops, _) in enumerate(CASES.values()):
        own = lambda v, n=n: v and f"{v}{n}"
        calls.append(call(f"t{n}", "s", 10, f"r{n}", 0, 600))
        trips += [(100 * n + t[0], own(t[1]), t[2], own(t[3]), *t[4:]) for t in own_trips]
        stops += [(100 * n + s[0], *s[1:]) for s in own_stops]
    return told(spark, calls, trips, stops)


@pytest.mark.parametrize("name", CASES)
def test_resolution(all_cases, name):
    n = list(CASES).index(name)
    assert all_cases[f"t{n}", "s", BASE + 600] == CASES[name][2]


def test_rows_that_go_or_stay(spark):
    calls = [call("gone", "s", 10), call("estimated", "s", 10, estimated=True), call("unknown", None, 10), call(None, "s", 10), call("loop", "s", 10), call("loop", "s", 90), call("loop", "s", 90)]
    got = told(spark, calls, [trip(1, "gone", deleted=True), trip(2, "estimated", cancelled=True), trip(3, "loop")], [at(3, 0, "s", 11, 60), at(3, 5, "s", 95, 300)])
    assert ("gone", "s", BASE + 600) not in got and got["estimated", "s", BASE + 600] == (False, None) == got["unknown", None, BASE + 600] == got[None, "s", BASE + 600]
    assert got["loop", "s", BASE + 600] == (False, 1) and got["loop", "s", BASE + 5400] == (False, 5)
    rows = live.resolve(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], TRIPS), spark.createDataFrame([], STOPS))
    assert rows.count() == len(calls)
