"""Profiles, intervals, the trip-based search and updates of trips, against plain versions on small networks."""

import random

import pytest

from tests.test_operators import EVENTS, events, start
from tramline import api
from tramline.functions.spans import Spans
from tramline.operators import footpaths, journeys, realtime, requests, routes, trip_based
from tramline.sources import bundle, gtfs


def random_network(spark, seed, trips=40, stops=12):
    r = random.Random(seed)
    rows = []
    for t in range(trips):
        at, line = r.randrange(300, 700), r.sample(range(stops), r.randrange(2, 6))
        if r.random() < 0.3:
            line.append(line[0])
        for i, s in enumerate(line):
            rows.append((t, i, s, at, at + 1, r.random() < 0.9, r.random() < 0.9))
            at += r.randrange(5, 40)
    locations = spark.createDataFrame([(s, 2 + s % 3) for s in range(stops)], "location_id long, transfer_min long")
    walks = [(s, (s + 1) % stops, 5) for s in range(0, stops, 3)]
    return spark.createDataFrame(rows, EVENTS), locations, spark.createDataFrame(walks + [(b, a, m) for a, b, m in walks], "from_id long, to_id long, minutes long")


@pytest.mark.parametrize("seed", [1, 2])
def test_trip_based_search_equals_the_rounds(spark, seed):
    network = random_network(spark, seed)
    changes = trip_based.all_changes(*network)
    asked = spark.createDataFrame([(s, s, 320) for s in range(4)], "query_id long, location_id long, time long")
    labels = journeys.rounds(journeys.Search(*network), asked, 3).where("kind = 'arrive'")
    want = {(r.query_id, r["round"] - 1, r.location_id): r.arr for r in labels.collect()}
    got = {(r.query_id, r.transfers, r.location_id): r.arr for r in trip_based.search(network[0], changes, asked, network[2], 3).collect()}
    # The rounds have no label of a stop from which the journey began.
    assert {k: v for k, v in got.items() if k in want} == want
    assert all(any(w[0] == k[0] and w[2] == k[2] and w[1] <= k[1] and want[w] <= v for w in want) or k[0] == k[2] for k, v in got.items())


@pytest.mark.parametrize("seed", [3, 4])
def test_pruned_profile_equals_each_start_by_itself(spark, seed):
    network = random_network(spark, seed)
    search = journeys.Search(*network)
    off = spark.createDataFrame([(0, 0), (1, 4)], "location_id long, minutes long")
    ends = spark.createDataFrame([(7, 0), (8, 3)], "location_id long, minutes long")
    found = {tuple(r) for r in journeys.profile(search, off, ends, 300, 600, 3).collect()}
    starts = journeys.start_events(search.events(), off, 300, 600).selectExpr("start_time as query_id", "location_id", "time")
    labels = journeys.rounds(search, starts, 3).where("kind = 'arrive' and location_id in (7, 8)").collect()
    rows = {(r.query_id, r.arr + (3 if r.location_id == 8 else 0), r["round"] - 1) for r in labels}
    best = {a for a in rows if not any(b != a and b[0] >= a[0] and b[1] <= a[1] and b[2] <= a[2] for b in rows)}
    assert found == {b for b in best if b[0] < 600} and found


def test_ping_pong_sees_timed_walks(spark):
    """A ride that leaves at 500 comes at 512; the walk takes 25 minutes until 515, then 1, so only the ride at 490 catches 520 before."""
    own = events(spark, {1: [(1, 490, 490), (2, 494, 494)], 2: [(1, 500, 500), (2, 512, 512)], 3: [(3, 520, 520), (4, 530, 530)]})
    locations = spark.createDataFrame([(i, 2) for i in range(1, 5)], "location_id long, transfer_min long")
    none = spark.createDataFrame([], "from_id long, to_id long, minutes long")
    steps = spark.createDataFrame([(2, 3, 0, 25, False)], "from_id long, to_id long, valid_from long, duration long, blocked boolean")
    search = journeys.Search(own, locations, none, td_edges=steps)
    assert [tuple(r) for r in journeys.ping_pong(search, 1, 4, 480, 2).collect()] == [(1, 490, 530)]


def test_ping_pong_sees_section_flags(spark):
    """The later trip has a section without the flag on the way, the earlier one none."""
    rows = [(1, 0, 1, 500, 500, True), (1, 1, 2, 510, 510, True), (1, 2, 3, 540, 540, False), (2, 0, 1, 505, 505, True), (2, 1, 2, 515, 515, False), (2, 2, 3, 530, 530, True), (3, 0, 1, 506, 506, True), (3, 1, 3, 540, 540, True)]
    own = spark.createDataFrame([(t, i, at, a, d, True, True, f) for t, i, at, a, d, f in rows], EVENTS + ", bikes_on boolean")
    locations = spark.createDataFrame([(i, 2) for i in range(1, 4)], "location_id long, transfer_min long")
    none = spark.createDataFrame([], "from_id long, to_id long, minutes long")
    search = journeys.Search(own, locations, none, section_flag="bikes_on")
    assert [tuple(r) for r in journeys.ping_pong(search, 1, 3, 480, 1).collect()] == [(0, 506, 540)]
    assert [tuple(r) for r in journeys.ping_pong(journeys.Search(own, locations, none), 1, 3, 480, 1).collect()] == [(0, 505, 530)]


def test_roots_of_chains_and_cycles(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 7)]
    cycle = [(100, 101), (101, 102), (102, 100)]
    long = [(200 + i, 199 + i if i else None) for i in range(40)]
    got = {r.location_id: r.root_id for r in routes.roots(spark.createDataFrame(chain + cycle + long, "location_id long, parent_id long")).collect()}
    assert {got[i] for i in range(1, 7)} == {1} and (got[100], got[101], got[102]) == (101, 102, 100)
    assert got[221] == 200 and got[222] == 221 and got[239] == 238


def test_intervals():
    day = 1440
    own = requests.Intervals((10 * day, 10 * day + 60), (0, 100 * day), least=3, later=True)
    assert own.initial() == (10 * day, 10 * day + 60 + 240) and own.extended((600, 700), 2) == (8 * day, 8 * day)
    both = requests.Intervals((10 * day, 10 * day + 60), (0, 100 * day), least=3, earlier=True, later=True)
    assert both.initial() == (10 * day - 60, 10 * day + 60 + 180)
    assert both.extended((10 * day, 10 * day + 100), 3) == (10 * day - 150, 10 * day + 250)
    assert requests.Intervals((10 * day, 10 * day + 60), (0, 100 * day), least=0, later=True).initial() == (10 * day, 10 * day + 60)
    tight = requests.Intervals((50, 100), (0, 120), least=3, earlier=True, later=True)
    assert tight.initial() == (0, 120) and tight.widest() == (0, 120)
    back = requests.Intervals((10 * day, 10 * day + 60), (0, 100 * day), least=2, earlier=True, later=True, backward=True)
    assert back.initial() == (10 * day - 120, 10 * day + 120)


def test_limits_and_vias(spark):
    assert requests.travel_limit(-5) == requests.travel_limit(None) == requests.travel_limit(99_999) == 1440 and requests.travel_limit(90) == 90
    assert requests.merged_vias([(1, 5), (2, 3), (3, 1)], [(1, 2)]) == [(1, 8), (3, 1)] and requests.merged_vias([(1, 0), (1, 4)]) == [(1, 4)] and requests.merged_vias([]) == []
    places = spark.createDataFrame([(1, None), (2, 1), (3, None)], "location_id long, parent_id long")
    one = lambda at: spark.createDataFrame([(at,)], "location_id long")
    assert requests.overlapping(one(1), one(2), places) and not requests.overlapping(one(1), one(3), places)
    assert not requests.overlapping(one(1), one(2), places, "exact", "exact") and not requests.overlapping(one(1), one(1), places, "intermodal")


def test_random_queries_repeat(spark):
    places = spark.createDataFrame([(i, 48 + i * 0.02, 8.0) for i in range(40)], "location_id long, lat double, lng double")
    a, b, c = (sorted(map(tuple, requests.random_queries(places, 20, s).collect())) for s in (1, 1, 2))
    assert a == b != c and len(a) >= 15 and all(abs(x - y) * 0.02 * 111_000 > 45 * 90 - 1000 for _, x, y in a)


def test_a_loop_takes_updates_in_order(spark):
    own = events(spark, {1: [(10, 500, 500), (11, 510, 511), (10, 520, 521), (12, 530, 531)]})
    asked = spark.createDataFrame([(100 + i, 1, i, None, at) for i, at in enumerate([10, 11, 10])] + [(200, 1, 3, None, 99), (201, 1, 4, 3, None)], "event_id long, trip_id long, position long, stop_seq long, location_id long")
    got = {r.event_id: r.stop_seq for r in realtime.matched_stops(asked, own).collect()}
    assert got == {100: 0, 101: 1, 102: 2, 201: 3}


def plain_times(stops, changes):
    """The same rule, event by event: (arr, dep) of stops with {stop: (arr_delay, dep_delay, arr_time, dep_time)}."""
    last, at, late, out = len(stops) - 1, None, None, []
    for i, (arr, dep) in enumerate(stops):
        ad, dd, at_, dt = changes.get(i, (None,) * 4)
        if i == 0 and dd is None and dt is None:
            dd, dt = ad, at_
        for planned, delay, time, before in ([] if i == 0 else [(arr, ad, at_, stops[i - 1][1])]) + ([] if i == last else [(dep, dd, dt, arr if i else -10**6)]):
            floor = at if at is not None else before
            if delay is not None:
                at, late = max(floor, planned + delay), delay
            elif time is not None:
                at = max(floor, time)
                late = at - planned
            elif at is not None:
                at = max(at, planned + late)
            out.append(at if at is not None else planned)
    for i in range(1, len(out)):
        out[i] = max(out[i], out[i - 1])
    return out


def test_times_of_updates_against_a_plain_version(spark):
    r = random.Random(9)
    trips, changes = {}, []
    for t in range(60):
        at, line = 500, []
        for _ in range(r.randrange(2, 7)):
            line.append((len(line), at, at + 2))
            at += r.randrange(4, 20)
        trips[t] = line
        for i in range(len(line)):
            if r.random() < 0.5 or i == 0 and t % 2:
                pick = lambda base: (r.randrange(-5, 30), None) if r.random() < 0.5 else (None, base + r.randrange(-10, 20)) if r.random() < 0.5 else (None, None)
                (ad, at_), (dd, dt) = pick(line[i][1]), pick(line[i][2])
                changes.append((t, i, ad, dd, at_, dt))
    asked = spark.createDataFrame(changes, "trip_id long, stop_seq long, arr_delay long, dep_delay long, arr_time long, dep_time long")
    got = {}
    for x in realtime.retimed(events(spark, trips), asked).collect():
        got.setdefault(x.trip_id, {})[x.stop_seq] = (x.arr, x.dep)
    for t, own in got.items():
        want = plain_times([(a, d) for _, a, d in trips[t]], {i: (ad, dd, at_, dt) for k, i, ad, dd, at_, dt in changes if k == t})
        flat = [v for i in range(len(own)) for v in own[i]][1:-1]
        assert flat == want, t
    assert len(got) > 50


def test_messages_change_a_timetable(spark):
    own = events(spark, {1: [(10, 500, 500), (11, 510, 511), (12, 520, 520)], 2: [(10, 600, 600), (12, 620, 620)], 3: [(10, 700, 700), (12, 720, 720)]})
    columns = "event_id long, trip_id long, position long, stop_seq long, location_id long, arr_delay long, dep_delay long, arr_time long, dep_time long, skipped boolean, cancelled boolean, assigned_id long"
    rows = [(1, 1, 0, 0, None, None, 7, None, None, False, False, None), (2, 1, 1, None, 11, None, None, None, None, False, False, 13), (3, 2, 0, 0, None, None, None, None, None, True, False, None), (4, 3, None, None, None, None, None, None, None, False, True, None)]
    same = spark.createDataFrame([(11, 13), (13, 11)], "location_id long, other_id long")
    changed = realtime.run_updates(own, spark.createDataFrame(rows, columns), same)
    got = {(r.trip_id, r.stop_seq): (r.location_id, r.arr, r.dep, r.cancelled) for r in changed.collect()}
    assert got[1, 0] == (10, 507, 507, False) and got[1, 1] == (13, 517, 518, False) and got[1, 2] == (12, 527, 527, False)
    assert got[2, 0][3] and got[3, 1][3]
    assert {r.trip_id for r in realtime.applied(own, changed).collect()} == {1}


def test_a_missing_feed_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        gtfs.read(spark, str(tmp_path))
    with pytest.raises(Exception):  # noqa: B017
        gtfs.raw(spark, "nosuch://host/feed", "stops")
    with pytest.raises(Exception):  # noqa: B017
        bundle.read(spark, str(tmp_path / "none"))


def test_frequencies_in_the_facade(spark):
    tables = {
        "service_days": spark.createDataFrame([("s", "2024-01-01")], "service_id string, day string").selectExpr("service_id", "cast(day as date) as day"),
        "trips": spark.createDataFrame([("often", "s", 1, "r"), ("once", "s", 1, "r")], "trip_id string, service_id string, clasz int, route_id string"),
        "stop_times": spark.createDataFrame([(t, i, s, at, at, True, True) for t in ("often", "once") for i, s, at in ((0, "a", 60), (1, "b", 70))], "trip_id string, stop_seq long, stop_id string, arr long, dep long, in_allowed boolean, out_allowed boolean"),
        "frequencies": spark.createDataFrame([("often", 300, 330, 10)], "trip_id string, start long, end long, headway int"),
    }
    rows = api.Timetable(tables).on_days("2024-01-01", "2024-01-01").collect()
    assert sorted((r.trip_id, r.dep) for r in rows if r.stop_seq == 0) == [("often@2024-01-01@300", 300), ("often@2024-01-01@310", 310), ("often@2024-01-01@320", 320), ("once@2024-01-01", 60)]
    assert sorted(r.arr for r in rows if r.stop_seq == 1) == [70, 310, 320, 330]


def test_sorted_footpaths_and_spans(spark, tmp_path):
    walks = spark.createDataFrame([(1, 2, 9), (1, 3, 4), (2, 1, 9)], "from_id long, to_id long, minutes long")
    spans = Spans(spark)
    with spans.span("all"), spans.span("write"):
        footpaths.persisted(walks, str(tmp_path / "walks"))
    assert [p for p, _ in spans.records] == ["all/write", "all"]
    assert sorted(map(tuple, footpaths.by_duration(spark.read.parquet(str(tmp_path / "walks"))).collect())) == [(1, 2, 9, 2), (1, 3, 4, 1), (2, 1, 9, 1)]


def test_searches_count_and_stop_at_targets(spark):
    network = random_network(spark, 5)
    search = journeys.Search(*network)
    whole = journeys.rounds(search, start(spark, 0, 320), 3)
    ends = spark.createDataFrame([(5, 0)], "location_id long, minutes long")
    some = journeys.rounds(search, start(spark, 0, 320), 3, ends)
    pick = lambda labels: sorted((r["round"], r.arr) for r in labels.where("kind = 'arrive' and location_id = 5").collect())
    assert pick(whole) == pick(some)
    assert sum(r.by_ride + r.by_walk for r in requests.counters(whole).collect()) == whole.where("kind = 'arrive'").count() >= some.where("kind = 'arrive'").count()
