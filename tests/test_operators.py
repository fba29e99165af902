import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo, times
from tramline.operators import alerts, areas, calendar, fares, graph, journeys, matching, measures, realtime, rides, routes, skyline, stop_times

EVENTS = "trip_id long, stop_seq long, location_id long, arr long, dep long, in_allowed boolean, out_allowed boolean"


def events(spark, trips):
    return spark.createDataFrame([(t, i, at, arr, dep, True, True) for t, stops in trips.items() for i, (at, arr, dep) in enumerate(stops)], EVENTS)


@pytest.fixture(scope="module")
def network(spark):
    """A - B - C every half hour, and C - D; A is 1, D is 4; a walk leads from C to 5."""
    trips = {}
    for k in range(6):
        t = 300 + 30 * k
        trips[10 + k] = [(1, t, t), (2, t + 60, t + 60)]
        trips[20 + k] = [(2, t + 75, t + 75), (3, t + 135, t + 135)]
        trips[30 + k] = [(3, t + 150, t + 150), (4, t + 200, t + 200)]
    locations = spark.createDataFrame([(i, 2) for i in range(1, 6)], "location_id long, transfer_min long")
    walks = spark.createDataFrame([(3, 5, 10), (5, 3, 10)], "from_id long, to_id long, minutes long")
    return events(spark, trips), locations, walks


def start(spark, at, time):
    return spark.createDataFrame([(0, at, time)], "query_id long, location_id long, time long")


def test_departures_and_arrivals_of_a_change(spark, network):
    search = journeys.Search(*network)
    off = spark.createDataFrame([(1, 0)], "location_id long, minutes long")
    target = spark.createDataFrame([(3, 0)], "location_id long, minutes long")
    found = sorted(tuple(r) for r in journeys.profile(search, off, target, 300, 360).collect())
    assert found == [(300, 435, 1), (330, 465, 1)]


def test_backwards(spark, network):
    search = journeys.Search(journeys.mirrored(network[0]), network[1], network[2])
    best = {r.location_id: -r.arr for r in journeys.one_to_all(journeys.rounds(search, start(spark, 3, -470), 3)).collect()}
    assert best == {2: 405, 1: 330}


def test_search_ends_and_walks_once(spark, network):
    labels = journeys.rounds(journeys.Search(*network), start(spark, 1, 300))
    assert labels.agg(F.max("round")).first()[0] == 3
    best = {r.location_id: (r.arr, r.round) for r in journeys.one_to_all(labels).collect()}
    assert best == {2: (360, 1), 3: (435, 2), 5: (445, 2), 4: (500, 3)}


def test_legs_lead_back(spark, network):
    labels = journeys.rounds(journeys.Search(*network), start(spark, 1, 300), 3)
    legs = journeys.reconstruct(labels, spark.createDataFrame([(4,)], "location_id long"), 3).orderBy(F.desc("leg")).collect()
    assert [(x.from_id, x.to_id, x.trip_id) for x in legs] == [(1, 2, 10), (2, 3, 20), (3, 4, 30)]


def test_transfer_settings(spark, network):
    slow = journeys.Search(*network, least_transfer=20)
    best = {r.location_id: r.arr for r in journeys.one_to_all(journeys.rounds(slow, start(spark, 1, 300), 2)).collect()}
    assert best[3] == 465


def test_ping_pong_departs_late(spark, network):
    found = journeys.ping_pong(journeys.Search(*network), 1, 3, 301).collect()
    assert [(r.transfers, r.dep, r.arr) for r in found] == [(1, 330, 465)]


def test_vias(spark, network):
    search = journeys.Search(*network, vias=[(2, 50)])
    best = {r.location_id: r.arr for r in journeys.one_to_all(journeys.rounds(search, start(spark, 1, 300), 3), vias=1).collect()}
    assert best[3] == 495
    none = journeys.Search(*network, vias=[(5, 0)])
    assert journeys.one_to_all(journeys.rounds(none, start(spark, 1, 300), 3), vias=1).collect() == []


def test_time_dependent_walks(spark, network):
    edges = spark.createDataFrame([(3, 5, 0, 10, True), (3, 5, 450, 4, False)], "from_id long, to_id long, valid_from long, duration long, blocked boolean")
    best = {r.location_id: r.arr for r in journeys.one_to_all(journeys.rounds(journeys.Search(*network, td_edges=edges), start(spark, 1, 300), 2)).collect()}
    assert best[5] == 454


def test_strings_as_identifiers(spark, network):
    as_text = [df.select(*(F.col(c).cast("string").alias(c) if c in ("location_id", "from_id", "to_id", "trip_id") else c for c in df.columns)) for df in network]
    starts = spark.createDataFrame([(0, "1", 300)], "query_id long, location_id string, time long")
    assert {r.location_id: r.arr for r in journeys.one_to_all(journeys.rounds(journeys.Search(*as_text), starts, 3)).collect()} == {"2": 360, "3": 435, "5": 445, "4": 500}


def test_skyline_against_all_pairs(spark):
    r = random.Random(1)
    rows = [(r.randrange(3), r.randrange(12), r.randrange(12), r.randrange(3)) for _ in range(150)]
    got = sorted(tuple(x) for x in skyline.journeys(spark.createDataFrame(rows, "k long, dep long, arr long, transfers int"), ["k"]).collect())
    better = lambda a, b: a[0] == b[0] and a != b and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]
    assert got == sorted({b for b in rows if not any(better(a, b) for a in rows)})


def test_graph_fixpoints(spark):
    edges = [(i, i + 1, 1) for i in range(8)] + [(100, 101, 7), (0, 8, 5)]
    df = spark.createDataFrame(edges, "from_id long, to_id long, minutes long")
    labels = {r.node: r.label for r in graph.components(df.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))).collect()}
    assert labels == {i: 0 for i in range(9)} | {100: 100, 101: 100}
    far = {r.node: r.minutes for r in graph.distances(df, spark.createDataFrame([(0, 0)], "node long, minutes long")).collect()}
    assert far == {i: min(i, 5 if i == 8 else 99) for i in range(9)}
    assert {(r.from_id, r.to_id): r.minutes for r in graph.closure(df, 4).where("from_id = 0").collect()} == {(0, i): i for i in range(1, 5)}


def test_interpolation_leaves_out_trips_without_ends(spark):
    rows = [(1, 0, None, 10), (1, 1, None, None), (1, 2, None, None), (1, 3, 20, None), (2, 0, None, None), (2, 1, 5, 5), (3, 0, 1, 1), (3, 1, None, 9)]
    got = sorted(tuple(r) for r in stop_times.interpolated(spark.createDataFrame(rows, "trip_id long, stop_seq long, arr long, dep long")).select("trip_id", "stop_seq", "arr", "dep").collect())
    assert got == [(1, 0, 10, 10), (1, 1, 13, 13), (1, 2, 17, 17), (1, 3, 20, 20)]


def test_noon_offset_around_the_change_of_clocks(spark):
    days = spark.createDataFrame([("2024-03-30",), ("2024-03-31",), ("2024-10-27",)], "d string")
    assert [r[0] for r in days.select(times.noon_offset(F.to_date("d"), F.lit("Europe/Berlin"))).collect()] == [60, 120, 60]


def test_overtaking_trips_part(spark):
    own = events(spark, {1: [(1, 0, 0), (2, 100, 100)], 2: [(1, 10, 10), (2, 50, 50)], 3: [(1, 20, 20), (2, 120, 120)]})
    keys = own.select("trip_id").distinct().withColumn("route_key", F.lit("k"))
    assert {r.trip_id: r.sub_route for r in routes.without_overtaking(own, keys).collect()} == {1: 0, 2: 1, 3: 0}


def test_seated_paths_with_forks_and_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (7, 8), (8, 7)], "from_trip long, to_trip long")
    trips = spark.createDataFrame([(i,) for i in range(10)], "trip_id long")
    assert sorted(r.trips for r in routes.seated_paths(links, trips).collect()) == ["1,2,3", "1,2,4"]


def test_fare_chains(spark):
    legs = spark.createDataFrame([(1, i, 0, g, 10 * i, 10 * i + 5) for i, g in enumerate([1, 1, 1, 2, None])] + [(2, 0, 0, 1, 0, 5)], "journey_id long, position long, src long, leg_group long, dep long, arr long")
    rule = {"from_leg_group": 1, "to_leg_group": 1, "transfer_count": 1, "duration_limit": 20, "duration_type": "dep_arr"}
    got = sorted((r.journey_id, r.fare, r.position, r.rule) for r in fares.transfers(legs, [rule]).collect())
    assert got[:2] == [(1, 1, 0, 0), (1, 1, 1, 0)] and got[-1] == (2, 1, 0, None)
    short = [rule | {"duration_limit": 2}]
    assert all(r.rule is None for r in fares.transfers(legs, short).collect())


def test_rating_of_sets(spark):
    a, b = [(-10.0, 20.0, 0.0)], [(-10.0, 30.0, 0.0)]
    assert measures.rating([], []) == 0 and measures.rating(a, []) == measures.BEST and measures.rating([], a) == measures.WORST
    assert measures.rating(a, b) > 0 > measures.rating(b, a) and measures.rating(a, a) == 0
    assert measures.improvement((0, 0, 0), (0, 10, 0)) == pytest.approx(math.log2(10) * (math.atan(297) + math.pi / 2))


def test_alert_precedence(spark):
    schema = "alert_id long, trip_id long, route_id long, agency_id long, route_type long, location_id long"
    rows = spark.createDataFrame([(1, 5, 6, None, None, None), (2, None, 6, None, None, 9), (3, None, None, None, None, 8), (4, None, None, None, 3, None), (5, None, None, None, None, None)], schema)
    stops = spark.createDataFrame([(5, 0, 6, 1, 3, 9, None), (7, 0, 6, 1, 2, 1, 9), (7, 1, 6, 1, 2, 8, None)], "trip_id long, stop_seq long, route_id long, agency_id long, route_type long, location_id long, parent_id long")
    got = sorted(tuple(r) for r in alerts.holding(stops, alerts.selectors(rows)).collect())
    assert got == [(5, 0, 1), (5, 0, 2), (5, 0, 4), (7, 0, 2), (7, 1, 3)]


def test_updates_hold_the_order_of_times(spark):
    own = events(spark, {1: [(1, 0, 0), (2, 10, 11), (3, 20, 21), (4, 30, 30)], 2: [(1, 0, 0), (2, 10, 10)]})
    updates = spark.createDataFrame([(1, 0, 15, False, False), (1, 1, -5, False, False), (1, 2, 0, True, False), (2, 0, 0, True, False)], "trip_id long, stop_seq long, delay long, skipped boolean, cancelled boolean")
    rows = realtime.overlay(own, updates).orderBy("trip_id", "stop_seq").collect()
    assert [(r.arr, r.dep, r.in_allowed) for r in rows[:4]] == [(15, 15, True), (15, 15, True), (15, 16, False), (25, 25, True)]
    assert all(r.cancelled for r in rows[4:])
    left = realtime.applied(own, realtime.overlay(own, updates))
    assert {r.trip_id for r in left.collect()} == {1}


def test_polygon_with_hole_and_wide_area(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    own = spark.createDataFrame([(1, ring(0.0, 10.0), [ring(4.0, 6.0)])], "area_id long, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 9.0), (3, 11.0, 1.0)], "location_id long, lat double, lng double")
    for cells in (10, 10**9):
        assert [r.location_id for r in areas.inside(points, own, size=0.5, cells=cells).collect()] == [2]


def test_grid_join_loses_no_pair(spark):
    from tramline.operators.footpaths import within

    r = random.Random(2)
    rows = [(i, 60 + r.random() / 50, 8 + r.random() / 50) for i in range(120)]
    own = spark.createDataFrame(rows, "location_id long, lat double, lng double")
    got = {(x.a_location_id, x.b_location_id) for x in within(own, own, 300.0).collect()}
    d = own.select(F.struct("*").alias("a")).crossJoin(own.select(F.struct("*").alias("b"))).where(geo.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) <= 300)
    assert got == {(x.a.location_id, x.b.location_id) for x in d.collect()}


def test_pairing_begins_again(spark):
    own = events(spark, {1: [(1, 0, 0), (1, 5, 5), (2, 9, 9), (2, 12, 12), (1, 15, 15), (2, 20, 20)]})
    at = lambda k: spark.createDataFrame([(k,)], "location_id long")
    assert sorted((r.board_seq, r.alight_seq) for r in rides.paired(own, at(1), at(2)).collect()) == [(0, 2), (4, 5)]


def test_empty_inputs(spark, network):
    none = spark.createDataFrame([], EVENTS)
    assert rides.all_rides(none).collect() == [] and stop_times.sections(none).collect() == []
    assert journeys.rounds(journeys.Search(none, network[1], network[2]), start(spark, 1, 300), 2).collect() == []
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert calendar.combine(spark.createDataFrame([(1,)], "d long"), spark.createDataFrame([], "d long"), "andnot").count() == 1
    assert matching.access(network[1], spark.createDataFrame([], "location_id long, minutes long"), network[2]).collect() == []
