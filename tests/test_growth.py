"""What is moved between tasks grows with the input, not with the pairs that come out."""

import random
import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from tramline.functions import storage
from tramline.operators import alerts, all_stops, assistance, calendar, fares, footpaths, journeys, matching, realtime, requests, rides, routes


def moved(spark, df):
    """df's rows, and how many rows went through shuffles on the way."""
    sc = spark.sparkContext
    listed = lambda: spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()))
    before = {(s.stageId(), s.attemptId()) for s in listed()}
    rows = df.collect()
    return rows, sum(s.shuffleWriteRecords() for s in listed() if (s.stageId(), s.attemptId()) not in before)


@contextmanager
def nothing_sent(spark):
    """Tables aren't sent to all tasks because they are small in a test."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, -1)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def test_fare_rules_are_found_once_for_equal_legs(spark):
    keys = "network_id long, from_area long, to_area long, from_timeframe long, to_timeframe long"
    legs = spark.createDataFrame([(i, 1, 2, 3, None, None) for i in range(200)], f"leg_id long, {keys}")
    rules = spark.createDataFrame([(i, 1, 2, 3, None, None, i % 2) for i in range(200)], f"rule_id long, {keys}, priority long")
    products = spark.createDataFrame([(i, f"p{i}", 0, False, float(-i)) for i in range(200)], "rule_id long, product_name string, rider_category long, is_default boolean, amount double")
    expected = {(leg, rule) for leg in range(200) for rule in range(1, 200, 2)}
    rows, n = moved(spark, fares.leg_rules(legs, rules, priorities=True))
    assert {(r.leg_id, r.rule_id) for r in rows} == expected and len(rows) == len(expected) and n < 4000
    rows, n = moved(spark, fares.ranked(legs, rules, products, priorities=True))
    assert {(r.leg_id, r.rule_id, r.nth) for r in rows} == {(leg, rule, (201 - rule) // 2) for leg, rule in expected} and n < 4000


def test_empty_keys_of_rules_and_legs(spark):
    keys = "network_id long, from_area long, to_area long, from_timeframe long, to_timeframe long"
    legs = spark.createDataFrame([(i, None if i % 2 else 1, 5, None, 1, None) for i in range(200)], f"leg_id long, {keys}")
    rules = spark.createDataFrame([(i, None, 5, None, i % 2, None, 1) for i in range(100)] + [(500, 1, 5, None, None, None, 0)], f"rule_id long, {keys}, priority long")
    rows, n = moved(spark, fares.leg_rules(legs, rules, priorities=True))
    assert {(r.leg_id, r.rule_id) for r in rows} == {(leg, rule) for leg in range(200) for rule in range(1, 100, 2)} and n < 2000


def test_rules_without_priorities_leave_named_values_alone(spark):
    keys = "network_id long, from_area long, to_area long, from_timeframe long, to_timeframe long"
    legs = spark.createDataFrame([(i, i % 2, 5, 6, 1, None) for i in range(200)], f"leg_id long, {keys}")
    rules = spark.createDataFrame([(i, None, 5, None, None, None, 0) for i in range(100)] + [(500, 1, 5, None, None, None, 0)], f"rule_id long, {keys}, priority long")
    rows, n = moved(spark, fares.leg_rules(legs, rules))
    assert {(r.leg_id, r.rule_id) for r in rows} == {(leg, rule) for leg in range(0, 200, 2) for rule in range(100)} | {(leg, 500) for leg in range(1, 200, 2)} and n < 2000


def stops(spark, n):
    """n stops at three places, of which the third is far, with two names."""
    rows = [(i, None, 48.0 + (i % 3) * (i % 3) * 0.001, 8.0, 2 + i % 2, i % 2, f"S{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "location_id long, parent_id long, lat double, lng double, transfer_min long, src long, name string")


def test_long_chain_and_many_sub_routes(spark):
    """Each trip is set against the last of each chain only; all trips of a chain would be 30 million comparisons of tuples here."""
    rows = [(i, s, i // 6 + 10 * s, i // 6 + 10 * s) for i in range(8000) for s in (0, 1)]
    own = spark.createDataFrame(rows, "trip_id long, stop_seq long, arr long, dep long")
    keys = own.select("trip_id").distinct().withColumn("route_key", F.lit("k"))
    began = time.monotonic()
    assert routes.without_overtaking(own, keys).count() == 8000
    assert time.monotonic() - began < 15


def test_sub_routes_equal_those_of_all_comparisons(spark):
    r = random.Random(4)
    trips = {}
    for i in range(300):
        at, times = r.randrange(0, 3000, 7), []
        for _ in range(3):
            times.append((at, at + r.randrange(2)))
            at = times[-1][1] + r.randrange(1, 12)
        trips[i] = times
    lanes, expected = [], {}
    for i, times in sorted(trips.items(), key=lambda x: (x[1][0][1], x[0])):
        own = [t - times[0][1] // 1440 * 1440 for pair in times for t in pair]
        fits = [k for k, lane in enumerate(lanes) if all(all(a <= b for a, b in zip(x, own)) or all(a >= b for a, b in zip(x, own)) for x in lane)]
        if not fits:
            lanes.append([])
        expected[i] = fits[0] if fits else len(lanes) - 1
        lanes[expected[i]].append(own)
    own = spark.createDataFrame([(i, s, a, d) for i, times in trips.items() for s, (a, d) in enumerate(times)], "trip_id long, stop_seq long, arr long, dep long")
    keys = own.select("trip_id").distinct().withColumn("route_key", F.lit("k"))
    assert {x.trip_id: x.sub_route for x in routes.without_overtaking(own, keys).collect()} == expected


def test_least_hashes_are_aggregated_in_place(spark):
    plan = requests.random_queries(stops(spark, 50), 20, 1, least_walk=0)._jdf.queryExecution().executedPlan().toString()
    assert " HashAggregate(keys=[draw" in plan


def test_days_of_a_trip_are_one_row(spark):
    a = spark.range(100).select(F.col("id").alias("trip_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))).alias("day"))
    b = a.where("(trip_id + day) % 2 = 0").unionByName(a.where("trip_id < 3 and day = 0").select("trip_id", (F.col("day") + 50).alias("day")))
    with nothing_sent(spark):
        rows, n = moved(spark, calendar.combined(a.where("day < 9"), b, ("and", "andnot", "or")))
    x, y = {(t, d) for t in range(100) for d in range(9)}, {(t, d) for t in range(100) for d in range(14) if (t + d) % 2 == 0} | {(t, 50) for t in range(3)}
    for how, days in (("and", x & y), ("andnot", x - y), ("or", x | y)):
        assert sorted((r.trip_id, r.day) for r in rows if r.how == how) == sorted(days)
    assert n <= 300


def test_equal_names_are_no_pairs(spark):
    own = stops(spark, 300).withColumn("parent_id", F.when(F.col("location_id") % 5 != 0, F.col("location_id") - F.col("location_id") % 5)).withColumn("name", F.when(F.col("location_id") < 290, F.concat(F.lit("S"), (F.col("location_id") % 10).cast("string"))))
    pairs = own.select(F.col("location_id").alias("from_id"), "name").join(own.select(F.col("location_id").alias("to_id"), "name"), "name").where("from_id <> to_id")
    expected = sorted(map(tuple, matching.expand_locations(own, own, "equivalent", pairs).collect()))
    with nothing_sent(spark):
        rows, n = moved(spark, matching.expand_classes(own, own, own.select("location_id", F.col("name").alias("class"))))
    assert sorted(map(tuple, rows)) == expected and len(rows) > 40_000 and n < 10_000


def test_one_place_is_joined_once(spark):
    """400 stops at three places: the distance is worked out for places, and identifiers are put in at the end."""
    with nothing_sent(spark):
        rows, n = moved(spark, footpaths.linked(stops(spark, 400), 300.0))
    assert len(rows) == 2 * sum((i % 3 == 2) == (j % 3 == 2) for i in range(0, 400, 2) for j in range(1, 400, 2)) and n < 1000


def test_pairs_of_one_place_need_no_shuffle(spark):
    own = stops(spark, 400).select("location_id", "lat", "lng")
    with nothing_sent(spark):
        rows, n = moved(spark, footpaths.within(own, own, 2000.0, values={"metres": F.round("metres", 3)}).where("a_location_id < b_location_id"))
    assert len({(r.a_location_id, r.b_location_id) for r in rows}) == len(rows) == 400 * 399 // 2 and n < 1000


def test_equal_names_or_parents_once(spark):
    own = stops(spark, 400).withColumn("parent_id", F.when(F.col("location_id") % 5 != 0, F.col("location_id") - F.col("location_id") % 5))
    with nothing_sent(spark):
        found = footpaths.same_place(own, 300.0)
        rows, _ = moved(spark, found)
    # Name and parent are keys of the joins, not a condition on all pairs that are near.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(__name" in plan and "(__root" in plan
    expected = {(i, j) for i in range(400) for j in range(400) if i != j and (i % 2 == j % 2 or i // 5 == j // 5) and (i % 3 == 2) == (j % 3 == 2)}
    assert {(r.from_id, r.to_id) for r in rows} == expected and len(rows) == len(expected)


def test_alerts_of_equal_stops(spark):
    stops = spark.createDataFrame([(i, 0, 6, 1, 9, 8) for i in range(300)], "trip_id long, stop_seq long, route_id long, agency_id long, location_id long, parent_id long")
    named = spark.createDataFrame([(i, 7 if i < 2 else None, 6 if i % 2 else None, 1, None, 8 if i % 3 else 9) for i in range(300)] + [(5, None, None, None, None, 9)], "alert_id long, trip_id long, route_id long, agency_id long, route_type long, location_id long")
    with nothing_sent(spark):
        rows, n = moved(spark, alerts.holding(stops, alerts.selectors(named)))
    assert sorted((r.trip_id, r.alert_id) for r in rows) == [(t, a) for t in range(300) for a in range(300) if a >= 2 or t == 7] and n < 4000


def calls(spark, rows):
    return spark.createDataFrame(rows, "trip_id long, stop_seq long, location_id long, arr long, dep long, route_id long").withColumns({"in_allowed": F.lit(True), "out_allowed": F.lit(True)})


def test_rides_at_other_times_are_not_moved(spark):
    own = calls(spark, [(t, s, 1 + s, 20 * t + 5 * s, 20 * t + 5 * s, 0) for t in range(1000) for s in (0, 1)])
    asked = spark.createDataFrame([(q, 1, 2, 20 * q, 20 * q + 6) for q in range(50)], "query_id long, from_id long, to_id long, ready long, latest long")
    walks = spark.createDataFrame([(1, 3, 1), (3, 1, 1), (2, 4, 1), (4, 2, 1)], "from_id long, to_id long, minutes long")
    with nothing_sent(spark):
        rows, n = moved(spark, rides.earliest_between(asked, own, walks))
    assert sorted((r.query_id, r.trip_id, r.board_seq, r.alight_seq, r.arr) for r in rows) == [(q, q, 0, 1, 20 * q + 5) for q in range(50)] and n < 8000


def test_arrivals_are_moved_once_a_walk(spark):
    own = calls(spark, [(t, s, s, 3 * t + 4 * s, 3 * t + 4 * s, t % 2) for t in range(100) for s in (0, 1)] + [(1000 + i, s, 10 + i + 100 * s, 50 + 4 * s, 50 + 4 * s, 7) for i in range(20) for s in (0, 1)])
    places = spark.createDataFrame([(i, 2) for i in range(200)], "location_id long, transfer_min long")
    walks = spark.createDataFrame([(1, 10 + i, 3) for i in range(20)], "from_id long, to_id long, minutes long")
    with nothing_sent(spark):
        rows, n = moved(spark, rides.transfers(own, places, walks, 15, uturns=True))
    assert sorted((r.from_trip, r.to_trip, r.wait) for r in rows) == [(t, 1000 + i, 43 - 3 * t) for t in range(100) for i in range(20) if 0 <= 43 - 3 * t < 15] and n < 3500


def test_days_make_no_rows_of_calls(spark):
    own = calls(spark, [(t, s, s, 100 + 10 * s, 101 + 10 * s, 0) for t in range(40) for s in range(4)]).withColumns({"in_wheelchair": F.lit(True), "out_wheelchair": F.col("location_id") != 2})
    days = spark.createDataFrame([(t, d) for t in range(40) for d in range(14)], "trip_id long, day long")
    served = spark.createDataFrame([(i, 5) for i in range(3)], "location_id long, offer_id long")
    hours = spark.createDataFrame([(5, 0, 0, 1440), (5, 2, 105, 115), (5, 2, 90, 102)], "offer_id long, weekday long, begin long, end long")
    with nothing_sent(spark):
        rows, n = moved(spark, assistance.split(own, days, served, hours))
    expected = {("1111", "1100"): [0, 7], ("1101", "1100"): [2, 9], ("0001", "1000"): [1, 3, 4, 5, 6, 8, 10, 11, 12, 13]}
    assert sorted((r.trip_id, r.boarding, r.alighting, r.days) for r in rows) == sorted((t, *way, d) for t in range(40) for way, d in expected.items())
    assert n < 1500


def test_turns_back_are_dropped_before_anything_is_moved(spark):
    """Trips go from 1 to 2, others back from 2 to 1 or on to 3."""
    own = calls(spark, [(t, s, 1 + s, 5 * s, 5 * s, t) for t in range(60) for s in (0, 1)] + [(1000 + t, s, 2 - s if t % 2 else 2 + s, 10 + 5 * s, 10 + 5 * s, 7) for t in range(60) for s in (0, 1)])
    places = spark.createDataFrame([(i, 2) for i in range(4)], "location_id long, transfer_min long")
    with nothing_sent(spark):
        rows, n = moved(spark, rides.transfers(own, places, spark.createDataFrame([], "from_id long, to_id long, minutes long"), 15))
    assert sorted((r.from_trip, r.to_trip, r.wait) for r in rows) == [(t, 1000, 3) for t in range(60)] and n < 2000


def test_runs_of_a_route_are_not_moved_again(spark):
    trips = spark.createDataFrame([(t, 1, 100) for t in range(300)], "trip_id long, route_id long, start_time long")
    days = spark.createDataFrame([(t, d) for t in range(300) for d in (t % 2, t % 2, 5)], "trip_id long, day long")
    asked = spark.createDataFrame([(e, None, 1, 1540, e % 2) for e in range(300)] + [(900, 4, 1, 0, 0), (901, 4, 1, 0, 1), (902, 999, 1, 0, 0)], "event_id long, trip_id long, route_id long, start_time long, day long")
    with nothing_sent(spark):
        rows, n = moved(spark, realtime.resolved(asked, trips, days))
    assert sorted((r.event_id, r.trip_id) for r in rows) == [(e, t) for e in range(300) for t in range(300) if e % 2 == t % 2] + [(900, 4)] and n < 10_000


def test_all_stops_as_queries_move_rides_only(spark, monkeypatch):
    """Trips that board anywhere for nearly every query: labels are no rows that are moved. Results are those of the search by rounds."""
    r = random.Random(7)
    rows = []
    for t in range(1000):
        at = r.randrange(0, 900)
        for s in range(r.randrange(1, 6)):
            arr, at = at, at + r.randrange(3)
            rows.append((t, s, r.randrange(60), arr, at, r.random() < 0.7, r.random() < 0.8))
            at += r.randrange(1, 30)
    own = spark.createDataFrame(rows, "trip_id long, stop_seq long, location_id long, arr long, dep long, in_allowed boolean, out_allowed boolean")
    places = spark.createDataFrame([(i, 2 + i % 3) for i in range(60)], "location_id long, transfer_min long")
    walks = spark.createDataFrame([(i, j, 3 + i % 4) for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60], "from_id long, to_id long, minutes long")
    starts = spark.createDataFrame([(f"q{i}", i, 20 * (i % 20)) for i in range(60)] + [("q5", 7, 100)], "query_id string, location_id long, time long")
    search = journeys.Search(own, places, walks, max_travel=400)
    monkeypatch.setattr(all_stops, "LEAST", 16)
    for most in (1, 3):
        expected = sorted(map(tuple, journeys.one_to_all(journeys.rounds(search, starts, most)).collect()))
        rows, n = moved(spark, all_stops.fastest(search, starts, most))
        assert sorted(map(tuple, rows)) == expected and len(expected) > 300 and n < 12_000


def test_trips_are_sorted_in_more_partitions_of_a_larger_table(spark, tmp_path):
    spark.range(200_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    parts = storage.spread(table, "k", size // 9)
    assert parts.rdd.getNumPartitions() in (9, 10) and parts.distinct().count() == 200_000
    assert storage.spread(table, "k").rdd.getNumPartitions() == table.rdd.getNumPartitions()
    # What is grouped by the key afterwards isn't moved again.
    plan = parts.groupBy("k").agg(F.max("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_messages_are_folded_once(spark):
    own = calls(spark, [(t, s, 10 + s % 3, 10 * s, 10 * s, 0) for t in range(20) for s in range(6)])
    asked = spark.createDataFrame([(100 * t + i, t, i, seq, at) for t in range(21) for i, (seq, at) in enumerate([(None, 11), (0, None), (None, 11), (None, 99), (5, None)])], "event_id long, trip_id long, position long, stop_seq long, location_id long")
    found = realtime.matched_stops(asked, own)
    assert sorted((r.event_id, r.stop_seq, r.at_id) for r in found.collect()) == [(100 * t + i, s, 10 + s % 3) for t in range(20) for i, s in ((0, 1), (2, 4), (4, 5))]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_runs_that_share_one_stop_are_not_moved(spark):
    """All messages and trips meet at stop 0 at one time; only a message's own trip is like it in its other stops."""
    own = spark.createDataFrame([(t, s, 0 if s == 0 else 10 * t + s, 100 + 20 * s) for t in range(300) for s in range(5)], "trip_id long, stop_seq long, location_id long, dep long")
    messages = own.select(F.col("trip_id").alias("message_id"), "location_id", (F.col("dep") + F.col("trip_id") % 7).alias("time"))
    with nothing_sent(spark):
        rows, n = moved(spark, matching.likely_runs(messages, own))
    assert sorted((r.message_id, r.trip_id, round(r.score, 6)) for r in rows) == [(t, t, round(1 - (t % 7) ** 2 / 230, 6)) for t in range(300)] and n < 12_000


def test_likely_runs_equal_those_of_all_pairs(spark):
    r = random.Random(3)
    some = lambda ids, most: [(i, r.choice([None, *range(6), *range(6)]), r.choice([None, *range(60, 200, 3)])) for i in ids for _ in range(r.randrange(1, most))]
    asked, calls_of = some([*range(60), None], 8), some([*range(80), None], 7)
    asked += asked[:20]
    messages = spark.createDataFrame(asked, "message_id long, location_id long, time long")
    own = spark.createDataFrame(calls_of, "trip_id long, location_id long, dep long")
    for tolerance, least, top in ((15, 0.5, 0.975), (20, 0.3, 0.5), (40, 0.0, 0.1), (15, 0.7, 0.9)):
        expected = []
        for m in range(60):
            rows, scores = [x for x in asked if x[0] == m], {}
            for t in [*range(80), None]:
                points = []
                for _, at, time_ in {x for x in rows if x[1] is not None and x[2] is not None}:
                    offs = [abs(c[2] - time_) for c in calls_of if c[0] == t and c[1] == at and c[2] is not None]
                    points += [230 - min(offs) ** 2] if offs and min(offs) <= tolerance else []
                if points and sum(points) / (230.0 * len(rows)) >= least:
                    scores[t] = sum(points) / (230.0 * len(rows))
            expected += [(m, str(t), round(x, 9)) for t, x in scores.items() if x >= max(scores.values()) * top]
        found = matching.likely_runs(messages, own, tolerance, least, top).collect()
        assert sorted((x.message_id, str(x.trip_id), round(x.score, 9)) for x in found) == sorted(expected) and len(expected) > 20


def test_first_departures_are_found_without_sorting_pairs(spark):
    """Trips call at few stops again and again, so that a route's first departure often is of the trip that one comes with; with one walk between two stops, and with several."""
    r = random.Random(5)
    rows = []
    for t in range(60):
        at = r.randrange(0, 60)
        for s in range(r.randrange(2, 7)):
            arr, at = at, at + r.randrange(2)
            rows.append((t, s, r.randrange(4), arr, at, r.choice([0, 1, None]), r.random() < 0.8, r.random() < 0.8))
            at += r.randrange(0, 6)
    own = spark.createDataFrame(rows, "trip_id long, stop_seq long, location_id long, arr long, dep long, route_id long, in_allowed boolean, out_allowed boolean")
    places = spark.createDataFrame([(i, 1 + i % 2) for i in range(4)], "location_id long, transfer_min long")
    last = {t: max(x[1] for x in rows if x[0] == t) for t in range(60)}
    for walks in ([(0, 1, 3), (1, 0, 2), (2, 3, 4)], [(0, 1, 3), (0, 1, 9), (0, 1, 30), (2, 2, 5), (1, 0, 2)]):
        first = {}
        for t, s, at, arr, _, _, _, out in rows:
            for here, there, minutes in [(i, i, 1 + i % 2) for i in range(4)] + walks:
                for t2, s2, at2, _, dep, route, into, _ in rows:
                    if out and s > 0 and here == at and at2 == there and into and s2 < last[t2] and t2 != t and 0 <= dep - arr - minutes < 8:
                        key = (t, s, there, route)
                        first[key] = min(first.get(key, (10**9,)), (dep, t2, s2, arr + minutes))
        expected = sorted((t, s, t2, s2, dep - ready) for (t, s, _, _), (dep, t2, s2, ready) in first.items())
        found = rides.transfers(own, places, spark.createDataFrame(walks, "from_id long, to_id long, minutes long"), 8, uturns=True)
        assert sorted(map(tuple, found.collect())) == expected and len(expected) > 100
        if (2, 2, 5) not in walks:
            assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_rules_of_a_leg_are_plain_identifiers(spark):
    keys = "network_id long, from_area long, to_area long, from_timeframe long, to_timeframe long"
    legs = spark.createDataFrame([(i, 1, 2, 3, None, None) for i in range(20)], f"leg_id long, {keys}")
    rules = spark.createDataFrame([(i or None, 1, 2, 3, None, None, 0) for i in range(20)], f"rule_id long, {keys}, priority long")
    found = fares.leg_rules(legs, rules)
    # No row of one is made for each row of the result.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" in plan and ".rule_id AS" not in plan.split("explode(")[0]
    assert {(r.leg_id, r.rule_id) for r in found.collect()} == {(leg, rule or None) for leg in range(20) for rule in range(20)}
