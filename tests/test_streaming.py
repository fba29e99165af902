import time

from tramline.streaming import updates


def test_last_message_counts_in_any_order(spark, tmp_path):
    stops = spark.createDataFrame([(1, 0, 1, 0, 0, True, True), (1, 1, 2, 10, 10, True, True), (1, 2, 3, 20, 20, True, True)], "trip_id long, stop_seq long, location_id long, arr long, dep long, in_allowed boolean, out_allowed boolean")
    source = tmp_path / "in"
    batches = [[(1, 0, 5, False, False, 100, 1)], [(1, 0, 99, False, False, 50, 0), (1, 1, 7, False, False, 110, 2)]]
    source.mkdir()
    got = {}

    def sink(rows, number):
        got[number] = sorted((r.stop_seq, r.arr) for r in rows.collect())

    spark.createDataFrame(batches[0], updates.SCHEMA).coalesce(1).write.mode("append").json(str(source))
    query = updates.apply_stream(spark.readStream.schema(updates.SCHEMA).json(str(source)), stops, sink, str(tmp_path / "state"), every="1 second")
    try:
        for n in (1, 2):
            ends = time.time() + 60
            while len(got) < n and time.time() < ends and query.isActive:
                time.sleep(0.2)
            if n == 1:
                spark.createDataFrame(batches[1], updates.SCHEMA).coalesce(1).write.mode("append").json(str(source))
    finally:
        query.stop()
    own = [v for _, v in sorted(got.items())]
    assert own[0] == [(0, 5), (1, 15), (2, 25)] and own[-1] == [(0, 5), (1, 17), (2, 27)]
