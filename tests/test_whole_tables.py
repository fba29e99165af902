"""Queries without SQL over every row that they may ask, against a plain version."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import SF_DIR
from tramline.operators import measures
from tramline.plans import derived, journey_queries


def test_each_stop_that_is_reached_is_rated(spark):
    own = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    sql = derived.sql(journey_queries._TABLES, journey_queries._rounds_sql(2) + f" SELECT b.l, a.t, b.t FROM arr_2 b LEFT JOIN arr_1 a USING (l) WHERE b.l <> {journey_queries.START}")
    expected = {}
    for stop, one, two in own.sql(sql).fetchall():
        first = [] if one is None else [(-480.0, float(one), 0.0)]
        expected[stop] = measures.rating(first + ([(-480.0, float(two), 1.0)] if two != one else []), first)
    got = {r.query_id: r.rating for r in entry.queries()["qa_rating"](spark, SF_DIR).collect() if r.query_id != journey_queries.START}
    assert len({stop % 5 for stop in expected}) == 5
    assert got == pytest.approx(expected)
