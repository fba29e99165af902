"""Queries against their SQL on the smallest tables; the driver does the same on larger ones."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
NAMES = "calendar_exceptions interpolate_stop_times local_to_utc section_flag_rides td_edge_bwd direct_pairing earliest_arrival_rounds fare_leg_rules rt_overlay_events delay_as_of rt_cursor rt_absolute rt_skip_track_cancel rt_added bike_rounds wheelchair_rounds trip_based_rounds assistance_split middle_leg_alternative start_is_destination".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        own.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return own


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
