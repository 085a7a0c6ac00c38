"""Queries over whole tables, at a size where a cut would show."""

import os

import duckdb
import pytest

from chronoloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def both(spark, name, table):
    """The query's rows and those of its SQL."""
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_throttled_log(spark):
    got, want = both(spark, "throttled_log", "events")
    last, fold = {}, []
    for event, at in duckdb.sql(f"SELECT event_type, epoch_us(ts) // 1000 FROM '{SF}/events.parquet' ORDER BY ts").fetchall():
        if event not in last or at - last[event] >= 600_000:
            last[event] = at
            fold.append((event, at))
    assert got == want == sorted(fold, key=repr)


@pytest.mark.parametrize("name", ["find_blocks", "transport_position"])
def test_every_event_has_its_row(spark, name):
    got, want = both(spark, name, "events")
    assert got == want
    assert len(got) == 10_000


@pytest.mark.parametrize("name, rows", [("widened_values", 500 * 64), ("recording_round_trip", 490 * 64)])
def test_every_value_has_its_row(spark, name, rows):
    got, want = both(spark, name, "embeddings")
    assert got == want
    assert len(got) == rows
