"""The further queries against their SQL on a small table, and the operators' edge cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import evidence
from gaugeflow.plans import evidence as queries
from gaugeflow.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
NAMES = ["cadence_evidence", "lomb_scargle", "detectability"] + [n for n, f in QUERIES.items() if f.__module__ == queries.__name__ and n in ORACLE]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sql, name):
    out = QUERIES[name](spark, DATA)
    want = sql.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in out.columns)} FROM ({ORACLE[name]})").fetchall()
    got, want = rounded(tuple(r) for r in out.collect()), rounded(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(math.isclose(x, y, abs_tol=2e-5) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


def series(spark, rows):
    return spark.createDataFrame(rows, "key string, t long, y double, x double")


def test_nothing_in_gives_nothing_out(spark):
    none = series(spark, [])
    assert evidence.nearest_ahead(none, ["key"], "y", 10).collect() == evidence.join_eras(none, ["key"], "y", 5, 5).collect() == evidence.cointegration(none, ["key"], "y", "x").collect() == []
    assert [tuple(r) for r in evidence.driver_coverage(none, "y", ["x"]).collect()] == [("x", 0, 0, None)]


def test_nearest_ahead_stops_at_its_reach(spark):
    rows = series(spark, [("a", 0, None, 0.0), ("a", 10, None, 0.0), ("a", 20, 5.0, 0.0), ("a", 30, None, 0.0)])
    got = evidence.nearest_ahead(rows, ["key"], "y", 10).orderBy("t").select("wait", "next_value").collect()
    assert [tuple(r) for r in got] == [(None, None), (10, 5.0), (0, 5.0), (None, None)]


def test_a_walk_and_its_copy_are_cointegrated_and_two_walks_are_not(spark):
    import random

    rng = random.Random(4)
    walk, other, rows = 0.0, 0.0, []
    for t in range(400):
        walk, other = walk + rng.gauss(0, 1), other + rng.gauss(0, 1)
        rows += [("with", t, 2 * walk + 1 + rng.gauss(0, 0.5), walk), ("without", t, other, walk)]
    got = {r.key: r for r in evidence.cointegration(series(spark, rows), ["key"], "y", "x").collect()}
    assert got["with"].cointegrated and abs(got["with"].slope - 2) < 0.1 and not got["without"].cointegrated


def test_eras_meet_on_one_level(spark):
    rows = series(spark, [("a", t, float(t % 5) + (100.0 if t >= 50 else 0.0), None) for t in range(100)])
    joined = evidence.join_eras(rows, ["key"], "y", 50, 50)
    assert joined.where(F.col("joined") != F.col("t") % 5).count() == 0
