import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    got = entry.queries()[name](spark, DATA)
    names = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name])
    place = {c: i for i, c in enumerate(want.columns)}
    assert sorted(place) == names
    key = lambda row: tuple(str(round(v, 7) + 0.0 if isinstance(v, float) else v) for v in row)
    assert sorted(key(tuple(r[c] for c in names)) for r in got.collect()) == sorted(key(tuple(r[place[c]] for c in names)) for r in want.fetchall())
