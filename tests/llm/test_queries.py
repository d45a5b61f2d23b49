import glob
import os

import duckdb
import pytest

from gaugeflow.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = con.sql(ORACLE[name])
    place = {c: i for i, c in enumerate(want.columns)}
    assert sorted(place) == names
    key = lambda row: tuple(str(round(v, 9) + 0.0 if isinstance(v, float) else v) for v in row)
    assert sorted(key(tuple(r[c] for c in names)) for r in got.collect()) == sorted(key(tuple(r[place[c]] for c in names)) for r in want.fetchall())
