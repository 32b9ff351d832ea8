import glob
import os

import duckdb
import pytest
from editwake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs_and_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in queries.ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        found = con.execute(queries.ORACLE[name])
        names = [x[0] for x in found.description]
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
