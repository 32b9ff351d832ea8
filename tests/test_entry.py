import glob
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
LLM = re.compile(r"p(3|7|8|9|10)_")


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "n", "median_seconds", "p95_seconds"] and df.count() > 0


def plain(v):
    return round(v, 9) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not LLM.match(n)])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_the_rest_imports_without_the_training_data_part():
    code = "import sys; sys.modules['editwake.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith(('p3_', 'p7_', 'p8_', 'p9_', 'p10_')) for n in e.queries()) and 'p1_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
