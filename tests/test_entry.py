import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def values(df: pd.DataFrame):
    cell = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    code = "import sys; sys.modules['rillstone.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
