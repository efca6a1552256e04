"""Every query against its SQL in DuckDB, on the small tables (event days need sf0.01)."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if pd.isna(value):
        return None
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype.kind == "b":
        return bool(value)
    try:
        return round(float(value), 6) + 0.0  # no sign on a zero
    except (TypeError, ValueError):
        return str(value)


def rows(df, columns):
    return sorted(map(repr, ([plain(x) for x in r] for r in df[columns].astype(object).itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
