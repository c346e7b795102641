import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="tables not present")

SAMPLE = ["lineitem_profile", "split_by_order", "statistical_features", "column_quality", "keywords", "detect_duplicates", "detect_column_drift", "forecast_report", "dbscan", "knn_classify", "smart_tags"]


def key(v):
    return "~" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) if isinstance(v, float) else str(v)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = entry.queries()[name](spark, str(DATA))
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = sorted(tuple(key(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall())
    got = sorted(tuple(key(r[c]) for c in sorted(cols)) for r in df.collect())
    assert sorted(df.columns) == sorted(cols) and got == want and got
