"""Every query of the event engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from glyphstream import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_each_query_has_sql_or_a_reason():
    without = catalog.queries().keys() - catalog.oracle_sql().keys()
    assert without == {"hull_overlaps", "geometry_tracker", "content_tracker_stateful", "pixel_pipeline"}
