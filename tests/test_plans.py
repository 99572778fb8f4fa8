"""Every query of the reference's operators against its SQL twin."""

import os

import duckdb
import pytest

from postlake import plans

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in os.listdir(SF)] if os.path.isdir(SF) else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(_plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    cur = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()], key=repr)
    assert len(got) == len(want) and got == want and got
