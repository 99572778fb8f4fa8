"""Queries whose rows have to grow with the table."""

import duckdb

from postlake import plans

ROOT = "/root/testdata"


def test_children_grow_with_the_table(spark):
    """J09_materialized_children keeps 107 rows at sf0.001 and none at ten times the size."""
    name, rows = "J09_children_whole", {}
    for sf in ("sf0.001", "sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{ROOT}/{sf}/events.parquet'")
        df = plans.queries()[name](spark, f"{ROOT}/{sf}")
        cur = con.execute(plans.oracle_sql()[name])
        assert sorted(c[0] for c in cur.description) == sorted(df.columns)
        want = sorted(cur.fetchall())
        got = sorted(tuple(r) for r in df.select(*[c[0] for c in cur.description]).collect())
        assert got == want
        rows[sf] = len(got)
    print(rows)
    assert {r[4] for r in want} == {"size_matched", "size_mismatch"}
    assert 9 * rows["sf0.001"] < rows["sf0.01"] < 11 * rows["sf0.001"]
