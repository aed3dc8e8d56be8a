"""Every registered query with an SQL twin agrees with it on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from lexmill.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def bag(cols, rows):
    def norm(v):
        return None if isinstance(v, float) and v != v else float(f"{v:.9g}") if isinstance(v, float) else v

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(cols, cur.fetchall())


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"f9_pii_masking", "f12_log_scrubbing", "a12_pii_per_type"}
