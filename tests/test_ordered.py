"""Skew-safe building blocks against pandas, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexmill.functions import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"id": range(n), "k": np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n)),
                        "o": rng.permutation(n), "v": rng.integers(0, 90, n) / 4})
    return spark.createDataFrame(pdf), pdf


def test_position_and_running_sum(skewed):
    df, pdf = skewed
    got = od.with_running_sums(df, ["k"], ["o"], od.block_of("o", 100), {"pos": F.lit(1), "cum": F.col("v")}).toPandas()
    want = pdf.sort_values(["k", "o"])
    want["pos"] = want.groupby("k").cumcount() + 1
    want["cum"] = want.groupby("k")["v"].cumsum()
    m = got.merge(want, on="id")
    assert len(m) == len(pdf) and (m.pos_x == m.pos_y).all() and np.allclose(m.cum_x, m.cum_y)


def test_segments_keep_every_row_once_and_bound_groups(skewed):
    df, pdf = skewed
    seg = od.in_segments(od.with_position(df, ["k"], ["o"], od.block_of("o", 100)), size=64, back=9, ahead=3).toPandas()
    assert sorted(seg[~seg.ctx].id) == list(range(len(pdf)))
    assert seg.groupby(["k", "seg"]).size().max() <= 64 + 9 + 3


@pytest.mark.parametrize("keys", [["k"], []])
def test_order_statistics_are_exact(skewed, keys):
    df, pdf = skewed
    got = od.rank_values(df, keys, "v", {"p50": od.nearest_rank(0.5), "p99": od.nearest_rank(0.99), "lo": F.lit(1)}, splits=8).toPandas()
    groups = pdf.groupby("k")["v"] if keys else [(None, pdf.v)]
    for key, vals in groups:
        s = sorted(vals)
        row = got[got.k == key].iloc[0] if keys else got.iloc[0]
        pick = lambda q: s[min(int(len(s) * q), len(s) - 1)]
        assert (row.p50, row.p99, row.lo, row.n) == (pick(0.5), pick(0.99), s[0], len(s))


def test_located_buckets_are_ordered_in_ranges(spark, monkeypatch):
    """One key holds most rows and its values are nearly unique: no window sees a whole bucket, and the ranks are exact."""
    rng = np.random.default_rng(11)
    values = rng.permutation(60_000).astype(float)
    values[:6_000] = 17.0
    rows = pd.DataFrame({"k": np.where(np.arange(60_000) < 50_000, "hot", "cold"), "v": values})
    seen, plain = [], od.dealt
    monkeypatch.setattr(od, "dealt", lambda *a, **kw: seen.append(plain(*a, **kw)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranks = {"p50": od.nearest_rank(0.5), "p99": od.nearest_rank(0.99)}
        got = {r.k: (r.n, r.p50, r.p99) for r in od.rank_values(spark.createDataFrame(rows), ["k"], "v", ranks, splits=4).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for k, part in rows.groupby("k"):
        v = np.sort(part["v"].to_numpy())
        want[k] = (len(v), *(v[min(int(len(v) * q), len(v) - 1)] for q in (0.5, 0.99)))
    assert got == want
    buckets = seen[0].groupBy("k", "q").count().agg({"count": "max"}).first()[0]
    windows = seen[0].groupBy("k", "q", "_range").count().agg({"count": "max"}).first()[0]
    assert buckets > 10_000 and windows < buckets / 2
