"""Published expectations of the telemetry rules."""

import datetime as dt

from pyspark.sql import functions as F

from lexmill.operators import telemetry as tm

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("s", float(v)) for v in range(10, 101, 10)], "stage string, ms double")
    r = tm.latency_report(df, "stage", "ms").first()
    assert (r.n, r.p50, r.p95) == (10, 60.0, 100.0)
    w = tm.window_report(df.withColumn("o", F.col("ms")), "stage", ["o"], "ms", 100).first()
    assert (w.p50, w.p95, w.p10) == (60.0, 100.0, 20.0)


def decisions(spark, calls, limit, window):
    df = spark.createDataFrame([(k, at(t), i) for i, (k, t) in enumerate(calls)], "k string, ts timestamp, id int")
    return [(r.allowed, r.remaining, r.retry_after_s) for r in tm.rate_decisions(df, "k", "ts", "id", limit, window).orderBy("id").collect()]


def test_rate_limit_retry_after(spark):
    got = decisions(spark, [("t", 0), ("t", 0), ("t", 0), ("t", 0), ("t", 10), ("t", 60)], 3, 60)
    assert got[:3] == [(True, 2, 0), (True, 1, 0), (True, 0, 0)]
    assert got[3] == (False, 0, 60) and got[4] == (False, 0, 50) and got[5][0] is True


def test_rate_limit_keys_are_independent_and_denied_do_not_consume(spark):
    got = decisions(spark, [("a", 0), ("a", 1), ("b", 2), ("a", 59), ("a", 60)], 1, 60)
    assert [g[0] for g in got] == [True, False, True, False, True]


def test_hold_time_alert(spark):
    timeline = [(0, 5.0), (60, 1.8), (120, 4.9), (180, 1.7), (240, 1.5), (300, 1.6), (360, 6.0)]
    df = spark.createDataFrame([("ram", at(t), i, v) for i, (t, v) in enumerate(timeline)], "k string, ts timestamp, id int, free double")
    got = tm.alert_states(df, "k", "ts", "id", F.col("free") < 2.0, 120).orderBy("id").select("state").collect()
    assert [r.state for r in got] == ["OK", "PENDING", "OK", "PENDING", "PENDING", "FIRING", "RESOLVED"]


def verdicts(spark, rows):
    df = spark.createDataFrame([("m", at(i), i, *r) for i, r in enumerate(rows)], "k string, ts timestamp, id int, gpu double, p50 double, n int")
    return tm.sticky_verdicts(df, "k", ["ts", "id"], "gpu", "p50", "n").orderBy("id").collect()


def test_sticky_verdict_and_learned_baseline(spark):
    got = verdicts(spark, [(0.4, 15.0, 5), (1.0, 82.0, 5), (1.0, 30.0, 5), (1.0, None, 0), (1.0, 90.0, 2), (1.0, 90.0, 3)])
    assert [r.degraded for r in got] == [True, False, True, True, True, False]
    assert got[0].baseline is None and got[1].baseline == 82.0


def test_every_fifth_degraded_request_is_a_canary(spark):
    got = verdicts(spark, [(1.0, 80.0, 5)] + [(1.0, 30.0, 5)] * 10)
    routes = [r.route for r in got[1:]]
    assert routes.count("canary") == 2 and routes[4] == routes[9] == "canary"


def test_cold_start_storm(spark):
    df = spark.createDataFrame([("m", at(i), i, 3.0 if i in (0, 9, 10) else 0.1) for i in range(25)], "k string, ts timestamp, id int, load double")
    got = {r.id: r.storm for r in tm.cold_start_storm(df, "k", ["ts", "id"], "load").collect()}
    assert got[9] and got[10] and got[18] and not got[8] and not got[20]


def test_no_limit_allows_everything(spark):
    assert decisions(spark, [("a", 0), ("a", 0), ("b", 1)], 0, 60) == [(True, 0, 0)] * 3


def test_sticky_verdicts_over_ranges(spark):
    """One key with half of all rows, long degraded stretches, against a plain loop; the plan has few exchanges."""
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(6000):
        phase = (i // 400) % 3
        rows.append((1 if i % 2 else rnd.randrange(2, 6), i, i, rnd.choice([None, 1.0, 0.95]) if phase else 0.4, rnd.choice([None, 10.0, 2.0 if phase == 2 else 9.0]), rnd.randrange(0, 6)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = tm.sticky_verdicts(spark.createDataFrame(rows, "u bigint, ts bigint, id bigint, gpu double, p50 double, samples int"), "u", ["ts", "id"], "gpu", "p50", "samples")
        got = {r["id"]: (r["degraded"], r["route"], r["baseline"]) for r in out.collect()}
        plan = out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state, want = {}, {}
    for u, _, i, gpu, p50, samples in rows:
        base, slow, served = state.get(u, (None, False, 0))
        spilled, able = gpu is not None and gpu < 0.9, p50 is not None and samples >= 3
        if able and base is None and not spilled:
            base = p50
        if able and base:
            slow = p50 < 0.5 * base
        bad = spilled or slow
        served = served + 1 if bad else 0
        state[u] = (base, slow, served)
        want[i] = (bad, "primary" if not bad else "canary" if served % 5 == 0 else "fallback", base)
    assert got == want
    assert plan.split("== Physical Plan ==")[-1].count("Exchange hashpartitioning") <= 6
