"""Telemetry over ``events``: stage = event type, duration = value * 100 ms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import ordered as od
from lexmill.operators import telemetry as tm
from lexmill.plans.registry import query, table


def events(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.col("event_type").alias("stage"), (F.col("value") * 100).alias("ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


SQL_E = """e AS (SELECT event_id, ts, user_id, event_type, value, event_type AS stage, value * 100 AS ms,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def nr(q: str, v: str = "ms", n: str = "n") -> str:
    return f"max({v}) FILTER (rn = least(floor({n} * {q}), {n} - 1) + 1)"


SQL_RANKED = """r AS (SELECT stage, ms, row_number() OVER (PARTITION BY stage ORDER BY ms) AS rn,
  count(*) OVER (PARTITION BY stage) AS n FROM e)"""


@query("a26_latency_percentiles", f"""WITH {SQL_E}, {SQL_RANKED}
SELECT stage, any_value(n) AS n, round(avg(ms), 4) AS mean, {nr('0.5')} AS p50, {nr('0.95')} AS p95, {nr('0.99')} AS p99
FROM r GROUP BY stage""")
def a26(spark, sf):
    return tm.latency_report(events(spark, sf), "stage", "ms")


@query("w6_last_100_percentiles", f"""WITH {SQL_E},
l AS (SELECT * FROM (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM e) WHERE b <= 100),
r AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM l)
SELECT user_id, any_value(n) AS n, {nr('0.5')} AS p50, {nr('0.95')} AS p95, {nr('0.1')} AS p10 FROM r GROUP BY user_id""")
def w6(spark, sf):
    return tm.window_report(events(spark, sf), "user_id", ["ts", "event_id"], "ms", 100)


@query("a27_outcome_shares", """SELECT event_type AS outcome, count(*) AS n,
round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def a27(spark, sf):
    return tm.outcome_shares(events(spark, sf).withColumnRenamed("event_type", "outcome"), "outcome")


@query("a28_alert_rules", f"""WITH {SQL_E},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e),
m AS (SELECT user_id, count(*) AS total, 1 - count(*) FILTER (event_type IN ('view', 'click')) / count(*) AS not_ok,
  count(*) FILTER (event_type = 'error') / count(*) AS rejected, {nr('0.95')} AS p95 FROM r GROUP BY user_id)
SELECT user_id, 'p95_latency' AS rule, round(p95, 6) AS value, 10000.0::DOUBLE AS threshold FROM m WHERE p95 > 10000
UNION ALL SELECT user_id, 'not_ok_share', round(not_ok, 6), 0.5 FROM m WHERE not_ok > 0.5 AND total >= 10
UNION ALL SELECT user_id, 'rejected_share', round(rejected, 6), 0.2 FROM m WHERE rejected > 0.2 AND total >= 10""")
def a28(spark, sf):
    ok = F.col("event_type").isin("view", "click")
    return tm.fired_alerts(events(spark, sf), "ms", ok, F.col("event_type") == "error", ["user_id"])


@query("a29_index_freshness", """WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1),
a AS (SELECT user_id, last, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(last)) AS age FROM l)
SELECT user_id, CASE WHEN last IS NULL THEN 'never' WHEN age > 86400 THEN 'stale' ELSE 'fresh' END AS status,
round(coalesce(age / 3600.0, -1), 4) AS age_h FROM a""")
def a29(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("ts")).scalar()
    return tm.freshness(e, "user_id", "ts", F.col("event_type") == "purchase", now, 86400)


SQL_HIST = f"""{SQL_E}, b AS (SELECT unnest(range(0, 11)) AS idx,
  unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 90.0]::DOUBLE[]) AS bound,
  unnest(['0.05', '0.1', '0.25', '0.5', '1.0', '2.0', '5.0', '10.0', '20.0', '40.0', '90.0']) AS le),
h AS (SELECT stage, idx, le, bound, count(*) FILTER (value / 10 <= bound) AS cum, count(*) AS n FROM e, b GROUP BY ALL
  UNION ALL SELECT stage, 11, '+Inf', 90.0, count(*), count(*) FROM e GROUP BY stage)"""


@query("a30_latency_histogram", f"""WITH {SQL_HIST}
SELECT stage, le, cum, n, round(total, 4) AS total FROM h JOIN (SELECT stage, sum(value / 10) AS total FROM e GROUP BY 1) USING (stage)""")
def a30(spark, sf):
    e = events(spark, sf).withColumn("s", F.col("value") / 10)
    return tm.histogram(e, "stage", "s", tm.LATENCY_BUCKETS).select("stage", "le", "cum", "n", F.round("total", 4).alias("total"))


def sql_hist(metric: str, label: str, value: str, bounds) -> str:
    return f"""SELECT '{metric}' AS metric, {label} AS label, le, count(*) FILTER ({value} <= bound) AS n, round(sum({value}), 4) AS total
FROM e, (SELECT unnest({[str(float(b)) for b in bounds] + ['inf']}::DOUBLE[]) AS bound, unnest({[str(float(b)) for b in bounds] + ['+Inf']}) AS le) GROUP BY ALL"""


@query("a30_metrics_in_one_pass", f"""WITH {SQL_E}
{sql_hist('stage_seconds', 'stage', 'value / 10', tm.LATENCY_BUCKETS)}
UNION ALL {sql_hist('chunks_used', "''", '(k % 23)::DOUBLE', tm.CHUNK_BUCKETS)}
UNION ALL {sql_hist('top_similarity', "''", 'value / 50', tm.SCORE_BUCKETS)}
UNION ALL SELECT 'requests', event_type || ',t' || user_id % 3, NULL, count(*), count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'no_context', '', NULL, count(*), count(*) FROM e WHERE value < 1 HAVING count(*) > 0
UNION ALL SELECT 'tokens', CASE WHEN event_id % 2 = 0 THEN 'prompt' ELSE 'answer' END, NULL, count(*), sum(k) FROM e GROUP BY ALL""")
def a30_all(spark, sf):
    """Histograms of latency, chunks used and top similarity, and counters by label, from one scan."""
    one, none = F.lit(1.0), F.lit("")
    return tm.accumulated(events(spark, sf), [
        ("stage_seconds", F.col("stage"), F.col("value") / 10, tm.LATENCY_BUCKETS), ("chunks_used", none, F.col("k") % 23, tm.CHUNK_BUCKETS),
        ("top_similarity", none, F.col("value") / 50, tm.SCORE_BUCKETS),
        ("requests", F.concat("event_type", F.lit(",t"), F.col("user_id") % 3), one, None), ("no_context", none, F.when(F.col("value") < 1, one), None),
        ("tokens", F.when(F.col("event_id") % 2 == 0, "prompt").otherwise("answer"), F.col("k"), None),
    ]).withColumn("total", F.round("total", 4))


@query("a31_bucket_quantile", f"""WITH {SQL_HIST},
p AS (SELECT *, coalesce(lag(cum) OVER w, 0) AS pc, coalesce(lag(bound) OVER w, 0) AS pb FROM h WINDOW w AS (PARTITION BY stage ORDER BY idx))
SELECT stage, round(CASE WHEN le = '+Inf' THEN bound ELSE pb + (bound - pb) * (n * 0.95::DOUBLE - pc) / (cum - pc) END, 6) AS quantile
FROM p WHERE cum >= n * 0.95::DOUBLE AND pc < n * 0.95::DOUBLE""")
def a31(spark, sf):
    e = events(spark, sf).withColumn("s", F.col("value") / 10)
    return tm.bucket_quantile(tm.histogram(e, "stage", "s", tm.LATENCY_BUCKETS), "stage", 0.95)


@query("a31_rate_rules", """WITH w AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT epoch(h)::BIGINT AS window_start, n, bad, round(bad / n, 6) AS share, bad / n > 0.3 AS fired FROM w""")
def a31r(spark, sf):
    g = events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("h"))
    w = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    share = F.col("bad") / F.col("n")
    return w.select(F.unix_timestamp("h").alias("window_start"), "n", "bad", F.round(share, 6).alias("share"), (share > 0.3).alias("fired"))


@query("a32_label_cardinality", """WITH c AS (SELECT 'event_type' AS label, count(DISTINCT event_type) AS n_values FROM events
UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events
UNION ALL SELECT 'props', count(DISTINCT props) FROM events
UNION ALL SELECT 'event_type+user_id+props', count(DISTINCT (event_type, user_id, props)) FROM events)
SELECT label, n_values, n_values > 50 AS too_many FROM c""")
def a32(spark, sf):
    return tm.label_cardinality(table(spark, sf, "events"), ["event_type", "user_id", "props"], 50)


@query("a35_cascade_call_budget", """WITH v AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'signup') AS off_topic,
count(*) FILTER (event_type = 'error') AS refusal, count(*) FILTER (event_type = 'click') AS retried FROM events)
SELECT n, refusal + retried * 4 + (n - off_topic - refusal - retried) * 2 AS cascade, n * 2 AS naive,
round(1 - (refusal + retried * 4 + (n - off_topic - refusal - retried) * 2) / (n * 2), 6) AS saving FROM v""")
def a35(spark, sf):
    calls = (
        F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "click", 4).otherwise(2)
    )
    s = events(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum(calls).alias("cascade"))
    return s.select("n", "cascade", (F.col("n") * 2).alias("naive"), F.round(1 - F.col("cascade") / (F.col("n") * 2), 6).alias("saving"))


@query("a36_length_statistics", """WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS rn, count(*) OVER () AS n FROM documents)
SELECT any_value(n) AS n, min(n_chars) AS shortest, max(n_chars) FILTER (rn = n // 2 + 1) AS median,
max(n_chars) FILTER (rn = least(floor(n * 0.95), n - 1) + 1) AS p95, max(n_chars) AS longest FROM r""")
def a36(spark, sf):
    d = table(spark, sf, "documents").select("n_chars")
    ranks = {
        "shortest": F.lit(1), "median": F.floor(F.col("n") / 2) + 1,
        "p95": od.nearest_rank(0.95), "longest": F.col("n"),
    }
    return od.rank_values(d, [], "n_chars", ranks)


@query("a36_length_histogram", "SELECT n_chars // 50 * 50 AS start, count(*) AS n FROM documents GROUP BY 1")
def a36h(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy((F.floor(F.col("n_chars") / 50) * 50).alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("w7_for_duration_alert", f"""WITH {SQL_E}, v AS (SELECT user_id, event_id, ts, value > 30 AS bad,
  sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
s AS (SELECT *, min(ts) FILTER (bad) OVER (PARTITION BY user_id, island) AS since FROM v),
o AS (SELECT *, bad AND epoch_us(ts) - epoch_us(since) >= 36000 * 1000000::BIGINT AS over FROM s),
f AS (SELECT *, count(*) FILTER (over) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS nth,
  lag(over) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM o)
SELECT user_id, event_id, CASE WHEN NOT bad AND was THEN 'RESOLVED' WHEN NOT bad THEN 'OK' WHEN NOT over THEN 'PENDING'
  WHEN nth = 1 THEN 'FIRING' ELSE 'FIRING_CONTINUES' END AS state FROM f""")
def w7(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "ts", "value")
    return tm.alert_states(e, "user_id", "ts", "event_id", F.col("value") > 30, 36000).select("user_id", "event_id", "state")


@query("w9_cold_start_storm", f"""WITH {SQL_E} SELECT user_id, event_id, cold, cold > 1 AS storm FROM (
SELECT user_id, event_id, sum(CASE WHEN value / 20 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS cold FROM e)""")
def w9(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "ts", (F.col("value") / 20).alias("load"))
    return tm.cold_start_storm(e, "user_id", ["ts", "event_id"], "load").select("user_id", "event_id", "cold", "storm")


SQL_ROUTES = f"""{SQL_E}, i AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 0.4 WHEN 'signup' THEN NULL ELSE 1.0 END AS gpu,
  CASE WHEN event_type <> 'view' THEN value END AS p50, k % 8 AS samples FROM e),
j AS (SELECT *, coalesce(gpu < 0.9, false) AS gpu_bad, p50 IS NOT NULL AND samples >= 3 AS judgeable FROM i),
f AS (SELECT user_id, min((ts, event_id, p50)) AS f FROM j WHERE judgeable AND NOT gpu_bad GROUP BY 1),
b AS (SELECT j.*, CASE WHEN (ts, event_id) >= (f[1], f[2]) THEN f[3] END AS baseline FROM j LEFT JOIN f USING (user_id)),
q AS (SELECT *, CASE WHEN judgeable AND baseline > 0 THEN p50 < 0.5 * baseline END AS jd FROM b),
d AS (SELECT *, gpu_bad OR coalesce(last_value(jd IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS degraded FROM q),
n AS (SELECT *, sum(CASE WHEN degraded THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isl FROM d),
c AS (SELECT *, count(*) FILTER (degraded) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id) AS nth FROM n)"""


@query("w10_sticky_degradation", f"""WITH {SQL_ROUTES} SELECT user_id, event_id, gpu_bad, degraded, coalesce(baseline, -1) AS baseline FROM c""")
def w10(spark, sf):
    return routes(spark, sf).select("user_id", "event_id", "gpu_bad", "degraded", F.coalesce("baseline", F.lit(-1.0)).alias("baseline"))


@query("w11_canary_every_fifth", f"""WITH {SQL_ROUTES} SELECT user_id, event_id,
CASE WHEN NOT degraded THEN 'primary' WHEN nth % 5 = 0 THEN 'canary' ELSE 'fallback' END AS route FROM c""")
def w11(spark, sf):
    return routes(spark, sf).select("user_id", "event_id", "route")


def routes(spark, sf):
    e = events(spark, sf).select(
        "user_id", "event_id", "ts",
        F.when(F.col("event_type") == "error", 0.4).when(F.col("event_type") != "signup", 1.0).alias("gpu"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("p50"), (F.col("k") % 8).alias("samples"),
    )
    return tm.sticky_verdicts(e, "user_id", ["ts", "event_id"], "gpu", "p50", "samples")


@query("w12_trace_stage_shares", f"""WITH {SQL_E}, t AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(ms) AS total, arg_max(stage, (ms, stage)) AS slowest FROM e GROUP BY ALL)
SELECT e.user_id, event_id, stage, ms, slowest, round(ms / total, 6) AS share FROM e JOIN t ON e.user_id = t.user_id AND CAST(e.ts AS DATE) = t.d""")
def w12(spark, sf):
    e = events(spark, sf).withColumn("day", F.to_date("ts"))
    return tm.trace_shares(e, ["user_id", "day"], "stage", "ms").select(
        "user_id", "event_id", "stage", "ms", "slowest", F.round("share", 6).alias("share"))


@query("f40_tokens_per_second", f"""WITH {SQL_E} SELECT event_id, round(k / nullif(value / 10, 0), 6) AS tps, round(k / greatest(value / 10 - 1, 1e-9::DOUBLE), 2) AS tps_floored FROM e""")
def f40(spark, sf):
    ns = F.col("value") / 10
    return events(spark, sf).select(
        "event_id", F.round(F.try_divide(F.col("k"), ns), 6).alias("tps"),
        F.round(F.col("k") / F.greatest(ns - 1, F.lit(1e-9)), 2).alias("tps_floored"))


@query("a21_benchmark_by_model_and_category", f"""WITH {SQL_E} SELECT event_type AS model, coalesce(CAST(k % 4 AS VARCHAR), '*') AS category,
count(*) AS n, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END), 6) AS score FROM e GROUP BY GROUPING SETS ((event_type, k % 4), (event_type))""")
def a21(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("model"), (F.col("k") % 4).cast("string").alias("category"), "value")
    g = e.groupingSets([["model", "category"], ["model"]], "model", "category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("value") > 20, 1.0).otherwise(0.0)), 6).alias("score"))
    return g.select("model", F.coalesce("category", F.lit("*")).alias("category"), "n", "score")


@query("a21_benchmark_speed", f"""WITH {SQL_E}, r AS (SELECT event_type AS model, k / (value / 10) AS s, row_number() OVER (PARTITION BY event_type ORDER BY k / (value / 10)) AS rn,
count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE value > 0)
SELECT model, any_value(n) AS n, round((max(s) FILTER (rn = (n - 1) // 2 + 1) + max(s) FILTER (rn = n // 2 + 1)) / 2, 6) AS median_tps,
round(max(s) FILTER (rn = n // 2 + 1), 6) AS upper_median_tps, round(max(s) FILTER (rn = n // 10 + 1), 6) AS p10_tps FROM r GROUP BY model""")
def a21s(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("model"), F.try_divide(F.col("k"), F.col("value") / 10).alias("s"))
    r = od.rank_values(e, ["model"], "s", {
        "lo": F.floor((F.col("n") - 1) / 2) + 1, "hi": F.floor(F.col("n") / 2) + 1, "p10": F.floor(F.col("n") / 10) + 1})
    return r.select("model", "n", F.round((F.col("lo") + F.col("hi")) / 2, 6).alias("median_tps"),
                    F.round("hi", 6).alias("upper_median_tps"), F.round("p10", 6).alias("p10_tps"))


@query("a41_tool_usage_and_steps", f"""WITH {SQL_E} SELECT 'tool' AS metric, CASE WHEN k % 2 = 0 THEN 'search_kb' ELSE 'calculator' END AS name, count(*)::DOUBLE AS value FROM e WHERE event_type = 'click' GROUP BY ALL
UNION ALL SELECT 'steps_mean', '', round(avg(k), 6) FROM e WHERE event_type = 'purchase'
UNION ALL SELECT 'steps_max', '', max(k)::DOUBLE FROM e WHERE event_type = 'purchase'""")
def a41(spark, sf):
    e = events(spark, sf)
    tools = e.where(F.col("event_type") == "click").groupBy(
        F.when(F.col("k") % 2 == 0, "search_kb").otherwise("calculator").alias("name")
    ).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("tool").alias("metric"), "name", "value")
    s = e.where(F.col("event_type") == "purchase").agg(F.round(F.avg("k"), 6).alias("a"), F.max("k").cast("double").alias("m"))
    steps = s.select(F.inline(F.array(
        F.struct(F.lit("steps_mean").alias("metric"), F.lit("").alias("name"), F.col("a").alias("value")),
        F.struct(F.lit("steps_max").alias("metric"), F.lit("").alias("name"), F.col("m").alias("value")))))
    return tools.unionByName(steps)


@query("a44_test_report", f"""WITH {SQL_E}, p AS (SELECT *, event_type <> 'error' AS ok, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 64 AS part FROM e),
v AS (SELECT user_id, count(*) FILTER (ok) AS passed, count(*) AS total, coalesce(min(event_id) FILTER (NOT ok), -1) AS first_fail FROM p GROUP BY 1),
l AS (SELECT user_id, part, string_agg(CASE WHEN ok THEN '[PASS] ' ELSE '[FAIL] ' END || event_id || ' -> ' || k, chr(10) ORDER BY ts, event_id) AS report FROM p GROUP BY ALL)
SELECT user_id, passed, total, first_fail, part, report FROM v JOIN l USING (user_id)""")
def a44(spark, sf):
    e = od.with_position(od.dealt(events(spark, sf), ["user_id"], ["ts", "event_id"]), ["user_id"], ["ts", "event_id"], F.col("_b"))
    ok = F.col("event_type") != "error"
    line = F.concat(F.when(ok, "[PASS] ").otherwise("[FAIL] "), F.col("event_id"), F.lit(" -> "), F.col("k"))
    verdict = e.groupBy("user_id").agg(
        F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"),
        F.coalesce(F.min(F.when(~ok, F.col("event_id"))), F.lit(-1)).alias("first_fail"))
    parts = e.groupBy("user_id", F.floor((F.col("pos") - 1) / 64).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))
    return verdict.join(parts, "user_id")


@query("a45_readiness_rollup", f"""WITH {SQL_E}, c AS (SELECT user_id, event_type AS name, max(value) < 200 AS ok FROM e GROUP BY ALL),
r AS (SELECT user_id, bool_and(ok) AS all_ok, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed FROM c GROUP BY 1)
SELECT user_id, CASE WHEN all_ok THEN 'ready' ELSE 'degraded' END AS status, failed,
((user_id % 2 = 0) <> all_ok) AS contradicts FROM r""")
def a45(spark, sf):
    checks = events(spark, sf).groupBy("user_id", F.col("event_type").alias("name")).agg((F.max("value") < 200).alias("ok"))
    r = checks.groupBy("user_id").agg(
        F.bool_and("ok").alias("all_ok"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("name")))), ",").alias("failed"))
    return r.select("user_id", F.when(F.col("all_ok"), "ready").otherwise("degraded").alias("status"), "failed",
                    ((F.col("user_id") % 2 == 0) != F.col("all_ok")).alias("contradicts"))


@query("a48_queue_decomposition", f"""WITH {SQL_E} SELECT event_id, round(ms, 4) AS wall_ms, round(ms - k * 10, 4) AS queue_ms,
row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS done_rank FROM e""")
def a48(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "ms", (F.col("ms") - F.col("k") * 10).alias("queue"))
    e = od.with_position(e, ["user_id"], ["ms", "event_id"], F.floor(F.col("ms") / 50), "done_rank")
    return e.select("event_id", F.round("ms", 4).alias("wall_ms"), F.round("queue", 4).alias("queue_ms"), "done_rank")


@query("t5_newest_n", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 20")
def t5(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value").orderBy(F.desc("event_id")).limit(20)


@query("st4_rate_limit_batch", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
d AS (SELECT user_id, event_id, rn, t, [t] AS hits, true AS allowed, 1 AS remaining, 0 AS retry_after_s FROM e WHERE rn = 1
UNION ALL
SELECT user_id, event_id, rn, t, CASE WHEN len(kept) >= 2 THEN kept ELSE list_append(kept, t) END, len(kept) < 2,
  CASE WHEN len(kept) >= 2 THEN 0 ELSE 2 - len(kept) - 1 END,
  CASE WHEN len(kept) >= 2 THEN greatest(CAST(ceil((kept[1] + 86400000000 - t) / 1000000) AS INTEGER), 1) ELSE 0 END
FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(d.hits, lambda h: e.t - h < 86400000000) AS kept FROM d JOIN e ON e.user_id = d.user_id AND e.rn = d.rn + 1))
SELECT user_id, event_id, allowed, remaining::INTEGER AS remaining, retry_after_s FROM d""")
def st4b(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "ts")
    return tm.rate_decisions(e, "user_id", "ts", "event_id", 2, 86400.0)
