"""Streaming twins over the event and document files, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import hygiene as hy
from lexmill.operators import retrieval as rt
from lexmill.plans.registry import query
from lexmill.plans.telemetry import SQL_E, SQL_ROUTES
from lexmill.session import scratch
from lexmill.streaming import jobs as sj

BOUNDS = (1000.0, 5000.0, 10000.0)


def stream_of(spark, sf, name):
    """The stream of a table, kept as one file or as a folder of files."""
    t = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    one = all(f.endswith(f"/{name}.parquet") for f in t.inputFiles()[:1])
    return sj.read_stream(spark, sf if one else f"{sf.rstrip('/')}/{name}.parquet", f"{name}.parquet" if one else "*.parquet", t.schema)


def event_stream(spark, sf):
    e = stream_of(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "user_id", "event_type", "value", (F.col("value") * 100).alias("ms"),
        F.when(F.col("event_type") == "error", "refused").otherwise("ok").alias("verdict"),
        F.get_json_object("props", "$.k").cast("long").alias("k"))


SQL_ST1 = f"""{SQL_E}, w AS (SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, event_type, count(*) AS n, sum(ms) AS total, max(ms) AS longest,
count(*) FILTER (event_type = 'error') AS not_ok, count(*) FILTER (ms <= 1000) AS le_0, count(*) FILTER (ms <= 5000) AS le_1, count(*) FILTER (ms <= 10000) AS le_2 FROM e GROUP BY ALL)"""


def latency_windows(spark, sf):
    w = sj.windowed_latency(event_stream(spark, sf), "ts", "event_type", "ms", BOUNDS, "6 hours", "1 hour")
    return sj.drain_updates(w, ["window_start", "event_type"], "st1")


@query("st1_windowed_latency_metrics", f"WITH {SQL_ST1} SELECT window_start, event_type, n, round(total, 2) AS total, longest, not_ok, le_0, le_1, le_2 FROM w")
def st1(spark, sf):
    return latency_windows(spark, sf).withColumn("total", F.round("total", 2))


@query("st8_alerts_on_stream", f"""WITH {SQL_ST1} SELECT window_start, event_type, 'slow_share' AS rule, round(1 - le_1 / n, 6) AS value FROM w WHERE 1 - le_1 / n > 0.4 AND n >= 10
UNION ALL SELECT window_start, 'all', 'not_ok_share', round(sum(not_ok) / sum(n), 6) FROM w GROUP BY window_start HAVING sum(not_ok) / sum(n) > 0.25 AND sum(n) >= 10
UNION ALL SELECT max(window_start), event_type, 'stale', round(((SELECT max(window_start) FROM w) - max(window_start)) / 3600.0, 6) FROM w GROUP BY event_type HAVING (SELECT max(window_start) FROM w) - max(window_start) > 86400""")
def st8(spark, sf):
    w = latency_windows(spark, sf)
    slow = w.where((1 - F.col("le_1") / F.col("n") > 0.4) & (F.col("n") >= 10)).select(
        "window_start", "event_type", F.lit("slow_share").alias("rule"), F.round(1 - F.col("le_1") / F.col("n"), 6).alias("value"))
    per = w.groupBy("window_start").agg(F.sum("not_ok").alias("b"), F.sum("n").alias("n"))
    bad = per.where((F.col("b") / F.col("n") > 0.25) & (F.col("n") >= 10)).select(
        "window_start", F.lit("all").alias("event_type"), F.lit("not_ok_share").alias("rule"), F.round(F.col("b") / F.col("n"), 6).alias("value"))
    now = w.agg(F.max("window_start").alias("m")).scalar()
    seen = w.groupBy("event_type").agg(F.max("window_start").alias("window_start"))
    stale = seen.where(now - F.col("window_start") > 86400).select(
        "window_start", "event_type", F.lit("stale").alias("rule"), F.round((now - F.col("window_start")) / 3600.0, 6).alias("value"))
    return slow.unionByName(bad).unionByName(stale)


def scan(stream, cols, rule, name):
    out_schema, state_schema, start, step = rule
    return sj.drain_to_table(sj.ordered_scan(stream, "user_id", ["us", "event_id"], cols, out_schema, state_schema, start, step), name)


@query("st2_last_n_window_on_stream", f"""WITH {SQL_E}, l AS (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS v FROM e)
SELECT user_id, event_id, len(v)::INTEGER AS n, v[least(floor(len(v) * 0.5), len(v) - 1)::INTEGER + 1] AS p50, v[least(floor(len(v) * 0.95), len(v) - 1)::INTEGER + 1] AS p95 FROM l""")
def st2(spark, sf):
    return scan(event_stream(spark, sf), ["value"], sj.last_n_percentiles(20), "st2")


@query("st3_for_duration_alert_on_stream", f"""WITH {SQL_E}, v AS (SELECT user_id, event_id, ts, value > 30 AS bad, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
s AS (SELECT *, min(ts) FILTER (bad) OVER (PARTITION BY user_id, island) AS since FROM v), o AS (SELECT *, bad AND epoch_us(ts) - epoch_us(since) >= 36000000000 AS over FROM s),
f AS (SELECT *, count(*) FILTER (over) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS nth, lag(over) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM o)
SELECT user_id, event_id, CASE WHEN NOT bad AND was THEN 'RESOLVED' WHEN NOT bad THEN 'OK' WHEN NOT over THEN 'PENDING' WHEN nth = 1 THEN 'FIRING' ELSE 'FIRING_CONTINUES' END AS state FROM f""")
def st3(spark, sf):
    return scan(event_stream(spark, sf), ["value"], sj.hold_alert(30, 36000), "st3")


@query("st4_rate_limit_on_stream", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
d AS (SELECT user_id, event_id, rn, t, [t] AS hits, true AS allowed, 2 AS remaining, 0 AS retry_after_s FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, t, CASE WHEN len(kept) >= 3 THEN kept ELSE list_append(kept, t) END, len(kept) < 3, CASE WHEN len(kept) >= 3 THEN 0 ELSE 3 - len(kept) - 1 END,
  CASE WHEN len(kept) >= 3 THEN greatest(CAST(ceil((kept[1] + 172800000000 - t) / 1000000) AS INTEGER), 1) ELSE 0 END
FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(d.hits, lambda h: e.t - h < 172800000000) AS kept FROM d JOIN e ON e.user_id = d.user_id AND e.rn = d.rn + 1))
SELECT user_id, event_id, allowed, remaining::INTEGER AS remaining, retry_after_s FROM d""")
def st4(spark, sf):
    out_schema, state_schema, start, step = sj.sliding_limit(3, 172800)
    return sj.drain_to_table(sj.keyed_scan(event_stream(spark, sf), "user_id", ["us", "event_id"], [], out_schema, state_schema, start, step), "st4")


@query("st5_cold_start_storm_on_stream", f"""WITH {SQL_E} SELECT user_id, event_id, cold, cold > 1 AS storm FROM (
SELECT user_id, event_id, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)::BIGINT AS cold FROM e)""")
def st5(spark, sf):
    return scan(event_stream(spark, sf), ["value"], sj.cold_storm(10, 20.0, 1), "st5")


@query("st6_degradation_and_canaries_on_stream", f"WITH {SQL_ROUTES} SELECT user_id, event_id, degraded, CASE WHEN NOT degraded THEN 'primary' WHEN nth % 5 = 0 THEN 'canary' ELSE 'fallback' END AS route FROM c")
def st6(spark, sf):
    e = event_stream(spark, sf).select(
        "user_id", "us", "event_id", F.when(F.col("event_type") == "error", 0.4).when(F.col("event_type") != "signup", 1.0).alias("gpu"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("p50"), (F.col("k") % 8).alias("samples"))
    return scan(e, ["gpu", "p50", "samples"], sj.route_by_health(), "st6")


@query("st7_incremental_ingest", r"""WITH d AS (SELECT doc_id, sha256(text) AS digest, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'), ' ')), lambda x: x <> '')) AS chunk,
generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'), ' ')), lambda x: x <> ''), 1) - 1 AS chunk_index FROM documents),
m AS (SELECT *, regexp_replace(chunk, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS masked FROM d)
SELECT doc_id, chunk_index::INT AS chunk_index, substr(sha256(doc_id || ':' || chunk_index), 1, 32) AS chunk_id, digest, length(masked) AS n_chars, masked <> chunk AS masked, sha256(masked) AS text_digest FROM m""")
def st7(spark, sf):
    """scan -> normalise -> chunk -> mask -> upsert by document and chunk; every copy of a text is a document of its own."""
    out, ckpt = scratch(spark, "st7"), scratch(spark, "st7-checkpoint")
    d = stream_of(spark, sf, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"), F.col("_metadata.file_modification_time").alias("sent"))
    d = sj.unsent(d, ["doc_id", "digest"], "sent")

    def prepare(batch):
        lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
        c = batch.select("doc_id", "digest", F.posexplode(F.filter(lines, lambda x: x != "")).alias("chunk_index", "chunk"))
        masked = F.regexp_replace("chunk", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
        return c.select(
            F.concat_ws(":", "doc_id", "chunk_index").alias("key"), "doc_id", "chunk_index", "digest", F.length(masked).alias("n_chars"),
            (masked != F.col("chunk")).alias("masked"), F.sha2(masked, 256).alias("text_digest"),
        ).withColumn("chunk_id", F.substring(F.sha2("key", 256), 1, 32))

    sj.ingest(d, prepare, "doc_id", out, ckpt).awaitTermination()
    return sj.ingested(spark, out, "doc_id").select("doc_id", "chunk_index", "chunk_id", "digest", "n_chars", "masked", "text_digest")


def chunked(batch):
    """The chunks of (doc_id, text, digest, trusted) as :func:`document_ingest` stores them."""
    # each step is worked out once: plain projections around a Python function are folded into one, which repeats a step in every use of it
    known = ["doc_id", "digest", "trusted"]
    untouched = F.struct(F.col("text").alias("t"), F.array().cast("array<string>").alias("removed"))
    stripped = F.when(F.col("trusted"), untouched).otherwise(hy.strip_untrusted(F.col("text"), False))
    c = tx.once(hy.normalise(batch), known, text=F.col("text"))
    c = tx.once(c, [*known, "text"], d=hy.injection_report(F.col("text")), s=stripped)
    c = tx.once(c, [*known, "text", "d", "s"], m=hy.mask_pii(F.col("s.t")))
    known += ["removed", "pii", "whole", "d"]
    c = hy.normalise(c.select(*known[:3], F.col("s.removed").alias("removed"), F.col("m.counts").alias("pii"), F.col("text").alias("whole"), "d", F.col("m.t").alias("text")))
    c = tx.once(c, known, text=F.col("text"))
    # a rule that matches a line matches the text that it is a line of
    able = F.when(F.col("text") == F.col("whole"), F.col("d.rules")).otherwise(hy.injection_report(F.col("text"))["rules"])
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    known = [*known[:5], "doc_risk", "able"]
    c = tx.once(c, known[:5], doc_risk=F.col("d.risk"), able=able, lines=lines)
    c = c.select(*known, F.posexplode("lines").alias("chunk_index", "text"))
    c = tx.once(c, [*known[:6], "chunk_index", "text"], r=hy.injection_report(F.col("text"), F.col("able")))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.col("digest"))), "chunk_index")
    return c.select(
        key.alias("key"), "doc_id", "chunk_index", F.substring(F.sha2(key, 256), 1, 32).alias("chunk_id"), "digest", "text",
        F.array_join("removed", ",").alias("removed"), F.array_join("pii", ",").alias("pii"),
        hy.chunk_risk(F.col("r.risk"), F.col("doc_risk"), F.col("trusted")).alias("risk"),
        F.array_join("r.rules", ",").alias("rules"), (~F.col("trusted")).alias("quarantined"))


def document_ingest(spark, sf):
    """scan -> normalise -> injection report -> strip (untrusted) -> mask all types -> normalise -> chunk -> chunk risk -> upsert.

    ``st7_incremental_ingest`` is the part of it that SQL can say. As in the other hygiene rows, every seventh id stands for an
    untrusted source; its chunks inherit the document's risk and are marked for quarantine, not dropped.
    """
    out, ckpt = scratch(spark, "st7-documents"), scratch(spark, "st7-documents-checkpoint")
    d = stream_of(spark, sf, "documents").select(
        "doc_id", "text", F.sha2("text", 256).alias("digest"), F.coalesce(F.col("doc_id") % 7 != 0, F.lit(False)).alias("trusted"),
        F.col("_metadata.file_modification_time").alias("sent"))
    d = sj.unsent(d, ["doc_id", "digest"], "sent")

    sj.ingest(d, chunked, "doc_id", out, ckpt).awaitTermination()
    return sj.ingested(spark, out, "doc_id").select(
        "doc_id", "chunk_index", "chunk_id", "digest", "text", "removed", "pii", "risk", "rules", "quarantined")


@query("st9_closed_sessions", """WITH g AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR >= ts THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
a AS (SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) + 43200000000 AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid)
SELECT * FROM a WHERE end_us // 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)""")
def st9(spark, sf):
    s = sj.sessions(event_stream(spark, sf), "user_id", "ts", "12 hours", "1 hour")
    return sj.drain_to_table(s, "st9").withColumn("total", F.round("total", 4))


@query("st10_append_log_sink", "SELECT event_type AS event, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def st10(spark, sf):
    path, ckpt = scratch(spark, "st10"), scratch(spark, "st10-checkpoint")
    line = F.to_json(F.struct("ts", F.col("event_type").alias("event"), "user_id"))
    sj.log_sink(event_stream(spark, sf), line, path, ckpt).awaitTermination()
    # a second run with the same checkpoint finds nothing new and adds nothing
    sj.log_sink(event_stream(spark, sf), line, path, ckpt).awaitTermination()
    log = spark.read.schema("event string, user_id bigint").json(path)
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
