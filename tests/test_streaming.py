"""State carried over several micro-batches gives the batch result."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import telemetry as tm
from lexmill.plans.telemetry import events
from lexmill.streaming import jobs as sj


@pytest.fixture(scope="module")
def sliced(spark, sf, tmp_path_factory):
    """Events in five files by time, picked up one per batch."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{sf}/events.parquet")
    day = F.dayofmonth("ts")
    for i in range(5):
        e.where((day > i * 7) & (day <= (i + 1) * 7)).coalesce(1).write.mode("append").parquet(path)
    s = sj.read_stream(spark, path, "*.parquet", e.schema, files_per_trigger=1)
    ts = F.col("ts").cast("timestamp")
    return s.select("user_id", F.unix_micros(ts).alias("us"), "event_id", "value", ts.alias("ts"))


def run(stream, cols, rule, name):
    out, state, start, step = rule
    return sj.drain_to_table(sj.keyed_scan(stream, "user_id", ["us", "event_id"], cols, out, state, start, step), name)


def same(a, b, cols):
    x, y = a.select(*cols), b.select(*cols)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() and not x.isEmpty()


def test_rate_limit_across_batches(spark, sf, sliced):
    got = run(sliced, [], sj.sliding_limit(2, 86400), "t4")
    want = tm.rate_decisions(events(spark, sf).select("user_id", "event_id", "ts"), "user_id", "ts", "event_id", 2, 86400.0)
    assert same(got, want, ["user_id", "event_id", "allowed", "remaining", "retry_after_s"])


def test_alert_across_batches(spark, sf, sliced):
    got = run(sliced, ["value"], sj.hold_alert(30, 36000), "t3")
    e = events(spark, sf).select("user_id", "event_id", "ts", "value")
    assert same(got, tm.alert_states(e, "user_id", "ts", "event_id", F.col("value") > 30, 36000), ["user_id", "event_id", "state"])


def test_storm_across_batches(spark, sf, sliced):
    got = run(sliced, ["value"], sj.cold_storm(10, 20.0, 1), "t5")
    e = events(spark, sf).select("user_id", "event_id", "ts", (F.col("value") / 20).alias("load"))
    assert same(got, tm.cold_start_storm(e, "user_id", ["ts", "event_id"], "load"), ["user_id", "event_id", "cold", "storm"])


def test_limit_zero_is_off():
    _, _, start, step = sj.sliding_limit(0, 60)
    assert step(start(), None)[1] == (True, 0, 0)


def test_windows_across_batches(spark, sf, sliced):
    s = sliced.withColumn("stage", F.lit("all")).withColumn("verdict", F.lit("ok"))
    got = sj.drain_updates(sj.windowed_latency(s, "ts", "stage", "value", (10.0,), "6 hours", "1 hour"), ["window_start", "stage"], "t1")
    e = events(spark, sf).groupBy(F.unix_timestamp(F.window("ts", "6 hours").start).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    assert same(got, e, ["window_start", "n"])


def ordered(stream, rule, name, **how):
    out, state, start, step = rule
    return sj.drain_to_table(sj.ordered_scan(stream, "user_id", ["us", "event_id"], ["value"], out, state, start, step, **how), name)


def files(spark, path, batches):
    """One file per batch, in order, with user_id, us, event_id, value."""
    schema = "user_id bigint, us bigint, event_id bigint, value double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return sj.read_stream(spark, path, "*.parquet", spark.read.parquet(path).schema, files_per_trigger=1)


HOUR = 3_600_000_000
END = [(99, 10**6 * HOUR, 10**9, 0.0)]  # moves the watermark past everything


def test_ordered_scan_across_batches(spark, sf, sliced):
    got = ordered(sliced, sj.hold_alert(30, 36000), "o3")
    e = events(spark, sf).select("user_id", "event_id", "ts", "value")
    assert same(got, tm.alert_states(e, "user_id", "ts", "event_id", F.col("value") > 30, 36000), ["user_id", "event_id", "state"])


def test_late_rows_are_judged_in_order(spark, tmp_path):
    rows = [(1, i * HOUR, i, float(i % 7)) for i in range(1, 40)] + [(2, i * HOUR + 5, 100 + i, 50.0) for i in range(1, 40)]
    late = [r for r in rows if r[2] % 5 == 0]  # these come a batch later than their neighbours
    batches = [[r for r in rows if r not in late and r[1] < 20 * HOUR], [r for r in late if r[1] < 20 * HOUR] + [r for r in rows if r not in late and r[1] >= 20 * HOUR], [r for r in late if r[1] >= 20 * HOUR], END]
    got = ordered(files(spark, str(tmp_path / "a"), batches), sj.last_n_percentiles(4), "late", delay="24 hours", idle_ms=10**12)
    want = ordered(files(spark, str(tmp_path / "b"), [rows, END]), sj.last_n_percentiles(4), "whole", idle_ms=10**12)
    mine, theirs = (sorted(map(tuple, x.where("user_id < 99").collect())) for x in (got, want))
    assert mine == theirs and len(mine) == len(rows)
    by_id = {r[1]: r[2:] for r in mine}
    assert by_id[3] == (3, 2.0, 3.0) and by_id[5] == (4, 4.0, 5.0)


def test_idle_keys_are_forgotten(spark, tmp_path):
    batches = [[(1, 1 * HOUR, 1, 5.0), (1, 2 * HOUR, 2, 6.0), (2, 2 * HOUR, 3, 7.0)], [(2, 30 * HOUR, 4, 1.0)], [(2, 31 * HOUR, 5, 1.0), (1, 32 * HOUR, 6, 9.0)], [(1, 33 * HOUR, 7, 2.0)], END]
    got = ordered(files(spark, str(tmp_path / "a"), batches), sj.last_n_percentiles(10), "idle", idle_ms=20 * 3_600_000)
    n = {r["event_id"]: r["n"] for r in got.collect() if r["user_id"] < 99}
    assert n == {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 1, 7: 2}  # both keys came back after more than twenty hours


def test_state_of_idle_keys_is_removed(spark, tmp_path):
    batches = [[(k, 1 * HOUR, k, 5.0) for k in range(50)], [(99, 2 * HOUR, 200, 0.0)], [(99, 90 * HOUR, 201, 0.0)], [(99, 91 * HOUR, 202, 0.0)], END]
    stream = files(spark, str(tmp_path / "a"), batches)
    out, state, start, step = sj.last_n_percentiles(10)
    spark.conf.set(sj.PROVIDER, sj.ROCKS)
    q = (
        sj.ordered_scan(stream, "user_id", ["us", "event_id"], ["value"], out, state, start, step, idle_ms=20 * 3_600_000).writeStream.format("noop")
        .option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", "current").load(str(tmp_path / "c"))
    assert {r["key"]["user_id"] for r in kept.select("key").collect()} <= {99}


def test_ingest_on_change(spark, tmp_path):
    """Later batches replace whole documents; files sent again change nothing; two rows of one id stay apart."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id bigint, text string"
    prepared = []

    def prepare(batch):
        prepared.append(batch.count())
        lines = F.filter(F.split("text", "\n"), lambda x: x != "")
        return batch.select("doc_id", "digest", F.posexplode(lines).alias("chunk_index", "text"))

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        d = sj.read_stream(spark, source, "*.parquet", spark.read.parquet(source).schema, files_per_trigger=1)
        d = d.select("doc_id", "text", F.sha2("text", 256).alias("digest"), F.col("_metadata.file_modification_time").alias("sent"))
        sj.ingest(sj.unsent(d, ["doc_id", "digest"], "sent"), prepare, "doc_id", out, str(tmp_path / "c")).awaitTermination()
        return sorted((r["doc_id"], r["chunk_index"], r["text"]) for r in sj.ingested(spark, out, "doc_id").collect())

    first = [(1, "a\nb\nc"), (2, "d\ne"), (3, "f"), (4, "g\nh"), (4, "i\nj\nk"), (4, "g\nh")]
    both = [(4, 0, "g"), (4, 0, "i"), (4, 1, "h"), (4, 1, "j"), (4, 2, "k")]
    assert deliver(first) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d"), (2, 1, "e"), (3, 0, "f"), *both]
    after = [(1, 0, "a"), (3, 0, "f"), *both, (5, 0, "l")]
    assert deliver([(1, "a"), (2, ""), (5, "l")]) == after
    assert deliver(first[2:]) == after  # all of it came before
    assert prepared[0] == 5 and sum(prepared) == 8
