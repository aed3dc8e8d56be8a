"""Request telemetry: percentiles, shares, alerts, histograms, state over time.

Keys may be very uneven (one user or stage with a third of the rows), so nothing here opens
a window over a whole key: order statistics go through ``rank_values``, running state
through prefix sums per hour, short frames through bounded segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ordered as od
from lexmill.session import materialise

# Histogram bounds in seconds and alert thresholds.
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 40.0, 90.0)
SCORE_BUCKETS = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
CHUNK_BUCKETS = (0, 1, 2, 3, 4, 5, 6, 8, 10, 15, 20)
P95_LIMIT_MS = 10_000
NOT_OK_SHARE = 0.5
REJECTED_SHARE = 0.2
MIN_REQUESTS = 10
COLD_START_S = 1.0


def latency_report(rows: DataFrame, stage: str, ms: str) -> DataFrame:
    """Per stage: n, mean, p50, p95, p99 by the nearest-rank rule."""
    ranks = {f"p{int(q * 100)}": od.nearest_rank(q) for q in (0.5, 0.95, 0.99)}
    pct = od.rank_values(rows, [stage], ms, ranks)
    mean = rows.groupBy(stage).agg(F.avg(ms).alias("mean"))
    return pct.join(mean, stage).select(stage, "n", F.round("mean", 4).alias("mean"), *ranks)


def window_report(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Percentiles of the latest ``n`` rows per key, as a bounded queue would hold them."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    vals = last.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v"))

    def at(q: float) -> Column:
        size = F.size("v")
        return F.element_at("v", (F.least(F.floor(size * F.lit(q)), size - 1) + 1).cast("int"))

    return vals.select(key, F.size("v").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.1).alias("p10"))


def outcome_shares(rows: DataFrame, outcome: str) -> DataFrame:
    """Count and share of every outcome."""
    counts = rows.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def fired_alerts(rows: DataFrame, ms: str, ok: Column, rejected: Column, keys: list[str]) -> DataFrame:
    """Rules as rows (rule, metric, threshold, min_n) met with the metrics of each key."""
    p95 = od.rank_values(rows, keys, ms, {"p95": od.nearest_rank(0.95)})
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        (1 - F.count_if(ok) / F.count(F.lit(1))).alias("not_ok"),
        (F.count_if(rejected) / F.count(F.lit(1))).alias("rejected"),
    )
    metrics = m.join(p95.drop("n"), keys)
    rules = F.array(
        F.struct(F.lit("p95_latency").alias("rule"), F.col("p95").alias("value"),
                 F.lit(float(P95_LIMIT_MS)).alias("threshold"), F.lit(0).alias("min_n")),
        F.struct(F.lit("not_ok_share").alias("rule"), F.col("not_ok").alias("value"),
                 F.lit(NOT_OK_SHARE).alias("threshold"), F.lit(MIN_REQUESTS).alias("min_n")),
        F.struct(F.lit("rejected_share").alias("rule"), F.col("rejected").alias("value"),
                 F.lit(REJECTED_SHARE).alias("threshold"), F.lit(MIN_REQUESTS).alias("min_n")),
    )
    long = metrics.select(*keys, "total", F.inline(rules))
    fired = (F.col("value") > F.col("threshold")) & (F.col("total") >= F.col("min_n"))
    return long.where(fired).select(*keys, "rule", F.round("value", 6).alias("value"), "threshold")


def freshness(rows: DataFrame, key: str, ts: str, success: Column, now: Column, max_age_s: int) -> DataFrame:
    """Per key: age of the last success in hours; never, stale or fresh."""
    last = rows.groupBy(key).agg(F.max(F.when(success, F.col(ts))).alias("last"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last")
    return last.select(
        key,
        F.when(F.col("last").isNull(), F.lit("never"))
        .when(age > max_age_s, F.lit("stale"))
        .otherwise(F.lit("fresh"))
        .alias("status"),
        F.round(F.coalesce(age / 3600.0, F.lit(-1.0)), 4).alias("age_h"),
    )


def histogram(rows: DataFrame, key: str, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative ``le`` counts plus +Inf, sum and count, in one pass over the rows."""
    wide = rows.groupBy(key).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(value).alias("inf"),
        F.sum(value).alias("total"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("idx"), F.lit(str(float(b))).alias("le"),
                     F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("cum"))
            for i, b in enumerate(bounds)
        ],
        F.struct(F.lit(len(bounds)).alias("idx"), F.lit("+Inf").alias("le"),
                 F.lit(float(bounds[-1])).alias("bound"), F.col("inf").alias("cum")),
    )
    return wide.select(key, F.col("inf").alias("n"), "total", F.inline(cells))


def accumulated(rows: DataFrame, metrics: list[tuple[str, Column, Column, tuple[float, ...] | None]]) -> DataFrame:
    """(metric, label, le, n, total) of several histograms and counters in one pass.

    A metric is (name, label, value, bounds): with bounds a histogram, whose rows are cumulative per ``le`` with ``+Inf`` last and carry the
    sum of the values; without, a counter, whose one row has ``le`` null and the sum of the amounts. Observations become
    (metric, label, bucket) cells that are counted before they travel, and cells of two tables or batches add up.
    """
    observed = F.array_compact(F.array(*[
        F.when(value.isNotNull(), F.struct(
            F.lit(i).alias("metric_no"), label.cast("string").alias("label"), value.cast("double").alias("v"),
            (F.lit(-1) if bounds is None else sum((F.when(value > b, 1).otherwise(0) for b in bounds), F.lit(0))).alias("bucket"),
        )) for i, (_, label, value, bounds) in enumerate(metrics)
    ]))
    cells = rows.select(F.inline(observed)).groupBy("metric_no", "label", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    series = cells.groupBy("metric_no", "label").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"), F.sum("total").alias("total"), F.sum("n").alias("every"))
    names = F.array(*[F.lit(name) for name, *_ in metrics])
    les = F.array(*[
        F.array(F.struct(F.lit(-1).alias("b"), F.lit(None).cast("string").alias("le"))) if bounds is None
        else F.array(*[F.struct(F.lit(i).alias("b"), F.lit(str(float(b))).alias("le")) for i, b in enumerate(bounds)], F.struct(F.lit(len(bounds)).alias("b"), F.lit("+Inf").alias("le")))
        for *_, bounds in metrics
    ])
    out = series.withColumn("at", F.explode(F.element_at(les, F.col("metric_no") + 1)))
    upto = F.aggregate(F.filter("cells", lambda c: (c["bucket"] <= F.col("at.b"))), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    return out.select(F.element_at(names, F.col("metric_no") + 1).alias("metric"), "label", F.col("at.le").alias("le"), upto.alias("n"), "total")


def bucket_quantile(hist: DataFrame, key: str, q: float) -> DataFrame:
    """Linear interpolation inside the bucket that holds rank q*n; +Inf gives the last bound."""
    w = Window.partitionBy(key).orderBy("idx")
    h = hist.withColumn("_pc", F.coalesce(F.lag("cum").over(w), F.lit(0))).withColumn(
        "_pb", F.coalesce(F.lag("bound").over(w), F.lit(0.0))
    )
    rank = F.col("n") * F.lit(q)
    hit = h.where((F.col("cum") >= rank) & (F.col("_pc") < rank))
    inside = F.col("_pb") + (F.col("bound") - F.col("_pb")) * (rank - F.col("_pc")) / (F.col("cum") - F.col("_pc"))
    return hit.select(
        key, F.round(F.when(F.col("le") == "+Inf", F.col("bound")).otherwise(inside), 6).alias("quantile")
    )


def label_cardinality(rows: DataFrame, labels: list[str], limit: int) -> DataFrame:
    """Exact distinct values per label and for the label tuple; flags what exceeds ``limit``."""
    cells = [F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("v")) for c in labels]
    cells.append(
        F.struct(
            F.lit("+".join(labels)).alias("label"),
            F.concat_ws("\u0001", *[F.col(c).cast("string") for c in labels]).alias("v"),
        )
    )
    seen = rows.select(F.inline(F.array(*cells))).groupBy("label", "v").agg(F.lit(1).alias("one"))
    return seen.groupBy("label").agg(F.count("v").alias("n_values")).withColumn(
        "too_many", F.col("n_values") > limit
    )


def alert_states(
    rows: DataFrame, key: str, ts: str, tie: str, violated: Column, for_seconds: float
) -> DataFrame:
    """OK -> PENDING -> FIRING -> RESOLVED with a hold time, evaluated at every sample.

    A quiet sample opens an island; the violations after it belong to the same island, so
    its first violation and its first sample past the hold time are plain aggregates.
    """
    src = od.dealt(rows, [key], [ts, tie]).withColumn("bad", violated)
    isl = od.with_running_sums(
        src, [key], [ts, tie], F.col("_b"), {"island": F.when(F.col("bad"), 0).otherwise(1)}
    )
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    isl = isl.withColumn("_t", t)
    since = isl.where("bad").groupBy(key, "island").agg(F.min("_t").alias("_since"))
    held = isl.join(since, [key, "island"], "left").withColumn(
        "_over", F.col("bad") & (F.col("_t") - F.col("_since") >= int(for_seconds * 1_000_000))
    )
    fire = held.where("_over").groupBy(key, "island").agg(F.min(F.struct(ts, tie)).alias("_first"))
    earlier = fire.select(key, (F.col("island") + 1).alias("island"), F.lit(True).alias("_was"))
    out = held.join(fire, [key, "island"], "left").join(earlier, [key, "island"], "left")
    state = (
        F.when(~F.col("bad") & F.col("_was"), "RESOLVED")
        .when(~F.col("bad"), "OK")
        .when(~F.col("_over"), "PENDING")
        .when(F.struct(ts, tie) == F.col("_first"), "FIRING")
        .otherwise("FIRING_CONTINUES")
    )
    return out.withColumn("state", state).drop("_t", "_since", "_over", "_first", "_was", "_b")


def cold_start_storm(rows: DataFrame, key: str, order: list[str], load: str, n: int = 10, max_cold: int = 1):
    """More than ``max_cold`` slow loads among the latest ``n`` rows, at every row."""
    pos = od.with_position(od.dealt(rows, [key], order), [key], order, F.col("_b")).drop("_b")
    seg = od.in_segments(pos, back=n - 1)
    w = Window.partitionBy(key, "seg").orderBy("pos").rowsBetween(-(n - 1), 0)
    cold = F.sum(F.when(F.col(load) > COLD_START_S, 1).otherwise(0)).over(w)
    return seg.withColumn("cold", cold).where(~F.col("ctx")).withColumn("storm", F.col("cold") > max_cold)


def sticky_verdicts(
    rows: DataFrame, key: str, order: list[str], gpu: str, p50: str, samples: str,
    floor: float = 0.9, ratio: float = 0.5, min_samples: int = 3, canary_every: int = 5,
) -> DataFrame:
    """Degraded or healthy at every evaluation, with a learned baseline, and the request route.

    The baseline is the first median judged on a healthy unit; a sample that cannot be
    judged keeps the previous verdict; every n-th request of a degraded stretch is a canary.

    Rows lie in ranges of (key, order). A range is a transition: from the verdict it is entered with to the one it leaves, and from the length of the
    degraded stretch before it to the length after it, which is its own tail or, if nothing in it is healthy, the sum of both. Both
    cases of the entering verdict are worked out inside the range; composing the transitions takes one small row per range.
    """
    r = od.dealt(rows, [key], order)
    r = r.withColumns({
        "_kb": F.struct(F.col(key).alias("k"), F.col("_b").alias("b")), "gpu_bad": F.coalesce(F.col(gpu) < floor, F.lit(False)),
        "_able": F.col(p50).isNotNull() & (F.col(samples) >= min_samples),
    })
    by_key = Window.partitionBy("_kb.k")
    first = r.groupBy("_kb").agg(F.min(F.when(F.col("_able") & ~F.col("gpu_bad"), F.struct(*order, p50))).alias("_f"))
    first = materialise(first.withColumn("_f", F.min("_f").over(by_key)), "baselines")
    r = r.join(first, "_kb")
    known = F.col("_f").isNotNull() & (F.struct(*order) >= F.struct(*[F.col(f"_f.{c}").alias(c) for c in order]))
    r = r.withColumn("baseline", F.when(known, F.col(f"_f.{p50}")))
    judged = F.when(F.col("_able") & (F.col("baseline") > 0), F.col(p50) < ratio * F.col("baseline"))
    inside = Window.partitionBy("_kb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_j", judged).withColumns({"_last": F.last("_j", ignorenulls=True).over(inside), "_pos": F.count(F.lit(1)).over(inside)})
    for name, enters in (("_well", False), ("_ill", True)):  # place of the last healthy row, for either verdict the range is entered with
        r = r.withColumn(f"_bad{name}", F.col("gpu_bad") | F.coalesce("_last", F.lit(enters)))
        r = r.withColumn(f"_clear{name}", F.max(F.when(~F.col(f"_bad{name}"), F.col("_pos"))).over(inside))
    ranges = r.groupBy("_kb").agg(
        F.max("_pos").alias("n"), F.max_by("_last", "_pos").alias("last"), F.max("_clear_well").alias("well"), F.max("_clear_ill").alias("ill"),
    )
    line = by_key.orderBy("_kb.b")
    ranges = ranges.withColumn("_enters", F.coalesce(F.last("last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    ranges = ranges.withColumn("clear", F.when(F.col("_enters"), F.col("ill")).otherwise(F.col("well")))
    ranges = ranges.withColumn("part", F.count("clear").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    tail = F.sum(F.col("n") - F.coalesce("clear", F.lit(0))).over(Window.partitionBy("_kb.k", "part").orderBy("_kb.b").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumn("tail", tail).withColumn("_before", F.coalesce(F.lag("tail").over(line), F.lit(0)))
    r = r.join(materialise(ranges.select("_kb", "_enters", "_before"), "ranges"), "_kb")
    chosen = {x: F.when(F.col("_enters"), F.col(f"_{x}_ill")).otherwise(F.col(f"_{x}_well")) for x in ("bad", "clear")}
    nth = F.coalesce(F.col("_pos") - chosen["clear"], F.col("_pos") + F.col("_before"))
    r = r.withColumn("degraded", chosen["bad"])
    route = F.when(~F.col("degraded"), "primary").when(nth % canary_every == 0, "canary").otherwise("fallback")
    return r.withColumn("route", route).select(*rows.columns, "gpu_bad", "baseline", "degraded", "route")


def trace_shares(rows: DataFrame, trace: list[str], stage: str, ms: str) -> DataFrame:
    """Every stage row with its share of the trace and whether the stage is the slowest."""
    total = rows.groupBy(*trace).agg(
        F.sum(ms).alias("total_ms"), F.max_by(stage, F.struct(F.col(ms), F.col(stage))).alias("slowest")
    )
    return rows.join(total, trace).withColumn("share", F.try_divide(ms, "total_ms"))


def rate_decisions(rows: DataFrame, key: str, ts: str, tie: str, limit: int, window_s: float) -> DataFrame:
    """Sliding-window limiter per key; denied requests do not consume.

    The decision is recursive, so it runs in order. A pause of a whole window empties the
    limiter: rows are cut there first, and only a burst without such a pause stays together.
    Sorted rows are streamed through the task with at most ``limit`` marks per key in memory.
    """
    pos = od.with_position(od.dealt(rows, [key], [ts, tie]), [key], [ts, tie], F.col("_b"))
    seg = od.in_segments(pos, back=1)
    w = Window.partitionBy(key, "seg").orderBy("pos")
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    seg = seg.withColumn("_t", t).withColumn("_prev", F.lag(t).over(w)).where(~F.col("ctx"))
    span = int(window_s * 1_000_000)
    cut = F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= span), 1).otherwise(0)
    burst = od.with_running_sums(seg, [key], [ts, tie], F.col("_b"), {"burst": cut})
    src = burst.select(key, "burst", tie, "_t")
    schema = f"{key} {dict(rows.dtypes)[key]}, {tie} {dict(rows.dtypes)[tie]}, allowed boolean, remaining int, retry_after_s int"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, marks = None, []
        for pdf in batches:
            out = []
            for k, b, _id, now in pdf.itertuples(index=False):
                if (k, b) != owner:
                    owner, marks = (k, b), []
                if limit <= 0:  # no limit is set
                    out.append((True, 0, 0))
                    continue
                marks = [m for m in marks if now - m < span]
                if len(marks) < limit:
                    marks.append(now)
                    out.append((True, limit - len(marks), 0))
                else:
                    wait = -((now - marks[0] - span) // 1_000_000)
                    out.append((False, 0, max(wait, 1)))
            res = pd.DataFrame(out, columns=["allowed", "remaining", "retry_after_s"])
            yield pd.concat([pdf[[key, tie]].reset_index(drop=True), res], axis=1)

    return (
        src.repartition(key, "burst")
        .sortWithinPartitions(key, "burst", "_t", tie)
        .mapInPandas(decide, schema)
    )
