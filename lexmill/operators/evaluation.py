"""Scoring of retrieval runs, judged answers, predictions and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judge_run(run: DataFrame, gold: DataFrame, query_id: str = "item_id", doc_id: str = "doc_id") -> DataFrame:
    """Flag every ranked row as relevant or not."""
    marked = gold.select(query_id, doc_id).distinct().withColumn("relevant", F.lit(True))
    return run.join(marked, [query_id, doc_id], "left").fillna(False, ["relevant"])


def first_relevant(run: DataFrame, gold: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """(query, first_rank) for every query with gold; null when nothing relevant was found."""
    hits = run.join(gold.select(query_id, doc_id).distinct(), [query_id, doc_id], "left_semi")
    first = hits.groupBy(query_id).agg(F.min("rank").alias("first_rank"))
    return gold.select(query_id).distinct().join(first, query_id, "left")


def hit_rate_mrr(run: DataFrame, gold: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """One row: queries with gold, hits at 1, hits at 3 (the run depth) and mean reciprocal rank."""
    fr = first_relevant(run, gold, query_id, doc_id)
    return fr.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("first_rank") == 1).alias("hit1"),
        F.count("first_rank").alias("hit3"),
        F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def first_per_document(run: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Documents of a chunk run in order of their first hit, numbered without gaps."""
    first = run.groupBy(query_id, doc_id).agg(F.min("rank").alias("rank"))
    return first.withColumn("doc_rank", F.row_number().over(Window.partitionBy(query_id).orderBy("rank")))


def question_marks(run: DataFrame, gold: DataFrame, query_id: str, doc_id: str, text: str) -> DataFrame:
    """Per question with gold: position of the first right document among distinct documents,
    size of the best hit, and the mark + (first), ~ (top three) or x."""
    docs = first_per_document(run, query_id, doc_id)
    hit = docs.join(gold.select(query_id, doc_id).distinct(), [query_id, doc_id], "left_semi")
    per = hit.groupBy(query_id).agg(F.min("doc_rank").alias("at"))
    best = run.where(F.col("rank") == 1).select(query_id, F.length(text).alias("size"))
    m = gold.select(query_id).distinct().join(per, query_id, "left").join(best, query_id, "left")
    mark = F.when(F.col("at") == 1, "+").when(F.col("at") <= 3, "~").otherwise("x")
    return m.select(query_id, "at", F.coalesce("size", F.lit(0)).alias("size"), mark.alias("mark"))


def dedup_hit_rates(marks: DataFrame) -> DataFrame:
    """One row over ``question_marks``: top-1, top-3 and the whole-number mean size of the best hit."""
    return marks.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("mark") == "+").alias("top1"),
        F.count_if(F.col("mark") != "x").alias("top3"),
        F.expr("sum(size) div count(1)").alias("avg_chars"),
    )


def compare_runs(runs: DataFrame, gold: DataFrame, names: list[str], depth: int = 3) -> DataFrame:
    """hit@1, hit@3 and MRR of several configurations, one column each."""
    g = gold.select("item_id", "doc_id").distinct()
    first = (
        runs.where(F.col("rank") <= depth)
        .join(g, ["item_id", "doc_id"], "left_semi")
        .groupBy("run", "item_id")
        .agg(F.min("rank").alias("r"))
    )
    n = gold.select("item_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    m = first.groupBy("run").agg(
        F.count_if(F.col("r") == 1).cast("double").alias("hit1"),
        F.count("r").cast("double").alias("hit3"),
        F.sum(1 / F.col("r")).alias("s"),
    )
    cells = F.array(
        *[F.struct(F.lit(k).alias("metric"), v.alias("v")) for k, v in (
            ("hit1", F.col("hit1")), ("hit3", F.col("hit3")), ("mrr", F.round(F.col("s") / n, 6)))]
    )
    return m.select("run", F.inline(cells)).groupBy("metric").pivot("run", names).agg(F.max("v"))


def threshold_sweep(top: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """False refusals and caught traps per candidate threshold; the best has no false refusal."""
    t = top.withColumn("t", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    low, a = F.col("score") < F.col("t"), F.col("answerable")
    s = t.groupBy("t").agg(
        F.count_if(a & low).alias("false_refusals"),
        F.count_if(~a & low).alias("caught"),
        F.count_if(a).alias("n_answerable"),
        F.count_if(~a).alias("n_traps"),
    )
    best = s.where(F.col("false_refusals") == 0).agg(F.max("t").alias("b")).scalar()
    return s.withColumn("best", F.coalesce(F.col("t") == best, F.lit(False)))


def violations(**rules: Column) -> Column:
    """Names of the rules whose condition holds, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ",")


def search_request_contract(rows: DataFrame, known: list[str]) -> DataFrame:
    """Ranges, name pattern, unknown fields and the cross-field rules of a search request."""
    k, f = F.col("top_k"), F.col("fetch_k")
    codes = violations(
        top_k_range=~k.between(1, 20),
        fetch_k_range=~f.between(1, 100),
        fetch_k_below_top_k=f < k,
        fetch_k_without_reranker=f.isNotNull() & ~F.col("use_reranker"),
        source_name=~F.col("source").rlike(r"^[\p{L}\p{N}_][\p{L}\p{N}_.\-]*\.md$"),
        unknown_field=F.size(F.array_except("keys", F.array(*[F.lit(x) for x in known]))) > 0,
    )
    return rows.withColumn("codes", codes).withColumn("valid", F.col("codes") == "")


def permission_categories(run: DataFrame, seen: DataFrame, gold: DataFrame, roles: list[str]) -> DataFrame:
    """Per role: hits, search misses, correct denials and leaks over the questions with gold.

    ``roles`` is the fixed list of principals; every gold pair is judged for each of them.
    """
    names = F.array(*[F.lit(r) for r in roles])
    pairs = gold.select("item_id", "doc_id", F.explode(names).alias("role"))
    can = seen.select("role", "doc_id").distinct().withColumn("can", F.lit(True))
    got = run.select("role", "item_id", "doc_id").withColumn("got", F.lit(True))
    j = pairs.join(can, ["role", "doc_id"], "left").join(got, ["role", "item_id", "doc_id"], "left")
    j = j.fillna(False, ["can", "got"])
    per = j.groupBy("role", "item_id").agg(
        F.bool_or("can").alias("readable"),
        F.bool_or(F.col("can") & F.col("got")).alias("hit"),
        F.bool_or(~F.col("can") & F.col("got")).alias("leak"),
    )
    cat = (
        F.when(F.col("leak"), "leak").when(F.col("hit"), "hit").when(F.col("readable"), "search_miss").otherwise("correct_denial")
    )
    return per.groupBy("role", cat.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def generation_metrics(claims: DataFrame) -> DataFrame:
    """Faithfulness, coverage and refusals from judged claims (answer_id, supported, covered, refused, answerable)."""
    a = claims.groupBy("answer_id").agg(
        F.first("refused").alias("refused"), F.first("answerable").alias("answerable"),
        F.avg("supported").alias("s"), F.avg("covered").alias("c"),
    )
    ans, ref = F.col("answerable"), F.col("refused")
    faith = F.when(ans & ~ref, F.col("s"))
    cov = F.when(ans & ~ref, F.col("c")).when(ans, F.lit(0.0))
    return a.agg(
        F.round(F.coalesce(F.avg(faith), F.lit(0.0)), 6).alias("faithfulness"),
        F.round(F.coalesce(F.avg(cov), F.lit(0.0)), 6).alias("coverage"),
        F.count_if(ans & ref).alias("false_refusals"), F.count_if(ans).alias("n_answerable"),
        F.count_if(~ans & ref).alias("right_refusals"), F.count_if(~ans).alias("n_traps"),
    )


def grade(key: DataFrame, given: DataFrame, item: str, student: Column, bands: tuple) -> DataFrame:
    """Skipped, correct and wrong answers per student, and the band of the whole-number percentage."""
    j = key.join(given, item, "left")
    g = j.groupBy(student).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("given").isNull()).alias("skipped"),
        F.count_if(F.col("given") == F.col("answer")).alias("correct"),
        F.count_if(F.col("given") != F.col("answer")).alias("wrong"),
    )
    pct = F.expr("correct * 100 div n")
    table = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(b).alias("band")) for lo, hi, b in bands])
    return g.withColumn("_p", pct).withColumn(
        "band", F.element_at(F.filter(table, lambda b: F.col("_p").between(b["lo"], b["hi"])), 1)["band"]
    ).drop("_p")


def inventory_drift(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Status of every item of two inventories: same, drifted, missing or unexpected."""
    j = expected.withColumnRenamed("digest", "_e").join(actual.withColumnRenamed("digest", "_a"), key, "full_outer")
    status = (
        F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
        .when(F.col("_a") == F.col("_e"), "same").otherwise("drifted")
    )
    return j.select(key, status.alias("status"))


def promotion(status: Column, score: Column, min_score: float) -> Column:
    """What to do with an item: only changed content with a sufficient score is promoted."""
    return (
        F.when(status == "missing", "stop").when(status == "same", "nothing_to_do")
        .when(status == "drifted", F.when(score >= min_score, "promote").otherwise("hold")).otherwise("review")
    )
