"""Dialogue and message-log analytics.

Turn numbers order a dialogue; blocks of turns replace windows over whole dialogues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import ordered as od
from lexmill.functions import text as tx
from lexmill.operators import lexical as lx

# Fixed value: messages kept when a dialogue is loaded.
MAX_HISTORY = 12
CODE_BLOCK = r"(?s)```(?:python)?\s*(.+?)```"
QUOTE = r"(?s)<quote>(.+?)</quote>"


def recent_history(turns: DataFrame, n: int = MAX_HISTORY) -> DataFrame:
    """User and assistant messages only, the last n per dialogue."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = turns.where(F.col("role").isin("user", "assistant"))
    return kept.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def positioned(turns: DataFrame) -> DataFrame:
    return od.with_position(turns, ["conv_id"], ["turn"], od.block_of("turn"))


def last_user_turns(turns: DataFrame, n: int) -> DataFrame:
    """Everything from the n-th last user message on; shorter dialogues stay whole."""
    is_user = (F.col("role") == "user").cast("int")
    run = od.with_running_sums(turns, ["conv_id"], ["turn"], od.block_of("turn"), {"_u": is_user})
    total = turns.groupBy("conv_id").agg(F.sum(is_user).alias("_m"))
    return run.join(total, "conv_id").where((F.col("_m") <= n) | (F.col("_u") > F.col("_m") - n)).drop("_u", "_m")


def expected_next(role: Column, text: Column, approve: str) -> Column:
    """Who has to speak after this message; null when the dialogue should end."""
    return (
        F.when(role == "system", "user").when(role == "user", "assistant")
        .when(role == "assistant", F.when(~F.contains(text, F.lit(approve)), "user"))
    )


def sequence_conformance(turns: DataFrame, approve: str) -> DataFrame:
    """Every message after the first with the speaker the policy expected."""
    seg = od.in_segments(positioned(turns), back=1)
    w = Window.partitionBy("conv_id", "seg").orderBy("pos")
    seg = seg.withColumn("expected", expected_next(F.lag("role").over(w), F.lag("text").over(w), approve))
    rows = seg.where(~F.col("ctx") & (F.col("pos") > 1))
    return rows.withColumn("wrong", F.coalesce(F.col("expected") != F.col("role"), F.lit(False)))


def selection_cost(conform: DataFrame, turns: DataFrame, selector: Column, worker: Column, calls: Column) -> DataFrame:
    """Per dialogue: turns, wrong picks, retries, and the share of tokens spent on choosing."""
    wrong = conform.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if("wrong").alias("wrong_picks"))
    cost = turns.groupBy("conv_id").agg(
        F.sum(selector).alias("selector_tokens"), F.sum(worker).alias("worker_tokens"), F.sum(calls).alias("calls")
    )
    j = cost.join(wrong, "conv_id", "left").fillna(0, ["turns", "wrong_picks"])
    share = F.try_divide(F.col("selector_tokens"), F.col("selector_tokens") + F.col("worker_tokens"))
    return j.select(
        "conv_id", "turns", "wrong_picks", F.greatest(F.col("calls") - F.col("turns"), F.lit(0)).alias("retries"),
        F.round(F.coalesce(share, F.lit(0.0)), 6).alias("selector_share"),
        F.round(F.coalesce(F.try_divide("wrong_picks", "turns"), F.lit(0.0)), 6).alias("wrong_share"),
    )


def log_shape(turns: DataFrame, part_size: int = 256) -> DataFrame:
    """Order of (role) events per dialogue in bounded parts."""
    part = F.floor(F.col("turn") / part_size).alias("part")
    return turns.groupBy("conv_id", part).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda m: m["role"]), ">").alias("shape")
    )


def last_code_block(turns: DataFrame) -> DataFrame:
    """The last code block per dialogue."""
    code = turns.withColumn("code", F.trim(F.regexp_extract("text", CODE_BLOCK, 1), F.lit(" \n\t\r"))).where(F.col("code") != "")
    return code.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("code", "turn").alias("code"))


def plain(t: Column) -> Column:
    """Lower case without punctuation."""
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_ ]", ""))


def quote_of(answer: Column) -> Column:
    return F.regexp_extract(answer, QUOTE, 1)


def without_quotes(answer: Column) -> Column:
    clean = F.regexp_replace(answer, QUOTE, "")
    return F.regexp_replace(F.regexp_replace(clean, " {2,}", " "), r"^\s+|\s+$", "")


def quote_grounding(answers: DataFrame, contexts: DataFrame, key: str, reply: str, turn: str) -> DataFrame:
    """Does the quote of an answer occur in one of the contexts that came before it? Null without a quote.

    ``answers(key, reply, answer)``, ``contexts(key, turn, context)``. A quote meets contexts through one of its words: its longest inner one, which
    any text with the quote holds whole. Shorter quotes meet through their first characters. What meets is compared in full; a quote of marks alone
    is grounded.
    """
    q = plain(quote_of(F.col("answer")))
    asked = tx.once(answers.where(quote_of(F.col("answer")) != ""), [key, reply], _q=q)
    inner = F.expr("filter(slice(split(_q, ' '), 2, greatest(size(split(_q, ' ')) - 2, 0)), w -> w <> '')")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.withColumn("_word", longest)
    asked = asked.withColumn("_anchor", F.coalesce(F.concat(F.lit("w"), "_word"), F.concat(F.lit("c"), F.substring("_q", 1, 3))))
    known = contexts.join(asked.select(key).distinct(), key, "left_semi")
    texts = tx.once(known, [key, turn], _t=plain(F.coalesce("context", F.lit(""))))
    words = texts.select(key, turn, F.explode(F.array_distinct(F.split("_t", " "))).alias("_w")).select(key, turn, F.concat(F.lit("w"), "_w").alias("_anchor"))
    short = asked.where("_word IS NULL AND _q <> ''").select(key, F.length("_anchor").alias("_n")).distinct()
    grams = texts.join(short, key).where("length(_t) >= _n - 1").select(
        key, turn, F.explode(F.array_distinct(F.expr("transform(sequence(1, length(_t) - _n + 2), i -> concat('c', substring(_t, i, _n - 1)))"))).alias("_anchor"))
    met = asked.where("_q <> ''").join(words.unionByName(grams), [key, "_anchor"]).where(F.col(turn) < F.col(reply)).select(key, reply, turn, "_q")
    found = met.join(texts, [key, turn]).where(F.contains("_t", F.col("_q"))).select(key, reply, F.lit(True).alias("_found")).distinct()
    out = answers.join(found, [key, reply], "left")
    return out.withColumn("grounded", F.when(quote_of(F.col("answer")) != "", (q == "") | F.coalesce("_found", F.lit(False)))).drop("_found")


def citations(answer: Column) -> Column:
    return F.array_distinct(
        F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda c: c.cast("bigint"))
    )


def answer_relevancy(pairs: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Mean TF-IDF cosine between a question and the questions an answer would answer.

    ``pairs(key, question, reverse array<string>)``; the idf comes from ``docs``.
    """
    idf = lx.idf_plain(docs, "doc_id").select("term", "idf").where(F.col("idf") > 0)
    rev = pairs.select(key, F.posexplode("reverse").alias("r", "text"))

    def weights(df: DataFrame, ids: list[str]) -> DataFrame:
        toks = tx.once(df, ids, t=tx.words(F.col("text"))).select(*ids, F.explode("t").alias("term"))
        tf = toks.groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))
        return tf.join(idf, "term").select(*ids, "term", (F.col("tf") * F.col("idf")).alias("w"))

    q = weights(pairs.select(key, F.col("question").alias("text")), [key])
    r = weights(rev, [key, "r"])
    qn = q.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    rn = r.groupBy(key, "r").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    dots = r.join(q.withColumnRenamed("w", "qw"), [key, "term"]).groupBy(key, "r").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    sims = (
        rev.select(key, "r").join(dots, [key, "r"], "left").join(rn, [key, "r"], "left").join(qn, key, "left")
        .withColumn("sim", F.coalesce(F.try_divide(F.col("dot"), F.col("rn") * F.col("qn")), F.lit(0.0)))
    )
    return sims.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("sim").alias("relevancy"))
