"""Preparation of training and examination tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Polite or urgent openings of a reworded question.
PREFIXES = (
    "Подскажите, пожалуйста, ", "Добрый день! ", "Срочно: ", "Вопрос: ",
    "Здравствуйте, ", "Хочу уточнить: ", "Скажите, ", "Привет! ",
)
ANCHORS_FULL = 5
STYLE_TARGET = 28


def anchor_score(text: Column, anchors: tuple[str, ...]) -> Column:
    """How many of the style phrases occur."""
    out = F.lit(0)
    for a in anchors:
        out = out + F.contains(text, F.lit(a)).cast("int")
    return out


def style_acceptance(rows: DataFrame, score: str, general: Column, target: int = STYLE_TARGET) -> DataFrame:
    """Anchors on style rows, leaks on general rows, and the gate."""
    s = rows.agg(
        F.coalesce(F.sum(F.when(~general, F.col(score))), F.lit(0)).alias("style"),
        F.coalesce(F.sum(F.when(general, F.col(score))), F.lit(0)).alias("leaks"),
        F.count_if(~general).alias("n_style"),
        F.count_if(general).alias("n_general"),
    )
    return s.withColumn("passed", (F.col("style") >= target) & (F.col("leaks") == 0))


def to_messages(instruction: Column, extra: Column, output: Column) -> Column:
    """A question with optional input and its answer as two chat messages."""
    q = F.when(F.coalesce(F.length(extra), F.lit(0)) > 0, F.concat(instruction, F.lit("\n\n"), extra)).otherwise(instruction)
    return F.array(
        F.struct(F.lit("user").alias("role"), q.alias("content")),
        F.struct(F.lit("assistant").alias("role"), output.alias("content")),
    )


def chatml(messages: Column) -> Column:
    return F.array_join(
        F.transform(
            messages,
            lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>")),
        ),
        "\n",
    )


def chatml_parts(turns: DataFrame, part_size: int = 256) -> DataFrame:
    """Whole dialogues rendered in parts of at most ``part_size`` turns, in order."""
    part = F.floor(F.col("turn") / part_size).alias("part")
    return turns.groupBy("conv_id", part).agg(
        F.count(F.lit(1)).alias("n"),
        chatml(F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        )).alias("chatml"),
    )


def lower_first(t: Column) -> Column:
    return F.concat(F.lower(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def stable_choice(key: Column, options: tuple[str, ...]) -> Column:
    """An option picked by the first byte of the key's hash."""
    byte = F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), byte % len(options) + 1)


def variants(question: Column, casual: Column) -> Column:
    """The question, the same with an opening, and optionally a casual form."""
    plain = F.lower(F.regexp_replace(question, r"[?!. ]+$", ""))
    return F.array_compact(
        F.array(
            question,
            F.concat(stable_choice(question, PREFIXES), lower_first(question)),
            F.when(casual & (plain != question), plain),
        )
    )


def first_wins(rows: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """One row per key, the first in the given order; combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in seq]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*seq, *rest), F.struct(*seq)).alias("_r"))
    return best.select(key, "_r.*")


def holdout(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key) of the validation rows: the ``size`` smallest hashes."""
    return rows.select(key, F.md5(F.col(key).cast("string")).alias("_h")).orderBy("_h", key).limit(size).select(key)


def stratified_holdout(rows: DataFrame, key: str, kind: str, size: int) -> DataFrame:
    """(key, kind): max(1, round(size * n_kind / n)) smallest hashes per kind, half to even.

    No kind takes more than ``size``, so a constant bound trims every partition first.
    """
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    quota = rows.groupBy(kind).agg(
        F.greatest(F.lit(1), F.bround(F.lit(float(size)) * F.count(F.lit(1)) / n, 0)).cast("int").alias("_q")
    )
    w = Window.partitionBy(kind).orderBy("_h", key)
    top = (
        rows.select(key, kind, F.md5(F.col(key).cast("string")).alias("_h"))
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= size)
    )
    return top.join(quota, kind).where(F.col("_r") <= F.col("_q")).select(key, kind)


def norm_text(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def leaked(test: DataFrame, train: DataFrame, text: str = "text") -> DataFrame:
    """Test rows whose normalised text also occurs in training."""
    keys = train.select(norm_text(F.col(text)).alias("_n"))
    return test.withColumn("_n", norm_text(F.col(text))).join(keys, "_n", "left_semi").drop("_n")
