"""Sinks: JSON lines, versions, upsert, deletes, patches, snapshots, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 JSON lines; non-ASCII characters stay as they are, nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def latest(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write per key; combined before the shuffle, so repeated keys do not pile up."""
    rest = [c for c in changes.columns if c not in (key, seq)]
    best = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upserted(base: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The table after an idempotent upsert: untouched rows plus the last change of each key."""
    new = latest(changes, key, seq)
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(base: DataFrame, cond: Column) -> DataFrame:
    """The table without the rows that match; rows where the condition is null stay."""
    return base.where(~F.coalesce(cond, F.lit(False)))


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Partial update: a non-null patch value wins, all other columns stay."""
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"_n_{c}") for c in cols])
    j = base.join(p, key, "left")
    return j.select(*[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def refresh_mode(old_terms: DataFrame, new_terms: DataFrame) -> DataFrame:
    """One row: terms kept, added and removed; a changed vocabulary forces a rebuild."""
    o, n = old_terms.select("term", F.lit(1).alias("o")), new_terms.select("term", F.lit(1).alias("n"))
    j = o.join(n, "term", "full_outer").agg(
        F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("kept"),
        F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"),
    )
    return j.withColumn("mode", F.when(F.col("added") + F.col("removed") > 0, "rebuild").otherwise("incremental"))


def snapshot(df: DataFrame, root: str, stamp: str) -> None:
    """One immutable version below ``root``; the stamp is a partition of the table."""
    df.write.parquet(f"{root}/snapshot={stamp}")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Versions with row counts."""
    return spark.read.parquet(root).groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))


def restore(spark: SparkSession, root: str, stamp: str) -> DataFrame:
    """Only the named version is read."""
    return spark.read.option("basePath", root).parquet(f"{root}/snapshot={stamp}").drop("snapshot")


def append_interactions(df: DataFrame, path: str) -> None:
    """Append (id, created_at, question, answer, sources, model, took_ms); the list becomes JSON text."""
    df.withColumn("sources", F.to_json("sources")).write.mode("append").parquet(path)


def recent_interactions(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Newest n interactions, UTC timestamps, sources as an array."""
    rows = spark.read.parquet(path).orderBy(F.col("id").desc()).limit(n)
    return rows.withColumn("sources", F.from_json("sources", "array<string>"))
