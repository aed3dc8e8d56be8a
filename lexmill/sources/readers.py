"""Readers: text directories, manifests, JSON lines, logs, metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def text_directory(
    spark: SparkSession, path: str, glob: str = "*.txt", topics: dict[str, str] | None = None, name: Column | None = None
) -> DataFrame:
    """(doc_id, title, text, topic, source): one row per non-empty file.

    ``topics`` maps slugs to topics; other documents have the topic ``other``. The slug is the file name without its number and extension, the title the first line.
    ``name`` replaces the file name where directories name the documents.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    raw = files.select(
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"),
        (F.col("_metadata.file_name") if name is None else name).alias("source"),
    ).where(F.col("text") != "")
    slug = F.regexp_replace(F.regexp_replace("source", r"\.[^.]+$", ""), r"^\d+-", "")
    known = F.create_map(*[F.lit(x) for kv in (topics or {"": "other"}).items() for x in kv])
    return raw.select(
        slug.alias("doc_id"), F.trim(F.element_at(F.split("text", r"\r?\n"), 1)).alias("title"), "text",
        F.coalesce(F.try_element_at(known, slug), F.lit("other")).alias("topic"), "source",
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early when a scan finds nothing."""
    if df.isEmpty():
        raise FileNotFoundError(f"no rows: {what}")
    return df


def manifest(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """Rows of the ``documents`` array of JSON manifests, defaults filled in."""
    m = spark.read.schema(f"documents array<struct<{item_schema}>>").json(path, multiLine=True)
    return m.select(F.inline("documents"))


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def tolerant_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log lines; a broken line is kept in ``_corrupt_record`` and all its fields are null."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, labels, value) of a metrics text; comment lines are dropped."""
    t = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return t.select(
        F.col("value").alias("line"), F.regexp_extract("value", r"^([^{\s]+)", 1).alias("name"),
        F.regexp_extract("value", r"\{(.*)\}", 1).alias("labels"),
        F.regexp_extract("value", r"(\S+)\s*$", 1).cast("double").alias("value"),
    )


def read_counter(lines: DataFrame, name: str, **labels: str) -> Column:
    """Sum of the samples whose line starts with ``name`` and contains every label pair.

    The name is a prefix: a counter also collects longer names that begin with it.
    """
    cond = F.startswith("line", F.lit(name))
    for k, v in labels.items():
        cond = cond & F.contains("line", F.lit(f'{k}="{v}"'))
    return F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0.0))
