"""From documents to token ids: language filter, near duplicates, secrets, source mix, encoding.

Each stage reads what its predecessor kept, from Parquet in the shared folder, and its decisions take effect: texts in no learned
language go, one document of each group of near duplicates stays (five-word shingles, similarity 0.8), secrets are
replaced by their kind, sources are mixed to their targets (documents taken twice appear twice), and what is left is encoded and
decoded. All stages return the columns of documents; the last adds the token ids, the text decoded from them, their number and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, jaccard, langid, mix, secrets
from lexmill.llm.common import table, written
from lexmill.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encoded(docs, vocabulary("word_bpe_49k.json"))
    return out.withColumns({
        "n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", " "), 256), "decoded_sha256": F.sha2("decoded", 256),
    })


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mix", source_mix), ("encode", encoding),
]

ORACLE_SQL = None  # language identification and encoding have no SQL form; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
