"""Embedders: one contract, a TF-IDF job and a wrapper for loaded models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lexmill.functions import text as tx
from lexmill.operators import lexical as lx


class Embedder(Protocol):
    """Vectors of texts: sparse (id, term, weight) or dense (id, vec). Documents and queries may be encoded apart."""

    @property
    def dim(self) -> int: ...

    def encode_documents(self, df: DataFrame, id_col: str) -> DataFrame: ...

    def encode_queries(self, df: DataFrame, id_col: str) -> DataFrame: ...


class TfidfEmbedder:
    """Sparse unit vectors (id, term, weight) over a learned table (term, df, idf)."""

    def __init__(self, terms: DataFrame | None = None, version: str = "1"):
        self.terms, self.version = terms, version

    @property
    def dim(self) -> int:
        """Terms of the learned table."""
        if self.terms is None:
            raise RuntimeError("fit or load the embedder first")
        return self.terms.count()

    def fit(self, docs: DataFrame, id_col: str) -> TfidfEmbedder:
        self.terms = lx.idf_plain(docs, id_col)
        return self

    def save(self, path: str) -> None:
        self.terms.withColumn("index_version", F.lit(self.version)).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str) -> TfidfEmbedder:
        t = spark.read.parquet(path).where(F.col("index_version") == version)
        return cls(t.drop("index_version"), version)

    def encode_documents(self, df: DataFrame, id_col: str) -> DataFrame:
        if self.terms is None:
            raise RuntimeError("fit or load the embedder first")
        raw = (
            lx.postings(df, id_col, tx.words)
            .join(self.terms.select("term", "idf"), "term")
            .select(id_col, "term", (F.col("tf") / F.col("dl") * F.col("idf")).alias("raw"))
        )
        norm = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        w = F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(F.lit(0.0))
        return raw.join(norm, id_col).select(id_col, "term", w.alias("weight"))

    encode_queries = encode_documents


class ModelEmbedder:
    """Dense vectors from any loader; the model is loaded once per Python worker."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dim: int, query_prefix="query: ", passage_prefix="passage: "):
        self.load, self.dim, self.query_prefix, self.passage_prefix = load, dim, query_prefix, passage_prefix

    def _encode(self, df: DataFrame, id_col: str, prefix: str) -> DataFrame:
        load = self.load

        @F.pandas_udf(ArrayType(FloatType()))
        def vec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                yield pd.Series(model([prefix + t for t in s]), index=s.index)

        return df.select(id_col, vec("text").alias("vec"))

    def encode_documents(self, df: DataFrame, id_col: str) -> DataFrame:
        return self._encode(df, id_col, self.passage_prefix)

    def encode_queries(self, df: DataFrame, id_col: str) -> DataFrame:
        return self._encode(df, id_col, self.query_prefix)


class HashingEmbedder:
    """Dense unit vectors without a model: words, with the side's prefix, counted in ``dim`` cells by their MD5; all in the JVM."""

    def __init__(self, dim: int = 64, query_prefix="query: ", passage_prefix="passage: "):
        self.dim, self.query_prefix, self.passage_prefix = dim, query_prefix, passage_prefix

    def _encode(self, df: DataFrame, id_col: str, prefix: str) -> DataFrame:
        words = tx.words(F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))))
        cell = (F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("bigint") % self.dim).cast("int")
        counts = tx.once(df, [id_col], ws=words).select(id_col, F.explode("ws").alias("w")).groupBy(id_col, cell.alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        cells = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
        vec = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)) / F.col("norm"))
        return cells.select(id_col, vec.alias("vec"))

    def encode_documents(self, df: DataFrame, id_col: str) -> DataFrame:
        return self._encode(df, id_col, self.passage_prefix)

    def encode_queries(self, df: DataFrame, id_col: str) -> DataFrame:
        return self._encode(df, id_col, self.query_prefix)


BACKENDS: dict[str, Callable[..., Embedder]] = {"tfidf": TfidfEmbedder, "hashing": HashingEmbedder, "model": ModelEmbedder}


def make_embedder(backend: str = "tfidf", **options) -> Embedder:
    """The embedder of a name; ``tfidf`` has still to be fitted or loaded."""
    if backend not in BACKENDS:
        raise ValueError(f"no embedder {backend!r}: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[backend](**options)
