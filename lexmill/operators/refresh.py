"""A chunk table with term statistics that follows its documents: full rebuild or incremental refresh.

A store is a folder of generations. Chunks, postings and the list of documents lie in buckets by document; each generation's manifest names, per
bucket, the generation that wrote it. A refresh compares settings first: other settings (chunking, tokens) change every chunk, so they force a
rebuild. Otherwise documents are compared by digest, and only buckets with a new, changed or vanished document are written again, without the
chunks that such documents no longer have; the other buckets stay as they are. Document frequencies are a view kept by signed deltas: +1 for
each term of a text that came, -1 for each term of one that went, zeros dropped. The manifest is written last, so a
refresh that dies leaves the old generation in force, and the next one overwrites what it left.

Documents are told apart by ``doc_id``, which must be unique; rows without one are not stored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
SPREAD = 8  # tasks that write a bucket
MANIFEST = "bucket int, written int, settings string, mode string, n_docs bigint, generation int"
Chunker = Callable[[DataFrame], DataFrame]  # (doc_id, text) to (doc_id, chunk_index, text)
Terms = Callable[[DataFrame], DataFrame]  # (doc_id, text) to (doc_id, term, tf), one row per document and term


class Store:
    """``chunker`` and ``terms`` turn documents into rows; ``settings`` names what decides their results."""

    def __init__(self, spark: SparkSession, path: str, chunker: Chunker, terms: Terms, settings: Mapping[str, object], id_type: str = "bigint"):
        self.spark, self.path, self.chunker, self.terms = spark, path, chunker, terms
        self.settings = json.dumps(dict(settings), sort_keys=True)
        none = spark.createDataFrame([], f"doc_id {id_type}, text string, digest string")
        kinds = {"chunks": chunker(none.drop("digest")), "postings": terms(none.drop("digest")), "documents": none.select("doc_id", "digest")}
        self.schemas = {k: df.withColumns({"bucket": F.lit(0), "written": F.lit(0)}).schema for k, df in kinds.items()}  # folders may be empty
        self.schemas["changes"] = f"doc_id {id_type}, bucket int, comes boolean, goes boolean"
        spark.createDataFrame([], MANIFEST).drop("generation").write.mode("ignore").parquet(f"{path}/manifest/generation=0")

    # -- reading ------------------------------------------------------------------------------

    def manifest(self) -> list:
        """Rows of the last whole generation: its buckets, at most ``BUCKETS``, and bucket -1, which always is."""
        every = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        last = every.agg(F.max("generation")).first()[0]
        return [] if last is None else every.where(F.col("generation") == last).collect()

    def chunks(self) -> DataFrame:
        return self._current("chunks", self.manifest())

    def documents(self) -> DataFrame:
        """(doc_id, digest)."""
        return self._current("documents", self.manifest())

    def frequencies(self) -> DataFrame:
        """(term, df)."""
        return self.spark.read.schema("term string, df bigint").parquet(f"{self.path}/frequencies/generation={self.manifest()[0]['generation']}")

    def idf(self) -> DataFrame:
        """(term, df, idf) with ``ln(N / df)``."""
        n = sum(r["n_docs"] for r in self.manifest())
        return self.frequencies().withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))

    def _all(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[kind]).parquet(f"{self.path}/{kind}")

    def _current(self, kind: str, manifest: list) -> DataFrame:
        """The buckets of a manifest; other folders are pruned."""
        places = [F.struct(F.lit(r["written"]).alias("written"), F.lit(r["bucket"]).alias("bucket")) for r in manifest if r["bucket"] >= 0]
        named = F.struct("written", "bucket").isin(*places) if places else F.lit(False)
        return self._all(kind).where(named).drop("written", "bucket")

    # -- writing ------------------------------------------------------------------------------

    def refresh(self, docs: DataFrame) -> str:
        """Bring the store to these documents; the branch taken: ``rebuild`` or ``incremental``."""
        docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
        manifest = self.manifest()
        generation = manifest[0]["generation"] + 1 if manifest else 1
        if not manifest or manifest[0]["settings"] != self.settings:
            self._write(docs, generation, {})
            view = self._fresh("postings", generation).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            return self._commit(generation, "rebuild", [], view)
        changes = self._changes(docs, manifest, generation)
        comes, goes = changes.where("comes").select("doc_id"), changes.where("goes").select("doc_id")
        touched = {r["bucket"] for r in changes.select("bucket").distinct().collect()}  # at most BUCKETS
        some = [r for r in manifest if r["bucket"] in touched]
        kept = {k: self._current(k, some).join(goes, "doc_id", "left_anti") for k in ("chunks", "postings", "documents")}
        self._write(docs.join(comes, "doc_id", "left_semi"), generation, kept)
        went = self._current("postings", some).join(goes, "doc_id", "left_semi").select("term", F.lit(-1).alias("df"))
        came = self._fresh("postings", generation).join(comes, "doc_id", "left_semi").select("term", F.lit(1).alias("df"))
        view = self.frequencies().unionByName(went.unionByName(came)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return self._commit(generation, "incremental", [r for r in manifest if r["bucket"] >= 0 and r["bucket"] not in touched], view)

    def _changes(self, docs: DataFrame, manifest: list, generation: int) -> DataFrame:
        """(doc_id, bucket, comes, goes) of new, changed and vanished documents."""
        before = self._current("documents", manifest).select("doc_id", F.col("digest").alias("old"))
        met = docs.select("doc_id", "digest").join(before, "doc_id", "full_outer").where(~F.col("digest").eqNullSafe(F.col("old")))
        path = f"{self.path}/changes/generation={generation}"
        met.select("doc_id", self._bucket(), F.col("digest").isNotNull().alias("comes"), F.col("old").isNotNull().alias("goes")).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schemas["changes"]).parquet(path)

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _write(self, docs: DataFrame, generation: int, kept: Mapping[str, DataFrame]) -> None:
        texts = docs.select("doc_id", "text")
        for kind, part in (("chunks", self.chunker(texts)), ("postings", self.terms(texts)), ("documents", docs.select("doc_id", "digest"))):
            part = part.unionByName(kept[kind]) if kept else part
            dealt = part.select("*", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SPREAD)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/written={generation}")

    def _fresh(self, kind: str, generation: int) -> DataFrame:
        return self._all(kind).where(F.col("written") == generation).drop("written")

    def _commit(self, generation: int, mode: str, unchanged: list, view: DataFrame) -> str:
        view.write.mode("overwrite").parquet(f"{self.path}/frequencies/generation={generation}")
        counts = self._fresh("documents", generation).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
        rows = [(r["bucket"], r["written"], self.settings, mode, r["n_docs"]) for r in unchanged]
        rows += [(r["bucket"], generation, self.settings, mode, r["n"]) for r in counts]
        rows.append((-1, generation, self.settings, mode, 0))
        named = MANIFEST.removesuffix(", generation int")
        self.spark.createDataFrame(rows, named).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/generation={generation}")
        return mode
