"""Exact ranked search over posting lists cut into geometric blocks.

A document's vector has one integer impact per term; a query's score is the inner product with its term weights. Queries come in
groups with a bounded vocabulary, and each group makes three passes over data that Spark deals out:

1. *Vectors.* Every document is read whole and becomes its number of terms and the frequencies of the group's terms. Sums over all documents
   give N, L and the document frequencies.
2. *Index.* Documents are dealt to shards by hash, bounded in documents and in cells of the shard's matrix. In a shard, each term's posting list is
   clustered by the similarity of its documents (directions in a random projection, nearest of centres drawn from the list), and every
   cluster is a block, cut where it grows beyond twice the wanted size. A block stores the coordinatewise maximum of its vectors, over the
   terms that share a query with the list's own term: other coordinates are never asked. The index is a table with a row per shard.
3. *Search.* A query takes its terms from the heaviest to the lightest and bounds the blocks of their lists by the inner product of the maxima with its weights,
   from the list's own term on: a document with a heavier term is bounded in that term's list. Blocks are opened best first and their documents scored
   exactly, once. It stops when the next bound is below the k-th best score: bounds are exact integers, so what is skipped cannot
   enter, ties included. Each shard returns at most k rows per query; the best k of all shards stay.

A group is bounded by its distinct terms, a shard by its matrix, so memory grows with neither documents nor queries. Only one
group's queries and document frequencies pass through the driver at a time.

Defined cases: a null or empty text, or one without terms, is no document; a query without terms, or whose terms no document holds, returns no row; equal
scores rank by id, null ids last; repeated documents are ranked each; rows of queries with equal id and text count once, others with a
null or repeated id are ranked each; empty tables give an empty result; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written

# Fixed value: a term is a run of digits, letters and characters beyond ASCII; only A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
K = 10
GROUP_TERMS = 1 << 14  # distinct terms of a group of queries; a longer query is a group of its own
GROUP_QUERIES = 4096
SHARD_DOCS = 4096
SHARD_CELLS = 1 << 24  # documents times terms of a shard's matrix
BLOCK = 32  # wanted documents of a block
DIRECTIONS = 24  # of the projection that documents are compared in
SCALE, B = 1_000_000_000, 75


def terms(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def groups(queries: DataFrame) -> Iterator[list[tuple]]:
    """(id, terms with counts) of queries in groups of bounded vocabulary, one group at a time."""
    held, words = [], set()
    for row in queries.distinct().orderBy(*queries.columns).toLocalIterator():
        counts = Counter(terms(row[1]))
        if held and (len(words | counts.keys()) > GROUP_TERMS or len(held) >= GROUP_QUERIES):
            yield held
            held, words = [], set()
        held.append((row[0], counts))
        words |= counts.keys()
    if held:
        yield held


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: ``doc_id``, number of terms ``n``, places of the vocabulary's terms in it and their frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                found = TERM.findall(text.as_buffer().to_pybytes().lower())
                if found:
                    counts = [(known[t], tf) for t, tf in Counter(found).items() if t in known]
                    rows.append((doc_id, len(found), [t for t, _ in counts], [tf for _, tf in counts]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _blocks(members: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """A posting list in clusters of documents whose directions agree."""
    n = -(-len(members) // BLOCK)
    if n == 1:
        return [members]
    centres = places[members[:: -(-len(members) // n)]]  # members come in hash order
    home = (places[members] @ centres.T).argmax(1)
    order = np.argsort(home, kind="stable")
    ends = np.flatnonzero(np.diff(home[order])) + 1
    return [part for cluster in np.split(members[order], ends) for part in np.array_split(cluster, -(-len(cluster) // (2 * BLOCK)))]


class Shard:
    """Documents' impacts, and per term the blocks of its posting list with their maxima."""

    def __init__(self, ids: np.ndarray, has_id: np.ndarray, impacts: np.ndarray, asked: list[np.ndarray]):
        self.ids, self.has_id, self.impacts = ids, has_id, impacts
        rng = np.random.default_rng(11)
        places = impacts.astype(np.float32) @ rng.standard_normal((impacts.shape[1], DIRECTIONS)).astype(np.float32)
        places /= np.maximum(np.sqrt(np.square(places).sum(1)), 1e-9)[:, None]
        self.lists: list[tuple[list[np.ndarray], np.ndarray] | None] = []
        for t, columns in enumerate(asked):
            members = np.flatnonzero(impacts[:, t])
            if not len(members):
                self.lists.append(None)
                continue
            blocks = _blocks(members, places)
            starts = np.cumsum([0, *map(len, blocks[:-1])])
            most = np.maximum.reduceat(impacts[np.concatenate(blocks)][:, columns], starts, axis=0)
            self.lists.append((blocks, most))

    def search(self, query: np.ndarray, weights: np.ndarray, asked: list[np.ndarray], k: int) -> list[tuple[int, int, bool]]:
        """Best (score, document id, has id) among the shard's documents with a score above 0; ``opened`` counts the blocks it took."""
        bounds, blocks, self.opened = [], [], 0
        heavy = np.argsort(-weights, kind="stable")
        for i, t in enumerate(query[heavy].tolist()):
            if self.lists[t] is not None:
                mine, most = self.lists[t]
                rest = heavy[i:]  # documents with a heavier term are bounded in that term's list
                bounds.append(most[:, np.searchsorted(asked[t], query[rest])].astype(np.int64) @ weights[rest])
                blocks += mine
        if not blocks:
            return []
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(len(self.ids), bool)
        best_docs, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        at, step = 0, 2
        while at < len(order):
            limit = best_scores[-1] if len(best_scores) == k else 0
            some = order[at : at + step]
            some = some[(bound[some] >= limit) & (bound[some] > 0)]
            if not len(some):
                break
            opened = np.unique(np.concatenate([blocks[i] for i in some.tolist()]))
            opened = opened[~seen[opened]]
            seen[opened] = True
            self.opened += len(some)
            scores = self.impacts[np.ix_(opened, query)].astype(np.int64) @ weights
            opened, scores = opened[scores > 0], scores[scores > 0]
            docs, values = np.concatenate([best_docs, opened]), np.concatenate([best_scores, scores])
            first = np.lexsort((self.ids[docs], ~self.has_id[docs], -values))[:k]
            best_docs, best_scores = docs[first], values[first]
            at += step
            step = min(32, step * 2)
        return [(int(s), int(self.ids[d]), bool(self.has_id[d])) for d, s in zip(best_docs, best_scores)]


def _build(asked: list[np.ndarray], total_docs: int, total_terms: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "doc_id"])  # hash order: centres of lists are drawn evenly
        impacts = np.zeros((len(rows), len(asked)), np.int32)
        for i, (n, ts, tfs) in enumerate(zip(rows["n"].tolist(), rows["terms"], rows["tfs"])):
            m = 100 - B + (B * n * total_docs) // total_terms
            tf = np.asarray(tfs, np.int64)
            impacts[i, np.asarray(ts, np.int64)] = (SCALE * tf) // (1000 * tf + 8 * m)
        shard = Shard(rows["doc_id"].to_numpy(np.int64), rows["has_id"].to_numpy(bool), impacts, asked)
        return pd.DataFrame({"shard": [key[0]], "index": [zstandard.compress(pickle.dumps(shard, 5))]})

    return run


def _search(items: list[tuple[np.ndarray, np.ndarray]], asked: list[np.ndarray], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["index"]:
                shard = pickle.loads(zstandard.decompress(data))
                out = [(q, *hit) for q, (query, weights) in enumerate(items) for hit in shard.search(query, weights, asked, k)]
                yield pd.DataFrame(out, columns=["q", "score", "doc_id", "has_id"]).astype({"q": "int32", "score": "int64", "doc_id": "int64", "has_id": "bool"})

    return run


def _group(docs: DataFrame, queries: list[tuple], k: int) -> DataFrame | None:
    """Ranked rows of one group of queries: (q, score, doc_id)."""
    words = sorted(set().union(*(c.keys() for _, c in queries)))
    if not words:
        return None
    place = {t: i for i, t in enumerate(words)}
    rows = written(vectors(docs, place).withColumn("place", F.xxhash64("doc_id", F.monotonically_increasing_id())), "blockrank-vectors")
    total_docs, total_terms, postings = rows.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    if not postings:
        return None
    counts = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * total_docs + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0)))).cast("bigint")
    weights = np.zeros(len(words), np.int64)
    for row in counts.select("t", weight.alias("w")).toLocalIterator():  # at most a group's vocabulary
        weights[row["t"]] = row["w"]
    asked_sets: list[set[int]] = [set() for _ in words]
    items = []
    for _, c in queries:
        query = np.array(sorted(place[t] for t in c), np.int64)
        items.append((query, np.array([weights[i] * c[words[i]] for i in query.tolist()], np.int64)))
        for i in query.tolist():
            asked_sets[i].update(query.tolist())
    asked = [np.array(sorted(s), np.int64) for s in asked_sets]
    most = max(1, min(SHARD_DOCS, SHARD_CELLS // len(words)))
    n_shards = max(1, -(-total_docs // most))
    keyed = rows.where(F.size("terms") > 0).withColumn("has_id", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    dealt = keyed.withColumn("shard", F.pmod("place", F.lit(n_shards)).cast("int"))  # hash of row numbers: copies and null ids spread
    index = dealt.groupBy("shard").applyInPandas(_build(asked, total_docs, total_terms), "shard int, index binary")
    index = written(index, "blockrank-index")
    shared = docs.sparkSession.sparkContext.broadcast((items, asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _search(*shared.value, k)(batches)

    found = index.select("index").repartition(min(n_shards, 4096)).mapInPandas(run, "q int, score bigint, doc_id bigint, has_id boolean")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("has_id"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return written(ranked.select("q", "rank", F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "score"), "blockrank-ranked")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k best documents of every query: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for group in groups(queries.select(F.col(query_id).cast("long").alias("item_id"), F.col(query_text).alias("text"))):
        ranked = _group(texts, group, k)
        if ranked is not None:
            names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(group)], "q int, item_id bigint")
            out = out.unionByName(ranked.join(names, "q").select("item_id", "rank", "doc_id", "score"))
    return out
