"""Ranked runs: fusion, diversification, hydration, expansion, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import lexical as lx
from lexmill.session import materialise


def _neighboured(c: lx.Contexts) -> list[pa.Array]:
    """Per word: its most frequent context (ties: the least), the sum of its squares, its contexts."""
    place = np.empty(len(c.contexts), np.int64)
    place[pc.array_sort_indices(c.contexts).to_numpy()] = np.arange(len(c.contexts))
    most = np.repeat(np.maximum.reduceat(c.n, c.first), c.sizes) if len(c.n) else c.n
    least = np.minimum.reduceat(np.where(c.n == most, place[c.ctx], len(place)), c.first) if len(c.n) else c.n
    other = pc.array_sort_indices(c.contexts).take(pa.array(least))
    squares = np.add.reduceat(c.n * c.n, c.first) if len(c.n) else c.n
    word, ctx, n = c.vectors()
    return [word, c.contexts.take(other), pa.array(squares), pa.array(c.sizes.astype(np.int32)), ctx, n]


def _dots(rows: pa.Table) -> pa.RecordBatch:
    """Products of words' vectors (side 1) with the vector that stands before them (side 0), where it is that of their neighbour."""
    side = rows["side"].to_numpy()
    unit = np.cumsum(side == 0) - 1
    answer = np.flatnonzero(side == 0)[unit]
    coded = (ctx := lx.unlisted(rows["ctx"])).flatten().dictionary_encode()
    n = lx.unlisted(rows["n"]).flatten().cast(pa.int64()).to_numpy()
    sizes = pc.list_value_length(ctx).to_numpy()
    key = np.repeat(unit, sizes) * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    asks = np.repeat(side == 1, sizes)
    order = np.argsort(key[~asks])
    known, counts = key[~asks][order], n[~asks][order]
    at = np.minimum(np.searchsorted(known, key[asks]), len(known) - 1)
    product = np.where(known[at] == key[asks], counts[at] * n[asks], 0)
    mine = np.flatnonzero(side == 1)
    dot = np.add.reduceat(product, np.cumsum(sizes[mine]) - sizes[mine])
    theirs = pa.array(answer[mine])
    mine = pa.array(mine)
    met = pc.and_(pc.equal(rows["other"].take(mine), rows["other"].take(theirs)), pc.equal(rows["part"].take(mine), rows["part"].take(theirs))).combine_chunks()
    columns = [rows["word"].take(mine), rows["other"].take(mine), pa.chunked_array([pa.array(dot)]), rows["squares"].take(mine), rows["squares"].take(theirs)]
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], ["word", "other", "dot", "squares", "squares2"]).filter(met)


def _met(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(held)
        side = rows["side"].to_numpy()
        asked = (side == 1) | (np.append(side[1:], 0) == 1)  # vectors that no word asks for go
        last = np.flatnonzero(side == 0)[-1:] if (side == 0).any() else []
        held[:] = [rows.take(pa.array(last, pa.int64()))]
        some = rows.filter(pa.array(asked & (np.cumsum(side == 0) > 0)))
        if len(some) and (side == 1).any() and some["side"].to_numpy().any():
            yield _dots(some)

    for batch in batches:
        for at in range(0, len(batch), 1000):
            held.append(pa.Table.from_batches([batch.slice(at, 1000)]))
            size += pc.sum(held[-1]["size"]).as_py()
            if size >= most:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def word_similarity(cooc: DataFrame) -> DataFrame:
    """Cosine of each word's context vector with that of its most frequent neighbour; words hold no blank. Takes either form of ``cooccurrence``.

    Each word becomes one row, its contexts as one string, written once. Words go to their neighbour's vector, those of a neighbour that
    many have in parts of about ``PAIRED`` contexts, each with a copy of its vector: the work follows the co-occurrence table
    and not the pairs of words, and no context is a row of a shuffle.
    """
    most = lx.PAIRED

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            return lx.in_parts(lx.Contexts.of_rows(*[c.combine_chunks() for c in rows.columns]).vectors(), ["word", "ctx", "n"])

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= most:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    whole = dict(cooc.dtypes)["n"] == "string"
    rows = cooc if whole else cooc.select("word", "ctx", F.col("n").cast("bigint").alias("n")).mapInArrow(packed, lx.VECTOR)
    vectors = lx.merged_vectors(rows, _neighboured, "word string, other string, squares bigint, size int, ctx string, n string", whole)
    vectors = materialise(vectors, "neighbours")
    parts = vectors.groupBy("other").agg(F.ceil(F.sum("size") / most).alias("parts")).where("parts > 1")
    parts = materialise(parts.select(F.col("other").alias("key"), "parts"), "neighbour-parts")
    of_key = lambda c: vectors.join(parts, F.col(c) == F.col("key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    common = ["word", "squares", "size", "ctx", "n"]
    asks = of_key("other").select("other", F.pmod(F.xxhash64("word"), F.col("parts")).alias("part"), F.lit(1).alias("side"), *common)
    answers = of_key("word").select(F.col("word").alias("other"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), *common)
    met = asks.unionByName(answers).repartition("other", "part").sortWithinPartitions("other", "part", "side")
    dots = met.mapInArrow(lambda it: _met(it, most), "word string, other string, dot bigint, squares bigint, squares2 bigint")
    return dots.select("word", "other", F.round(F.col("dot") / (F.sqrt("squares") * F.sqrt("squares2")), 6).alias("similarity"))


def posting_join_summary(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """What the posting-list join touches per question: postings, documents, idf-weighted mass."""
    q = lx.query_terms(queries, "item_id", tx.code_tokens)
    post = lx.postings(docs, "doc_id", tx.code_tokens, q.select("term").distinct())
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", lx.bm25_idf(n_docs, F.col("df")).alias("idf")
    )
    # one row per (question, document) first, so that counting documents needs no distinct
    per_doc = (
        post.join(idf, "term")
        .join(q, "term")
        .groupBy("item_id", "doc_id")
        .agg(
            F.count(F.lit(1)).alias("p"),
            F.sum("tf").alias("tf"),
            F.sum(F.col("idf") * F.col("tf")).alias("mass"),
        )
    )
    return per_doc.groupBy("item_id").agg(
        F.sum("p").alias("n_postings"),
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("tf").alias("tf_total"),
        F.round(F.sum("mass"), 4).alias("mass"),
    )


# Fusion constant, funnel widths, context budget, chunk separator.
RRF_K = 60
CANDIDATES_K = 20
FINAL_K = 4
CONTEXT_CHARS = 4000


def lines_of(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents cut at newlines: (chunk_id, doc_id, idx, text); blank lines dropped, idx kept dense."""
    parts = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    rows = docs.select(doc_id, F.posexplode(parts).alias("idx", "text"))
    return rows.withColumn("chunk_id", F.concat_ws("_", F.col(doc_id), F.col("idx")))


def as_run(scores: DataFrame, name: str, query_id: str, unit: str, k: int) -> DataFrame:
    """(query, run, unit, rank, score)."""
    top = lx.top_k(scores, query_id, unit, k)
    return top.select(query_id, F.lit(name).alias("run"), unit, "rank", "score")


def fuse(runs: DataFrame, query_id: str, unit: str, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of a long run table.

    Grouping the union gives full-outer semantics; ranks stay available per run.
    """
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("run") == name, F.lit(float(value))).otherwise(weight)
    dense = F.col("run").startswith("dense")
    return runs.groupBy(query_id, unit).agg(
        F.round(F.sum(weight / (F.lit(k) + F.col("rank"))), 6).alias("rrf"),
        F.max(F.when(dense, F.col("score"))).alias("similarity"),
        F.max(F.when(F.col("run") == "bm25", F.col("score"))).alias("bm25"),
        F.array_join(
            F.sort_array(F.collect_list(F.concat_ws("=", "run", "rank"))), ","
        ).alias("ranks"),
    )


def hydrated(run: DataFrame, rows: DataFrame, unit: str) -> DataFrame:
    """The hits with the columns of their rows. Run and result, a few rows per question, are written: Spark then knows that the
    run is small and takes it to the rows, texts included, instead of shuffling these."""
    return materialise(materialise(run, "run").join(rows, unit), "hits")


def ordered(df: DataFrame, query_id: str, *order: Column, name: str = "pos", k: int | None = None) -> DataFrame:
    """Number rows per query; with ``k`` only the first k are kept (and shipped)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def union_first_seen(runs: DataFrame, query_id: str, unit: str) -> DataFrame:
    """Union of runs, each unit kept where it was seen first (run name, then rank)."""
    return runs.groupBy(query_id, unit).agg(F.min(F.struct("run", "rank")).alias("first")).select(
        query_id, unit, F.col("first.run").alias("run"), F.col("first.rank").alias("rank")
    )


def diversify(run: DataFrame, query_id: str, owner: str, max_per_owner: int = 1) -> DataFrame:
    """At most N units per owner, order kept, renumbered. ``run`` is bounded by its depth per query."""
    w = Window.partitionBy(query_id, owner).orderBy("rank")
    kept = run.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_per_owner).drop("_n")
    return ordered(kept, query_id, F.col("rank"), name="new_rank")


def over_threshold(fused: DataFrame, t: float) -> DataFrame:
    """Similarity threshold; rows without similarity or found lexically pass."""
    keep = F.col("similarity").isNull() | (F.col("similarity") >= t) | (F.coalesce("bm25", F.lit(0.0)) != 0)
    return fused.where(keep)


def rerank(cands: DataFrame, query_id: str, unit: str, score: str, top_n: int, zero_last: bool = True) -> DataFrame:
    """Second stage by an input score column; a score of zero sorts last as in ``score or -inf``."""
    s = F.col(score)
    key = F.when(s.isNull() | ((s == 0) & F.lit(zero_last)), F.lit(-1e9)).otherwise(s)
    return ordered(cands, query_id, key.desc(), F.col("pos"), F.col(unit), name="final_rank", k=top_n)


class Reranker(Protocol):
    """``rerank(hits, top_n)``: the best of each query's candidates in a new order, with ``final_rank``; an interchangeable second stage."""

    def rerank(self, hits: DataFrame, top_n: int) -> DataFrame: ...


class ScoreReranker:
    """Orders candidates (query, unit, pos) by a score that ``add`` puts on them as column ``s``; higher is better, no score is last."""

    def __init__(self, query_id: str, unit: str, add: Callable[[DataFrame], DataFrame], zero_last: bool = True):
        self.query_id, self.unit, self.add, self.zero_last = query_id, unit, add, zero_last

    def rerank(self, hits: DataFrame, top_n: int) -> DataFrame:
        return rerank(self.add(hits), self.query_id, self.unit, "s", top_n, self.zero_last)


class OverlapReranker(ScoreReranker):
    """TF-IDF overlap of question and text, scored for the candidates only: hand it written ones."""

    def __init__(self, docs: DataFrame, queries: DataFrame, query_id: str, unit: str):
        def add(hits: DataFrame) -> DataFrame:
            found = lx.tfidf_overlap(docs, queries, unit, query_id, pairs=hits)
            return hits.join(found.select(query_id, unit, F.round("score", 9).alias("s")), [query_id, unit], "left")

        super().__init__(query_id, unit, add)


class LengthReranker(ScoreReranker):
    """Short texts first: ``1000 / (1000 + n)`` for ``lengths(unit, n_chars)``."""

    def __init__(self, lengths: DataFrame, query_id: str, unit: str):
        super().__init__(query_id, unit, lambda hits: hits.join(lengths, unit).withColumn("s", F.lit(1000.0) / (1000 + F.col("n_chars"))))


class PairReranker(ScoreReranker):
    """A loaded model that scores (question, text) pairs in batches; it is loaded once per Python worker. A score of zero counts."""

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]], docs: DataFrame, queries: DataFrame, query_id: str, unit: str, digits: int = 4):
        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for asked, text in batches:
                yield pd.Series([round(float(x), digits) for x in model(asked.tolist(), text.tolist())], index=asked.index, dtype="float64")

        def add(hits: DataFrame) -> DataFrame:
            pairs = hits.join(queries.select(query_id, F.col("text").alias("_q")), query_id).join(docs.select(unit, F.col("text").alias("_t")), unit)
            return pairs.withColumn("s", score("_q", "_t")).drop("_q", "_t")

        super().__init__(query_id, unit, add, zero_last=False)


def blocks(hits: DataFrame, rank: str, body: Column, header: Column) -> DataFrame:
    return hits.withColumn("block", F.concat(header, F.lit("\n"), F.trim(body)))


def pack(hits: DataFrame, keys: list[str], rank: str, max_chars: int) -> DataFrame:
    """Blocks within a character budget, at least one; lengths are positive, so the running
    sum is monotone and stopping at the first overflow equals a filter."""
    w = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    used = hits.withColumn("used", F.sum(F.length("block")).over(w))
    return used.where((F.col("used") <= max_chars) | (F.col(rank) == 1))


def prompts(packed: DataFrame, query_id: str, rank: str, question: str) -> DataFrame:
    """One prompt per question: numbered blocks in rank order, then the question."""
    body = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(rank, "block"))), lambda b: b["block"]), "\n\n"
    )
    return packed.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.concat(F.lit("<context>\n"), body, F.lit("\n</context>\n\n"), F.first(question)).alias("prompt"),
    )


def with_neighbours(hits: DataFrame, chunks: DataFrame, query_id: str) -> DataFrame:
    """Each hit with the chunks before and after it in the same document."""
    around = hits.select(
        query_id, "chunk_id", "doc_id", F.explode(F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1)).alias("idx")
    )
    near = around.join(chunks.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    return near.groupBy(query_id, "chunk_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]), "\n\n").alias("expanded"),
    )


def parent_windows(rows: DataFrame, radius: int = 300) -> DataFrame:
    """Adds ``window``: the parent text around ``text`` cut at blanks, or the chunk itself."""
    r = rows.withColumn("_s", F.expr("locate(substr(text, 1, 50), parent)") - 1)
    r = r.withColumn("_l", F.greatest(F.lit(0), F.col("_s") - radius))
    r = r.withColumn("_r", F.least(F.length("parent"), F.col("_s") + F.length("text") + radius))
    r = r.withColumn("_l", F.when(F.col("_l") > 0, F.expr("locate(' ', parent, _l + 1)")).otherwise(0))
    r = r.withColumn("_w", F.expr("substr(parent, _l + 1, greatest(_r - _l, 0))"))
    r = r.withColumn("_b", F.expr("locate(' ', reverse(_w))"))
    cut = F.when(F.col("_r") >= F.length("parent"), F.col("_r")).when(
        F.col("_b") > 0, F.col("_l") + F.length("_w") - F.col("_b")
    ).otherwise(F.length("parent") - 1)
    r = r.withColumn("_e", cut)
    body = F.regexp_replace(F.expr("substr(parent, _l + 1, greatest(_e - _l, 0))"), r"^\s+|\s+$", "")
    text = F.concat(
        F.when(F.col("_l") > 0, "...").otherwise(""), body,
        F.when(F.col("_e") < F.length("parent"), "...").otherwise(""),
    )
    return r.withColumn("window", F.when(F.col("_s") < 0, F.col("text")).otherwise(text)).drop(
        "_s", "_l", "_r", "_w", "_b", "_e"
    )


# Interchangeable search backends: (docs, queries, doc id, query id, best=None) -> (query, doc, score).
BACKENDS = {"bm25": lx.bm25_scores, "dense0": lx.tfidf_cosine}

# Fixed value: list markers that precede a reformulated question.
LIST_PREFIX = r"^\s*(?:[-–—•*]|\d{1,2}[.)])\s*"


def query_variants(turns: DataFrame, n: int, max_len: int) -> DataFrame:
    """The first user question of a dialogue and up to n reformulations taken from reply lines.

    Lines lose their list marker; length, preamble and case-folded duplicates are checked.
    """
    first = (
        turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.trim(F.min_by("text", "turn"), F.lit("\n ")).alias("q"))
    )
    lines = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "line")
    )
    v = lines.withColumn("v", F.trim(F.regexp_replace("line", LIST_PREFIX, "")))
    ok = v.join(first, "conv_id").where(
        F.length("v").between(6, max_len) & ~F.endswith("v", F.lit(":")) & (F.lower("v") != F.lower("q"))
    )
    uniq = ok.groupBy("conv_id", F.lower("v").alias("_k")).agg(F.min(F.struct("turn", "i", "v")).alias("f"))
    picked = ordered(uniq, "conv_id", F.col("f"), name="n", k=n).select(
        "conv_id", F.col("n").cast("long").alias("n"), F.col("f.v").alias("variant")
    )
    return first.select("conv_id", F.lit(0).cast("long").alias("n"), F.col("q").alias("variant")).unionByName(picked)


def top_k_within(scores: DataFrame, keys: list[str], unit: str, k: int) -> DataFrame:
    """Best k per combination of keys; filters belong before this step."""
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), F.col(unit))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
