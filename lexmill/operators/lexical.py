"""Term statistics and lexical scoring (TF-IDF, BM25, bag of words, n-grams).

Tokens are exploded and counted with map-side combining; when only the terms of a query
set matter, postings are reduced to those terms before any shuffle. Small sides are never
hinted: Spark broadcasts them when their measured size allows and merges sorted runs
otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.functions import text as tx
from lexmill.session import materialise, scratch, version

Tokenizer = Callable[[Column], Column]

# Okapi parameters.
BM25_K1 = 1.5
BM25_B = 0.75

# What meets in one task when questions are scored: postings of texts, and terms of questions.
CELL_POSTINGS = 1_000_000
CELL_TERMS = 500_000
CELL_PAIRS = 500_000  # pairs handed on at once
COUNTED = 1_000_000  # tokens counted at once


class Index:
    """Postings of a collection, written once and read by every scoring function in place of the texts.

    Each token class is counted at its first use: ``of`` gives (doc, dl, term, tf) from one pass over the texts, ``frequencies`` (term, df),
    ``mean_length`` the mean of ``dl``, and ``norms`` the lengths (doc, dn) of the TF-IDF vectors. Wherever a function here takes documents, it takes an index.
    """

    KINDS = {tx.words: "words", tx.code_tokens: "code"}

    def __init__(self, docs: DataFrame, id_col: str, path: str):
        self.docs, self.id_col, self.path, self.kinds, self.dn = docs, id_col, path, {}, None
        self.ids = self._written(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")), "ids")
        self.n_docs = self.ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        repeated = self.ids.where("n > 1").select(F.col(id_col).alias("_id"))
        self.repeated = None if repeated.isEmpty() else repeated

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{name}")  # an empty collection has empty folders

    def whole(self) -> bool:
        """Whether its files are still there."""
        spark = self.docs.sparkSession
        try:
            for name in ["ids", *(f"{kind}/{part}" for kind in self.kinds for part in ("postings", "terms")), *(["norms"] if self.dn is not None else [])]:
                spark.read.schema("n bigint").parquet(f"{self.path}/{name}")
        except AnalysisException:
            return False
        return True

    def _kind(self, tokenizer: Tokenizer) -> tuple[DataFrame, DataFrame, float]:
        kind = self.KINDS[tokenizer]
        if kind not in self.kinds:
            docs, id_col = self.docs, self.id_col
            if self.repeated is None:
                counts = counted(docs, id_col, tokenizer)
            else:  # rows of one id are one text where they are equally long
                part = lambda how: docs.join(self.repeated, F.col(id_col).eqNullSafe(F.col("_id")), how)
                merged = counted(part("left_semi"), id_col, tokenizer).groupBy(id_col, "dl", "term").agg(F.sum("tf").alias("tf"))
                counts = counted(part("left_anti"), id_col, tokenizer).unionByName(merged)
            rows = self._written(counts, f"{kind}/postings")
            terms = self._written(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{kind}/terms")
            tokens = rows.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
            self.kinds[kind] = rows, terms, tokens / self.n_docs if self.n_docs else 0.0
        return self.kinds[kind]

    def of(self, tokenizer: Tokenizer) -> DataFrame:
        return self._kind(tokenizer)[0]

    def frequencies(self, tokenizer: Tokenizer) -> DataFrame:
        return self._kind(tokenizer)[1]

    def mean_length(self, tokenizer: Tokenizer) -> float:
        return self._kind(tokenizer)[2]

    @property
    def norms(self) -> DataFrame:
        if self.dn is None:
            idf = self.frequencies(tx.words).select("term", F.log(F.lit(float(self.n_docs)) / F.col("df")).alias("idf")).where("idf > 0")
            norm = F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2)))
            # a term has one row in idf, so hashing a part of the terms takes little and spares the sorting of all postings
            self.dn = self._written(self.of(tx.words).join(idf.hint("shuffle_hash"), "term").groupBy(self.id_col).agg(norm.alias("dn")), "norms")
        return self.dn


_INDEXES: dict[tuple, Index] = {}


def indexed(docs: DataFrame, id_col: str) -> Index:
    """The index of a collection of files: built at its first use in an application, read after that.

    The same files (names, sizes, times of change) read by the same plan share an index.
    """
    spark, files = docs.sparkSession, version(docs)
    if files is None:
        return Index(docs, id_col, scratch(spark, "index"))
    key = (id_col, *files)
    if key not in _INDEXES or not _INDEXES[key].whole():  # the shared folder may have been emptied meanwhile
        _INDEXES[key] = Index(docs, id_col, scratch(spark, "index"))
    return _INDEXES[key]


def _n_docs(docs: DataFrame | Index) -> Column:
    return F.lit(docs.n_docs) if isinstance(docs, Index) else docs.agg(F.count(F.lit(1)).alias("n")).scalar()


def _document_frequency(docs: DataFrame | Index, tokenizer: Tokenizer, post: DataFrame) -> DataFrame:
    """(term, df) of the terms in ``post``."""
    return docs.frequencies(tokenizer) if isinstance(docs, Index) else post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def token_rows(docs: DataFrame, id_col: str, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """(id, dl, term): one row per token; ``dl`` counts all tokens of the text."""
    toks = tx.once(docs, [id_col], _t=tokenizer(F.col(text)))
    return toks.select(id_col, F.size("_t").alias("dl"), F.explode("_t").alias("term"))


def postings(docs: DataFrame, id_col: str, tokenizer: Tokenizer, terms: DataFrame | None = None) -> DataFrame:
    """(id, dl, term, tf), optionally only for the given distinct ``terms``.

    Rows are hashed by the text's id alone, so that counting terms per text and, after a
    broadcast join with a query set, summing scores per (query, text) share one shuffle.
    """
    if isinstance(docs, Index):
        return docs.of(tokenizer) if terms is None else docs.of(tokenizer).join(terms, "term", "left_semi")
    rows = token_rows(docs, id_col, tokenizer)
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.repartition(id_col).groupBy(id_col, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame, id_col: str, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """(id, dl, term, tf) counted row by row: no token is shuffled. A repeated id has the rows of each of its texts."""
    cut = docs.select(id_col, tokenizer(F.col(text)).alias("_t"))
    schema = T.StructType([cut.schema[id_col], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            piece = (np.cumsum(sizes) - sizes) // COUNTED
            for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(piece)) + 1):
                if not len(part) or not (n := sizes[part]).sum():
                    continue
                rows = batch.slice(int(part[0]), len(part))
                coded = rows.column(1).flatten().dictionary_encode()
                key = np.repeat(np.arange(len(part)), n) * len(coded.dictionary) + coded.indices.to_numpy()
                key, tf = np.unique(key, return_counts=True)
                row, term = np.divmod(key, len(coded.dictionary))
                columns = rows.column(0).take(pa.array(row)), pa.array(n[row].astype(np.int32)), coded.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64))
                yield pa.RecordBatch.from_arrays(list(columns), schema.names)

    return cut.mapInArrow(run, schema)


def query_terms(queries: DataFrame, id_col: str, tokenizer: Tokenizer) -> DataFrame:
    """(query, term, qtf, ql) for a table of questions."""
    return postings(queries, id_col, tokenizer).select(
        F.col(id_col), "term", F.col("tf").alias("qtf"), F.col("dl").alias("ql")
    )


def idf_plain(docs: DataFrame, id_col: str, tokenizer: Tokenizer = tx.words) -> DataFrame:
    """(term, df, idf) with the unsmoothed idf = ln(N / df)."""
    if isinstance(docs, Index):
        return docs.frequencies(tokenizer).withColumn("idf", F.log(_n_docs(docs) / F.col("df")))
    terms = docs.select(F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("term"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        terms.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", F.log(n_docs / F.col("df")))
    )


def tfidf_weights(docs: DataFrame, id_col: str, tokenizer: Tokenizer = tx.words) -> DataFrame:
    """(id, term, weight, norm): L2-normalised TF-IDF vectors as a long table."""
    idf = idf_plain(docs, id_col, tokenizer)
    raw = (
        postings(docs, id_col, tokenizer)
        .join(idf.select("term", "idf"), "term")
        .select(id_col, "term", (F.col("tf") / F.col("dl") * F.col("idf")).alias("raw"))
    )
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, id_col).select(
        id_col,
        "term",
        F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(F.lit(0.0)).alias("weight"),
        "norm",
    )


def _stored(docs: DataFrame | Index, id_col: str, tokenizer: Tokenizer, asked: DataFrame | None = None) -> DataFrame:
    """Postings in files, of an index as they are, else of the asked terms only: read more than once, and counted from their footers."""
    if isinstance(docs, Index):
        return docs.of(tokenizer)
    return materialise(postings(docs, id_col, tokenizer, None if asked is None else asked.select("term").distinct()), "postings")


def numbered(asked: DataFrame, df: DataFrame, *idf: Column) -> tuple[DataFrame, DataFrame]:
    """The questions' terms that some text holds, written with a number and their ``idf``, and the questions with these numbers."""
    terms = df.join(asked.select("term").distinct(), "term").select("term", *idf, F.monotonically_increasing_id().alias("_t"))
    terms = materialise(terms, "terms")
    return terms, asked.join(terms, "term")


def _highest(sums: np.ndarray, best: int | None, least: float) -> np.ndarray:
    """Places of the ``best`` highest sums from ``least`` on (all, without a number), equal ones (9 digits) by place."""
    if best is None or len(sums) <= best:
        limit = least
    else:  # the best of the highest of each run of 32 bound the best of all from below
        whole = len(sums) // 32 * 32
        tops = sums[:whole].reshape(-1, 32).max(1) if whole >= 32 * best else sums
        limit = max(np.partition(tops, len(tops) - best)[len(tops) - best] - 1e-8, least)
    some = np.flatnonzero(sums >= limit)
    if best is not None and len(some) > best:
        some = some[np.argsort(-np.round(sums[some], 9), kind="stable")[:best]]
    return some


def _sums(doc_type: pa.DataType, query_type: pa.DataType, names: list[str], best: int | None, normed: bool):
    """Scores of one cell: each question adds up the weights of its terms, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        asks = cell.column("_asks")
        asked, posts = cell.filter(asks), cell.filter(pc.invert(asks))
        plain = pc.is_valid(posts.column("_t"))
        norms, posts = posts.filter(pc.invert(plain)), posts.filter(plain)
        if not len(asked) or not len(posts):
            return
        # texts are numbered by class, then id: a class is a range, and of equal scores the first is the smaller id
        coded = posts.column("_doc").combine_chunks().dictionary_encode(null_encoding="encode")
        codes, ids = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        classes = np.empty(len(ids), np.int64)
        classes[codes] = posts.column("_class").to_numpy()
        order = pc.sort_indices(pa.table({"c": classes, "d": ids}), [("c", "ascending"), ("d", "ascending")], null_placement="at_start")
        ids, order = ids.take(order), order.to_numpy()
        ends = np.r_[np.flatnonzero(np.diff(classes[order])) + 1, len(ids)]
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc, term = place[codes], posts.column("_t").to_numpy()
        order = np.lexsort((doc, term))
        term, doc, weight = term[order], doc[order], posts.column("_w").to_numpy()[order]
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])  # a repeated id has several postings for a term
        term, doc, weight = term[new], doc[new], np.add.reduceat(weight, new)
        if normed:
            norm = np.zeros(len(ids))
            known = pc.index_in(norms.column("_doc").combine_chunks(), value_set=ids)
            norm[known.drop_null().to_numpy()] = norms.column("_w").to_numpy()[known.is_valid().to_numpy(zero_copy_only=False)]
            has = norm[doc] > 0
            term, doc, weight = term[has], doc[has], weight[has] / norm[doc[has]]
            if not len(term):
                return
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        terms, stops = term[starts], np.r_[starts[1:], len(term)]
        zeros = bool((weight <= 0).any() or (asked.column("_w").to_numpy() <= 0).any())  # then a score of 0 is no sign that nothing met

        query = asked.column("_query").combine_chunks().dictionary_encode(null_encoding="encode")
        codes, query_ids = query.indices.to_numpy(zero_copy_only=False), query.dictionary
        order = np.argsort(codes, kind="stable")
        codes, wanted, factor = codes[order], asked.column("_t").to_numpy()[order], asked.column("_w").to_numpy()[order]
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        met = terms[at] == wanted
        codes, at, factor = codes[met], at[met], factor[met]
        firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)

        def out(qs, ds, ss):
            which = np.repeat(np.array(qs, np.int64), [len(d) for d in ds])
            columns = query_ids.take(pa.array(which)).cast(query_type), ids.take(pa.array(np.concatenate(ds))).cast(doc_type), pa.array(np.concatenate(ss))
            return pa.RecordBatch.from_arrays(list(columns), names)

        sums, hit, held, size = np.empty(len(ids)), np.empty(len(ids), bool), ([], [], []), 0
        for lo, hi in zip(firsts, np.r_[firsts[1:], len(codes)].astype(np.int64)):
            sums[:] = 0
            for i, f in zip(at[lo:hi], factor[lo:hi]):
                sums[doc[starts[i] : stops[i]]] += weight[starts[i] : stops[i]] * f
            if zeros:
                hit[:] = False
                for i in at[lo:hi]:
                    hit[doc[starts[i] : stops[i]]] = True
                sums[~hit] = -1
            begin = 0
            for end in ends if best is not None else [len(ids)]:
                some = _highest(sums[begin:end], best, 0 if zeros else np.nextafter(0, 1)) + begin
                if len(some):
                    for kept, x in zip(held, (codes[lo], some, sums[some])):
                        kept.append(x)
                    size += len(some)
                begin = end
            if size >= CELL_PAIRS:
                yield out(*held)
                held, size = ([], [], []), 0
        if size:
            yield out(*held)

    return run


def cell_scores(
    weighted: DataFrame, asked: DataFrame, doc_id: str, query_id: str, n_postings: int, best: int | None = None, within: DataFrame | None = None,
    norms: DataFrame | None = None,
) -> DataFrame:
    """(query, doc, score): the sum of products of weights over shared terms, from ``weighted(doc, _t, _w)`` and ``asked(query, _t, _w)``.

    Blocks of texts meet groups of questions; a task adds up the scores of such a cell, so that no pair of a question and a posting is a row.
    With ``best``, a cell hands on only its best texts per question, which hold the best of all: what is shuffled then follows the
    postings and not the pairs. ``within(doc, ...)`` sorts texts into classes, those with the same rows there: the best of each class stay,
    so that the best among any choice of rows can be taken afterwards; texts without a row are left out.
    ``norms(doc, dn)`` divide the weights of their text: they travel to its cell alone, a row per text, and no posting is shuffled to meet them;
    texts without a norm above 0, or without an id, are left out.
    """
    spark = weighted.sparkSession
    asked = materialise(asked.select(query_id, "_t", F.col("_w").cast("double").alias("_w")), "asked")
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-n_postings // CELL_POSTINGS))
    n_groups = max(1, -(-asked.count() // CELL_TERMS))
    label = F.lit(0)
    if within is not None:
        rows = F.to_json(F.sort_array(F.collect_set(F.struct(*[c for c in within.columns if c != doc_id]))))
        weighted, label = weighted.join(within.groupBy(doc_id).agg(F.xxhash64(rows).alias("_class")), doc_id), F.col("_class")
    group, block = F.pmod(F.xxhash64(query_id), F.lit(n_groups)), F.pmod(F.xxhash64(doc_id), F.lit(n_blocks))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    query_type, doc_type = asked.schema[query_id].dataType, weighted.schema[doc_id].dataType
    posts = weighted.select(
        block.alias("_block"), up_to(n_groups).alias("_group"), F.lit(False).alias("_asks"),
        F.col(doc_id).alias("_doc"), F.lit(None).cast(query_type).alias("_query"), label.cast("long").alias("_class"), "_t", F.col("_w").cast("double").alias("_w"))
    if norms is not None:
        posts = posts.unionByName(norms.where((F.col("dn") > 0) & F.col(doc_id).isNotNull()).select(
            block.alias("_block"), up_to(n_groups).alias("_group"), F.lit(False).alias("_asks"), F.col(doc_id).alias("_doc"),
            F.lit(None).cast(query_type).alias("_query"), F.lit(0).cast("long").alias("_class"), F.lit(None).cast("long").alias("_t"), F.col("dn").cast("double").alias("_w")))
    wants = asked.select(
        up_to(n_blocks).alias("_block"), group.alias("_group"), F.lit(True).alias("_asks"),
        F.lit(None).cast(doc_type).alias("_doc"), F.col(query_id).alias("_query"), F.lit(0).cast("long").alias("_class"), "_t", "_w")
    schema = T.StructType([T.StructField(query_id, query_type), T.StructField(doc_id, doc_type), T.StructField("score", T.DoubleType())])
    run = _sums(to_arrow_type(doc_type), to_arrow_type(query_type), [query_id, doc_id, "score"], best, norms is not None)
    return posts.unionByName(wants).groupBy("_block", "_group").applyInArrow(run, schema)


def tfidf_cosine(docs: DataFrame | Index, queries: DataFrame, doc_id: str, query_id: str, best: int | None = None) -> DataFrame:
    """(query, doc, score): cosine of TF-IDF vectors, the query encoded with the corpus idf; ``best`` as in :func:`cell_scores`."""
    idf = idf_plain(docs, doc_id).select("term", "idf").where(F.col("idf") > 0)
    q = query_terms(queries, query_id, tx.words)
    terms, q = numbered(q, idf, F.col("idf"))
    q = q.select(query_id, "_t", (F.col("qtf") * F.col("idf")).alias("qw"))
    qnorm = q.groupBy(query_id).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    all_post = _stored(docs, doc_id, tx.words)
    if isinstance(docs, Index):
        dnorm = docs.norms
    else:
        dnorm = (
            all_post.join(idf, "term")
            .groupBy(doc_id)
            .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("dn"))
        )
    weighted = all_post.join(terms, "term").select(doc_id, "_t", (F.col("tf") * F.col("idf")).alias("_w"))
    asked = q.join(qnorm.where("qn > 0"), query_id).select(query_id, "_t", (F.col("qw") / F.col("qn")).alias("_w"))
    return cell_scores(weighted, asked, doc_id, query_id, all_post.count(), best, norms=dnorm)


def tfidf_overlap(
    docs: DataFrame | Index, queries: DataFrame, doc_id: str, query_id: str, best: int | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """(query, doc, score): sum of tf/len*idf over the *set* of query words, not normalised.

    With ``pairs(query, doc)``, a second stage's candidates, only these are scored; ``best`` as in :func:`cell_scores`.
    """
    q = query_terms(queries, query_id, tx.words).select(query_id, "term")
    post = _stored(docs, doc_id, tx.words, q)
    df = _document_frequency(docs, tx.words, post)
    terms, q = numbered(q, df, F.log(_n_docs(docs) / F.col("df")).alias("idf"))
    part = post.join(terms, "term").select(doc_id, "_t", (F.col("tf") / F.col("dl") * F.col("idf")).alias("_w"))
    if pairs is None:
        return cell_scores(part, q.select(query_id, "_t", F.lit(1.0).alias("_w")), doc_id, query_id, post.count(), best)
    met = part.join(pairs.select(query_id, doc_id).distinct(), doc_id).join(q.select(query_id, "_t"), [query_id, "_t"])
    return met.groupBy(query_id, doc_id).agg(F.sum("_w").alias("score"))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def bm25_terms(docs: DataFrame, doc_id: str) -> DataFrame:
    """(term, df, idf) with the smoothed Okapi idf over code-preserving tokens."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        docs.select(F.explode(F.array_distinct(tx.code_tokens(F.col("text")))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", bm25_idf(n_docs, F.col("df")))
    )


def bm25_corpus(docs: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl)."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum(F.size(tx.code_tokens(F.col("text")))) / F.count(F.lit(1))).alias("avgdl"),
    )


def bm25_scores(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str,
    query_id: str,
    k1: float = BM25_K1,
    b: float = BM25_B,
    best: int | None = None,
    within: DataFrame | None = None,
) -> DataFrame:
    """(query, doc, score) for every pair with a shared term; a repeated query term counts each time.

    Statistics come from the whole collection, so access filters belong after this step
    and before ranking. ``best`` and ``within`` as in :func:`cell_scores`.
    """
    q = query_terms(queries, query_id, tx.code_tokens)
    post = _stored(docs, doc_id, tx.code_tokens, q)
    n_docs = _n_docs(docs)
    avgdl = F.lit(docs.mean_length(tx.code_tokens)) if isinstance(docs, Index) else bm25_corpus(docs).select("avgdl").scalar()
    df = _document_frequency(docs, tx.code_tokens, post)
    terms, q = numbered(q, df, bm25_idf(n_docs, F.col("df")).alias("idf"))
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("dl") / avgdl
    part = post.join(terms, "term").select(
        doc_id,
        "_t",
        (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + F.lit(k1) * norm)).alias("_w"),
    )
    return cell_scores(part, q.select(query_id, "_t", F.col("qtf").alias("_w")), doc_id, query_id, post.count(), best, within)


def bow_cosine(docs: DataFrame | Index, queries: DataFrame, doc_id: str, query_id: str, best: int | None = None) -> DataFrame:
    """(query, doc, score): cosine of plain word counts; ``best`` as in :func:`cell_scores`."""
    q = query_terms(queries, query_id, tx.words)
    qn = q.groupBy(query_id).agg(F.sqrt(F.sum(F.col("qtf") * F.col("qtf"))).alias("qn"))
    post = _stored(docs, doc_id, tx.words)
    dn = post.groupBy(doc_id).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("dn"))
    terms, q = numbered(q, _document_frequency(docs, tx.words, post))
    weighted = post.join(terms, "term").select(doc_id, "_t", F.col("tf").alias("_w"))
    asked = q.join(qn, query_id).select(query_id, "_t", (F.col("qtf") / F.col("qn")).alias("_w"))
    return cell_scores(weighted, asked, doc_id, query_id, post.count(), best, norms=dn)


# Words, or words with their neighbours, that a task counts at once before it hands them on.
PAIRED = 4_000_000
VECTOR = "word string, ctx string, n string"


def _listed(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    """One string per run of ``sizes`` values: words and numbers hold no blank."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values.cast(pa.string())), " ")


def in_parts(columns: list[pa.Array], names: list[str], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, len(whole), rows):
        yield whole.slice(at, rows)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


class Contexts:
    """Counts of (word, context), ascending by the word's place: ``words`` and ``contexts`` are what ``word`` and ``ctx`` point to."""

    def __init__(self, words: pa.Array, contexts: pa.Array, word: np.ndarray, ctx: np.ndarray, n: np.ndarray):
        self.words, self.contexts = words, contexts
        key, self.n = _summed(word.astype(np.int64) * max(len(contexts), 1) + ctx, n)
        self.word, self.ctx = np.divmod(key, max(len(contexts), 1))
        self.first = np.flatnonzero(np.diff(self.word, prepend=-1))  # where each word begins
        self.sizes = np.diff(np.append(self.first, len(key)))

    @staticmethod
    def of_rows(word: pa.Array, ctx: pa.Array, n: pa.Array) -> Contexts:
        word, ctx = word.dictionary_encode(), ctx.dictionary_encode()
        return Contexts(word.dictionary, ctx.dictionary, word.indices.to_numpy(), ctx.indices.to_numpy(), n.to_numpy(zero_copy_only=False))

    @staticmethod
    def of_vectors(rows: pa.Table) -> Contexts:
        ctx, n = unlisted(rows["ctx"]), unlisted(rows["n"])
        words = rows["word"].combine_chunks().dictionary_encode()
        coded = ctx.flatten().dictionary_encode()
        word = np.repeat(words.indices.to_numpy(), pc.list_value_length(ctx).to_numpy())
        return Contexts(words.dictionary, coded.dictionary, word, coded.indices.to_numpy(), n.flatten().cast(pa.int64()).to_numpy())

    def vectors(self) -> list[pa.Array]:
        """Per word: the word, its contexts and their numbers, both as one string."""
        return [
            self.words.take(pa.array(self.word[self.first])), _listed(self.sizes, self.contexts.take(pa.array(self.ctx))),
            _listed(self.sizes, pa.array(self.n)),
        ]


def unlisted(column: pa.ChunkedArray) -> pa.ListArray:
    return pc.split_pattern(column.combine_chunks(), " ")


def _pairs_of(sentences: list[pa.Array], window: int) -> Contexts:
    sizes = np.concatenate([pc.list_value_length(s).to_numpy() for s in sentences])
    coded = pa.chunked_array([s.flatten() for s in sentences]).combine_chunks().dictionary_encode()
    sentence, code = np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy().astype(np.int64)
    n_words, keys = max(len(coded.dictionary), 1), []
    for d in range(1, window + 1):
        a, b = code[:-d], code[d:]
        within = sentence[:-d] == sentence[d:]
        keys.append((np.minimum(a, b) * n_words + np.maximum(a, b))[within])
    key = np.concatenate(keys)
    key, n = np.unique(key, return_counts=True)
    a, b = np.divmod(key, n_words)
    same = a == b  # a word beside itself counts twice
    return Contexts(coded.dictionary, coded.dictionary, np.concatenate([a, b[~same]]), np.concatenate([b, a[~same]]), np.concatenate([np.where(same, 2 * n, n), n[~same]]))


def merged_vectors(vectors: DataFrame, finish: Callable[[Contexts], list[pa.Array]], schema: str, whole: bool = False) -> DataFrame:
    """``finish`` over the counts of whole words, from rows (``word``, ``ctx``, ``n``: strings of contexts and numbers) that may repeat a word, unless ``whole``.

    What is shuffled is a word with its contexts as one string. A task holds ``PAIRED`` contexts, or one word's if these are more.
    """
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, limit = 0, PAIRED
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = pa.Table.from_batches([batch.slice(at, 1000)])
                held.append(rows)
                size += pc.sum(pc.add(pc.count_substring(rows["n"], " "), 1)).as_py()
                if size < limit:
                    continue
                some = pa.concat_tables(held)
                last = len(some) if whole else pc.index(some["word"], some["word"][-1]).as_py()  # the last word may go on
                if last:
                    yield from in_parts(finish(Contexts.of_vectors(some.slice(0, last))), names)
                rest = some.slice(last)
                if len(rest) > 1:
                    rest = pa.Table.from_arrays(Contexts.of_vectors(rest).vectors(), rest.column_names)
                held, size = [rest], sum(pc.add(pc.count_substring(rest["n"], " "), 1).to_pylist())
                limit = max(PAIRED, 2 * size)
        if held:
            yield from in_parts(finish(Contexts.of_vectors(pa.concat_tables(held))), names)

    return (vectors if whole else vectors.repartition("word").sortWithinPartitions("word")).mapInArrow(run, schema)


def cooccurrence(docs: DataFrame, id_col: str, window: int = 2, whole: bool = False) -> DataFrame:
    """(word, ctx, n): how often two words stand within ``window`` positions in one sentence. ``whole``: a row per word, contexts and numbers as strings.

    A task counts the pairs of many sentences and hands on every word once, with its contexts as one string: no pair is a row before it is counted.
    """
    sents = docs.select(F.explode(tx.sentences(F.col("text"))).alias("s"))
    sents = tx.once(sents, [], t=tx.words(F.col("s")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            held.append(batch.column(0))
            size += len(batch.column(0).flatten())
            if size >= PAIRED:
                yield from in_parts(_pairs_of(held, window).vectors(), ["word", "ctx", "n"])
                held, size = [], 0
        if size:
            yield from in_parts(_pairs_of(held, window).vectors(), ["word", "ctx", "n"])

    if whole:
        return merged_vectors(sents.mapInArrow(count, VECTOR), Contexts.vectors, VECTOR)
    rows = lambda c: [c.words.take(pa.array(c.word)), c.contexts.take(pa.array(c.ctx)), pa.array(c.n)]
    return merged_vectors(sents.mapInArrow(count, VECTOR), rows, "word string, ctx string, n bigint")


def successors(docs: DataFrame, prefix: int, id_col: str = "doc_id") -> DataFrame:
    """(w1[, w2], next, n): counts of the word that follows a prefix of 1 or 2 words."""
    toks = tx.once(docs, [], t=tx.words(F.col("text")))
    grams = toks.select(F.explode(tx.ngrams("t", prefix + 1)).alias("g"))
    names = [f"w{i + 1}" for i in range(prefix)]
    cols = [F.col(f"g.g{i}").alias(n) for i, n in enumerate(names)]
    return (
        grams.select(*cols, F.col(f"g.g{prefix}").alias("next"))
        .groupBy(*names, "next")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def likeliest(succ: DataFrame) -> DataFrame:
    """Per prefix: total, most likely successor (ties: smallest word) and its probability."""
    names = [c for c in succ.columns if c.startswith("w")]
    return succ.groupBy(*names).agg(
        F.sum("n").alias("total"),
        F.max("n").alias("n"),
        F.min(F.struct((-F.col("n")).alias("m"), F.col("next").alias("w"))).alias("_best"),
    ).select(*names, "total", F.col("_best.w").alias("best"), "n", (F.col("n") / F.col("total")).alias("p"))


def temperature_softmax(counts: DataFrame, prefix: list[str], t: float) -> DataFrame:
    """Adds ``p``: softmax of ln(n)/t inside each prefix, shifted by the maximum.

    The maximum and the sum are aggregates joined back, not windows, so a frequent
    prefix is combined map-side.
    """
    logit = F.log(F.col("n")) / F.lit(t)
    top = counts.groupBy(*prefix).agg(F.max(logit).alias("_mx"))
    e = counts.join(top, prefix).withColumn("_e", F.exp(logit - F.col("_mx")))
    total = e.groupBy(*prefix).agg(F.sum("_e").alias("_s"))
    return e.join(total, prefix).withColumn("p", F.col("_e") / F.col("_s")).drop("_mx", "_e", "_s")


def rarest_meetings(asked: DataFrame, anchors: DataFrame, by: list[str], owner: str) -> DataFrame:
    """(by, owner): owners that hold the rarest of a row's anchors; rows with an anchor that nobody holds meet nobody.

    ``asked(by, _a)``, ``anchors(owner, _a)``, both distinct. Only asked anchors travel; they are written once, counted, and joined.
    """
    held = materialise(anchors.join(asked.select("_a").distinct(), "_a", "left_semi"), "anchors")
    counts = held.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
    known = asked.join(counts, "_a", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = known.groupBy(*by).agg(F.min(F.struct("_n", "_a")).alias("_r")).where(F.col("_r._n") > 0)
    return rarest.select(*by, F.col("_r._a").alias("_a")).join(held, "_a").select(*by, owner)


def contained_in(docs: DataFrame, passages: DataFrame, doc_id: str, passage_id: str) -> DataFrame:
    """(passage, doc) for every passage that occurs verbatim in a document.

    Containment is no equality, so an anchor makes it one. The words strictly inside a contained passage are whole words of the
    document too: a passage with at least six of them meets documents on its rarest run of six, one with fewer on its rarest word.
    Without such words, its longest word is a part of a word of the document: the vocabulary's words that hold its rarest
    three letters are compared, then documents with a word that does. A passage without any word meets documents on its rarest
    character. Every meeting is then verified, so the result is exact.
    """
    p = passages.select(passage_id, F.col("text").alias("_p"), F.xxhash64("text").alias("_h")).where(F.length("_p") > 0).distinct()
    by = [passage_id, "_h"]
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(f"({tx.WORD})"), F.lit(1))
    sixes = F.transform(tx.ngrams("t", 6), lambda g: F.xxhash64(F.array(*[g[f"g{k}"] for k in range(6)])))
    hashes = F.transform("t", lambda w: F.xxhash64(w))
    cut = tx.once(p, [*by, "_p"], w=words("_p"))
    inner = cut.select(*by, F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))).alias("t")).where(F.size("t") > 0)
    asked = inner.select(*by, F.explode(F.array_distinct(F.when(F.size("t") >= 6, sixes).otherwise(hashes))).alias("_a"))
    split = tx.once(docs.select(doc_id, "text"), [doc_id], t=words("text"))
    met = rarest_meetings(asked, split.select(doc_id, F.explode(F.array_distinct(F.concat(sixes, hashes))).alias("_a")), by, doc_id)

    short = cut.where(F.size("w") < 3)
    if not short.isEmpty():
        plain = lambda c: F.transform(c, lambda g: F.array_join(F.array(g["g0"], g["g1"], g["g2"]), ""))
        # letters in runs of three, two and one: a word of one or two letters is a run itself
        runs = F.array_distinct(F.concat(
            plain(tx.ngrams("t", 3)), F.transform(tx.ngrams("t", 2), lambda g: F.concat(g["g0"], g["g1"])), F.col("t")))
        part = F.element_at(F.array_sort("w", lambda a, b: F.length(b) - F.length(a)), 1)
        edges = short.where(F.size("w") > 0).select(*by, part.alias("_e"))
        letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
        in_edges = tx.once(edges, [*by, "_e"], t=letters("_e")).select(
            *by, F.explode(F.filter(runs, lambda r: F.length(r) == F.least(F.length("_e"), F.lit(3)))).alias("_a"))
        postings = split.select(doc_id, F.explode(F.array_distinct("t")).alias("_w"))
        vocabulary = tx.once(postings.select("_w").distinct(), ["_w"], t=letters("_w")).select("_w", F.explode(runs).alias("_a"))
        holds = rarest_meetings(in_edges, vocabulary, by, "_w").join(edges, by).where(F.contains("_w", "_e"))
        met = met.unionByName(holds.select(*by, "_w").join(postings, "_w").select(*by, doc_id))
        others = lambda c: F.array_distinct(letters(F.regexp_replace(c, tx.WORD, "")))
        signs = short.where(F.size("w") == 0).select(*by, F.explode(others("_p")).alias("_a"))
        met = met.unionByName(rarest_meetings(signs, docs.select(doc_id, F.explode(others("text")).alias("_a")), by, doc_id))

    # only ids travel with the anchors; the texts join the few pairs that met
    texts = met.distinct().join(p, by).join(docs.select(doc_id, "text"), doc_id)
    return texts.where(F.contains("text", "_p")).select(passage_id, doc_id).distinct()


def top_k(scores: DataFrame, query_id: str, doc_id: str, k: int, score: str = "score") -> DataFrame:
    """Best k per query, ties by id; Spark keeps only k rows per query before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(F.round(F.col(score), 9).desc(), F.col(doc_id))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
