"""Embedders and rerankers by contract, several metrics in one pass, quotes against earlier turns."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.embed import HashingEmbedder, ModelEmbedder, TfidfEmbedder, make_embedder
from lexmill.operators import dialogues as dg
from lexmill.operators import retrieval as rt
from lexmill.operators import telemetry as tm


def test_embedders(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple pie"), (3, ""), (4, None)], "doc_id bigint, text string")
    tfidf = make_embedder("tfidf")
    assert isinstance(tfidf, TfidfEmbedder)
    with pytest.raises(RuntimeError):
        tfidf.dim  # noqa: B018
    assert tfidf.fit(docs, "doc_id").dim == 4
    dense = make_embedder("hashing", dim=61)
    assert isinstance(dense, HashingEmbedder) and dense.dim == 61
    d, q = (dict(map(tuple, e(docs, "doc_id").collect())) for e in (dense.encode_documents, dense.encode_queries))
    assert set(d) == {1, 2, 3, 4} and all(len(v) == 61 and abs(sum(x * x for x in v) - 1) < 1e-9 for v in d.values())
    assert d[1] != q[1] and d[3] == d[4]
    model = make_embedder("model", load=lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], dim=2)
    assert isinstance(model, ModelEmbedder) and model.dim == 2
    assert dict(map(tuple, model.encode_queries(docs.limit(1), "doc_id").collect())) == {1: [16.0, 1.0]}
    with pytest.raises(ValueError):
        make_embedder("nothing")


def test_pair_reranker(spark):
    docs = spark.createDataFrame([(1, "aaa b"), (2, "b b b"), (3, "c")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(7, "b"), (8, "c")], "item_id bigint, text string")
    hits = spark.createDataFrame([(q, d, d) for q in (7, 8) for d in (1, 2, 3)], "item_id bigint, doc_id bigint, pos int")

    def load():
        return lambda questions, texts: [t.split().count(q) for q, t in zip(questions, texts)]

    r = rt.PairReranker(load, docs, asked, "item_id", "doc_id")
    got = sorted((x["item_id"], x["final_rank"], x["doc_id"], x["s"]) for x in r.rerank(hits, 2).collect())
    assert got == [(7, 1, 2, 3.0), (7, 2, 1, 1.0), (8, 1, 3, 1.0), (8, 2, 1, 0.0)]


def test_accumulated(spark):
    rows = spark.createDataFrame([("a", 0.5, 2), ("a", 3.0, None), ("b", 9.0, 5), (None, None, 1)], "k string, v double, n int")
    got = {(r["metric"], r["label"], r["le"]): (r["n"], r["total"]) for r in tm.accumulated(rows, [("h", F.col("k"), F.col("v"), (1.0, 5.0)), ("c", F.lit("x"), F.col("n"), None)]).collect()}
    assert got == {
        ("h", "a", "1.0"): (1, 3.5), ("h", "a", "5.0"): (2, 3.5), ("h", "a", "+Inf"): (2, 3.5), ("h", "b", "1.0"): (0, 9.0), ("h", "b", "5.0"): (0, 9.0), ("h", "b", "+Inf"): (1, 9.0),
        ("c", "x", None): (3, 8.0),
    }


def test_quotes_against_earlier_turns(spark):
    contexts = spark.createDataFrame([(1, 0, "The Quick, brown fox jumps"), (1, 4, "later text about whales"), (2, 0, None), (None, 0, "quick brown fox")], "c bigint, t int, context string")
    cases = [
        (1, 1, "see <quote>quick brown fox</quote>", True), (1, 3, "<quote>uick brown f</quote>", True), (1, 2, "<quote>whales</quote>", False), (1, 5, "<quote>about whales</quote>", True),
        (1, 6, "<quote>brown quick</quote>", False), (1, 7, "no quote", None), (1, 8, "<quote>fo</quote>", True), (1, 9, "<quote>!!</quote>", True), (2, 1, "<quote>quick</quote>", False),
        (3, 1, "<quote>the</quote>", False), (1, 10, "<quote>x</quote>", True), (1, 11, "<quote>z</quote>", False), (1, 12, None, None),
    ]
    answers = spark.createDataFrame([c[:3] for c in cases], "c bigint, reply int, answer string")
    got = {(r["c"], r["reply"]): r["grounded"] for r in dg.quote_grounding(answers, contexts, "c", "reply", "t").collect()}
    assert got == {(c, r): want for c, r, _, want in cases}
