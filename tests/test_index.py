"""Scores from the posting index equal scores from the texts."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import lexical as lx
from lexmill.operators import retrieval as rt
from lexmill.plans.ranking import line_run
from lexmill.session import materialise

DOCS = [(1, "Red apple, red pie"), (2, "green apple 10.0.0.1"), (3, ""), (4, None), (5, "billing-api apple")]
SCHEMA = "doc_id bigint, text string"


def asked(spark):
    return spark.createDataFrame([(7, "red apple"), (8, "billing-api 10.0.0.1 apple apple"), (9, None)], "item_id bigint, text string")


@pytest.mark.parametrize("score", [lx.bm25_scores, lx.tfidf_cosine, lx.tfidf_overlap])
def test_same_scores(spark, tmp_path, score):
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))

    def rows(df):
        return sorted((r["item_id"], r["doc_id"], round(r["score"], 9)) for r in df.select("item_id", "doc_id", "score").collect())

    index = lx.indexed(docs, "doc_id")
    assert rows(score(index, asked(spark), "doc_id", "item_id")) == rows(score(docs, asked(spark), "doc_id", "item_id")) != []


def test_an_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(path)
    before = len(lx._INDEXES)
    assert lx.indexed(spark.read.parquet(path), "doc_id").n_docs == 5 and lx.indexed(spark.read.parquet(path), "doc_id").n_docs == 5
    assert len(lx._INDEXES) == before + 1
    spark.createDataFrame([(6, "more")], SCHEMA).write.mode("append").parquet(path)
    assert lx.indexed(spark.read.parquet(path), "doc_id").n_docs == 6


def test_empty_collection(spark):
    index = lx.indexed(spark.createDataFrame([], SCHEMA), "doc_id")
    assert index.n_docs == 0 and all(f(index, asked(spark), "doc_id", "item_id").count() == 0 for f in (lx.bm25_scores, lx.tfidf_cosine, lx.tfidf_overlap))


@pytest.mark.parametrize("tokens", [3, 1_000_000])
def test_terms_are_counted_without_a_shuffle(spark, monkeypatch, tmp_path, tokens):
    monkeypatch.setattr(lx, "COUNTED", tokens)
    rows = [*DOCS, (None, "a a b"), (None, "b a c"), (None, "b"), (7, "a b a"), (7, "a b b"), (7, "a"), (8, "x " * 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert "Exchange" not in lx.counted(stored, "doc_id", lx.tx.words)._jdf.queryExecution().executedPlan().toString()
    index = lx.indexed(stored, "doc_id")
    for tokenizer in lx.Index.KINDS:
        want = lx.postings(docs, "doc_id", tokenizer).select("doc_id", "dl", "term", "tf").collect()
        assert sorted(map(str, index.of(tokenizer).collect())) == sorted(map(str, want)) != []


def test_only_the_asked_token_class_is_counted(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(str(tmp_path / "d"))
    index = lx.indexed(spark.read.parquet(str(tmp_path / "d")), "doc_id")
    assert lx.bm25_scores(index, asked(spark), "doc_id", "item_id").count() == 6
    assert set(index.kinds) == {"code"} and index.dn is None
    assert lx.tfidf_cosine(index, asked(spark), "doc_id", "item_id").count() == 6 and set(index.kinds) == {"code", "words"}


def test_lines_are_searched_by_an_index(spark, tmp_path):
    docs = spark.createDataFrame([*DOCS, (1, "Red apple, red pie"), (1, "red\n\nred pie 10.0.0.1"), (None, "red\napple red")], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    asked(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    before = set(lx._INDEXES)
    run, lines = line_run(spark, str(tmp_path), 3)
    (key,) = set(lx._INDEXES) - before
    assert key[0] == "chunk_id" and set(lx._INDEXES[key].kinds) == {"code"}
    plain = lx.top_k(lx.bm25_scores(rt.lines_of(docs), asked(spark), "chunk_id", "item_id"), "item_id", "chunk_id", 3).join(rt.lines_of(docs), "chunk_id")
    got, want = (sorted((str(r.item_id), r["rank"], r.chunk_id, str(r.doc_id), r.text, round(r.score, 9)) for r in x.collect()) for x in (run, plain))
    assert got == want != []


def test_hits_go_to_their_rows(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(rt, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or materialise(df, name))
    rows = spark.range(2_000_000).withColumn("text", F.concat(F.lit("t"), "id"))
    run = spark.range(2_000_000).where("id % 500000 = 7").select("id", F.lit(1).alias("rank"))
    assert sorted(map(tuple, rt.hydrated(run, rows, "id").collect())) == [(i, 1, f"t{i}") for i in (7, 500007, 1000007, 1500007)]
    assert "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]
