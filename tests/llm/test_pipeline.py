"""The stages of the pipeline, one after another, against plain statements of what each must do."""

import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexmill.llm import bpe
from lexmill.llm.langid import identify
from tests.llm.rows import SCHEMA, frame
from tests.llm.test_jaccard import plain


def test_stages(spark, sf):
    docs = frame(spark).unionByName(spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True).cache()
    seen = {}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, sf).cache()
        assert step.columns == docs.columns
        seen[name] = step.collect()
    guess = {(r.doc_id, r.lang_pred) for r in identify(docs).collect()}
    assert {r.doc_id for r in seen["language"]} <= {i for i, g in guess if g != "und"}
    assert len(seen["language"]) >= sum(g != "und" for _, g in guess) - 3
    classes = plain([(r.doc_id, r.text) for r in seen["language"]], 5, 80)
    groups = Counter(c for _, n, c in classes.elements() if n)
    assert len(seen["near_duplicates"]) == len(groups) and len({r.text for r in seen["near_duplicates"]}) == len(groups)
    assert {r.doc_id for r in seen["near_duplicates"]} == set(groups)
    assert len(seen["secrets"]) == len(seen["near_duplicates"])
    assert not any(re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text) for r in seen["secrets"])
    assert {r.text for r in seen["mix"]} <= {r.text for r in seen["secrets"]} and max(Counter(r.text for r in seen["mix"]).values()) <= 2
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.STAGES[-1][1](spark, step, sf).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((r.doc_id, len(lib.encode(r.text, add_special_tokens=False).ids)) for r in seen["mix"])


def test_empty(spark, sf):
    step = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf)
    assert step.count() == 0


def test_encoding_keeps_ids_and_text(spark, sf):
    docs = frame(spark)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert set(docs.columns) < set(out.columns)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    plain = bpe.digests(docs, path)
    assert Counter(map(tuple, plain.collect())) == Counter(map(tuple, out.select(*plain.columns).collect()))
