"""Fusion arithmetic, access invariants, exact matching and both vector paths."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import access as ac
from lexmill.operators import datasets as ds
from lexmill.operators import lexical as lx
from lexmill.operators import retrieval as rt
from lexmill.operators import triage as tr
from lexmill.operators import vectors as vx


def test_reciprocal_rank_fusion(spark):
    runs = spark.createDataFrame(
        [(1, "dense0", "a", 1, 0.9), (1, "dense0", "b", 2, 0.8), (1, "bm25", "b", 1, 7.0), (1, "bm25", "c", 2, 5.0)],
        "q int, run string, id string, rank int, score double")
    got = {r.id: r for r in rt.fuse(runs, "q", "id").collect()}
    assert got["a"].rrf == round(1 / 61, 6) and got["b"].rrf == round(1 / 62 + 1 / 61, 6) and got["c"].rrf == round(1 / 62, 6)
    assert got["a"].bm25 is None and got["c"].similarity is None and got["b"].ranks == "bm25=1,dense0=2"


def test_no_denied_document_in_any_run(spark, sf):
    from lexmill.plans.access import acl_docs, acl_run

    run, _, _ = acl_run(spark, sf)
    allowed = ac.visible(acl_docs(spark, sf), ac.principals(spark), ac.can_read())
    assert run.join(allowed, ["role", "doc_id"], "left_anti").isEmpty() and not run.isEmpty()
    ranks = run.groupBy("role", "item_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert ranks.where("m <> n").isEmpty()


def test_row_without_tenant_belongs_to_whoever_asks(spark):
    docs = spark.createDataFrame([(1, None, "all", 0), (2, "acme", "all", 0)], "doc_id int, doc_tenant string, department string, sensitivity int")
    got = {(r.role, r.doc_id) for r in ac.visible(docs, ac.principals(spark), ac.can_read()).collect()}
    assert ("employee", 1) in got and ("other_tenant", 1) in got and ("employee", 2) not in got


def test_containment_is_exact_for_short_and_long_passages(spark):
    texts = ["the quick brown fox jumps over the lazy dog near the river bank", "abc", "fox", "", "été au bord de la mer"]
    passages = ["uick brown fox jumps over the lazy dog near the ri", "x jumps", "a", "fox", "té", "no such thing at all in any of these texts here", "the quick brown fox jumps over the lazy dog near the river bank"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    p = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string")
    got = {(r.item_id, r.doc_id) for r in lx.contained_in(d, p, "doc_id", "item_id").collect()}
    assert got == {(i, j) for i, x in enumerate(passages) for j, t in enumerate(texts) if x in t}


def test_containment_equals_brute_force(spark):
    rng = random.Random(7)
    open_with = "all rights reserved by the authors of this text and "  # an opening that every document shares
    words = ["ab", "abc", "bca", "é", "x1", "_", "日本", "the"]
    texts = [open_with + "".join(rng.choice(words) + rng.choice([" ", ", ", " - ", "\n", "😀", ""]) for _ in range(30)) for _ in range(40)] + ["", None, "--", "a"]
    passages = [None, "", " ", "-", "😀", "\n", "--", "zz", "z z", open_with, open_with + "ab"]
    for _ in range(120):
        t = rng.choice(texts[:40])
        a = rng.randrange(len(t))
        passages.append(t[a : a + rng.choice([1, 2, 3, 5, 9, 20, 60, 90])])
    rows = [(i // 2, t) for i, t in enumerate(passages)]  # two passages to an id
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r.item_id, r.doc_id) for r in lx.contained_in(d, spark.createDataFrame(rows, "item_id int, text string"), "doc_id", "item_id").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in rows for j, t in enumerate(texts) if x and t and x in t}


def test_common_anchors_meet_nobody(spark):
    """A passage with a shared opening meets the documents that hold its rarest run, not all that share the opening."""
    asked = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 9)], "item_id int, _a long")
    held = spark.createDataFrame([(d, 7) for d in range(50)] + [(3, 8)], "doc_id int, _a long")
    assert [(r.item_id, r.doc_id) for r in lx.rarest_meetings(asked, held, ["item_id"], "doc_id").collect()] == [(1, 3)]


def test_both_vector_paths_agree_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    q = v.where("id < 20").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(vx, "BLOCK", 64)
    one = {(r.query_id, r["rank"]): r.id for r in vx.nearest(v, q, 5).collect()}
    two = {(r.query_id, r["rank"]): r.id for r in vx.nearest(v, q, 5, block=7).collect()}
    want = {(i, k + 1): int(n) for i in range(20) for k, n in enumerate(np.argsort(-(x @ x[i]), kind="stable")[:5])}
    assert one == two == want


def test_masked_vector_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(4).tolist(), int(i % 5)) for i in range(200)]
    v = spark.createDataFrame(rows, "id long, vec array<double>, cell int")
    q = v.where("id < 12").select(F.col("id").alias("query_id"), "vec", F.array((F.col("cell") + 1) % 5, F.lit(0)).alias("allowed"))
    monkeypatch.setattr(vx, "BLOCK", 50)
    a = sorted(map(tuple, vx.nearest(v, q, 4, tag="cell").select("query_id", "rank", "id").collect()))
    b = sorted(map(tuple, vx.nearest(v, q, 4, block=3, tag="cell").select("query_id", "rank", "id").collect()))
    assert a == b and len(a) == 48


def test_split_is_disjoint_and_stratified(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 3, "rare").otherwise("common").alias("kind"))
    val = ds.stratified_holdout(df, "id", "kind", 20)
    sizes = {r.kind: r["count"] for r in val.groupBy("kind").count().collect()}
    assert sizes == {"rare": 1, "common": 20}
    assert df.join(val, "id", "left_anti").join(val, "id", "left_semi").isEmpty()


def test_rubric_points(spark):
    cases = [
        ('{"answer": null, "confidence": 0.0}', "off_topic", 5), ('{"answer": "да", "confidence": 0.9}', "on_topic", 5),
        ('{"answer": "да", "confidence": 0.9}', "vague", 4), ('{"answer": "да", "confidence": true}', "on_topic", 3),
        ('Вот: {"answer": "да", "confidence": 0.9}', "on_topic", 0), ("[1]", "on_topic", 1), ('{"answer": "да"}', "partial", 2),
    ]
    df = spark.createDataFrame(cases, "t string, k string, want int").select("want", tr.rubric(F.col("t"), F.col("k")).alias("r"))
    assert all(r.want == r.r.score for r in df.collect())


def test_each_business_rule_fires_alone(spark):
    rows = [
        ("outage", "normal", ["host 5"], True, "x", "R1"), ("performance", "critical", ["host 5"], True, "x", "R2"),
        ("access", "high", ["please"], True, "x", "R3"), ("billing", "low", ["z"], False, "списали дважды", "R4"),
        ("question", "low", ["z"], True, "x", "R5"), ("access", "high", ["логин"], False, "x", "R6"), ("billing", "high", ["счёт 5"], True, "x", "R7"),
        ("other", "low", ["z"], False, "x", ""),
    ]
    df = spark.createDataFrame(rows, "c string, p string, f array<string>, h boolean, t string, want string")
    got = df.select("want", tr.policy(F.col("c"), F.col("p"), F.col("f"), F.col("h"), F.col("t")).alias("b")).collect()
    assert all(r.want == r.b for r in got)


def test_quotes_ignore_case_dashes_and_yo(spark):
    df = spark.createDataFrame([("«Счёт» не оплачен — 5 дней.", "счет не оплачен - 5 дней"), ("abc", "abc")], "f string, t string")
    assert [r[0] for r in df.select(tr.grounded(F.col("f"), F.col("t"))).collect()] == [True, False]


def test_schema_check_reasons(spark):
    good = {"category": "access", "priority": "low", "facts": ["x"], "needs_human": False, "summary": "long enough"}
    cases = [(json.dumps(good), ""), ("none", "no_object"), ("{broken}", "not_json"), (json.dumps({**good, "extra": 1}), "keys"),
             (json.dumps({**good, "priority": "urgent"}), "priority"), (json.dumps({**good, "facts": []}), "facts"), (json.dumps({**good, "summary": "ab"}), "summary")]
    df = spark.createDataFrame(cases, "raw string, want string").select("want", tr.parse_triage(F.col("raw")).alias("p"))
    assert all(r.want == r.p.reason for r in df.collect())


def vector_table(spark, folder, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 6)) + 4 * np.eye(6)[rng.integers(0, 6, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_cells_are_fitted_once_and_read_by_probe(spark, tmp_path, monkeypatch):
    v = vector_table(spark, f"{tmp_path}/v")
    cells = vx.stored_cells(v, 6)
    monkeypatch.setattr(vx, "kmeans_cells", None)  # a second fit would fail
    again = vx.stored_cells(spark.read.parquet(f"{tmp_path}/v"), 6)
    assert np.array_equal(cells.centroids, again.centroids)
    placed = {(r.id, r.cell) for r in vx.assign_cells(v, cells.fitted_with).collect()}
    assert placed == {(r.id, r.cell) for r in again.vectors.collect()} and len(placed) == 400
    assert sum(r.n for r in again.sizes().collect()) == 400 and again.sizes().count() == 6

    def read(nprobe):
        q = vx.probes(v.where("id = 1").select(F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("vec")), cells.centroids, nprobe)
        found = again.probed_by(q)
        assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString() or nprobe == 6 or "PartitionFilters: [cell" in found._jdf.queryExecution().toString()
        return found.select("_metadata.file_path").distinct().count()

    assert read(1) < read(3) < read(6)


def test_cells_follow_the_files_and_stand_empty_tables(spark, tmp_path):
    first = vx.stored_cells(vector_table(spark, f"{tmp_path}/v"), 4).centroids
    other = vx.stored_cells(vector_table(spark, f"{tmp_path}/v", seed=9), 4).centroids
    assert not np.array_equal(first, other)
    empty = vx.stored_cells(vector_table(spark, f"{tmp_path}/e").where("id < 0"), 4)
    assert empty.vectors.count() == 0 and empty.sizes().count() == 0
