"""Scores added up in cells of texts and questions against plain sums."""

import random
from collections import defaultdict

import pytest

from lexmill.operators import lexical as lx
from lexmill.operators import retrieval as rt


def tables(spark, seed=3):
    r = random.Random(seed)
    # repeated ids, null ids, equal weights (ties) and weights of zero
    posts = [(r.choice([None, *range(12)]), r.randrange(6), r.choice([0.0, 0.5, 1.0, 2.0])) for _ in range(150)]
    asked = [(r.choice([None, "a", "b", "c"]), r.randrange(8), r.choice([1.0, 2.0])) for _ in range(15)]
    return posts, asked, spark.createDataFrame(posts, "doc_id long, _t long, _w double"), spark.createDataFrame(asked, "item_id string, _t long, _w double")


def plain(posts, asked):
    out = defaultdict(float)
    for q, t, f in asked:
        for d, u, w in posts:
            if t == u:
                out[q, d] += w * f
    return out


@pytest.mark.parametrize("terms", [4, 500_000])
def test_every_pair(spark, monkeypatch, terms):
    monkeypatch.setattr(lx, "CELL_TERMS", terms)
    monkeypatch.setattr(lx, "CELL_PAIRS", 3)
    posts, asked, p, q = tables(spark)
    got = lx.cell_scores(p, q, "doc_id", "item_id", len(posts)).collect()
    assert sorted((str(r.item_id), str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(q), str(d), round(s, 9)) for (q, d), s in plain(posts, asked).items())


@pytest.mark.parametrize("best", [1, 3])
def test_best_of_each_class(spark, best):
    posts, asked, p, q = tables(spark, 5)
    lang = [(d, "xy"[d % 2]) for d in range(10)] + [(3, "x"), (4, None)]
    within = spark.createDataFrame(lang, "doc_id long, lang string")
    scores = lx.cell_scores(p, q, "doc_id", "item_id", len(posts), best, within)
    got = rt.top_k_within(scores.join(within.distinct(), "doc_id"), ["item_id", "lang"], "doc_id", best).collect()
    want = defaultdict(list)
    for (item, d), s in plain(posts, asked).items():
        for x in {x for i, x in lang if i == d}:
            want[item, x].append((-round(s, 9), d))
    assert {(r.item_id, r.lang, r.doc_id, r["rank"]) for r in got} == {(*k, d, i) for k, v in want.items() for i, (_, d) in enumerate(sorted(v)[:best], 1)}


@pytest.mark.parametrize("terms", [4, 500_000])
def test_norms_travel_to_the_cell(spark, monkeypatch, terms):
    monkeypatch.setattr(lx, "CELL_TERMS", terms)
    posts, asked, p, q = tables(spark, 7)
    norm = {d: d % 4 + 0.5 for d in range(9)} | {9: 0.0}  # 10 and 11 have none
    norms = spark.createDataFrame([*norm.items(), (None, 2.0), (99, 3.0)], "doc_id long, dn double")
    scores = lx.cell_scores(p, q, "doc_id", "item_id", len(posts), norms=norms)
    want = {(str(q), d, round(s / norm[d], 9)) for (q, d), s in plain(posts, asked).items() if norm.get(d)}
    assert sorted((str(r.item_id), r.doc_id, round(r.score, 9)) for r in scores.collect()) == sorted(want) != []
    assert "Join" not in scores._jdf.queryExecution().executedPlan().toString()


def test_a_cell_hands_on_its_best_only(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i % 7}") for i in range(400)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha w3"), (2, "alpha alpha w5 w6")], "item_id long, text string")
    every, few = (lx.bm25_scores(docs, asked, "doc_id", "item_id", best=k) for k in (None, 3))
    assert every.count() == 800 and few.count() <= 2 * 3 * spark.sparkContext.defaultParallelism
    top = [{(r.item_id, r.doc_id, r["rank"]) for r in lx.top_k(x, "item_id", "doc_id", 3).collect()} for x in (every, few)]
    assert top[0] == top[1] and len(top[0]) == 6


def test_candidates_only(spark):
    docs = spark.createDataFrame([(i, f"alpha w{i % 3}") for i in range(9)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha w1"), (2, "w2")], "item_id long, text string")
    pairs = spark.createDataFrame([(1, 4), (1, 4), (2, 5), (2, 0), (2, 77)], "item_id long, doc_id long")
    every, few = ({(r.item_id, r.doc_id): round(r.score, 9) for r in lx.tfidf_overlap(docs, asked, "doc_id", "item_id", pairs=p).collect()} for p in (None, pairs))
    assert few == {k: every[k] for k in [(1, 4), (2, 5)]}


def test_cooccurrence_is_counted_once_and_similarity_reads_it(spark):
    texts = ["a b a a. c a", "b a b", "d", None, "e e e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = defaultdict(int)
    for text in texts:
        for words in (s.split() for s in (text or "").split(".")):
            for i, x in enumerate(words):
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(words):
                        want[x, words[j]] += 1
    cooc = lx.cooccurrence(docs, "doc_id")
    assert {(r.word, r.ctx): r.n for r in cooc.collect()} == want
    plan = lx.cooccurrence(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    vector = {w: {c: n for (x, c), n in want.items() if x == w} for w in {w for w, _ in want}}
    norm = {w: sum(n * n for n in v.values()) ** 0.5 for w, v in vector.items()}
    other = {w: min(v, key=lambda c: (-v[c], c)) for w, v in vector.items()}
    similar = {w: round(sum(n * vector[o].get(c, 0) for c, n in vector[w].items()) / norm[w] / norm[o], 6) for w, o in other.items()}
    assert {r.word: (r.other, r.similarity) for r in rt.word_similarity(cooc).collect()} == {w: (other[w], similar[w]) for w in vector}


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_similarity_of_words_that_come_in_many_parts(spark, monkeypatch, most):
    """Pairs travel as strings of a word's contexts, few at a time, and neighbours of many words are met in parts."""
    monkeypatch.setattr(lx, "PAIRED", most)
    texts = [f"the w{i} w{i % 7} the. w{i % 3} of the w{i % 11}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = defaultdict(int)
    for text in texts:
        for words in (s.split() for s in text.split(".")):
            for i, x in enumerate(words):
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(words):
                        want[x, words[j]] += 1
    rows, whole = lx.cooccurrence(docs, "doc_id"), lx.cooccurrence(docs, "doc_id", whole=True)
    assert {(r.word, r.ctx): r.n for r in rows.collect()} == want
    got = whole.collect()
    assert {(r.word, c): int(n) for r in got for c, n in zip(r.ctx.split(), r.n.split(), strict=True)} == want and len(got) == len({x for x, _ in want})
    vector = {w: {c: n for (x, c), n in want.items() if x == w} for w in {w for w, _ in want}}
    norm = {w: sum(n * n for n in v.values()) ** 0.5 for w, v in vector.items()}
    other = {w: min(v, key=lambda c: (-v[c], c)) for w, v in vector.items()}
    similar = {w: round(sum(n * vector[o].get(c, 0) for c, n in vector[w].items()) / norm[w] / norm[o], 6) for w, o in other.items()}
    for cooc in (rows, whole):
        assert {r.word: (r.other, round(r.similarity, 6)) for r in rt.word_similarity(cooc).collect()} == {w: (other[w], similar[w]) for w in vector}
