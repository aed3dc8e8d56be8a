"""Ranked search over geometric blocks against a plain loop over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import blockrank
from tests.llm.rows import frame, texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, "The QUICK brown fox, the river bank"), (2, "schnelle Fuchs über"), (3, None), (4, "  !! "), (5, "nowhere to be found xyzzy"), (6, "two words two"),
    (None, "日本語"), (7, "word12 word13 the"), (7, "lazy dog"), (8, "fox"), (8, "fox"),
]
SCHEMA = "item_id bigint, text string, doc_id string, score string"


def plain(rows, items, k):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_plain_loop(spark, k):
    got = Counter(map(tuple, blockrank.top_k(frame(spark), items(spark), k).collect()))
    assert got == plain([(r[0], r[1]) for r in texts()], ITEMS, k)


def test_groups_of_queries_and_shards_change_nothing(spark, sf, monkeypatch):
    docs, asked = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = Counter(map(tuple, blockrank.top_k(docs, asked).collect()))
    monkeypatch.setattr(blockrank, "GROUP_TERMS", 400)
    monkeypatch.setattr(blockrank, "SHARD_DOCS", 50)
    assert len(list(blockrank.groups(asked.select("item_id", "text")))) > 1
    assert whole == Counter(map(tuple, blockrank.top_k(docs, asked).collect()))
    assert whole == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in asked.select("item_id", "text").collect()], 10)


def test_empty_tables(spark):
    assert blockrank.top_k(frame(spark, []), items(spark)).count() == 0
    assert blockrank.top_k(frame(spark), items(spark, [])).count() == 0


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    topics = rng.integers(0, 6, 1500)
    impacts = (rng.random((1500, 60)) < 0.06) * rng.integers(1, 900, (1500, 60))
    for topic in range(6):  # documents of a topic share terms that others lack
        impacts[np.ix_(topics == topic, range(topic * 10, topic * 10 + 6))] += rng.integers(200, 600, ((topics == topic).sum(), 6))
    asked = [np.arange(60)] * 60
    shard = blockrank.Shard(np.arange(1500), np.ones(1500, bool), impacts.astype(np.int32), asked)
    for t, (blocks, most) in enumerate(shard.lists):
        assert sorted(np.concatenate(blocks).tolist()) == np.flatnonzero(impacts[:, t]).tolist()
        assert all((most[i] == impacts[b].max(0)).all() for i, b in enumerate(blocks))
    query, weights = np.array([0, 1, 2, 13, 24, 35]), np.array([9, 8, 7, 1, 1, 1])
    got = shard.search(query, weights, asked, 10)
    scores = impacts[:, query] @ weights
    best = np.lexsort((np.arange(1500), -scores))[:10]
    assert got == [(int(scores[d]), int(d), True) for d in best]
    assert 0 < shard.opened < sum(len(shard.lists[t][0]) for t in query) / 2  # most blocks stay shut
