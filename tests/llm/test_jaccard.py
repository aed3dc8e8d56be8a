import random
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import jaccard
from lexmill.llm.components import components
from lexmill.llm.shingles import shingle_sets
from tests.llm.rows import SCHEMA, frame


def plain_sets(text, width):
    words = (text or "").encode().lower().split()
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def plain(rows, width, percent):
    """Ids and components by comparing all pairs."""
    sets = [plain_sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent,leaf", [(3, 90, 64), (5, 80, 64), (3, 90, 4), (5, 80, 3)])
def test_equals_all_pairs(spark, monkeypatch, width, percent, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)  # small leaves send the groups through the Voronoi recursion
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rng = random.Random(width * leaf)
    texts = [t for edits in (1, 3, 6) for t in family(rng, 14, 90, edits)] + [" ".join(f"w{rng.randrange(400)}" for _ in range(50)) for _ in range(20)]
    shared = " ".join(f"p{i}" for i in range(45))
    texts += [shared + " " + t for t in texts[:12]] + ["a b", "a b", "A  B", "c", "", None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df, width=width, percent=percent)) == plain(rows, width, percent)


def test_odd_rows(spark):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(jaccard.join(df, width=3, percent=90)) == plain(rows, 3, 90)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 0 and ids[5] == ids[6] == ids[7] == 1 and ids[None] == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(df).count() == 0 and jaccard.one_of_each(df).count() == 0


def test_shingles_of_long_texts_are_whole():
    text = " ".join(f"v{i}" for i in range(400_000)) + " " + "z" * 50_000 + " end"
    (h,) = shingle_sets([text], 3)
    assert len(h) == 400_000
    a, b = shingle_sets(["q" * 20_000 + " b c", "Q" * 20_000 + " B C"], 3)
    assert len(a) == 1 and (a == b).all()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        new = dict(least)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == least:
            break
        least = new
    assert found == {x: r for x, r in least.items() if x in found}
    assert all(a in found for a, b in edges if a != b)


def plain_links(rows, width, percent):
    """Linked pairs of rows, by comparing all pairs."""
    sets = [plain_sets(t, width) for _, t in rows]
    near = lambda x, y: bool(x & y) and 100 * len(x & y) >= percent * len(x | y)
    return {(i, j): (len(sets[i]), len(sets[j]), len(sets[i] & sets[j])) for j in range(len(rows)) for i in range(j) if near(sets[i], sets[j])}


@pytest.mark.parametrize("width,percent,block,columns", [(3, 90, 256, 1 << 13), (5, 80, 256, 40), (3, 90, 4, 1 << 13), (5, 80, 3, 40)])
def test_every_link(spark, monkeypatch, width, percent, block, columns):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)  # small blocks cut the components into many cells
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    rng = random.Random(width * block)
    texts = [t for edits in (1, 2, 4) for t in family(rng, 14, 120, edits)] + family(rng, 3, 40, 0)
    long = [f"c{i}" for i in range(170)]
    texts += [" ".join(long[: 60 + 3 * i]) for i in range(30)]  # a chain over several size classes
    texts += ["a b", "a b", "A  B", "c", "", None, None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_links(rows, width, percent)
    each = Counter(i for pair in want for i in pair)
    out = jaccard.counted(df, width=width, percent=percent).collect()
    assert Counter((r.doc_id, r.n_links) for r in out) == Counter((i, each[i]) for i, _ in rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == plain(rows, width, percent)
    pairs, membership = jaccard.links(df, width=width, percent=percent)
    docs = {}
    for r in membership.collect():
        docs.setdefault(None if r.cls is None else bytes(r.cls), []).append(r.doc_id)
    found = pairs.collect()
    assert len({(bytes(r.cls_a), bytes(r.cls_b)) for r in found}) == len(found)
    crossed = {(i, j): (r.n_a, r.n_b, r.common) for r in found for i in docs[bytes(r.cls_a)] for j in docs[bytes(r.cls_b)]}
    crossed = {(min(p), max(p)): m if p[0] < p[1] else (m[1], m[0], m[2]) for p, m in crossed.items()}
    copies = {(min(i, j), max(i, j)) for c, ids in docs.items() if c for i in ids for j in ids if i != j}
    assert crossed == {p: m for p, m in want.items() if p not in copies}
    assert copies <= set(want)


def test_links_of_odd_rows(spark):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    each = Counter(i for pair in plain_links(rows, 3, 90) for i in pair)
    assert Counter((r.doc_id, r.n_links) for r in jaccard.counted(df, width=3, percent=90).collect()) == Counter((rows[i][0], each[i]) for i in range(len(rows)))
    assert jaccard.counted(spark.createDataFrame([], SCHEMA)).count() == 0 and jaccard.links(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_links_equal_sql(spark, sf):
    import duckdb

    from lexmill.llm import queries, sql

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(sql.JACCARD_LINKS)
    cols = [d[0] for d in cur.description]
    assert Counter(tuple(r) for r in queries.op2_jaccard_links(spark, sf).select(*cols).collect()) == Counter(cur.fetchall())


def leaf_sizes(spark, monkeypatch, rows):
    """Sizes of the regions whose pairs are joined, and the result."""
    sizes = []
    plainly = jaccard._leaf_pairs

    def spied(join, regions):
        sizes.extend(r["count"] for r in regions.groupBy("s").count().collect())
        return plainly(join, regions)

    monkeypatch.setattr(jaccard, "_leaf_pairs", spied)
    return got(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90)), sizes


def test_near_copies_meet_once_and_not_around_each_shingle(spark, monkeypatch):
    rng = random.Random(5)
    rows = list(enumerate(family(rng, 40, 120, 40)))  # too far apart to be linked, with many shingles in common
    result, sizes = leaf_sizes(spark, monkeypatch, rows)
    assert result == plain(rows, 3, 90)
    assert sizes and sum(n * n for n in sizes) <= 4 * 40 * 40


def test_large_regions_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 10)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 8)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(100))
    rows = list(enumerate(f"{base} " + " ".join(f"x{i}y{k}" for k in range(10 + i % 3)) for i in range(60)))
    rows += [(100 + i, f"{t} z") for i, t in rows[::7]]
    result, sizes = leaf_sizes(spark, monkeypatch, rows)
    assert result == plain(rows, 3, 90)
    assert max(sizes, default=0) <= 10


def test_forest_connects_what_is_linked():
    rng = random.Random(7)
    for _ in range(30):
        linked = np.array([[rng.random() < 0.12 for _ in range(9)] for _ in range(12)])
        kept = np.zeros_like(linked)
        for a, b in jaccard._forest(linked):
            assert linked[a, b] and not kept[a, b]
            kept[a, b] = True

        def reach(m):
            both = np.block([[np.eye(12, dtype=bool), m], [m.T, np.eye(9, dtype=bool)]])
            return np.linalg.matrix_power(both.astype(float), 21) > 0

        assert (reach(linked) == reach(kept)).all() and kept.sum() < 21
