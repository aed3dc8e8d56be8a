"""Paged tables read few files; a refreshed store equals one built anew."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import refresh as rf
from lexmill.plans.storage import line_chunks, word_counts
from lexmill.sources import pages as pg


@pytest.fixture(scope="module")
def paged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paged") / "t")
    rows = spark.range(0, 20_000).select((F.col("id") * 3).alias("id"), (F.col("id") % 10).alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    pg.write_pages(rows.repartition(7), "id", path, page_rows=100, files=20)
    return pg.Paged(spark, path, "id")




def test_layout(paged):
    assert len(paged.files()) == 20 and sum(n for *_, n in paged.files()) == 20_000
    ends = [(a, b) for _, a, b, _ in paged.files()]
    assert all(b < a for (_, b), (a, _) in zip(ends, ends[1:]))
    assert paged.pages.where("n > 100").isEmpty()


def test_paging_gives_every_row_once(paged):
    after, seen = None, []
    while rows := paged.page(after, 1500, F.col("kind") == 3).collect():
        assert len(rows) <= 1500
        seen += [r["id"] for r in rows]
        after = seen[-1]
    assert seen == [3 * i for i in range(3, 20_000, 10)]


def test_a_page_opens_few_files(paged):
    some = paged.page(3 * 9000, 100)
    assert [r["id"] for r in some.collect()] == [3 * i for i in range(9001, 9101)]
    assert len({r["_file"] for r in paged._ahead(3 * 9000, 2)}) <= 2
    read = paged._within(paged._ahead(3 * 9000, 2), 3 * 9000)
    assert read.select(F.input_file_name()).distinct().count() <= 2
    keys = [30, 33, 34, 59_997, 10**9, -1]
    assert sorted(r["id"] for r in paged.lookup(keys).collect()) == [30, 33, 59_997]
    assert paged.lookup(keys).select(F.input_file_name()).distinct().count() <= 2
    assert paged.lookup([1]).count() == 0 and paged.lookup([]).count() == 0


def test_bounds(paged):
    got = {r["page"]: (r["first_id"], r["last_id"], r["n"]) for r in paged.bounds(F.col("kind") == 3, 64).collect()}
    ids = [3 * i for i in range(3, 20_000, 10)]
    assert got == {p: (ids[64 * p], ids[64 * p : 64 * p + 64][-1], len(ids[64 * p : 64 * p + 64])) for p in range(-(-len(ids) // 64))}
    assert paged.bounds(F.col("kind") == 99, 64).count() == 0


def state(store):
    return (
        sorted(map(tuple, store.chunks().select("doc_id", "chunk_index", "text").collect())), sorted(map(tuple, store.frequencies().select("term", "df").collect())),
        sorted(map(tuple, store.documents().select("doc_id", "digest").collect())),
    )


def test_refresh_equals_rebuild(spark, tmp_path):
    settings = {"v": 1}
    steps = [
        [(i, f"alpha line{i}\nbeta word{i % 5}") for i in range(200)],
        [(i, f"alpha line{i}\nbeta word{i % 5}") for i in range(3, 200)],  # some vanish
        [(i, f"alpha line{i}" if i == 50 else f"alpha line{i}\nbeta word{i % 5}") for i in range(3, 203)],  # one gets shorter, some come
        [(i, f"alpha line{i}" if i == 50 else f"alpha line{i}\nbeta word{i % 5}") for i in range(3, 203)],  # nothing changes
        [(7, None), (8, "gamma")],
        [],
        [(1, "back again")],
    ]
    store = rf.Store(spark, str(tmp_path / "a"), line_chunks, word_counts, settings)
    modes = []
    for n, rows in enumerate(steps):
        docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id bigint, text string")
        before = {r["bucket"]: r["written"] for r in store.manifest()}
        modes.append(store.refresh(docs))
        fresh = rf.Store(spark, str(tmp_path / f"b{n}"), line_chunks, word_counts, settings)
        fresh.refresh(docs)
        assert state(store) == state(fresh)
        if n == 3:  # no bucket is written again
            assert {r["bucket"]: r["written"] for r in store.manifest() if r["bucket"] >= 0} == {b: w for b, w in before.items() if b >= 0}
        if n == 2:
            after = {r["bucket"]: r["written"] for r in store.manifest()}
            assert 0 < sum(after.get(b) == w for b, w in before.items()) < len(before)
    assert modes == ["rebuild"] + ["incremental"] * 6
    assert rf.Store(spark, str(tmp_path / "a"), line_chunks, word_counts, {"v": 2}).refresh(docs) == "rebuild"


def test_a_refresh_that_died_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id bigint, text string")
    store = rf.Store(spark, path, line_chunks, word_counts, {})
    store.refresh(docs)
    want = state(store)
    more = spark.createDataFrame([(1, "one"), (3, "four")], "doc_id bigint, text string")
    commit, store._commit = store._commit, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.refresh(more)
    assert state(store) == want
    store._commit = commit
    assert store.refresh(more) == "incremental"
    assert state(store)[0] == [(1, 0, "one"), (3, 0, "four")]
