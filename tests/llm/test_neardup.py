"""Near-duplicate vectors against all pairs of a small table."""

import math
import random

import numpy as np
import pytest

from lexmill.llm import neardup

SCHEMA = "vec_id bigint, embedding array<float>, label int, c string, n string, root string, path string"


def plain(rows, cosine=0.93):
    def sound(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v, label) in enumerate(rows) if sound(v, label)]
    unit = {}
    for i in ok:
        v = np.array(rows[i][1], np.float32).astype(float)
        v /= np.abs(v).max()
        unit[i] = v / np.sqrt(v @ v)
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                near[i].add(j)
                near[j].add(i)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return sorted(map(str, out.values()))


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", "p") for i, v, label in rows], SCHEMA)


def made(n, seed, dim=12, groups=8):
    rnd = np.random.default_rng(seed)
    hearts = rnd.standard_normal((groups, dim))
    rows = []
    for i in range(n):
        g = int(rnd.integers(0, groups * 2))
        v = hearts[g] + 0.12 * rnd.standard_normal(dim) if g < groups else rnd.standard_normal(dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rnd.integers(0, 3)) if i % 3 else 0))
    rows += [(n + i, rows[i % 40][1], rows[i % 40][2]) for i in range(200)]  # copies
    return rows


@pytest.mark.parametrize("target, block, seed", [(1024, 4096, 1), (20, 16, 2), (40, 500, 3)])
def test_equals_all_pairs(spark, monkeypatch, target, block, seed):
    monkeypatch.setattr(neardup, "TARGET", target)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = made(700, seed)
    got = neardup.join(table(spark, rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(rows)
    assert any(r["n_links"] > 20 for r in got) and any(r["n_links"] == 0 for r in got)


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 1), (2, one, 2), (3, [2.0, 4.0, 6.0], 1), (3, [2.0, 4.0, 6.0], 1), (None, one, 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, one, None), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1), (13, [1e-30, 2e-30, 3e-30], 1),
        (14, [1e30, 2e30, 3e30], 1), (None, None, None), (None, [5.0, 0.0, 0.0], 1), (15, [0.0, 1.0], 1), (16, [0.0, 1.0], 1),
    ]
    got = neardup.join(table(spark, rows)).collect()
    want = plain(rows)
    assert sorted(str(tuple(r)) for r in got) == want
    kept = neardup.deduplicated(table(spark, rows))
    assert kept.columns == ["vec_id", "embedding", "label", "c", "n", "root", "path"]
    ids = [r["vec_id"] for r in kept.collect()]
    assert 3 not in ids and 13 not in ids and 16 not in ids and {1, 2, 4, 12, 15} <= set(ids)


def test_empty(spark):
    assert neardup.join(table(spark, [])).count() == 0


def test_each_pair_meets_once():
    """The cells that a level deals classes to hold every pair within r, and each in one cell that is home to one of them."""
    import pandas as pd

    rnd = random.Random(5)
    r = 0.4
    v = np.random.default_rng(5).standard_normal((300, 4))
    p = pd.DataFrame({"pivot": range(7), "v": list(v[:7])})
    rows = pd.DataFrame({"c": [str(i) for i in range(300)], "v": list(v)})
    out = neardup._assign(r)(rows, p)
    cells = [(h, set(c)) for h, c in zip(out["home"], out["cells"])]
    unit = neardup._unit(rows["v"])
    d = neardup._distances(unit, unit)
    for i, j in [(rnd.randrange(300), rnd.randrange(300)) for _ in range(20_000)]:
        if i != j and d[i, j] <= r:
            (hi, ci), (hj, cj) = cells[i], cells[j]
            assert (hi == hj) + (hi in cj) + (hj in ci) == 1


def classes_of(spark, n, dim):
    rnd = np.random.default_rng(9)
    rows = [(1, dim, i.to_bytes(16, "big"), [float(x) for x in rnd.standard_normal(dim)], 1) for i in range(n)]
    return spark.createDataFrame(rows, "label int, dim int, c binary, v array<double>, w long")


def test_a_region_that_cells_do_not_thin_out_is_not_copied(spark, monkeypatch):
    """Unrelated vectors of many dimensions lie in most rings around most pivots: copies would multiply rows and spare no pair."""
    monkeypatch.setattr(neardup, "TARGET", 100)
    assert neardup.cells(classes_of(spark, 600, 64), 0.374).count() == 600
    assert neardup.cells(classes_of(spark, 600, 2), 0.05).select("path").distinct().count() > 1  # here they do


@pytest.mark.parametrize("gain", [0, 2, 1e9])
def test_parted_or_whole_the_result_is_the_same(spark, monkeypatch, gain):
    for name, value in (("TARGET", 20), ("BLOCK", 32), ("SPLIT", 2), ("LARGEST", 2), ("GAIN", gain)):
        monkeypatch.setattr(neardup, name, value)
    rows = made(500, 4)
    assert sorted(str(tuple(r)) for r in neardup.join(table(spark, rows)).collect()) == plain(rows)


def test_blocks_grow_with_their_cell(spark, monkeypatch):
    for name, value in (("BLOCK", 10), ("SPLIT", 2), ("LARGEST", 4)):
        monkeypatch.setattr(neardup, name, value)
    rows = classes_of(spark, 400, 3).selectExpr("*", "'' as path", "0L as marks", "400L as size", "400L as homes")
    met = neardup._meetings(rows)
    assert met.count() == 400 * 10 and met.select("ia", "ib").distinct().count() == 55  # 40 blocks of 10 would send every row 40 times
    assert neardup._join_unit(met.where("ia = 0 and ib = 0").toPandas(), -1.0)["n"].sum() % 2 == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_a_unit_in_pieces(monkeypatch, block):
    import pandas as pd

    monkeypatch.setattr(neardup, "BLOCK", block)
    v = np.random.default_rng(3).standard_normal((50, 3))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.8
    for itself in (True, False):
        side = np.full(50, 2) if itself else np.arange(50) % 2
        unit = pd.DataFrame({"side": side, "c": [str(i) for i in range(50)], "v": list(v), "w": np.arange(50) + 1})
        got = neardup._join_unit(unit, 0.8).groupby("c")["n"].sum()
        meets = near & ~np.eye(50, dtype=bool) if itself else near & (side[:, None] != side[None, :])
        assert {c: n for c, n in got.items() if n} == {str(i): n for i in range(50) if (n := int(meets[i] @ unit["w"]))}
