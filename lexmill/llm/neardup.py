"""Near-duplicate vectors by an exact metric range join.

Vectors of one label (and one length) link when their cosine reaches a bound. For unit vectors that is a range of the Euclidean
distance, ``r = sqrt(2 - 2 cos)``, a metric. Equal vectors are one class with a weight; classes are joined in regions:

1. *Pivots.* A region draws up to ``PIVOTS`` of a hash-ordered sample of its classes: first those with many sample members within ``r`` (the
   hearts of groups of near copies), then others. Every class gets its distances to them, is at home at the nearest pivot, and there in the
   ring ``floor(d / r)``. Pivot and ring are its cell.
2. *Boundary.* The triangle inequality says where else it may have partners: around pivots with ``d <= d_home + 2 r``, in the rings from
   ``(d - r) / r`` to ``(d + r) / r``. A class is copied to those of these cells that come before its own in order, so a pair meets in
   exactly one cell, that of its earlier member. Cells without a home class go.
3. *Gain.* Cells are counted before any vector is copied. Where they would not compare ``GAIN`` times fewer pairs (unrelated vectors lie in most
   rings), the region stays whole.
4. *Recursion.* Cells that are home to many and smaller than their region are regions again. Each level marks copies with a bit; two rows with a bit in
   common meet in another cell.
5. *Cells.* Rows of a cell lie in blocks by their marks and a hash; every two blocks without a common mark meet in a task of their
   own, as products of matrices. A product returns, per class, the weight of its partners and one link to a representative of its
   connected part, so a group of m near copies gives m rows and not m squares.

Then weights are summed and components found from those links. Nothing but pivots (at most ``PIVOTS`` per region) is sent to several
blocks, and a task holds two blocks. Blocks grow with their cell from ``SPLIT`` of them on, up to ``LARGEST`` times ``BLOCK``.

Defined cases: a row whose label is null or whose vector is null, empty, zero, or holds null or non-finite components has no links and
is a component of its own; vectors of other lengths never link; a null id counts as a row but is never the least id unless the whole
component has none (then ``component_id`` is null and its rows are kept); repeated rows and ids are rows each; an empty table gives an empty
result; extra columns are ignored by :func:`join` and kept by :func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written
from lexmill.llm.components import components

COSINE = 0.93
TARGET = 1024  # classes of a region that is not parted
PIVOTS = 32
SAMPLE = 512  # classes that pivots are drawn from
DENSE = 4  # sample members around a pivot that is drawn first
DEPTH = 3
GAIN = 2  # times fewer pairs for which a region is parted
BLOCK = 4096  # mean classes of a block, and classes on a side of one product
SPLIT = 8  # blocks of a cell from which on they grow
LARGEST = 4  # mean blocks in one that has grown
TILE = 512  # rows multiplied at once
SLACK = 1e-9
REGION = ["label", "dim", "path"]


def _unit(vectors) -> np.ndarray:
    v = np.array(vectors.tolist(), float)
    v /= np.abs(v).max(1)[:, None]  # tiny and huge components survive squaring
    return v / np.sqrt(np.square(v).sum(1))[:, None]


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))


def _draw(r: float, target: int):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("c")
        v = _unit(sample["v"])
        near = _distances(v, v) <= r
        wanted = min(PIVOTS, len(v), max(2, -(-int(sample["homes"].iloc[0]) // target)))
        free, chosen = np.ones(len(v), bool), []
        while len(chosen) < PIVOTS:
            count = (near & free).sum(1) * free
            best = int(count.argmax())
            if count[best] < DENSE:
                break
            chosen.append(best)
            free &= ~near[best]
        others = [i for i in np.flatnonzero(free).tolist() if i not in chosen] + np.flatnonzero(~free).tolist()
        for i in others:
            if len(chosen) >= wanted:
                break
            if i not in chosen:
                chosen.append(i)
        return sample.iloc[chosen].assign(pivot=range(len(chosen)))[[*REGION, "pivot", "v"]]

    return run


def _assign(r: float):
    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"c": [], "home": [], "cells": []})
        pivots = pivots.sort_values("pivot")
        p, x = _unit(pivots["v"]), _unit(rows["v"])
        out, homes = [], []
        for at in range(0, len(x), BLOCK):
            d = _distances(x[at : at + BLOCK], p)
            home = d.argmin(1)
            least = d[np.arange(len(d)), home]
            ring = np.floor(least / r).astype(np.int64)
            low = np.maximum(0, np.floor((d - r - SLACK) / r)).astype(np.int64)
            high = np.floor((d + r + SLACK) / r).astype(np.int64)
            near = d <= least[:, None] + 2 * r + SLACK
            near &= np.arange(d.shape[1])[None, :] <= home[:, None]
            rings = 1 + int(2 / r + SLACK)
            for i in range(len(d)):
                h, k = int(home[i]), int(ring[i])
                cells = []
                for j in np.flatnonzero(near[i]).tolist():
                    last = min(int(high[i, j]), k - 1) if j == h else min(int(high[i, j]), rings)
                    cells += [j * (rings + 1) + z for z in range(int(low[i, j]), last + 1)]
                out.append(cells)
                homes.append(h * (rings + 1) + k)
        return pd.DataFrame({"c": rows["c"].to_numpy(), "home": homes, "cells": out})

    return run


def _homes(rows: DataFrame, r: float) -> DataFrame:
    """Per class (``cc``) the cell where it is at home and those that it is copied to."""
    order = Window.partitionBy(*REGION).orderBy(F.xxhash64("c"), "c")
    sample = rows.withColumn("i", F.row_number().over(order)).where(F.col("i") <= SAMPLE).select(*REGION, "homes", "c", "v")
    drawn = sample.groupBy(*REGION).applyInPandas(_draw(r, TARGET), _schema(rows, [*REGION, "v"], "pivot int"))
    drawn = written(drawn, "neardup-pivots")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("c"), blocks))
    sent = drawn.join(rows.select(*REGION, "size").distinct(), REGION)
    sent = sent.select(*REGION, "pivot", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    keys = [*REGION, "block"]
    cells = dealt.select(*keys, "c", "v").groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(
        _assign(r), "c binary, home bigint, cells array<bigint>",
    )
    return written(cells.withColumnRenamed("c", "cc"), "neardup-homes")


def _placed(rows: DataFrame, homes: DataFrame) -> DataFrame:
    met = rows.join(homes, F.col("c") == F.col("cc"))
    return met.withColumn("cell", F.explode(F.concat(F.array("home"), "cells"))).withColumn("own", F.col("cell") == F.col("home"))


def _worth(rows: DataFrame, homes: DataFrame) -> DataFrame:
    """Regions whose cells compare ``GAIN`` times fewer pairs than they do whole."""
    sizes = _placed(rows.select(*REGION, "size", "c"), homes).groupBy(*REGION, "size", "cell")
    sizes = sizes.agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("own").alias("at_home")).where("at_home > 0")
    pairs = sizes.groupBy(*REGION, "size").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    return written(pairs.where(F.col("pairs") * GAIN <= F.col("size") * F.col("size").cast("double")).select(*REGION), "neardup-worth")


def _parted(rows: DataFrame, homes: DataFrame, level: int) -> DataFrame:
    """Regions cut into cells: rows (label, dim, path, parent, c, v, w, marks), copies included."""
    out = _placed(rows, homes).select(
        "label", "dim", F.concat("path", F.col("cell").cast("string"), F.lit(".")).alias("path"), F.col("size").alias("parent"), "c", "v", "w",
        (F.col("marks") + F.when(F.col("own"), 0).otherwise(1 << level)).alias("marks"), "own",
    )
    return written(out, "neardup-cells")


def _schema(df: DataFrame, names: list[str], *more: str) -> str:
    return ", ".join([*[f"{n} {df.schema[n].dataType.simpleString()}" for n in names], *more])


def _sized(rows: DataFrame) -> DataFrame:
    """Rows with their region's rows (``size``) and classes at home there (``homes``); regions where nobody is at home go."""
    sizes = rows.groupBy(*REGION).agg(F.count(F.lit(1)).alias("size"), F.count_if("own").alias("homes")).where("homes > 0 and size > 1")
    return written(rows.drop("own").join(sizes, REGION), "neardup-regions")


def cells(classes: DataFrame, r: float) -> DataFrame:
    """Classes (label, dim, c, v, w) in the cells where they meet others, with their ``marks``."""
    rows = _sized(classes.withColumns({"path": F.lit(""), "marks": F.lit(0).cast("bigint"), "parent": F.lit(1 << 62).cast("bigint"), "own": F.lit(True)}))
    done = []
    for level in range(DEPTH):
        large = (F.col("homes") > TARGET) & (F.col("size") <= 0.8 * F.col("parent"))
        todo = rows.where(large)
        if todo.isEmpty():
            break
        done.append(rows.where(~large))
        single = _single(todo.drop("parent"))
        homes = _homes(single, r)
        worth = _worth(single, homes)
        done.append(todo.join(worth, REGION, "left_anti"))
        if worth.isEmpty():
            rows = None
            break
        rows = _sized(_named(_parted(single.join(worth, REGION, "left_semi"), homes, level)))
    if rows is not None:
        done.append(rows)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _single(rows: DataFrame) -> DataFrame:
    """Keys of rows: a class may be in several regions, so its key takes its region in."""
    return rows.withColumn("c", F.concat("c", F.unhex(F.lpad(F.hex(F.xxhash64("path")), 16, "0"))))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("c", F.substring("c", 1, 16))


def _meetings(rows: DataFrame) -> DataFrame:
    """Rows in every pair of blocks where they meet others: (label, dim, path, unit, side)."""
    n = F.count(F.lit(1))
    nb = F.least(F.ceil(n / BLOCK), F.greatest(F.lit(SPLIT), F.ceil(n / (LARGEST * BLOCK))))
    blocks = rows.groupBy(*REGION, "marks").agg(nb.cast("int").alias("nb"))
    blocks = written(blocks, "neardup-blocks")
    others = blocks.select(*REGION, F.col("marks").alias("marks2"), F.col("nb").alias("nb2"))
    met = rows.join(blocks, [*REGION, "marks"]).withColumn("own", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
    met = met.join(others, REGION).where(F.col("marks").bitwiseAND(F.col("marks2")) == 0)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb2") - 1)))
    mine, theirs = F.struct("marks", "own"), F.struct(F.col("marks2").alias("marks"), F.col("other").alias("own"))
    low, high = F.when(mine <= theirs, mine).otherwise(theirs), F.when(mine <= theirs, theirs).otherwise(mine)
    side = F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1)
    return met.select(
        F.xxhash64(*REGION, F.lit(0)).alias("u"), "label", "dim", "path", low["marks"].alias("ma"), low["own"].alias("ia"), high["marks"].alias("mb"), high["own"].alias("ib"),
        side.alias("side"), "c", "v", "w",
    )


UNIT = ["u", *REGION, "ma", "ia", "mb", "ib"]


def _parts(linked: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Connected parts of a block pair: a part's number per left row and per right row, -1 where there is no link."""
    n_left, n_right = linked.shape
    left, right = np.full(n_left, -1), np.full(n_right, -1)
    part = 0
    for start in np.flatnonzero(linked.any(1)).tolist():
        if left[start] >= 0:
            continue
        left[start] = part
        if itself:
            right[start] = part
        rows = np.array([start])
        while len(rows):
            cols = np.flatnonzero(linked[rows].any(0) & (right < 0))
            right[cols] = part
            if itself:
                left[cols] = part
                rows = cols
            else:
                rows = np.flatnonzero(linked[:, cols].any(1) & (left < 0))
                left[rows] = part
        part += 1
    return left, right


def _product(v: np.ndarray, w: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, itself: bool, bound: float) -> pd.DataFrame | None:
    linked = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), TILE):
        linked[at : at + TILE] = v[a[at : at + TILE]] @ v[b].T >= bound
    if itself:
        np.fill_diagonal(linked, False)
    some_a, some_b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(some_a):
        return None
    linked = linked[np.ix_(some_a, some_b)]
    a, b = a[some_a], b[some_b]
    got = np.zeros(len(v), np.int64)
    got[a] += linked @ w[b]
    if not itself:
        got[b] += w[a] @ linked
    part_a, part_b = _parts(linked, itself)
    heads = np.empty(part_a.max() + 1, object)
    heads[part_a[::-1]] = c[a[::-1]]
    head = np.empty(len(v), object)
    head[b], head[a] = heads[part_b], heads[part_a]
    some = np.union1d(a, b)
    return pd.DataFrame({"c": c[some], "n": got[some], "head": head[some]})


def _join_unit(unit: pd.DataFrame, bound: float) -> pd.DataFrame | None:
    """Two blocks, or one with itself, by products of at most ``BLOCK`` classes on a side."""
    side = unit["side"].to_numpy()
    a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if len(unit) < 2 or not len(a) or not len(b):
        return None
    v, w, c = _unit(unit["v"]), unit["w"].to_numpy(), unit["c"].to_numpy()
    itself, out = side[0] == 2, []
    for i in range(0, len(a), BLOCK):
        for j in range(i if itself else 0, len(b), BLOCK):
            out.append(_product(v, w, c, a[i : i + BLOCK], b[j : j + BLOCK], itself and i == j, bound))
    out = [x for x in out if x is not None]
    return pd.concat(out) if out else None


def _units(batches: Iterator[pd.DataFrame], bound: float) -> Iterator[pd.DataFrame]:
    """Units come one after the other, each ordered together; each is joined when whole."""
    held: list[pd.DataFrame] = []

    def flush() -> Iterator[pd.DataFrame]:
        if held:
            out = _join_unit(pd.concat(held) if len(held) > 1 else held[0], bound)
            held.clear()
            if out is not None:
                yield out

    for batch in batches:
        if not len(batch):
            continue
        starts = batch[UNIT].ne(batch[UNIT].shift()).any(axis=1).to_numpy()
        starts[0] = not held or (held[-1][UNIT].iloc[-1].to_numpy() != batch[UNIT].iloc[0].to_numpy()).any()
        at = [0, *(i for i in np.flatnonzero(starts).tolist() if i), len(batch)]
        for i, (x, y) in enumerate(zip(at, at[1:])):
            if i or starts[0]:
                yield from flush()
            held.append(batch.iloc[x:y])
    yield from flush()


def _sound(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def classify(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Rows (``id``, ``c``: class or null) and per linked class its component ``root`` and the weight ``n`` of its partners."""
    v, label = F.col(vector_col), F.col(label_col)
    takes_part = F.coalesce(label.isNotNull() & _sound(v), F.lit(False))
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(s), label, v)), 16, "0") for s in (1, 2)]
    rows = vectors.select(F.col(id_col).alias("id"), F.when(takes_part, F.unhex(F.concat(*halves))).alias("c"), label.alias("label"), v.alias("v"))
    classes = rows.where("c is not null").groupBy("c").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("w"))
    classes = written(classes.withColumn("dim", F.size("v")), "neardup-classes")
    r = math.sqrt(2.0 - 2.0 * cosine)
    met = _meetings(cells(classes, r)).repartition(*UNIT).sortWithinPartitions(*UNIT)
    met = met.select(*UNIT, "side", "c", "v", "w")
    found = written(met.mapInPandas(lambda it: _units(it, cosine), "c binary, n bigint, head binary"), "neardup-found")
    linked = found.groupBy("c").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("c").alias("a"), F.col("head").alias("b")))
    linked = linked.join(roots.select(F.col("node").alias("c"), "root"), "c")
    return rows.select("id", "c"), written(linked, "neardup-linked")


def join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id`` (least id it is linked to, itself included), and whether it is that one."""
    rows, linked = classify(vectors, id_col, vector_col, label_col, cosine)
    copies = rows.where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("least")).join(linked, "c", "left")
    copies = copies.withColumn("root", F.coalesce("root", "c"))
    least = copies.groupBy("root").agg(F.min("least").alias("component_id"))
    copies = copies.join(least, "root").select("c", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(copies, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicated(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """The table without rows whose id is not the least of their component; all columns kept."""
    gone = join(vectors, id_col, vector_col, label_col, cosine).where("not kept").select("vec_id").distinct()
    return vectors.join(gone, vectors[id_col] == gone["vec_id"], "left_anti")
