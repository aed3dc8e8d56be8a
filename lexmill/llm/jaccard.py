"""Jaccard metric-space join of documents as sets of word shingles.

Sets with Jaccard distance ``d = 1 - J`` form a metric space, and so do sets with the size of the symmetric difference. The join works
on classes of equal sets, in regions around pivots:

1. *Singleton pivots.* A set's nearest one-element pivots are its own shingles, all at one distance; ties go to rarer
   shingles, by counts over all documents in a sketch of fixed size. Sets within distance ``e`` differ in so few elements that of the
   first ``n - ceil((1 - e) n) + 1`` pivots of each they share one. Replicated to the regions of these pivots, all pairs meet.
2. *Star.* In each region with two classes or more, every class meets the region's first class. Before sets are fetched,
   triangle-inequality windows drop pairs: sizes (distance to the empty set) and the numbers of shingles in 32 hash
   classes (distances to 32 pivots that part the universe, whose differences add up) must not differ by more than the
   symmetric difference may be. Then sets are intersected.
3. *Components* of the links so far. A region whose classes all belong to one component is finished: further links
   in it cannot change the result. Regions left that share their least class, by key and then by a hash, are taken together
   wherever that makes no more pairs, so that near copies are compared once and not around each shingle they share.
4. *Voronoi recursion.* A large region with several components draws ``PIVOTS`` of its classes; every class gets its distances to
   them and goes to the cell of the nearest, and to each cell whose pivot is at most ``2 e`` farther. Classes at least ``1 - 2 e``
   from all pivots form a cell of their own, as if around a pivot at distance 1 from everything; farther classes stay out of other
   cells unless within ``1 - e``. Cells are regions again. A cell that keeps most of its region is not drawn again.
5. *Leaves.* In small regions, pairs of different components are compared, through the same windows. In regions that stay large,
   sets meet block by block, as in :func:`counted`, and a block hands on links that connect what it links.

Each document gets the least id of its component. Sets are exact up to equality of 64-bit hashes; classes are told apart by 128 bits.

Steps 3 to 5 leave out pairs that cannot change the components, so they do not find every link. :func:`links` and :func:`counted` do: a
link never leaves its component, so all pairs of different classes of each component meet once, in cells. A small component is one
cell; a larger one is cut by size class (linked sets are at most one apart) and hash into blocks, and every two blocks that
may hold a link are a cell. Sets meet whole inside their cell, as products of shingle columns; the number of links of a
document counts every other document within the distance, copies included, without a row per pair.

Defined cases: null, empty and blank texts have no shingles and are a component each; null ids are ignored in the least id (null if
there is no other); repeated rows give a row each; an empty table gives an empty result; texts count whole; extra columns
are ignored by :func:`join` and kept by :func:`one_of_each`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import masked, unmasked, written
from lexmill.llm.components import components
from lexmill.llm.shingles import shingle_sets

WIDTH, PERCENT = 5, 80
SKETCH_BITS = 20
CHUNK = 1 << 16
CLASSES = 32
LEAF = 64  # classes of a region whose pairs are compared
PIVOTS = 8
DEPTH = 4
BROADCAST_CLASSES = 1_000_000  # classes whose digests are broadcast where sets are fetched; beyond that sets are joined by shuffle
SEEN = 200_000  # classes that a task remembers so as not to hand on copies
BLOCK_CLASSES = 256  # mean classes of a block, and mean shingles of its sets together
BLOCK_SHINGLES = 1 << 20
COLUMNS = 1 << 13  # shingles that a cell multiplies at once
CELL = ["root", "z", "y", "i", "j"]


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _class(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def features(docs: DataFrame, keep: list[str], text_col: str, width: int) -> DataFrame:
    """The columns to keep, a hash of the text (``t``), class, class key, set size, and shingles per hash class."""

    def one(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for h in shingle_sets(texts.tolist(), width):
            c = _class(h)
            rows.append((c, _key(c) if c else None, len(h), np.bincount((h & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)))
        cls, k, n, counts = zip(*rows) if rows else ([], [], [], [])
        return pd.DataFrame({"cls": list(cls), "k": pd.array(k, "Int64"), "n": list(n), "counts": list(counts)})  # keys keep all 64 bits beside nulls

    kind = T.StructType([T.StructField("cls", T.BinaryType()), T.StructField("k", T.LongType()), T.StructField("n", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield one(texts)

    return docs.select(*keep, F.xxhash64(text_col).alias("t"), run(F.col(text_col)).alias("_f")).select(*keep, "t", "_f.*")


def sketch(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Documents per shingle slot, over all documents: 2^20 sums, whatever the corpus."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for h in shingle_sets(batch["text"].tolist(), width):
                np.add.at(total, _slots(h), 1)
        if total.any():
            parts = total.reshape(-1, CHUNK)
            yield pd.DataFrame({"chunk": np.arange(len(parts), dtype=np.int32), "part": np.random.randint(0, 256), "counts": [p.astype("<i8").tobytes() for p in parts]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<i8") for c in rows["counts"])
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": rows["part"].iloc[:1], "counts": [total.tobytes()]})

    kind = "chunk int, part int, counts binary"
    parts = docs.select(F.col(text_col).alias("text")).mapInPandas(count, kind)
    sums = parts.groupBy("chunk", "part").applyInPandas(add, kind).groupBy("chunk").applyInPandas(add, kind)
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in sums.toLocalIterator():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], "<i8")
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def pivots_of(docs: DataFrame, text_col: str, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(region ``s``, class key ``k``): the singleton pivots that each set is replicated to. A task skips classes it has just seen."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            regions, keys = [], []
            for h in shingle_sets(batch["text"].tolist(), width):
                if not len(h) or (k := _key(_class(h))) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                first = np.lexsort((h, shared.value[_slots(h)]))[: len(h) - least_overlap(len(h), percent) + 1]
                regions.append(h[first])
                keys.append(np.full(len(first), k, np.int64))
            if regions:
                yield pd.DataFrame({"s": np.concatenate(regions).view(np.int64), "k": np.concatenate(keys)})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "s bigint, k bigint")


@F.pandas_udf(T.LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


class Join:
    """One join: its documents, classes and parameters."""

    def __init__(self, docs: DataFrame, classes: DataFrame, text_col: str, width: int, percent: int):
        self.docs, self.classes, self.text_col, self.width, self.percent = docs, classes, text_col, width, percent

    def fits(self, a: str, b: str) -> Column:
        """What sizes and hash classes of two sets allow: in a link, the symmetric difference has at most a share of both sizes."""
        n_a, n_b = F.col(f"n{a}"), F.col(f"n{b}")
        apart = sum((F.abs(F.col(f"counts{a}")[i] - F.col(f"counts{b}")[i]) for i in range(CLASSES)), F.lit(0))
        sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * self.percent
        return sizes & (apart * (100 + self.percent) <= (n_a + n_b) * (100 - self.percent))

    def windowed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of class keys that the windows leave, with their classes."""
        c = self.classes.select("k", "cls", "n", "counts")
        a, b = (c.select(F.col("k").alias(x), *[F.col(y).alias(f"{y}_{x}") for y in ("cls", "n", "counts")]) for x in "ab")
        met = pairs.join(a, "a").join(b, "b").where(self.fits("_a", "_b"))
        return met.select("a", "b", "cls_a", "cls_b", "n_a", "n_b")

    def unwindowed(self, pairs: DataFrame) -> DataFrame:
        c = self.classes.select("k", "cls", "n")
        a, b = (c.select(F.col("k").alias(x), F.col("cls").alias(f"cls_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b")

    def measured(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs with the size of their intersection, ``common``."""
        pairs = written(pairs, f"jaccard-{name}-pairs")
        wanted = pairs.select(F.col("cls_a").alias("cls")).union(pairs.select("cls_b")).distinct()
        wanted = written(wanted, f"jaccard-{name}-wanted")
        sets = self._sets(wanted)
        a, b = (sets.select(F.col("cls").alias(f"cls_{x}"), F.col("h").alias(f"h_{x}")) for x in "ab")
        met = pairs.join(a, "cls_a").join(b, "cls_b")
        return written(met.select("a", "b", "n_a", "n_b", _shared("h_a", "h_b").alias("common")), f"jaccard-{name}-measured")

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """The sets of the wanted classes, computed again from texts with the hashes of theirs: few are ever needed."""
        width = self.width
        small = wanted.count() <= BROADCAST_CLASSES
        docs = self.docs.select(F.col(self.text_col).alias("text"))
        if small:
            hashes = self.classes.join(wanted.select("cls"), "cls", "left_semi").select(F.col("t").alias("_t")).distinct()
            docs = docs.join(F.broadcast(hashes), F.xxhash64("text") == F.col("_t"), "left_semi")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[bytes] = set()
            for batch in batches:
                out, size = [], 0
                for h in shingle_sets(batch["text"].tolist(), width):
                    c = _class(h)
                    if c is None or c in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    out.append((c, h.tobytes()))
                    size += 8 * len(h)
                    if size > 1 << 23:
                        yield pd.DataFrame(out, columns=["cls", "h"])
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=["cls", "h"])

        sets = docs.mapInPandas(run, "cls binary, h binary")
        sets = sets.join(F.broadcast(wanted.select("cls")) if small else wanted.select("cls"), "cls", "left_semi")
        return written(sets.dropDuplicates(["cls"]), "jaccard-sets")

    def linked(self) -> Column:
        return F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * self.percent


def _different(regions: DataFrame) -> DataFrame:
    """One of the regions that have the same members: sets with a long run in common meet around each of its shingles."""
    same = regions.groupBy("s").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y"), F.first("first").alias("first"),
    )
    return regions.join(same.groupBy("size", "x", "y", "first").agg(F.min("s").alias("s")).select("s"), "s", "left_semi")


def _mixed_regions(regions: DataFrame, links: DataFrame) -> DataFrame:
    """Members (s, k, first) of regions with several components, with ``root`` and the region's ``size``."""
    roots = components(links).select(F.col("node").alias("k"), "root")
    rooted = regions.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    rooted = written(rooted, "jaccard-rooted")
    several = rooted.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y")
    return written(rooted.join(several.select("s", "size"), "s"), "jaccard-mixed")


def _merged(regions: DataFrame, by: Column, name: str) -> DataFrame:
    """Mixed regions (s, k, first, root, size), those with the same least member by ``by`` taken together wherever that makes no more pairs.

    Near copies meet around each shingle that they share; a pair of them is then looked at once, not once a shingle. ``first`` stays a class
    that the row's own class was compared with.
    """
    least = regions.groupBy("s").agg(F.min_by("k", by).alias("g"))
    placed = written(regions.join(least, "s"), f"jaccard-placed-{name}")
    members = written(placed.groupBy("g", "k").agg(F.min("first").alias("first"), F.min("root").alias("root")), f"jaccard-members-{name}")
    apart = placed.where("k = g").groupBy("g").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    whole = members.groupBy("g").agg(F.count(F.lit(1)).alias("size")).join(apart, "g").where("size * size <= apart").drop("apart")
    whole = written(whole, f"jaccard-whole-{name}")
    together = members.join(whole, "g").select(F.xxhash64("g", F.lit(name)).alias("s"), "k", "first", "root", "size")
    rest = placed.join(whole.select("g"), "g", "left_anti").select("s", "k", "first", "root", "size")
    return written(together.unionByName(rest), f"jaccard-merged-{name}")


def _voronoi(join: Join, regions: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Links found at the pivots of large regions, and the members of the cells, with the ``parent``'s size."""
    e, slack = 1 - join.percent / 100, 1e-9
    order = Window.partitionBy("s").orderBy("k")
    pivots = regions.withColumn("i", F.row_number().over(order)).where(F.col("i") <= PIVOTS).select("s", F.col("k").alias("p"))
    met = written(regions.select("s", "k", "size").join(pivots, "s"), f"jaccard-met-{level}")
    pairs = met.where("k <> p").select(F.least("k", "p").alias("a"), F.greatest("k", "p").alias("b")).distinct()
    measured = join.measured(join.unwindowed(pairs), f"pivots-{level}")
    far = measured.select("a", "b", (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("d"))
    far = far.select(F.col("a").alias("k"), F.col("b").alias("p"), "d").unionByName(far.select(F.col("b").alias("k"), F.col("a").alias("p"), "d"))
    near = met.join(far, ["k", "p"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))  # a pivot has no distance to itself
    near = near.groupBy("s", "k", "size").agg(F.min("d").alias("least"), F.collect_list(F.struct("p", "d")).alias("ds"))  # at most PIVOTS
    cells = F.filter("ds", lambda x: (x["d"] <= F.col("least") + 2 * e + slack) & (x["d"] < 1 - e + slack))
    alone = F.when(F.col("least") >= 1 - 2 * e - slack, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = near.select(F.col("s").alias("old"), "k", F.col("size").alias("parent"), F.explode(F.concat(F.transform(cells, lambda x: x["p"]), alone)).alias("p"))
    out = out.select(F.xxhash64("old", "p", F.lit(level)).alias("s"), "k", F.lit(None).cast("long").alias("first"), "parent")
    return measured.where(join.linked()).select("a", "b"), out


def _leaf_pairs(join: Join, regions: DataFrame) -> DataFrame:
    """Pairs of different components that meet in a region and pass the windows; those of a class and its first are known."""
    # most of a group of near copies is one component by now; every pair that counts has a member outside the region's largest one
    parts = regions.groupBy("s", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = parts.groupBy("s").agg(F.max_by("root", F.struct("members", "root")).alias("main"))
    step = math.log(100 / join.percent)
    full = regions.join(largest, "s").join(join.classes.select("k", "n", "counts"), "k").withColumn("x", F.log("n") / step)
    full = written(full, "jaccard-leaves")
    a, b = (full.select("s", "first", "main", "x", *[F.col(c).alias(f"{c}{x}") for c in ("k", "root", "n", "counts")]) for x in "ab")
    a = a.where("roota <> main").drop("main")
    # a linked set's size class is at most one away
    a = a.withColumn("z", F.explode(F.sequence(F.floor(F.col("x") - 1 - 1e-9), F.floor(F.col("x") + 1 + 1e-9)))).drop("x")
    a, b = a.withColumnRenamed("first", "firsta"), b.withColumnRenamed("first", "firstb")
    b = b.withColumn("z", F.floor("x")).drop("x")
    once = (F.col("rootb") == F.col("main")) | (F.col("ka") < F.col("kb"))
    known = F.col("ka").eqNullSafe(F.col("firstb")) | F.col("kb").eqNullSafe(F.col("firsta"))
    met = a.join(b, ["s", "z"]).where(once & (F.col("roota") != F.col("rootb")) & ~known & join.fits("a", "b"))
    pairs = met.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
    return join.unwindowed(pairs)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at the places ``left`` with those at ``right``."""
    sizes = [len(h) for h in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(len(sets)), sizes), times[column] > 1
    renamed = np.cumsum(times > 1) - 1
    row, column = row[several], renamed[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        block = np.zeros((len(sets), int(column[b - 1]) - low + 1), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        out += (block[left] @ block[right].T).astype(np.int64)
    return out


def _cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cells of rows that come ordered by cell, each one whole."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[CELL].to_numpy()
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            part = batch.iloc[a:b]
            if held and (held[-1][CELL].iloc[-1].to_numpy() != part[CELL].iloc[0].to_numpy()).any():
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def _met(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[tuple]:
    """For each cell with links: classes, sizes and weights of its rows, their places left and right, and which are linked with how much in common."""
    for cell in _cells_of(batches):
        side = cell["side"].to_numpy()
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(left) or not len(right) or len(cell) < 2:
            continue
        sets = [np.frombuffer(h, np.uint64) for h in cell["h"]]
        n = np.array([len(h) for h in sets], np.int64)
        common = _common(sets, left, right)
        linked = common * 100 >= (n[left][:, None] + n[right][None, :] - common) * percent
        if side[0] == 2:  # a block with itself
            np.fill_diagonal(linked, False)
        if linked.any():
            yield cell["cls"].to_numpy(), n, cell["weight"].to_numpy(), left, right, linked, common, side[0] == 2


def _in_cells(join: Join, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Classes with their sets and numbers of documents (``weight``) in every cell where they meet others, ordered by cell."""
    step = (math.log(100 / join.percent) or 1.0) * (1 + 1e-9)  # size classes: linked sets are less than one step apart
    weights = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"))
    members = weights.join(roots, "cls")
    totals = members.groupBy("root").agg(F.count(F.lit(1)).alias("all"), F.sum("n").alias("all_n")).where("all > 1")
    whole = (F.col("all") <= BLOCK_CLASSES) & (F.col("all_n") <= BLOCK_SHINGLES)
    members = members.join(totals, "root").withColumn("z", F.when(whole, F.lit(-1)).otherwise(F.floor(F.log("n") / step)).cast("int"))
    members = written(members.select("cls", "root", "z", "n", "weight"), "jaccard-members")
    blocks = members.groupBy("root", "z").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"),
    )
    blocks = written(blocks, "jaccard-blocks")
    above, below = (blocks.select("root", (F.col("z") + d).alias("z"), F.col("nb").alias(x)) for x, d in (("up", -1), ("down", 1)))
    placed = members.join(blocks.join(above, ["root", "z"], "left").join(below, ["root", "z"], "left"), ["root", "z"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))

    def cells(n: str, cell) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda o: F.struct(*[c.cast("int").alias(x) for x, c in zip((*CELL[1:], "side"), cell(o))]))
        return F.coalesce(some, F.array().cast("array<struct<z:int,y:int,i:int,j:int,side:int>>"))

    z, own = F.col("z"), F.col("own")
    same = cells("nb", lambda o: (z, z, F.least(own, o), F.greatest(own, o), F.when(own == o, 2).when(own < o, 0).otherwise(1)))
    higher = cells("up", lambda o: (z, z + 1, own, o, F.lit(0)))
    lower = cells("down", lambda o: (z - 1, z, o, own, F.lit(1)))
    placed = placed.select("cls", "weight", "root", F.explode(F.concat(same, higher, lower)).alias("c")).select("cls", "weight", "root", "c.*")
    sets = join._sets(members.select("cls").distinct())
    return placed.join(sets, "cls").repartition(*CELL).sortWithinPartitions(*CELL)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) of the matrix that connect all that it links: fewer than its rows and columns."""
    rows, columns, out = linked.any(axis=1), linked.any(axis=0), []
    for start in np.flatnonzero(rows).tolist():
        if not rows[start]:
            continue
        rows[start] = False
        waiting = [(start, True)]
        while waiting:
            at, is_row = waiting.pop()
            free = columns if is_row else rows
            new = np.flatnonzero((linked[at] if is_row else linked[:, at]) & free).tolist()
            free[new] = False
            out += [(at, x) if is_row else (x, at) for x in new]
            waiting += [(x, not is_row) for x in new]
    return out


def _block_links(join: Join, regions: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked in large regions: their sets meet block by block, and no pair of theirs is a row."""
    percent = join.percent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cls, _, _, left, right, linked, _, _ in _met(batches, percent):
            keys = np.array([_key(c) for c in cls], np.int64)
            rows, columns = np.array(_forest(linked), np.int64).T
            yield pd.DataFrame({"a": keys[left[rows]], "b": keys[right[columns]]})

    places = written(regions.select("s", "k"), "jaccard-large")
    if places.isEmpty():
        return places.select(F.col("k").alias("a"), F.col("k").alias("b"))
    members = places.join(join.classes.select("k", "cls"), "k").select("cls", F.col("s").alias("root"))
    cells = _in_cells(join, join.classes, members).select(*CELL, "side", "cls", "weight", "h")
    return written(cells.mapInPandas(run, "a bigint, b bigint").distinct(), "jaccard-block-links")


def classify(docs: DataFrame, keep: list[str], text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their classes (``cls``, ``n``), and the component ``root`` of each class."""
    rows = written(features(docs, keep, text_col, width), "jaccard-features")
    classes = rows.where("cls is not null").groupBy("cls").agg(*[F.first(c).alias(c) for c in ("k", "t", "n", "counts")])
    classes = written(classes, "jaccard-classes")
    join = Join(docs, classes, text_col, width, percent)
    members = written(pivots_of(docs, text_col, width, percent, sketch(docs, text_col, width)), "jaccard-pivots")
    shared = members.groupBy("s").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").drop("last")
    regions = written(_different(written(members.join(shared, "s").distinct(), "jaccard-meetings")), "jaccard-regions")
    star = regions.where("k <> first").select(F.least("k", "first").alias("a"), F.greatest("k", "first").alias("b")).distinct()
    links = join.measured(join.windowed(star), "star").where(join.linked()).select("a", "b")
    mixed = _mixed_regions(regions, links).where("size > 2")  # of two classes one is the first: they have met
    mixed = _merged(_merged(mixed, F.col("k"), "first"), F.xxhash64("k"), "hash")
    leaves = [mixed.where(F.col("size") <= LEAF)]
    large = mixed.where(F.col("size") > LEAF)
    for level in range(DEPTH):
        if large.isEmpty():
            break
        found, cells = _voronoi(join, large, level)
        links = links.unionByName(found)
        cells = _mixed_regions(cells, links)
        done = (F.col("size") <= LEAF) | (F.col("size") > 0.9 * F.col("parent"))
        leaves.append(cells.where(done).drop("parent"))
        large = cells.where(~done).drop("parent")
    leaves.append(large)
    rest = leaves[0]
    for more in leaves[1:]:
        rest = rest.unionByName(more)
    links = links.unionByName(join.measured(_leaf_pairs(join, rest.where(F.col("size") <= LEAF)), "leaves").where(join.linked()).select("a", "b"))
    links = links.unionByName(_block_links(join, rest.where(F.col("size") > LEAF)))
    roots = components(links).select(F.col("node").alias("k"), "root")
    return rows, written(classes.select("cls", "k").join(roots, "k", "left").select("cls", F.coalesce("root", "k").alias("root")), "jaccard-roots")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, and ``component_id``, the least id it is linked to, itself included."""
    return _components_of(*classify(_named(docs, id_col, text_col), ["doc_id"], "text", width, percent)).drop("cls")


def _components_of(rows: DataFrame, roots: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", "cls", F.col("n").alias("n_shingles"))
    least = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id")).join(roots, "cls")
    ids = least.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = least.join(ids, "root").select("cls", "component_id")
    out = rows.join(by_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links as pairs of different classes (``cls_a`` < ``cls_b``, ``n_a``, ``n_b``, ``common``), each once, and the class of each document (``doc_id``, ``cls``).

    Documents of one class are linked to each other as well; a document without shingles has no class and no links.
    """
    docs = _named(docs, id_col, text_col)
    rows, roots = classify(docs, ["doc_id"], "text", width, percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cls, n, _, left, right, linked, common, itself in _met(batches, percent):
            a, b = np.nonzero(np.triu(linked) if itself else linked)
            for at in range(0, len(a), CHUNK):
                x, y = a[at : at + CHUNK], b[at : at + CHUNK]
                p, q = left[x], right[y]
                swap = cls[p] > cls[q]
                p, q = np.where(swap, q, p), np.where(swap, p, q)
                yield pd.DataFrame({"cls_a": cls[p], "cls_b": cls[q], "n_a": n[p], "n_b": n[q], "common": common[x, y]})

    cells = _in_cells(Join(docs, rows, "text", width, percent), rows, roots).select(*CELL, "side", "cls", "weight", "h")
    pairs = cells.mapInPandas(run, "cls_a binary, cls_b binary, n_a bigint, n_b bigint, common bigint")
    return pairs, rows.select("doc_id", "cls")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of :func:`join` with ``n_links``, the number of other documents (rows) that each is linked to."""
    docs = _named(docs, id_col, text_col)
    rows, roots = classify(docs, ["doc_id"], "text", width, percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cls, _, weight, left, right, linked, _, itself in _met(batches, percent):
            got = np.zeros(len(cls), np.int64)
            got[left] += linked @ weight[right]
            if not itself:
                got[right] += weight[left] @ linked
            some = np.flatnonzero(got)
            yield pd.DataFrame({"cls": cls[some], "others": got[some]})

    cells = _in_cells(Join(docs, rows, "text", width, percent), rows, roots).select(*CELL, "side", "cls", "weight", "h")
    others = cells.mapInPandas(run, "cls binary, others bigint").groupBy("cls").agg(F.sum("others").alias("others"))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("copies")).join(others, "cls", "left")
    number = classes.select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = _components_of(rows, roots).join(number, "cls", "left")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The table with one row of each component: least id, then least text digest. Rows without shingles all stay; columns are kept."""
    table, new = masked(docs)
    key = F.struct(F.col(new[id_col]).alias("doc_id"), F.sha2(F.col(new[text_col]), 256).alias("sha"))
    rows, roots = classify(table.select(key.alias("key"), F.col(new[text_col]).alias("text")).select("key.*", "text"), ["doc_id", "sha"], "text", width, percent)
    choice = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha")
    best = rows.where("cls is not null").groupBy("cls").agg(F.min(choice).alias("best")).join(roots, "cls")
    best = best.groupBy("root").agg(F.min("best").alias("best")).select(F.struct("best.doc_id", "best.sha").alias("key"), F.lit(True).alias("one"))
    empty = rows.where("cls is null").select(F.struct("doc_id", "sha").alias("key"), F.lit(False).alias("one")).distinct()
    plan = written(best.unionByName(empty), "jaccard-kept")
    met = table.withColumn("key", key).join(plan, "key")
    once = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))  # equal rows, of which one is enough
    kept = met.where("not one").unionByName(met.where("one").withColumn("place", once).where("place = 1").drop("place"))
    return unmasked(kept, new)
