"""Exact top-k search by inner product with M-trees and best-first search.

The largest inner product is the smallest distance once every vector ``x`` gets one more coordinate
``sqrt(M^2 - |x|^2)``, where ``M`` is the largest length, and the query gets 0 there: then
``d^2 = |q|^2 + M^2 - 2 <q, x>``. Vectors are dealt to blocks by a hash of their id, so copies of one vector spread out.
Each block becomes an M-tree of pages: a routing entry has a centre, the radius that covers its
subtree, and its distance to its parent's centre; a leaf entry has its vector and its distance to the leaf's centre.
Queries come in blocks as well, and every query block visits every tree. Best first, a query opens the page whose lower
bound ``max(0, d - radius)`` is least; before a distance is computed, ``|d(q, parent) - d(o, parent)| - radius`` must
fail to rule the entry out. A page that cannot hold a score of at least the k-th best ends the search, so results are
exact, ties included. Bounds are compared as scores with a margin above rounding error; scores are integers.

A tree is as large as its block, and a block as the parameters say, so memory does not grow with the table. Each
block pair returns at most k rows per query.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as candidates or queries;
vectors whose length is not the most common one raise no error and meet only vectors of their own length; null ids take
no part; repeated ids are separate candidates, but no candidate has its query's id; repeated queries return one list;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import written

PAGE = 128  # entries of a page
BLOCK_VECTORS = 10_000
BLOCK_QUERIES = 500
TASK_QUERY_BLOCKS = 8  # query blocks that one copy of a tree serves
MARGIN = 1e-6  # of scores, relative to the largest possible one


class Node:
    """A page: its entries' centres or vectors, their distances to the page's own centre, radii and children."""

    __slots__ = ("points", "to_parent", "radius", "children", "ids")

    def __init__(self, points, to_parent, radius=None, children=None, ids=None):
        self.points, self.to_parent, self.radius, self.children, self.ids = points, to_parent, radius, children, ids


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(points - centre).sum(1))


def build(points: np.ndarray, ids: np.ndarray, centre: np.ndarray, rng: np.random.Generator) -> Node:
    """Bulk-load: centres drawn from the points, each point to its nearest centre, and so on below.

    Centres are drawn among distinct points, so equal vectors never leave a split without progress; more equal vectors
    than a page holds make one large leaf.
    """
    to_centre = _distances(points, centre)
    if len(points) <= PAGE or not to_centre.any() or (distinct := np.unique(points, axis=0)).shape[0] == 1:
        return Node(points, to_centre, ids=ids)
    size = min(PAGE, len(distinct), max(2, -(-len(points) * 2 // PAGE)))
    centres = distinct[np.sort(rng.choice(len(distinct), size, replace=False))]
    squares = np.square(centres).sum(1)
    home = np.concatenate([(squares - 2 * part @ centres.T).argmin(1) for part in np.array_split(points, -(-len(points) // 4096))])
    radii, children, kept = [], [], []
    for i in range(size):
        mine = home == i
        if mine.any():
            children.append(build(points[mine], ids[mine], centres[i], rng))
            radii.append(_distances(points[mine], centres[i]).max())
            kept.append(i)
    if len(children) == 1:
        return Node(points, to_centre, ids=ids)
    centres = centres[kept]
    return Node(centres, _distances(centres, centre), np.array(radii), children)


def search(root: Node, root_centre: np.ndarray, query: np.ndarray, own_id: int, k: int, most: float) -> list[tuple[int, int]]:
    """The k best (score, id), best first and smaller ids first among equals. ``most`` is M squared."""
    flat = np.append(query, 0.0)
    reach = query @ query + most
    slack = MARGIN * max(1.0, reach)
    best: list[tuple[int, int]] = []  # a heap with the worst kept entry on top; ids negated
    queue: list[tuple[float, int, Node, float]] = [(0.0, 0, root, float(np.sqrt(np.square(flat - root_centre).sum())))]
    made = 1
    limit = np.inf  # distance beyond which nothing can be among the best
    while queue:
        bound, _, node, to_page = heapq.heappop(queue)
        if bound > limit:
            break
        gap = np.abs(to_page - node.to_parent)
        if node.children is None:
            near = np.flatnonzero(gap <= limit)
            scores = (node.points[near, :-1] @ query).astype(np.int64)
            for s, i in zip(scores.tolist(), node.ids[near].tolist()):
                if i == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                limit = float(np.sqrt(max(0.0, reach - 2.0 * best[0][0]) + slack))
        else:
            near = np.flatnonzero(gap - node.radius <= limit)
            d = _distances(node.points[near], flat)
            for x, lower, i in zip(d.tolist(), np.maximum(0.0, d - node.radius[near]).tolist(), near.tolist()):
                if lower <= limit:
                    heapq.heappush(queue, (lower, made, node.children[i], x))
                    made += 1
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _build_tree(key, rows: pd.DataFrame) -> pd.DataFrame:
    points = np.array(rows["v"].tolist(), float)
    most = float(rows["most"].iloc[0])
    last = np.sqrt(np.maximum(0.0, most - np.square(points).sum(1)))
    points = np.column_stack([points, last])
    centre = points.mean(0)
    root = build(points, rows["id"].to_numpy(np.int64), centre, np.random.default_rng(7))
    return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "tree": [pickle.dumps((root, centre, most), 5)]})


def _search_trees(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, loaded = None, None
        for batch in batches:
            out = []
            for dim, block, data, ids, vectors in zip(batch["dim"], batch["block"], batch["tree"], batch["ids"], batch["vs"]):
                if loaded != (dim, block):
                    tree, loaded = pickle.loads(data), (dim, block)
                root, centre, most = tree
                for i, v in zip(ids, vectors):
                    out += [(int(i), s, n) for s, n in search(root, centre, np.asarray(v, float), int(i), k, most)]
            yield pd.DataFrame(out, columns=["query_id", "score", "vec_id"]).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
          block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k best other rows of each row for which ``queries`` (a condition on the id column) holds."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    sound = F.size(x) > 0
    sound = sound & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).alias("id"), whole.alias("v"), queries.alias("q"))
    rows = written(rows.withColumn("dim", F.size("v")), "mtree-vectors")
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    sizes = rows.groupBy("dim").agg(F.max(length).alias("most"), F.count(F.lit(1)).alias("n"), F.count_if("q").alias("nq"))
    dealt = rows.join(sizes, "dim")
    home = F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / block_vectors))
    trees = dealt.select("dim", home.alias("block"), "id", "v", "most").groupBy("dim", "block").applyInPandas(_build_tree, "dim int, block bigint, tree binary")
    trees = written(trees, "mtree-trees")
    q_blocks = F.ceil(F.col("nq") / block_queries)
    groups = F.ceil(q_blocks / TASK_QUERY_BLOCKS)
    asked = dealt.where("q").dropDuplicates(["dim", "id"]).select(
        "dim", F.pmod(F.xxhash64("id"), q_blocks).alias("qb"), "id", "v", groups.alias("groups"), F.ceil(F.col("n") / block_vectors).alias("blocks"),
    )
    asked = asked.groupBy("dim", "qb", "groups", "blocks").agg(F.collect_list(F.struct("id", "v")).alias("x"))  # at most a block's queries
    asked = asked.select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), (F.col("qb") % F.col("groups")).alias("part"),
        F.col("x.id").alias("ids"), F.col("x.v").alias("vs"),
    )
    copies = trees.join(sizes.select("dim", groups.alias("groups")), "dim")
    copies = copies.select("dim", "block", F.explode(F.sequence(F.lit(0), F.greatest(F.col("groups"), F.lit(1)) - 1)).alias("part"), "tree")
    met = copies.join(asked, ["dim", "block", "part"]).select("dim", "block", "tree", "ids", "vs")
    found = met.mapInPandas(_search_trees(k), "query_id bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
