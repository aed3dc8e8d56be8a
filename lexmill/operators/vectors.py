"""Dense vectors: exact and cell-pruned nearest neighbours, k-means cells, recall.

Vectors and queries are cut into blocks, per cell where cells prune; a block of vectors meets a block of queries in one
matrix product, which sends on only the best k rows per query. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import scratch, version

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision."""
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 when either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def group_means(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec): unit-length element-wise mean per key; sums combine before the shuffle."""
    cells = vectors.select(key, F.posexplode(vec).alias("pos", "v"))
    mean = cells.groupBy(key, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    # one entry per dimension: bounded by the vector length
    arr = mean.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("_m")
    )
    return arr.select(key, F.transform("_m", lambda x: x / norm(F.col("_m"))).alias(vec))


def _best(ids, sims, qids, k) -> pd.DataFrame:
    """Best k rows per query column of a (rows x queries) score block."""
    out = []
    for c, q in enumerate(qids):
        col = np.round(sims[:, c], 12)
        rows = np.arange(len(ids))
        if len(rows) > k:
            cut = np.partition(col[rows], len(rows) - k)[len(rows) - k]
            rows = rows[col[rows] >= cut]
        out.append(pd.DataFrame({"query_id": q, "id": ids[rows], "score": col[rows]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, tag: str | None = None, keys: tuple[str, ...] = ("query_id",), block: int = BLOCK
) -> DataFrame:
    """(keys, id, score, rank): cosine top-k of unit vectors, ties by id.

    ``vectors(id, vec[, tag])``; ``queries(keys, vec[, allowed])``. With ``tag`` a query only meets rows whose tag is in its
    ``allowed`` array (cells to probe, a category): the join of blocks is on the tag, so other rows cost no product.
    """
    group = F.col(tag).alias("tag") if tag else F.lit(0).alias("tag")
    asked = F.explode(F.array_distinct("allowed")).alias("tag") if tag else F.lit(0).alias("tag")
    # fresh column ids: the queries may be rows of the vector table itself
    v = vectors.select("id", "vec", group)
    q = queries.select(*keys, "vec", asked).toDF(*keys, "vec", "tag")
    v_blocks = v.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / block).alias("nv"))
    q_blocks = q.groupBy("tag").agg(F.ceil(F.count(F.lit(1)) / block).alias("nq"))
    blocks = v_blocks.join(q_blocks, "tag")  # a row per cell that both sides have
    vb = v.join(blocks, "tag").withColumn("vb", F.pmod(F.xxhash64("id"), "nv")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
    qb = q.join(blocks, "tag").withColumn("qb", F.pmod(F.xxhash64(*keys), "nq")).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)))

    types = dict(queries.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "id long, score double"])

    def product(vp: pd.DataFrame, qp: pd.DataFrame) -> pd.DataFrame:
        if not len(vp) or not len(qp):
            return pd.DataFrame({c: [] for c in (*keys, "id", "score")})
        sims = np.stack(vp["vec"].to_numpy()).astype("float64") @ np.stack(qp["vec"].to_numpy()).astype("float64").T
        found = _best(vp["id"].to_numpy(), sims, np.arange(len(qp)), k)
        named = qp[list(keys)].iloc[found["query_id"].to_numpy(dtype=int)].reset_index(drop=True)
        return pd.concat([named, found[["id", "score"]].reset_index(drop=True)], axis=1)

    on = ["tag", "vb", "qb"]
    part = vb.select(*on, "id", "vec").groupBy(*on).cogroup(qb.select(*on, *keys, "vec").groupBy(*on)).applyInPandas(product, schema)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cell, vec): nearest centroid of every vector."""
    mat = centroids.T.copy()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sims = np.stack(pdf["vec"].to_numpy()).astype("float64") @ mat
                yield pdf.assign(cell=np.argmax(np.round(sims, 12), axis=1).astype("int32"))

    return vectors.select("id", "vec").mapInPandas(go, "id long, vec array<float>, cell int")


def kmeans_cells(vectors: DataFrame, k: int, iters: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after ``iters`` rounds and those the last assignment was made with.

    Start: the k vectors with the smallest md5 of their id. Each round sums its batch per
    cell inside the task; only k x dim sums come back. An empty cell keeps its centroid.
    """
    start = vectors.orderBy(F.md5(F.col("id").cast("string")), "id").limit(k).collect()
    cent = np.array([r["vec"] for r in start], dtype="float64")
    used = cent
    for _ in range(iters):
        used = cent
        mat = cent.T.copy()

        def partial(batches: Iterator[pd.DataFrame], mat=mat) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["vec"].to_numpy()).astype("float64")
                    cell = np.argmax(np.round(x @ mat, 12), axis=1)
                    for c in np.unique(cell):
                        yield pd.DataFrame({"cell": [int(c)], "s": [x[cell == c].sum(axis=0)], "n": [int((cell == c).sum())]})

        parts = vectors.select("vec").mapInPandas(partial, "cell int, s array<double>, n long")
        sums = parts.select("cell", "n", F.posexplode("s").alias("pos", "v"))
        got = sums.groupBy("cell", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
        cent = cent.copy()
        fresh: dict[int, np.ndarray] = {}
        for r in got:
            fresh.setdefault(r["cell"], np.zeros(cent.shape[1]))[r["pos"]] = r["v"] / r["n"]
        for c, mean in fresh.items():
            cent[c] = mean / np.linalg.norm(mean)
    return cent, used


class Cells:
    """Vectors stored by cell, with the centroids: fitted and written once, after that a search reads the files of the cells it probes.

    ``centroids``: those after the last round; ``fitted_with``: those the stored assignment was made with.
    """

    def __init__(self, spark: SparkSession, path: str):
        rows = sorted(spark.read.schema("cell int, vec array<double>, before array<double>").parquet(f"{path}/centroids").collect(), key=lambda r: r["cell"])  # k rows
        self.centroids = np.array([r["vec"] for r in rows], dtype="float64")
        self.fitted_with = np.array([r["before"] for r in rows], dtype="float64")
        self.vectors = spark.read.schema("id long, vec array<float>, cell int").parquet(f"{path}/vectors")

    @classmethod
    def build(cls, vectors: DataFrame, k: int, iters: int, path: str) -> Cells:
        spark = vectors.sparkSession
        cent, used = kmeans_cells(vectors, k, iters)
        # a cell may hold a third of all vectors: rebalancing cuts it into files of even size
        assign_cells(vectors, used).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        rows = [(i, c.tolist(), u.tolist()) for i, (c, u) in enumerate(zip(cent, used))]
        spark.createDataFrame(rows, "cell int, vec array<double>, before array<double>").write.parquet(f"{path}/centroids")
        return cls(spark, path)

    def probed_by(self, queries: DataFrame) -> DataFrame:
        """The vectors in any of the cells that the queries' ``allowed`` name; the other cells' files are not read."""
        wanted = queries.select(F.explode("allowed").alias("cell")).distinct().collect()  # k rows at most
        return self.vectors.where(F.col("cell").isin(sorted(r["cell"] for r in wanted)))

    def sizes(self) -> DataFrame:
        """(cell, n), empty cells included."""
        n = self.vectors.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        every = self.vectors.sparkSession.range(len(self.centroids)).select(F.col("id").cast("int").alias("cell"))
        return every.join(n, "cell", "left").fillna(0, ["n"])


_CELLS: dict[tuple, str] = {}


def stored_cells(vectors: DataFrame, k: int, iters: int = 5) -> Cells:
    """The cells of a table of vectors, fitted at its first use in an application and read after that while its files stay the same."""
    spark, files = vectors.sparkSession, version(vectors)
    key = None if files is None else (k, iters, *files)
    if key in _CELLS:
        try:
            return Cells(spark, _CELLS[key])
        except AnalysisException:  # the shared folder was emptied meanwhile
            del _CELLS[key]
    path = scratch(spark, "cells")
    cells = Cells.build(vectors, k, iters, path)
    if key is not None:
        _CELLS[key] = path
    return cells


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """Adds ``allowed``: the nprobe nearest cells of every query, nearest first."""
    mat = centroids.T.copy()

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sims = np.round(np.stack(pdf["vec"].to_numpy()).astype("float64") @ mat, 12)
                order = np.argsort(-sims, axis=1, kind="stable")[:, :nprobe]
                yield pdf.assign(allowed=list(order.astype("int32")))

    return queries.select("query_id", "vec").mapInPandas(go, "query_id long, vec array<double>, allowed array<int>")


def recall(found: DataFrame, exact: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """Share of the exact k neighbours found, always divided by k, averaged per parameter."""
    truth = exact.select("query_id", "id")
    hit = found.join(truth, ["query_id", "id"], "left_semi").groupBy(*keys, "query_id").agg(
        F.count(F.lit(1)).alias("h")
    )
    every = found.select(*keys, "query_id").distinct().join(hit, [*keys, "query_id"], "left").fillna(0, ["h"])
    return every.groupBy(*keys).agg(F.round(F.avg(F.col("h") / k), 6).alias("recall"))
