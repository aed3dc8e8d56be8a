"""Vector search over ``embeddings``; the queries are the unit mean vectors of the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import vectors as vx
from lexmill.plans.registry import query, table
from lexmill.session import materialise

CELLS = 16
NPROBES = (1, 2, 4, 8, 16)


def vecs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def label_queries(v):
    return vx.group_means(v, "label", "vec").select(F.col("label").cast("long").alias("query_id"), "vec")


def means(src: str, key: str, out: str) -> str:
    return f"""{out}_m AS (SELECT {key}, i, avg(v[i]) AS m FROM (SELECT {key}, v, unnest(range(1, len(v) + 1)) AS i FROM {src}) GROUP BY ALL),
{out}_l AS (SELECT {key}, list(m ORDER BY i) AS m FROM {out}_m GROUP BY 1),
{out} AS (SELECT {key}, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM {out}_l)"""


SQL_V = f"""ev AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
{means('ev', 'label', 'lq')},
sc AS (SELECT lq.label::BIGINT AS query_id, id, ev.label, round(list_dot_product(ev.v, lq.v), 12) AS score FROM ev, lq),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"""


@query("j1_exact_nearest_neighbours", f"WITH {SQL_V} SELECT query_id, id, rank, round(score, 6) AS score FROM rk WHERE rank <= 10")
def j1(spark, sf):
    v = vecs(spark, sf)
    return vx.nearest(v, label_queries(v), 10).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("t1_top_k_per_query", f"WITH {SQL_V} SELECT query_id, count(*) AS n, round(min(score), 6) AS kth_score, count(*) FILTER (label = query_id) AS same_label FROM rk WHERE rank <= 50 GROUP BY 1")
def t1(spark, sf):
    v = vecs(spark, sf)
    top = vx.nearest(v, label_queries(v), 50).join(v.select("id", "label"), "id")
    return top.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("kth_score"),
        F.count_if(F.col("label") == F.col("query_id")).alias("same_label"))


@query("p12_minimum_score", f"WITH {SQL_V} SELECT query_id, id, rank FROM rk WHERE rank <= 20 AND score >= 0.3")
def p12(spark, sf):
    v = vecs(spark, sf)
    return vx.nearest(v, label_queries(v), 20).where(F.col("score") >= 0.3).select("query_id", "id", "rank")


@query("f38_vector_math", f"WITH {SQL_V} SELECT id, round(sqrt(list_dot_product(ev.v, ev.v)), 6) AS norm, round(list_dot_product(ev.v, lq.v) / (sqrt(list_dot_product(ev.v, ev.v)) * sqrt(list_dot_product(lq.v, lq.v))), 6) AS cosine FROM ev JOIN lq ON lq.label = ev.label")
def f38(spark, sf):
    v = vecs(spark, sf)
    m = vx.group_means(v, "label", "vec").withColumnRenamed("vec", "m")
    return v.join(m, "label").select(
        "id", F.round(vx.norm(F.col("vec")), 6).alias("norm"), F.round(vx.cosine(F.col("vec"), F.col("m")), 6).alias("cosine"))


@query("p8_pre_versus_post_filter", f"""WITH {SQL_V}, f AS (SELECT unnest([10, 50, 200, 400]) AS fetch_k),
g AS (SELECT fetch_k, query_id, least(count(*) FILTER (rank <= fetch_k AND id % 20 = query_id % 20), 10) AS got FROM rk, f GROUP BY ALL),
p AS (SELECT query_id, least(count(*), 10) AS got FROM sc WHERE id % 20 = query_id % 20 GROUP BY 1)
SELECT 'post' AS mode, fetch_k, round(avg(got), 6) AS mean_got, round(count(*) FILTER (got = 0) / count(*), 6) AS empty_share FROM g GROUP BY fetch_k
UNION ALL SELECT 'pre', 10, round(avg(got), 6), round(count(*) FILTER (got = 0) / count(*), 6) FROM p""")
def p8(spark, sf):
    v = vecs(spark, sf).withColumn("cat", (F.col("id") % 20).cast("int"))
    q = label_queries(v).withColumn("allowed", F.array((F.col("query_id") % 20).cast("int")))
    wide = vx.nearest(v, q.drop("allowed"), 400)
    own = (F.col("id") % 20 == F.col("query_id") % 20).cast("int")
    fetched = wide.withColumn("fetch_k", F.explode(F.array(*map(F.lit, (10, 50, 200, 400))))).where(F.col("rank") <= F.col("fetch_k"))
    post = fetched.groupBy("fetch_k", "query_id").agg(F.least(F.sum(own), F.lit(10)).alias("got")).withColumn("mode", F.lit("post"))
    pre = vx.nearest(v, q, 10, tag="cat").groupBy("query_id").agg(F.count(F.lit(1)).alias("got")).select(
        F.lit(10).alias("fetch_k"), "query_id", "got", F.lit("pre").alias("mode"))
    return post.unionByName(pre).groupBy("mode", "fetch_k").agg(
        F.round(F.avg("got"), 6).alias("mean_got"), F.round(F.count_if(F.col("got") == 0) / F.count(F.lit(1)), 6).alias("empty_share"))


def kmeans_sql(iters: int = 5) -> str:
    steps = [f"c0 AS (SELECT row_number() OVER (ORDER BY md5(id::VARCHAR), id) - 1 AS cell, v FROM ev QUALIFY row_number() OVER (ORDER BY md5(id::VARCHAR), id) <= {CELLS})"]
    for i in range(iters):
        steps.append(f"a{i} AS (SELECT id, v, cell FROM (SELECT e.id, e.v, c.cell, row_number() OVER (PARTITION BY e.id ORDER BY round(list_dot_product(e.v, c.v), 12) DESC, c.cell) AS r FROM ev e, c{i} c) WHERE r = 1)")
        steps.append(means(f"a{i}", "cell", f"k{i}"))
        steps.append(f"c{i + 1} AS (SELECT c.cell, coalesce(k.v, c.v) AS v FROM c{i} c LEFT JOIN k{i} k ON k.cell = c.cell)")
    return ",\n".join(steps)


SQL_K = f"{SQL_V}, {kmeans_sql()}"


@query("a39_kmeans_cells", f"WITH {SQL_K} SELECT cell, count(*) OVER () AS n_cells, round(v[1], 6) AS first_dim, round(v[-1], 6) AS last_dim, round(list_sum(v), 6) AS total FROM c5")
def a39(spark, sf):
    cent = vx.stored_cells(vecs(spark, sf), CELLS).centroids
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(cent)]
    c = spark.createDataFrame(rows, "cell int, v array<double>")
    return c.select(
        "cell", F.lit(len(rows)).alias("n_cells"), F.round(F.element_at("v", 1), 6).alias("first_dim"),
        F.round(F.element_at("v", -1), 6).alias("last_dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("a40_cell_sizes", f"WITH {SQL_K} SELECT c5.cell, count(a4.id) AS n FROM c5 LEFT JOIN a4 ON a4.cell = c5.cell GROUP BY 1")
def a40(spark, sf):
    return vx.stored_cells(vecs(spark, sf), CELLS).sizes()


SQL_IVF = f"""{SQL_K}, np AS (SELECT unnest({list(NPROBES)}) AS nprobe),
cp AS (SELECT lq.label::BIGINT AS query_id, cell, row_number() OVER (PARTITION BY lq.label ORDER BY round(list_dot_product(lq.v, c5.v), 12) DESC, cell) AS pr FROM lq, c5),
iv AS (SELECT * FROM (SELECT nprobe, s.query_id, s.id, s.score, row_number() OVER (PARTITION BY nprobe, s.query_id ORDER BY s.score DESC, s.id) AS rank
  FROM sc s JOIN a4 ON a4.id = s.id JOIN cp ON cp.query_id = s.query_id AND cp.cell = a4.cell JOIN np ON cp.pr <= nprobe) WHERE rank <= 10)"""


def ivf(spark, sf, nprobes):
    """All settings in one pass: a query is repeated per nprobe with a prefix of its cells."""
    v = vecs(spark, sf)
    cells = vx.stored_cells(v, CELLS)
    q = materialise(vx.probes(label_queries(v), cells.centroids, max(nprobes)), "probes")
    stored = cells.probed_by(q)
    q = q.withColumn("nprobe", F.explode(F.array(*map(F.lit, nprobes))))
    q = q.select("query_id", "nprobe", "vec", F.slice("allowed", 1, F.col("nprobe")).alias("allowed"))
    return v, vx.nearest(stored, q, 10, tag="cell", keys=("nprobe", "query_id"))


@query("j2_cell_pruned_nearest_neighbours", f"WITH {SQL_IVF} SELECT query_id, id, rank, round(score, 6) AS score FROM iv WHERE nprobe = 4")
def j2(spark, sf):
    _, run = ivf(spark, sf, (4,))
    return run.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


@query("a15_recall_sweep", f"""WITH {SQL_IVF}, h AS (SELECT nprobe, iv.query_id, count(rk.id) AS h FROM iv LEFT JOIN rk ON rk.query_id = iv.query_id AND rk.id = iv.id AND rk.rank <= 10 GROUP BY ALL),
r AS (SELECT nprobe, round(avg(h / 10), 6) AS recall FROM h GROUP BY 1)
SELECT nprobe, recall, coalesce(nprobe = (SELECT min(nprobe) FROM r WHERE recall >= 0.95), false) AS sweet_spot FROM r""")
def a15(spark, sf):
    v, run = ivf(spark, sf, NPROBES)
    exact = vx.nearest(v, label_queries(v), 10)
    r = vx.recall(run, exact, 10, ["nprobe"])
    best = r.where(F.col("recall") >= 0.95).agg(F.min("nprobe").alias("b")).scalar()
    return r.withColumn("sweet_spot", F.coalesce(F.col("nprobe") == best, F.lit(False)))
