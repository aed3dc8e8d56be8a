"""Runs, fusion, reranking, context building and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import evaluation as ev
from lexmill.operators import lexical as lx
from lexmill.operators import retrieval as rt
from lexmill.plans.lexical import C, SQL_BM25, SQL_DENSE_RUN, SQL_GOLD, docs_items, ranked
from lexmill.plans.registry import query, table
from lexmill.session import materialise


def two_runs(d, q, k=rt.CANDIDATES_K):
    dense = rt.as_run(lx.tfidf_cosine(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=k), "dense0", "item_id", "doc_id", k)
    return dense.unionByName(rt.as_run(lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=k), "bm25", "item_id", "doc_id", k))


SQL_RUNS = f"""{SQL_DENSE_RUN}, {SQL_BM25},
runs AS (SELECT item_id, 'dense0' AS run, doc_id, rank, score FROM ({ranked('dense_scores', 20)})
  UNION ALL SELECT item_id, 'bm25', doc_id, rank, score FROM ({ranked('bm25_scores', 20)}))"""
SQL_FUSED = f"""{SQL_RUNS},
fused AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf, max(score) FILTER (run = 'dense0') AS similarity,
  max(score) FILTER (run = 'bm25') AS bm25, string_agg(run || '=' || rank, ',' ORDER BY run || '=' || rank) AS ranks FROM runs GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS pos FROM fused)"""


def fused(d, q):
    f = rt.fuse(two_runs(d, q), "item_id", "doc_id")
    return rt.ordered(f, "item_id", F.col("rrf").desc(), F.col("doc_id"))


@query("w1_rank_within_run", f"WITH {SQL_RUNS} SELECT item_id, run, doc_id, rank FROM runs")
def w1(spark, sf):
    return two_runs(*docs_items(spark, sf)).select("item_id", "run", "doc_id", "rank")


@query("a9_reciprocal_rank_fusion", f"""WITH {SQL_FUSED} SELECT item_id, doc_id, pos, rrf, coalesce(round(similarity, 6), -1) AS similarity,
coalesce(round(bm25, 4), -1) AS bm25, ranks FROM fr""")
def a9(spark, sf):
    return fused(*docs_items(spark, sf)).select(
        "item_id", "doc_id", "pos", "rrf", F.coalesce(F.round("similarity", 6), F.lit(-1.0)).alias("similarity"),
        F.coalesce(F.round("bm25", 4), F.lit(-1.0)).alias("bm25"), "ranks")


@query("j5_fuse_full_outer", f"""WITH {SQL_FUSED} SELECT item_id, count(*) AS n, count(*) FILTER (similarity IS NULL) AS only_bm25,
count(*) FILTER (bm25 IS NULL) AS only_dense, count(*) FILTER (similarity IS NOT NULL AND bm25 IS NOT NULL) AS both_runs FROM fused GROUP BY 1""")
def j5(spark, sf):
    s, b = F.col("similarity"), F.col("bm25")
    return rt.fuse(two_runs(*docs_items(spark, sf)), "item_id", "doc_id").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s.isNull()).alias("only_bm25"),
        F.count_if(b.isNull()).alias("only_dense"), F.count_if(s.isNotNull() & b.isNotNull()).alias("both_runs"))


@query("u1_union_first_seen", f"""WITH {SQL_RUNS} SELECT item_id, doc_id, f[1] AS run, f[2] AS rank FROM (
SELECT item_id, doc_id, min((run, rank)) AS f FROM runs GROUP BY ALL)""")
def u1(spark, sf):
    return rt.union_first_seen(two_runs(*docs_items(spark, sf)), "item_id", "doc_id")


@query("p10_threshold_with_lexical_exemption", f"""WITH {SQL_FUSED} SELECT item_id, doc_id, pos FROM fr
WHERE similarity IS NULL OR similarity >= 0.1 OR coalesce(bm25, 0) <> 0""")
def p10(spark, sf):
    return rt.over_threshold(fused(*docs_items(spark, sf)), 0.1).select("item_id", "doc_id", "pos")


@query("j4_hit_hydration", f"""WITH {SQL_BM25}, run AS ({ranked('bm25_scores', 10)})
SELECT item_id, run.doc_id, rank, lang, source, n_chars, substr(sha256(text), 1, 12) AS checksum FROM run JOIN documents d ON d.doc_id = run.doc_id""")
def j4(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=10), "item_id", "doc_id", 10)
    return rt.hydrated(run, table(spark, sf, "documents"), "doc_id").select(
        "item_id", "doc_id", "rank", "lang", "source", "n_chars", F.substring(F.sha2("text", 256), 1, 12).alias("checksum"))


SQL_OVERLAP = "ov AS (SELECT item_id, doc_id, sum(tf / dl * idf) AS rerank FROM wpost JOIN widf USING (term) JOIN wq USING (term) GROUP BY ALL)"
SQL_T3 = f"""{SQL_FUSED}, {SQL_OVERLAP}, cand AS (SELECT fr.*, round(rerank, 9) AS rr FROM fr LEFT JOIN ov USING (item_id, doc_id) WHERE pos <= 20),
fin AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN rr IS NULL OR rr = 0 THEN -1e9 ELSE rr END DESC, pos, doc_id) AS final_rank FROM cand)"""


def funnel(d, q, top_n=rt.FINAL_K):
    cand = materialise(fused(d, q).where(F.col("pos") <= rt.CANDIDATES_K), "candidates")
    second = lx.tfidf_overlap(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", pairs=cand).select("item_id", "doc_id", F.round("score", 9).alias("rr"))
    return rt.rerank(cand.join(second, ["item_id", "doc_id"], "left"), "item_id", "doc_id", "rr", top_n)


@query("t3_two_stage_funnel", f"WITH {SQL_T3} SELECT item_id, doc_id, final_rank, round(rr, 6) AS rerank_score FROM fin WHERE final_rank <= 4")
def t3(spark, sf):
    return funnel(*docs_items(spark, sf)).select("item_id", "doc_id", "final_rank", F.round("rr", 6).alias("rerank_score"))


@query("f42_final_score", f"""WITH {SQL_T3} SELECT item_id, doc_id, round(coalesce(CASE WHEN final_rank <= 4 THEN rr END, rrf, similarity, bm25), 4) AS final_score FROM fin""")
def f42(spark, sf):
    c = funnel(*docs_items(spark, sf), top_n=rt.CANDIDATES_K)
    best = F.when(F.col("final_rank") <= 4, F.col("rr"))
    return c.select("item_id", "doc_id", F.round(F.coalesce(best, "rrf", "similarity", "bm25"), 4).alias("final_score"))


@query("t4_judge_order", f"""WITH {SQL_BM25}, run AS ({ranked('bm25_scores', 20)})
SELECT item_id, run.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(quality, 0) DESC, rank) AS judged_rank
FROM run LEFT JOIN labels l ON l.doc_id = run.doc_id""")
def t4(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=20), "item_id", "doc_id", 20)
    flag = F.coalesce("quality", F.lit(0))
    j = run.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rt.ordered(j, "item_id", flag.desc(), F.col("rank"), name="judged_rank").select("item_id", "doc_id", "judged_rank")


SQL_BLOCKS = f"""{SQL_FUSED}, bl AS (SELECT fr.item_id, pos, '[#' || pos || '] doc ' || fr.doc_id || ' | ' || source || chr(10) || trim(text, ' ') AS block
FROM fr JOIN documents d ON d.doc_id = fr.doc_id WHERE pos <= 8),
us AS (SELECT *, sum(length(block)) OVER (PARTITION BY item_id ORDER BY pos) AS used FROM bl)"""


def hit_blocks(spark, sf, k=8):
    d, q = docs_items(spark, sf)
    hits = rt.hydrated(fused(d, q).where(F.col("pos") <= k), table(spark, sf, "documents"), "doc_id")
    head = F.concat(F.lit("[#"), F.col("pos"), F.lit("] doc "), F.col("doc_id"), F.lit(" | "), F.col("source"))
    return rt.blocks(hits, "pos", F.col("text"), head).select("item_id", "pos", "block")


@query("w4_context_packing", f"WITH {SQL_BLOCKS} SELECT item_id, pos, used::BIGINT AS used FROM us WHERE used <= 4000 OR pos = 1")
def w4(spark, sf):
    return rt.pack(hit_blocks(spark, sf), ["item_id"], "pos", rt.CONTEXT_CHARS).select("item_id", "pos", "used")


@query("f37_prompt_table", f"""WITH {SQL_BLOCKS}, p AS (SELECT item_id, count(*) AS n_blocks, '<context>' || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY pos) || chr(10) || '</context>' || chr(10) || chr(10) AS ctx
FROM us WHERE used <= 4000 OR pos = 1 GROUP BY 1)
SELECT item_id, n_blocks, length(ctx || text) AS n_chars, sha256(ctx || text) AS digest FROM p JOIN benchmark USING (item_id)""")
def f37(spark, sf):
    packed = rt.pack(hit_blocks(spark, sf), ["item_id"], "pos", rt.CONTEXT_CHARS)
    p = rt.prompts(packed.join(table(spark, sf, "benchmark"), "item_id"), "item_id", "pos", "text")
    return p.select("item_id", "n_blocks", F.length("prompt").alias("n_chars"), F.sha2("prompt", 256).alias("digest"))


@query("a47_context_budget_curve", f"""WITH {SQL_BLOCKS}, ks AS (SELECT unnest([1, 2, 4, 8]) AS k),
u AS (SELECT bl.*, k, sum(length(block)) OVER (PARTITION BY item_id, k ORDER BY pos) AS used8 FROM bl, ks WHERE pos <= k)
SELECT k, count(*) AS blocks_kept, sum(length(block))::BIGINT AS context_chars, round(avg(length(block)), 4) AS mean_block FROM u WHERE used8 <= 8000 OR pos = 1 GROUP BY k""")
def a47(spark, sf):
    b = hit_blocks(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))).where(F.col("pos") <= F.col("k"))
    return rt.pack(b, ["item_id", "k"], "pos", 8000).groupBy("k").agg(
        F.count(F.lit(1)).alias("blocks_kept"), F.sum(F.length("block")).alias("context_chars"),
        F.round(F.avg(F.length("block")), 4).alias("mean_block"))


SQL_TOP1 = f"""{SQL_DENSE_RUN}, {SQL_GOLD}, top AS (SELECT b.item_id, coalesce(max(score), 0) AS score, b.item_id IN (SELECT item_id FROM gold) AS answerable
FROM benchmark b LEFT JOIN dense_scores s ON s.item_id = b.item_id GROUP BY b.item_id)"""


def top_scores(d, q):
    best = lx.tfidf_cosine(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=1).groupBy("item_id").agg(F.max("score").alias("score"))
    gold = lx.contained_in(d, q, "doc_id", "item_id").select("item_id").distinct().withColumn("answerable", F.lit(True))
    return q.select("item_id").join(best, "item_id", "left").join(gold, "item_id", "left").fillna(
        {"score": 0.0, "answerable": False})


@query("p11_refuse_before_generation", f"WITH {SQL_TOP1} SELECT item_id, round(score, 6) AS score, score < 0.5 AS refused FROM top")
def p11(spark, sf):
    return top_scores(*docs_items(spark, sf)).select("item_id", F.round("score", 6).alias("score"), (F.col("score") < 0.5).alias("refused"))


@query("a46_threshold_sweep", f"""WITH {SQL_TOP1}, th AS (SELECT unnest([0.05, 0.08, 0.10, 0.12, 0.15, 0.20, 0.50, 0.60]::DOUBLE[]) AS t),
s AS (SELECT t, count(*) FILTER (answerable AND score < t) AS false_refusals, count(*) FILTER (NOT answerable AND score < t) AS caught,
  count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_traps FROM top, th GROUP BY t)
SELECT *, t = (SELECT max(t) FROM s WHERE false_refusals = 0) AS best FROM s""")
def a46(spark, sf):
    return ev.threshold_sweep(top_scores(*docs_items(spark, sf)), (0.05, 0.08, 0.10, 0.12, 0.15, 0.20, 0.50, 0.60))


@query("f16_refusal_with_nearest_titles", f"""WITH {SQL_FUSED}, ti AS (SELECT item_id, source, min(pos) AS pos FROM fr JOIN documents d ON d.doc_id = fr.doc_id WHERE pos <= 20 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS r FROM ti)
SELECT item_id, 'no answer found. Nearest topics: ' || string_agg(source, ', ' ORDER BY r) || '.' AS answer FROM n WHERE r <= 3 GROUP BY 1""")
def f16(spark, sf):
    d, q = docs_items(spark, sf)
    hits = rt.hydrated(fused(d, q).where(F.col("pos") <= 20), table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    first = hits.groupBy("item_id", "source").agg(F.min("pos").alias("pos"))
    three = rt.ordered(first, "item_id", F.col("pos"), name="r", k=3)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]), ", ")
    return three.groupBy("item_id").agg(F.concat(F.lit("no answer found. Nearest topics: "), names, F.lit(".")).alias("answer"))


SQL_LINES = rf"""
li AS (SELECT doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS idx FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)),
lines AS (SELECT doc_id, idx, text, doc_id || '_' || idx AS chunk_id FROM li),
ltok AS (SELECT chunk_id, doc_id, idx, list_transform(regexp_extract_all(text, {C}), lambda x: lower(x)) AS t FROM lines),
lpost AS (SELECT chunk_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM ltok) GROUP BY ALL),
lcorpus AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS avgdl FROM ltok),
lidf AS (SELECT term, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM lpost, lcorpus GROUP BY term, n_docs),
lq AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, {C}))) AS term FROM benchmark) GROUP BY ALL),
lscores AS (SELECT item_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM lpost JOIN lidf USING (term) JOIN lq USING (term), lcorpus GROUP BY item_id, chunk_id),
lrun AS (SELECT r.*, doc_id, idx, text FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM lscores) r
  JOIN lines USING (chunk_id) WHERE rank <= 10)"""


def line_run(spark, sf, k=10):
    d, q = docs_items(spark, sf)
    chunks = rt.lines_of(d)
    run = lx.top_k(lx.bm25_scores(lx.indexed(chunks, "chunk_id"), q, "chunk_id", "item_id", best=k), "item_id", "chunk_id", k)
    return rt.hydrated(run, chunks, "chunk_id"), chunks


@query("w2_diversify_per_document", f"""WITH {SQL_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY rank) AS n FROM lrun)
SELECT item_id, chunk_id, rank, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS new_rank FROM k WHERE n <= 1""")
def w2(spark, sf):
    run, _ = line_run(spark, sf)
    return rt.diversify(run, "item_id", "doc_id", 1).select("item_id", "chunk_id", "rank", "new_rank")


SQL_FIRSTDOC = f"""{SQL_LINES}, fd AS (SELECT item_id, doc_id, min(rank) AS rank FROM lrun GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS doc_rank FROM fd)"""


@query("w3_first_hit_per_document", f"WITH {SQL_FIRSTDOC} SELECT item_id, doc_id, rank, doc_rank FROM dr")
def w3(spark, sf):
    run, _ = line_run(spark, sf)
    return ev.first_per_document(run, "item_id", "doc_id")


SQL_A14 = f"""{SQL_FIRSTDOC}, {SQL_GOLD},
m AS (SELECT a.item_id, coalesce(bool_or(g.doc_id IS NOT NULL AND doc_rank = 1), false) AS hit1, coalesce(bool_or(g.doc_id IS NOT NULL AND doc_rank <= 3), false) AS hit3
  FROM (SELECT DISTINCT item_id FROM gold) a LEFT JOIN dr ON dr.item_id = a.item_id LEFT JOIN gold g ON g.item_id = dr.item_id AND g.doc_id = dr.doc_id GROUP BY 1),
z AS (SELECT item_id, length(text) AS size FROM lrun WHERE rank = 1)"""


@query("a14_deduplicated_hit_rates", f"""WITH {SQL_A14}
SELECT count(*) AS n, count(*) FILTER (hit1) AS top1, count(*) FILTER (hit3) AS top3, (sum(coalesce(size, 0)) // count(*))::BIGINT AS avg_chars FROM m LEFT JOIN z USING (item_id)""")
def a14(spark, sf):
    return ev.dedup_hit_rates(question_marks(spark, sf))


@query("a14_question_marks", f"""WITH {SQL_A14} SELECT item_id, coalesce(size, 0) AS size, CASE WHEN hit1 THEN '+' WHEN hit3 THEN '~' ELSE 'x' END AS mark FROM m LEFT JOIN z USING (item_id)""")
def a14m(spark, sf):
    return question_marks(spark, sf).select("item_id", "size", "mark")


def question_marks(spark, sf):
    d, q = docs_items(spark, sf)
    run, _ = line_run(spark, sf)
    return ev.question_marks(run, lx.contained_in(d, q, "doc_id", "item_id"), "item_id", "doc_id", "text")


@query("j6_parent_document_search", f"""WITH {SQL_LINES}, p AS (SELECT item_id, doc_id, min(rank) AS rank FROM lrun WHERE rank <= 6 GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS parent_rank FROM p)
SELECT item_id, t.doc_id, rank, parent_rank, n_chars FROM t JOIN documents d ON d.doc_id = t.doc_id WHERE parent_rank <= 2""")
def j6(spark, sf):
    run, _ = line_run(spark, sf, 6)
    first = run.groupBy("item_id", "doc_id").agg(F.min("rank").alias("rank"))
    top = rt.ordered(first, "item_id", F.col("rank"), name="parent_rank", k=2)
    return top.join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


@query("j7_neighbour_expansion", f"""WITH {SQL_LINES} SELECT r.item_id, r.chunk_id, count(*) AS n, sha256(string_agg(l.text, chr(10) || chr(10) ORDER BY l.idx)) AS digest
FROM lrun r JOIN lines l ON l.doc_id = r.doc_id AND abs(l.idx - r.idx) <= 1 GROUP BY ALL""")
def j7(spark, sf):
    run, chunks = line_run(spark, sf)
    return rt.with_neighbours(run, chunks, "item_id").select("item_id", "chunk_id", "n", F.sha2("expanded", 256).alias("digest"))


@query("j8_parent_window", rf"""WITH {SQL_LINES}, a AS (SELECT item_id, chunk_id, r.text, d.text AS parent, instr(d.text, substr(r.text, 1, 50)) - 1 AS s FROM lrun r JOIN documents d ON d.doc_id = r.doc_id),
b AS (SELECT *, greatest(0, s - 300) AS l0, least(length(parent), s + length(text) + 300) AS r0 FROM a),
c AS (SELECT *, CASE WHEN l0 > 0 THEN CASE WHEN instr(substr(parent, l0 + 1), ' ') > 0 THEN l0 + instr(substr(parent, l0 + 1), ' ') ELSE 0 END ELSE 0 END AS l FROM b),
w AS (SELECT *, substr(parent, l + 1, r0 - l) AS w, instr(reverse(substr(parent, l + 1, r0 - l)), ' ') AS rb FROM c),
e AS (SELECT *, CASE WHEN r0 >= length(parent) THEN r0 WHEN rb > 0 THEN l + length(w) - rb ELSE length(parent) - 1 END AS e FROM w)
SELECT item_id, chunk_id, length(CASE WHEN s < 0 THEN text ELSE x END) AS n_chars, sha256(CASE WHEN s < 0 THEN text ELSE x END) AS digest FROM (
SELECT *, CASE WHEN l > 0 THEN '...' ELSE '' END || regexp_replace(substr(parent, l + 1, e - l), '^\s+|\s+$', '', 'g') || CASE WHEN e < length(parent) THEN '...' ELSE '' END AS x FROM e)""")
def j8(spark, sf):
    run, _ = line_run(spark, sf)
    parents = table(spark, sf, "documents").select("doc_id", F.col("text").alias("parent"))
    r = rt.parent_windows(run.join(parents, "doc_id"))
    return r.select("item_id", "chunk_id", F.length("window").alias("n_chars"), F.sha2("window", 256).alias("digest"))


@query("j17_compare_two_configurations", f"""WITH {SQL_RUNS}, {SQL_GOLD}, f AS (SELECT c.run, g.item_id, min(rank) FILTER (rank <= 3 AND r.doc_id IS NOT NULL) AS fr
FROM gold g CROSS JOIN (SELECT unnest(['bm25', 'dense0']) AS run) c LEFT JOIN runs r ON r.run = c.run AND r.item_id = g.item_id AND r.doc_id = g.doc_id GROUP BY ALL),
m AS (SELECT run, count(*) FILTER (fr = 1)::DOUBLE AS hit1, count(fr)::DOUBLE AS hit3, round(avg(coalesce(1.0 / fr, 0)), 6) AS mrr FROM f GROUP BY run)
SELECT metric, max(v) FILTER (run = 'bm25') AS bm25, max(v) FILTER (run = 'dense0') AS dense0 FROM (
SELECT run, unnest(['hit1', 'hit3', 'mrr']) AS metric, unnest([hit1, hit3, mrr]) AS v FROM m) GROUP BY metric""")
def j17(spark, sf):
    d, q = docs_items(spark, sf)
    return ev.compare_runs(two_runs(d, q), lx.contained_in(d, q, "doc_id", "item_id"), ["bm25", "dense0"])


@query("x5_interchangeable_search_backends", f"""WITH {SQL_RUNS} SELECT run, count(*) AS n_rows, count(DISTINCT item_id) AS n_queries, min(rank) AS first_rank, max(rank) AS last_rank FROM runs GROUP BY run""")
def x5(spark, sf):
    d, q = docs_items(spark, sf)
    out = None
    for name, backend in rt.BACKENDS.items():
        run = rt.as_run(backend(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=rt.CANDIDATES_K), name, "item_id", "doc_id", rt.CANDIDATES_K)
        part = run.groupBy("run", "item_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("run").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_queries"), F.min("lo").alias("first_rank"), F.max("hi").alias("last_rank"))


@query("u2_query_variants", r"""WITH first_user AS (SELECT conv_id, trim(arg_min(text, turn), chr(10) || ' ') AS q FROM conversations WHERE role = 'user' GROUP BY 1),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, i, trim(regexp_replace(line, '^\s*(?:[-–—•*]|\d{1,2}[.)])\s*', ''), ' ') AS v FROM l),
ok AS (SELECT c.* FROM c JOIN first_user f USING (conv_id) WHERE length(v) BETWEEN 6 AND 160 AND NOT ends_with(v, ':') AND lower(v) <> lower(f.q)),
d AS (SELECT conv_id, arg_min(v, (turn, i)) AS v, min((turn, i)) AS pos FROM ok GROUP BY conv_id, lower(v)),
r AS (SELECT conv_id, v, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM d)
SELECT conv_id, 0::BIGINT AS n, q AS variant FROM first_user UNION ALL SELECT conv_id, n, v FROM r WHERE n <= 3""")
def u2(spark, sf):
    return rt.query_variants(table(spark, sf, "conversations"), 3, 160)


@query("x2_interchangeable_rerankers", f"""WITH {SQL_T3}, len2 AS (SELECT fr.item_id, fr.doc_id, pos, 1000.0::DOUBLE / (1000 + n_chars) AS s FROM fr JOIN documents d ON d.doc_id = fr.doc_id WHERE pos <= 20),
l2 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, pos, doc_id) AS final_rank FROM len2)
SELECT 'overlap' AS reranker, item_id, doc_id, final_rank FROM fin WHERE final_rank <= 4 UNION ALL SELECT 'brevity', item_id, doc_id, final_rank FROM l2 WHERE final_rank <= 4""")
def x2(spark, sf):
    """The same candidates through two rerankers of the library."""
    d, q = docs_items(spark, sf)
    cand = materialise(fused(d, q).where(F.col("pos") <= rt.CANDIDATES_K), "candidates")
    rerankers = {
        "overlap": rt.OverlapReranker(lx.indexed(d, "doc_id"), q, "item_id", "doc_id"),
        "brevity": rt.LengthReranker(table(spark, sf, "documents").select("doc_id", "n_chars"), "item_id", "doc_id"),
    }
    out = None
    for name, r in rerankers.items():
        part = r.rerank(cand, rt.FINAL_K).select(F.lit(name).alias("reranker"), "item_id", "doc_id", "final_rank")
        out = part if out is None else out.unionByName(part)
    return out
