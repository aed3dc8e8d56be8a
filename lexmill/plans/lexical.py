"""Term statistics, lexical search and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import evaluation as ev
from lexmill.operators import lexical as lx
from lexmill.operators import retrieval as rt
from lexmill.plans.registry import query, table

W = r"'[\p{L}\p{N}_]+'"
C = r"'[a-zA-Zа-яёА-ЯЁ0-9][a-zA-Zа-яёА-ЯЁ0-9._-]*'"

SQL_WORD_POST = rf"""
wtok AS (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS t FROM documents),
wpost AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf
          FROM (SELECT doc_id, t, unnest(t) AS term FROM wtok) GROUP BY ALL),
widf AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM documents) / count(*)) AS idf
         FROM wpost GROUP BY term),
qtok AS (SELECT item_id, regexp_extract_all(lower(text), {W}) AS t FROM benchmark),
wq AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM qtok) GROUP BY ALL)
"""

SQL_DENSE_RUN = rf"""{SQL_WORD_POST},
qw AS (SELECT item_id, term, idf, qtf * idf AS qw FROM wq JOIN widf USING (term) WHERE idf > 0),
qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY 1),
dn AS (SELECT doc_id, sqrt(sum((tf * idf) ** 2)) AS dn FROM wpost JOIN widf USING (term) GROUP BY 1),
dense_scores AS (
  SELECT item_id, doc_id, sum(qw * tf * qw.idf) / (any_value(qn) * any_value(dn)) AS score
  FROM wpost JOIN qw USING (term) JOIN qn USING (item_id) JOIN dn USING (doc_id)
  WHERE qn > 0 AND dn > 0 GROUP BY item_id, doc_id)
"""

SQL_BM25 = rf"""
ctok AS (SELECT doc_id, list_transform(regexp_extract_all(text, {C}), lambda x: lower(x)) AS t FROM documents),
cpost AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf
          FROM (SELECT doc_id, t, unnest(t) AS term FROM ctok) GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS avgdl FROM ctok),
cidf AS (SELECT term, count(*) AS df, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf
         FROM cpost, corpus GROUP BY term, n_docs),
cq AS (SELECT item_id, term, count(*) AS qtf FROM (
         SELECT item_id, lower(unnest(regexp_extract_all(text, {C}))) AS term FROM benchmark) GROUP BY ALL),
bm25_scores AS (
  SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM cpost JOIN cidf USING (term) JOIN cq USING (term), corpus GROUP BY item_id, doc_id)
"""

SQL_GOLD = """
gold AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
"""


def ranked(scores: str, k: int) -> str:
    return f"""SELECT item_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM {scores}) WHERE rank <= {k}"""


def docs_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d, table(spark, sf, "benchmark")


@query("f1_word_tokens", rf"""
SELECT doc_id, len(t) AS n_words, len(list_distinct(t)) AS n_distinct, t[1] AS first_word, t[-1] AS last_word
FROM (SELECT doc_id, regexp_extract_all(lower(text), {W}) AS t FROM documents)""")
def f1(spark, sf):
    d, _ = docs_items(spark, sf)
    return d.select("doc_id", tx.words(F.col("text")).alias("t")).select(
        "doc_id",
        F.size("t").alias("n_words"),
        F.size(F.array_distinct("t")).alias("n_distinct"),
        F.try_element_at("t", F.lit(1)).alias("first_word"),
        F.try_element_at("t", F.lit(-1)).alias("last_word"),
    )


@query("f2_code_tokens", rf"""
SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, {C}))) AS term FROM documents)
WHERE regexp_matches(term, '[._-]') GROUP BY term""")
def f2(spark, sf):
    d, _ = docs_items(spark, sf)
    return (
        d.select(F.explode(tx.code_tokens(F.col("text"))).alias("term"))
        .where(F.col("term").rlike("[._-]"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("a1_document_frequency_idf", f"WITH {SQL_WORD_POST} SELECT term, df, round(idf, 6) AS idf FROM widf")
def a1(spark, sf):
    d, _ = docs_items(spark, sf)
    return lx.idf_plain(d, "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query("a2_tfidf_vectors", f"""WITH {SQL_WORD_POST},
raw AS (SELECT doc_id, term, tf / dl * idf AS raw FROM wpost JOIN widf USING (term)),
nrm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1)
SELECT doc_id, count(*) AS n_terms, round(any_value(norm), 6) AS norm,
       round(max(CASE WHEN norm > 0 THEN raw / norm ELSE 0 END), 6) AS top_weight,
       round(sum(CASE WHEN norm > 0 THEN raw / norm ELSE 0 END), 6) AS weight_sum
FROM raw JOIN nrm USING (doc_id) GROUP BY doc_id""")
def a2(spark, sf):
    d, _ = docs_items(spark, sf)
    return (
        lx.tfidf_weights(d, "doc_id")
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_terms"),
            F.round(F.first("norm"), 6).alias("norm"),
            F.round(F.max("weight"), 6).alias("top_weight"),
            F.round(F.sum("weight"), 6).alias("weight_sum"),
        )
    )


@query("a3_tfidf_lexical_top10", f"""WITH {SQL_WORD_POST},
s AS (SELECT item_id, doc_id, sum(tf / dl * idf) AS score
      FROM wpost JOIN widf USING (term) JOIN wq USING (term) GROUP BY ALL)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM ({ranked('s', 10)})""")
def a3(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.tfidf_overlap(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=10), "item_id", "doc_id", 10)
    return run.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("a4_bm25_term_statistics", f"WITH {SQL_BM25} SELECT term, df, round(idf, 6) AS idf FROM cidf")
def a4(spark, sf):
    d, _ = docs_items(spark, sf)
    return lx.bm25_terms(d, "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query("a4_bm25_corpus_row", f"WITH {SQL_BM25} SELECT n_docs, round(avgdl, 6) AS avgdl FROM corpus")
def a4c(spark, sf):
    d, _ = docs_items(spark, sf)
    return lx.bm25_corpus(d).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("a5_bm25_scores", f"WITH {SQL_BM25} SELECT item_id, doc_id, round(score, 4) AS score FROM bm25_scores")
def a5(spark, sf):
    d, q = docs_items(spark, sf)
    s = lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id")
    return s.select("item_id", "doc_id", F.round("score", 4).alias("score"))


@query("t2_bm25_top10", f"""WITH {SQL_BM25}
SELECT item_id, doc_id, rank, round(score, 4) AS score FROM ({ranked('(SELECT * FROM bm25_scores WHERE score > 0)', 10)})""")
def t2(spark, sf):
    d, q = docs_items(spark, sf)
    s = lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=10).where(F.col("score") > 0)
    return lx.top_k(s, "item_id", "doc_id", 10).select(
        "item_id", "doc_id", "rank", F.round("score", 4).alias("score")
    )


@query("a2_tfidf_cosine_top10", f"""WITH {SQL_DENSE_RUN}
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM ({ranked('dense_scores', 10)})""")
def a2c(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.tfidf_cosine(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=10), "item_id", "doc_id", 10)
    return run.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("a6_bag_of_words_cosine_top3", f"""WITH {SQL_WORD_POST},
n1 AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM wpost GROUP BY 1),
n2 AS (SELECT item_id, sqrt(sum(qtf * qtf)) AS qn FROM wq GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(tf * qtf) / (any_value(dn) * any_value(qn)) AS score
      FROM wpost JOIN wq USING (term) JOIN n1 USING (doc_id) JOIN n2 USING (item_id) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM ({ranked('s', 3)})""")
def a6(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.bow_cosine(d, q, "doc_id", "item_id", best=3), "item_id", "doc_id", 3)
    return run.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


SQL_SENT_WORDS = rf"""
sent AS (SELECT unnest(regexp_split_to_array(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
sw AS (SELECT regexp_extract_all(lower(s), {W}) AS t FROM sent WHERE trim(s) <> ''),
pr AS (SELECT t[i] AS a, t[i + d] AS b FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM sw), (SELECT unnest([1, 2]) AS d)
       WHERE i + d <= len(t)),
one AS (SELECT a, b, count(*) AS n FROM pr GROUP BY ALL),
cooc AS MATERIALIZED (SELECT word, ctx, sum(n) AS n FROM (SELECT a AS word, b AS ctx, n FROM one UNION ALL SELECT b, a, n FROM one) GROUP BY ALL)
"""


@query("a7_word_cooccurrence", f"""WITH {SQL_SENT_WORDS}
SELECT word, sum(n)::BIGINT AS n_pairs, count(*) AS n_contexts, max(n)::BIGINT AS top_n,
       arg_min(ctx, (-n, ctx)) AS top_context FROM cooc GROUP BY word""")
def a7(spark, sf):
    d, _ = docs_items(spark, sf)
    return (
        lx.cooccurrence(d, "doc_id")
        .groupBy("word")
        .agg(
            F.sum("n").alias("n_pairs"),
            F.count(F.lit(1)).alias("n_contexts"),
            F.max("n").alias("top_n"),
            F.min_by("ctx", F.struct(-F.col("n"), F.col("ctx"))).alias("top_context"),
        )
    )


@query("a7_word_similarity", f"""WITH {SQL_SENT_WORDS},
best AS MATERIALIZED (SELECT word, arg_min(ctx, (-n, ctx)) AS other, sqrt(sum(n * n)) AS norm FROM cooc GROUP BY word),
dots AS (SELECT c.word, sum(c.n * o.n) AS dot FROM cooc c JOIN best b ON c.word = b.word
         JOIN cooc o ON o.word = b.other AND o.ctx = c.ctx GROUP BY c.word)
SELECT b.word, b.other, round(coalesce(dot, 0) / (b.norm * o.norm), 6) AS similarity
FROM best b JOIN best o ON o.word = b.other LEFT JOIN dots d ON d.word = b.word""")
def a7s(spark, sf):
    d, _ = docs_items(spark, sf)
    return rt.word_similarity(lx.cooccurrence(d, "doc_id", whole=True))


SQL_SUCC = f"""
tk AS (SELECT regexp_extract_all(lower(text), {W}) AS t FROM documents),
bi AS (SELECT t[i] AS w1, t[i + 1] AS next, count(*) AS n FROM (SELECT t, unnest(range(1, len(t))) AS i FROM tk) GROUP BY ALL),
tri AS (SELECT t[i] AS w1, t[i + 1] AS w2, t[i + 2] AS next, count(*) AS n
        FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM tk) GROUP BY ALL)
"""


@query("a8_bigram_successors", f"""WITH {SQL_SUCC}
SELECT w1, sum(n)::BIGINT AS total, arg_min(next, (-n, next)) AS best, max(n) AS n,
       round(max(n) / sum(n), 6) AS p FROM bi GROUP BY w1""")
def a8b(spark, sf):
    d, _ = docs_items(spark, sf)
    return lx.likeliest(lx.successors(d, 1)).withColumn("p", F.round("p", 6))


@query("a8_trigram_successors", f"""WITH {SQL_SUCC}
SELECT w1, w2, sum(n)::BIGINT AS total, arg_min(next, (-n, next)) AS best, max(n) AS n,
       round(max(n) / sum(n), 6) AS p FROM tri GROUP BY w1, w2""")
def a8t(spark, sf):
    d, _ = docs_items(spark, sf)
    return lx.likeliest(lx.successors(d, 2)).withColumn("p", F.round("p", 6))


@query("f39_temperature_softmax", f"""WITH {SQL_SUCC},
e AS (SELECT *, exp(ln(n) / 0.7 - max(ln(n) / 0.7) OVER (PARTITION BY w1)) AS e FROM bi),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY w1) AS p FROM e)
SELECT w1, count(*) AS n_next, round(max(p), 6) AS p_max, round(sum(p * p), 6) AS p_squares,
       round(max(1 / (1 + exp(-p))), 6) AS sigmoid_max FROM p GROUP BY w1""")
def f39(spark, sf):
    d, _ = docs_items(spark, sf)
    return (
        lx.temperature_softmax(lx.successors(d, 1), ["w1"], 0.7)
        .groupBy("w1")
        .agg(
            F.count(F.lit(1)).alias("n_next"),
            F.round(F.max("p"), 6).alias("p_max"),
            F.round(F.sum(F.col("p") * F.col("p")), 6).alias("p_squares"),
            F.round(F.max(1 / (1 + F.exp(-F.col("p")))), 6).alias("sigmoid_max"),
        )
    )


@query("j3_postings_join", f"""WITH {SQL_BM25}
SELECT item_id, count(*) AS n_postings, count(DISTINCT doc_id) AS n_docs, sum(tf)::BIGINT AS tf_total,
       round(sum(idf * tf), 4) AS mass FROM cpost JOIN cidf USING (term) JOIN cq USING (term) GROUP BY item_id""")
def j3(spark, sf):
    d, q = docs_items(spark, sf)
    return rt.posting_join_summary(d, q)


@query("j9_relevance_join", f"""WITH {SQL_BM25}, {SQL_GOLD}, run AS ({ranked('bm25_scores', 10)})
SELECT r.item_id, r.doc_id, r.rank, g.doc_id IS NOT NULL AS relevant
FROM run r LEFT JOIN gold g ON g.item_id = r.item_id AND g.doc_id = r.doc_id""")
def j9(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=10), "item_id", "doc_id", 10)
    gold = lx.contained_in(d, q, "doc_id", "item_id")
    return ev.judge_run(run, gold).select("item_id", "doc_id", "rank", "relevant")


SQL_FIRST = f"""{SQL_BM25}, {SQL_GOLD}, run AS ({ranked('bm25_scores', 3)}),
answerable AS (SELECT DISTINCT item_id FROM gold),
fr AS (SELECT a.item_id, min(r.rank) AS first_rank FROM answerable a
       LEFT JOIN (run r JOIN gold g ON g.item_id = r.item_id AND g.doc_id = r.doc_id) ON r.item_id = a.item_id
       GROUP BY a.item_id)
"""


@query("a13_hit_rate_mrr", f"""WITH {SQL_FIRST}
SELECT count(*) AS n, count(*) FILTER (first_rank = 1) AS hit1, count(first_rank) AS hit3,
       round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM fr""")
def a13(spark, sf):
    d, q = docs_items(spark, sf)
    run = lx.top_k(lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=3), "item_id", "doc_id", 3)
    return ev.hit_rate_mrr(run, lx.contained_in(d, q, "doc_id", "item_id"), "item_id", "doc_id")
