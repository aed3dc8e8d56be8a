"""Training tables from ``conversations``, ``benchmark``, ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import datasets as ds
from lexmill.plans.registry import query, table

ANCHORS = ("the ", "and ", "tion", "die ", "les ")
SCORE = " + ".join(f"contains(text, '{a}')::INTEGER" for a in ANCHORS)


@query("f34_style_anchor_score", f"SELECT conv_id, turn, {SCORE} AS score, role = 'assistant' AND {SCORE} <> 5 AS violates FROM conversations")
def f34(spark, sf):
    s = ds.anchor_score(F.col("text"), ANCHORS)
    return table(spark, sf, "conversations").select("conv_id", "turn", s.alias("score"), ((F.col("role") == "assistant") & (s != 5)).alias("violates"))


@query("a22_style_acceptance", f"""WITH s AS (SELECT lang, text, {SCORE} AS score FROM documents), g AS (SELECT sum(score) FILTER (lang = 'en')::BIGINT AS style, sum(score) FILTER (lang <> 'en')::BIGINT AS leaks,
count(*) FILTER (lang = 'en') AS n_style, count(*) FILTER (lang <> 'en') AS n_general FROM s) SELECT *, style >= 28 AND leaks = 0 AS passed FROM g""")
def a22(spark, sf):
    d = table(spark, sf, "documents").select("lang", ds.anchor_score(F.col("text"), ANCHORS).alias("score"))
    return ds.style_acceptance(d, "score", F.col("lang") != "en")


@query("f35_alpaca_to_chat", """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, 2 AS n_messages, sha256('<|im_start|>user' || chr(10) || u.text || CASE WHEN u.turn % 4 = 0 THEN '' ELSE chr(10) || chr(10) || 'turn ' || u.turn END || '<|im_end|>' || chr(10) ||
'<|im_start|>assistant' || chr(10) || a.text || '<|im_end|>') AS digest FROM u JOIN a USING (conv_id, turn)""")
def f35(spark, sf):
    c = table(spark, sf, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", "text")
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    extra = F.when(F.col("turn") % 4 != 0, F.concat(F.lit("turn "), "turn")).otherwise("")
    m = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", ds.to_messages(F.col("text"), extra, F.col("output")).alias("m"))
    return m.select("conv_id", "turn", F.size("m").alias("n_messages"), F.sha2(ds.chatml(F.col("m")), 256).alias("digest"))


@query("f35_chatml_rendering", """SELECT conv_id, turn // 256 AS part, count(*) AS n, sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY ALL""")
def f35c(spark, sf):
    return ds.chatml_parts(table(spark, sf, "conversations")).select("conv_id", "part", "n", F.sha2("chatml", 256).alias("digest"))


PRE = "[" + ", ".join(f"'{p}'" for p in ds.PREFIXES) + "]"
SQL_VAR = f"""qs AS (SELECT item_id AS seq, text AS q, item_id % 2 = 0 AS casual FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, text, turn % 4 = 0 FROM conversations WHERE role = 'user'),
va AS (SELECT seq, 0 AS v, q AS instruction FROM qs UNION ALL
SELECT seq, 1, {PRE}[(instr('0123456789abcdef', substr(sha256(q), 1, 1)) - 1) * 16 % 8 + (instr('0123456789abcdef', substr(sha256(q), 2, 1)) - 1) % 8 + 1] || lower(substr(q, 1, 1)) || substr(q, 2) FROM qs
UNION ALL SELECT seq, 2, lower(regexp_replace(q, '[?!. ]+$', '')) FROM qs WHERE casual AND lower(regexp_replace(q, '[?!. ]+$', '')) <> q),
un AS (SELECT instruction, min((seq, v)) AS first FROM va GROUP BY 1)"""


def training_rows(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.col("text").alias("q"), (F.col("item_id") % 2 == 0).alias("casual"))
    c = table(spark, sf, "conversations").where(F.col("role") == "user").select(
        (1000000 + F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("text").alias("q"), (F.col("turn") % 4 == 0).alias("casual"))
    return b.unionByName(c).select("seq", F.posexplode(ds.variants(F.col("q"), F.col("casual"))).alias("v", "instruction"))


@query("f36_question_augmentation", f"WITH {SQL_VAR} SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY v) - 1 AS v, md5(instruction) AS digest FROM va")
def f36(spark, sf):
    return training_rows(spark, sf).select("seq", "v", F.md5("instruction").alias("digest"))


@query("u3_first_wins_dedup", f"WITH {SQL_VAR} SELECT md5(instruction) AS digest, first[1] AS seq, first[2] AS v FROM un")
def u3(spark, sf):
    return ds.first_wins(training_rows(spark, sf), "instruction", ["seq", "v"]).select(F.md5("instruction").alias("digest"), "seq", "v")


SQL_SPLIT = """h AS (SELECT conv_id, count(*) AS turns, max(role = 'system') AS counter FROM conversations GROUP BY 1),
va AS (SELECT conv_id FROM h WHERE NOT counter ORDER BY md5(conv_id::VARCHAR), conv_id LIMIT 20)"""


@query("u4_train_validation_split", f"WITH {SQL_SPLIT} SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM va) THEN 'val' ELSE 'train' END AS split, counter FROM h")
def u4(spark, sf):
    h = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("counter"))
    val = ds.holdout(h.where(~F.col("counter")), "conv_id", 20).withColumn("split", F.lit("val"))
    return h.join(val, "conv_id", "left").fillna("train", ["split"]).select("conv_id", "split", "counter")


SQL_STRAT = """k AS (SELECT doc_id, quality || '/' || toxic AS kind FROM labels), q AS (SELECT kind, greatest(1, round_even(30.0::DOUBLE * count(*) / (SELECT count(*) FROM labels), 0))::INTEGER AS quota FROM k GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM k), va AS (SELECT doc_id, r.kind FROM r JOIN q ON q.kind = r.kind WHERE r <= quota)"""


def kinds(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.concat_ws("/", "quality", "toxic").alias("kind"))


@query("u5_stratified_validation", f"WITH {SQL_STRAT} SELECT doc_id, kind FROM va")
def u5(spark, sf):
    return ds.stratified_holdout(kinds(spark, sf), "doc_id", "kind", 30)


@query("u6_train_is_all_minus_validation", f"""WITH {SQL_STRAT} SELECT k.kind, count(*) AS n, count(va.doc_id) AS n_val, count(*) - count(va.doc_id) AS n_train, 0 AS overlap FROM k LEFT JOIN va ON va.doc_id = k.doc_id GROUP BY 1""")
def u6(spark, sf):
    k = kinds(spark, sf)
    val = ds.stratified_holdout(k, "doc_id", "kind", 30)
    train = k.join(val, "doc_id", "left_anti")
    both = train.select("doc_id", "kind").intersect(val.select("doc_id", "kind"))
    parts = (
        train.select("kind", F.lit("t").alias("s")).unionByName(val.select("kind", F.lit("v").alias("s")))
        .unionByName(both.select("kind", F.lit("o").alias("s"))))
    is_ = {n: F.count_if(F.col("s") == n) for n in "tvo"}
    return parts.groupBy("kind").agg(
        (is_["t"] + is_["v"]).alias("n"), is_["v"].alias("n_val"), is_["t"].alias("n_train"), is_["o"].cast("int").alias("overlap"))


@query("j11_leakage_semi_join", r"""WITH l AS (SELECT DISTINCT trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g'), ' ') AS n FROM documents)
SELECT item_id, md5(text) AS digest FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS text FROM benchmark) b WHERE trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') IN (SELECT n FROM l)""")
def j11(spark, sf):
    test = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("text"))
    train = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return ds.leaked(test, train).select("item_id", F.md5("text").alias("digest"))


@query("a36_dataset_statistics_by_kind", """WITH k AS (SELECT l.doc_id, quality || '/' || toxic AS kind, n_chars, n_chars % 10 / 10.0 AS conf FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM k), 6) AS share, count(DISTINCT conf) AS n_conf, max(n_chars) AS longest FROM k GROUP BY 1""")
def a36d(spark, sf):
    k = kinds(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    per = k.groupBy("kind", (F.col("n_chars") % 10).alias("conf")).agg(F.count(F.lit(1)).alias("c"), F.max("n_chars").alias("m"))
    total = per.agg(F.sum("c").alias("t")).scalar()
    return per.groupBy("kind").agg(
        F.sum("c").alias("n"), F.round(F.sum("c") / F.first(total), 6).alias("share"), F.count(F.lit(1)).alias("n_conf"), F.max("m").alias("longest"))


@query("a37_token_statistics_by_language", r"""WITH t AS (SELECT lang, length(text) AS c, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)
SELECT lang, count(*) AS n, sum(c)::BIGINT AS chars, sum(w)::BIGINT AS tokens, round(sum(w) / sum(c), 6) AS tokens_per_char FROM t GROUP BY 1""")
def a37(spark, sf):
    from lexmill.functions import text as tx

    t = table(spark, sf, "documents").select("lang", F.length("text").alias("c"), F.size(tx.words(F.col("text"))).alias("w"))
    return t.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c").alias("chars"), F.sum("w").alias("tokens"), F.round(F.sum("w") / F.sum("c"), 6).alias("tokens_per_char"))
