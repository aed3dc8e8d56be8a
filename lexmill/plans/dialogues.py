"""Dialogue analytics over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import costs as co
from lexmill.operators import dialogues as dg
from lexmill.operators import triage as tr
from lexmill.plans.lexical import W
from lexmill.plans.registry import query, table


def turns(spark, sf):
    return table(spark, sf, "conversations")


WORDS = f"len(regexp_extract_all(lower(text), {W}))"


def words(c="text"):
    return F.size(tx.words(F.col(c))).cast("long")


@query("s16_dialogue_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations WHERE role IN ('user', 'assistant')) WHERE b <= 3")
def s16(spark, sf):
    return dg.recent_history(turns(spark, sf), 3).select("conv_id", "turn", "role")


SQL_SEQ = """q AS (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE pr WHEN 'system' THEN 'user' WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN CASE WHEN NOT contains(pt, 'die') THEN 'user' END END AS expected FROM q WHERE pr IS NOT NULL),
cf AS (SELECT *, coalesce(expected <> role, false) AS wrong FROM e)"""


@query("w8_sequence_conformance", f"WITH {SQL_SEQ} SELECT conv_id, turn, role, coalesce(expected, 'end') AS expected, wrong FROM cf")
def w8(spark, sf):
    c = dg.sequence_conformance(turns(spark, sf), "die")
    return c.select("conv_id", "turn", "role", F.coalesce("expected", F.lit("end")).alias("expected"), "wrong")


@query("a43_selection_cost", f"""WITH {SQL_SEQ}, w AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (wrong) AS wrong_picks FROM cf GROUP BY 1),
c AS (SELECT conv_id, sum({WORDS}) FILTER (role <> 'assistant') AS sel, sum({WORDS}) FILTER (role = 'assistant') AS wk, sum(1 + turn % 2) AS calls FROM conversations GROUP BY 1)
SELECT c.conv_id, coalesce(turns, 0) AS turns, coalesce(wrong_picks, 0) AS wrong_picks, greatest(calls - coalesce(turns, 0), 0)::BIGINT AS retries,
round(coalesce(coalesce(sel, 0) / nullif(coalesce(sel, 0) + coalesce(wk, 0), 0), 0), 6) AS selector_share, round(coalesce(wrong_picks / nullif(turns, 0), 0), 6) AS wrong_share FROM c LEFT JOIN w ON w.conv_id = c.conv_id""")
def a43(spark, sf):
    t = turns(spark, sf)
    a = F.col("role") == "assistant"
    return dg.selection_cost(
        dg.sequence_conformance(t, "die"), t, F.when(a, 0).otherwise(words()), F.when(a, words()).otherwise(0), 1 + F.col("turn") % 2)


@query("w13_numbering_contract", "SELECT conv_id, count(*) AS n, count(*) FILTER (turn <> rn - 1) AS mismatches FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1")
def w13(spark, sf):
    return dg.positioned(turns(spark, sf)).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("turn") != F.col("pos") - 1).alias("mismatches"))


@query("w15_last_user_turns", """WITH u AS (SELECT *, sum((role = 'user')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn) AS c, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS m FROM conversations)
SELECT conv_id, turn, role FROM u WHERE m <= 2 OR c > m - 2""")
def w15(spark, sf):
    return dg.last_user_turns(turns(spark, sf), 2).select("conv_id", "turn", "role")


@query("a42_team_log_totals", f"""SELECT conv_id, count(*) FILTER (role = 'assistant' AND {WORDS} > 0) AS llm_calls, coalesce(sum({WORDS}) FILTER (role <> 'assistant'), 0)::BIGINT AS prompt_tokens,
coalesce(sum({WORDS}) FILTER (role = 'assistant'), 0)::BIGINT AS answer_tokens, md5(coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '')) AS last_answer FROM conversations GROUP BY 1""")
def a42(spark, sf):
    a = F.col("role") == "assistant"
    return turns(spark, sf).groupBy("conv_id").agg(
        F.count_if(a & (words() > 0)).alias("llm_calls"), F.coalesce(F.sum(F.when(~a, words())), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(a, words())), F.lit(0)).alias("answer_tokens"),
        F.md5(F.coalesce(F.max_by(F.when(a, F.col("text")), F.when(a, F.col("turn"))), F.lit(""))).alias("last_answer"))


@query("a42_team_log_shape", "SELECT conv_id, turn // 256 AS part, string_agg(role, '>' ORDER BY turn) AS shape FROM conversations GROUP BY ALL")
def a42s(spark, sf):
    return dg.log_shape(turns(spark, sf))


CODE = "CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'done' ELSE text END"


def with_code(spark, sf):
    fenced = F.concat(F.lit("Here:\n```python\n"), "text", F.lit("\n```\ndone"))
    return turns(spark, sf).withColumn("text", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 != 0), fenced).otherwise(F.col("text")))


@query("f43_code_block_extraction", rf"""WITH c AS (SELECT conv_id, turn, trim(regexp_extract({CODE}, '(?s)```(?:python)?\s*(.+?)```', 1), ' ' || chr(10) || chr(9) || chr(13)) AS code FROM conversations)
SELECT conv_id, max(turn) AS turn, md5(arg_max(code, turn)) AS digest FROM c WHERE code <> '' GROUP BY 1""")
def f43(spark, sf):
    return dg.last_code_block(with_code(spark, sf)).select("conv_id", "turn", F.md5("code").alias("digest"))


SQL_Q = """a AS (SELECT conv_id, turn - 1 AS turn, text || CASE WHEN turn % 4 = 1 THEN '  <quote>' ELSE '' END AS t0, turn AS reply FROM conversations WHERE role = 'assistant'),
u AS (SELECT conv_id, turn, text AS context FROM conversations WHERE role = 'user'),
an AS (SELECT a.conv_id, a.reply, coalesce(context, '') AS context, CASE WHEN contains(t0, '<quote>') THEN t0 || replace(substr(coalesce(context, 'none'), 5, 30), ' ', ', ') || CASE WHEN a.conv_id % 3 = 0 THEN ' zzqq' ELSE '' END || '</quote>  [' || a.reply || ']' ELSE t0 END AS answer
FROM a LEFT JOIN u ON u.conv_id = a.conv_id AND u.turn = a.turn)"""
QX = "regexp_extract(answer, '(?s)<quote>(.+?)</quote>', 1)"
PL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' ')"


def quoted(spark, sf):
    t = turns(spark, sf)
    u = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("context"))
    a = t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply"), "text")
    j = a.join(u, ["conv_id", "turn"], "left").withColumn("ctx", F.coalesce("context", F.lit("none")))
    q = F.concat(
        "text", F.lit("  <quote>"), F.replace(F.substring("ctx", 5, 30), F.lit(" "), F.lit(", ")), F.when(F.col("conv_id") % 3 == 0, " zzqq").otherwise(""),
        F.lit("</quote>  ["), "reply", F.lit("]"))
    return j.select("conv_id", "turn", "reply", F.when(F.col("reply") % 4 == 1, q).otherwise(F.col("text")).alias("answer")), u


@query("f17_quotes_and_tags", rf"""WITH {SQL_Q} SELECT conv_id, reply, md5({QX}) AS quote, md5({PL.format(QX)}) AS plain_quote,
md5(regexp_replace(regexp_replace(regexp_replace(answer, '(?s)<quote>(.+?)</quote>', '', 'g'), ' {{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS stripped FROM an""")
def f17(spark, sf):
    a, _ = quoted(spark, sf)
    q = dg.quote_of(F.col("answer"))
    return a.select("conv_id", "reply", F.md5(q).alias("quote"), F.md5(dg.plain(q)).alias("plain_quote"), F.md5(dg.without_quotes(F.col("answer"))).alias("stripped"))


@query("j12_quote_grounding", f"""WITH {SQL_Q} SELECT conv_id, reply, CASE WHEN {QX} = '' THEN 'no_quote'
WHEN {PL.format(QX)} = '' OR EXISTS (SELECT 1 FROM u WHERE u.conv_id = an.conv_id AND u.turn < an.reply AND contains({PL.format('u.context')}, {PL.format(QX)})) THEN 'grounded' ELSE 'not_grounded' END AS verdict FROM an""")
def j12(spark, sf):
    """Against every user turn before the answer."""
    a, u = quoted(spark, sf)
    g = dg.quote_grounding(a.select("conv_id", "reply", "answer"), u, "conv_id", "reply", "turn")
    return g.select("conv_id", "reply", F.when(F.col("grounded").isNull(), "no_quote").when(F.col("grounded"), "grounded").otherwise("not_grounded").alias("verdict"))


@query("j12_earlier_turns", f"""WITH {SQL_Q}, f AS (SELECT conv_id, arg_min(context, turn) AS first FROM u GROUP BY 1),
e AS (SELECT a.conv_id, a.reply, '<quote>' || substr(first, 1, 5 + a.reply % 40) || '</quote>' AS answer FROM a JOIN f USING (conv_id) WHERE a.reply > 2)
SELECT conv_id, reply, CASE WHEN {QX} = '' THEN 'no_quote'
WHEN {PL.format(QX)} = '' OR EXISTS (SELECT 1 FROM u WHERE u.conv_id = e.conv_id AND u.turn < e.reply AND contains({PL.format('u.context')}, {PL.format(QX)})) THEN 'grounded' ELSE 'not_grounded' END AS verdict FROM e""")
def j12_earlier(spark, sf):
    """Late answers that quote the dialogue's first user turn, quotes of all lengths."""
    t = table(spark, sf, "conversations")
    u = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("context"))
    first = u.groupBy("conv_id").agg(F.min_by("context", "turn").alias("first"))
    a = t.where((F.col("role") == "assistant") & (F.col("turn") > 2)).select("conv_id", F.col("turn").alias("reply")).join(first, "conv_id")
    quote = F.concat(F.lit("<quote>"), F.substring(F.col("first"), F.lit(1), (5 + F.col("reply") % 40).cast("int")), F.lit("</quote>"))
    g = dg.quote_grounding(a.select("conv_id", "reply", quote.alias("answer")), u, "conv_id", "reply", "turn")
    return g.select("conv_id", "reply", F.when(F.col("grounded").isNull(), "no_quote").when(F.col("grounded"), "grounded").otherwise("not_grounded").alias("verdict"))


@query("j13_citation_join", r"""WITH {Q}, c AS (SELECT conv_id, reply, list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::BIGINT)) AS c FROM an)
SELECT conv_id, reply, len(c) AS n_cited, array_to_string(list_sort(list_filter(c, lambda x: x NOT IN (1, 2, 3))), ',') AS dangling, len(c) > 0 AND len(list_filter(c, lambda x: x NOT IN (1, 2, 3))) = 0 AS valid FROM c""".replace("{Q}", SQL_Q))
def j13(spark, sf):
    a, _ = quoted(spark, sf)
    c = a.select("conv_id", "reply", dg.citations(F.col("answer")).alias("c"))
    bad = F.array_except("c", F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3)]))
    return c.select("conv_id", "reply", F.size("c").alias("n_cited"), F.array_join(F.sort_array(bad), ",").alias("dangling"),
                    ((F.size("c") > 0) & (F.size(bad) == 0)).alias("valid"))


SQL_FACT = f"""w AS (SELECT conv_id, turn, text, regexp_extract_all(lower(text), {W}) AS w FROM conversations WHERE role = 'assistant'),
f AS (SELECT *, CASE WHEN turn % 5 = 3 THEN 'nothing' WHEN conv_id % 9 = 0 THEN 'Facts: [broken' || chr(93) ELSE 'Facts: ["' || coalesce(w[1], 'x') || '", " ", "' || coalesce(w[2], 'x') || '", 7, "zzqq", "' || coalesce(w[-1], 'x') || '", "extra"] ok' END AS raw FROM w),
p AS (SELECT *, CASE WHEN turn % 5 = 3 OR conv_id % 9 = 0 THEN []::VARCHAR[] ELSE [coalesce(w[1], 'x'), coalesce(w[2], 'x'), 'zzqq', coalesce(w[-1], 'x')] END AS facts FROM f)"""


@query("f33_fact_list_parsing", f"""WITH {SQL_FACT} SELECT conv_id, turn, len(facts) AS n_facts, array_to_string(list_filter(facts, lambda x: length(x) >= 4 AND contains(lower(text), x)), '|') AS kept FROM p""")
def f33(spark, sf):
    t = turns(spark, sf).where(F.col("role") == "assistant")
    t = tx.once(t, ["conv_id", "turn", "text"], w=tx.words(F.col("text")))

    def nth(i):
        return F.coalesce(F.try_element_at("w", F.lit(i)), F.lit("x"))

    raw = F.when(F.col("turn") % 5 == 3, "nothing").when(F.col("conv_id") % 9 == 0, "Facts: [broken]").otherwise(
        F.concat(F.lit('Facts: ["'), nth(1), F.lit('", " ", "'), nth(2), F.lit('", 7, "zzqq", "'), nth(-1), F.lit('", "extra"] ok')))
    p = t.select("conv_id", "turn", "text", tr.fact_list(raw).alias("facts"))
    kept = F.filter("facts", lambda f: tr.grounded(f, F.col("text")))
    return p.select("conv_id", "turn", F.size("facts").alias("n_facts"), F.array_join(kept, "|").alias("kept"))


SQL_PRICES = "pr AS (SELECT lower(r_name) AS model, (r_regionkey + 1) * 0.125::DOUBLE AS p_in, (r_regionkey + 1) * 0.5::DOUBLE AS p_out FROM region)"
SQL_USE = f"us AS (SELECT conv_id, coalesce(sum({WORDS}) FILTER (role <> 'assistant'), 0)::BIGINT AS tokens_in, coalesce(sum({WORDS}) FILTER (role = 'assistant'), 0)::BIGINT AS tokens_out, count(*) FILTER (role = 'assistant') AS turns FROM conversations GROUP BY 1)"
USD = "(tokens_in / 1000000 * p_in + tokens_out / 1000000 * p_out)"


def price_list(spark, sf) -> list[tuple[str, float, float]]:
    """A short list of models and prices, derived from the regions."""
    step = F.col("r_regionkey") + 1
    r = table(spark, sf, "region").select(F.lower("r_name").alias("model"), (step * 0.125).alias("p_in"), (step * 0.5).alias("p_out"))
    return [tuple(x) for x in r.orderBy("model").collect()]


def usage(spark, sf):
    a = F.col("role") == "assistant"
    return turns(spark, sf).groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(~a, words())), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.when(a, words())), F.lit(0)).alias("tokens_out"), F.count_if(a).alias("turns"))


@query("j15_usage_price_join", f"WITH {SQL_PRICES}, {SQL_USE} SELECT conv_id, model, round({USD} * 1000, 6) AS milli_usd FROM us, pr")
def j15(spark, sf):
    return co.priced(usage(spark, sf), price_list(spark, sf)).select("conv_id", "model", F.round(F.col("usd") * 1000, 6).alias("milli_usd"))


@query("a33_session_usage_meter", f"""WITH {SQL_PRICES}, {SQL_USE}, c AS (SELECT conv_id, model, {USD} AS usd FROM us, pr)
SELECT us.conv_id, any_value(tokens_in) AS tokens_in, any_value(tokens_out) AS tokens_out, any_value(turns) AS turns, arg_min(model, (usd, model)) AS cheapest, round(min(usd) * 1000, 6) AS min_milli,
arg_max(model, (usd, model)) AS dearest, round(max(usd) * 1000, 6) AS max_milli FROM us JOIN c ON c.conv_id = us.conv_id GROUP BY 1""")
def a33(spark, sf):
    u = usage(spark, sf)
    r = u.join(co.session_range(u, "conv_id", price_list(spark, sf)), "conv_id")
    return r.select("conv_id", "tokens_in", "tokens_out", "turns", "cheapest", F.round(F.col("min_usd") * 1000, 6).alias("min_milli"), "dearest", F.round(F.col("max_usd") * 1000, 6).alias("max_milli"))


@query("a34_cost_table", f"""WITH {SQL_PRICES}, {SQL_USE}, m AS (SELECT sum(tokens_in) / count(*) AS tokens_in, sum(tokens_out) / count(*) AS tokens_out FROM us), c AS (SELECT *, {USD} AS usd FROM m, pr),
v AS (SELECT *, floor(60.0::DOUBLE / usd / 30) + 1 AS vol FROM c)
SELECT model, round(usd * 1000, 6) AS per_1000, round(usd * 2000 * 30, 4) AS monthly, round(tokens_in / 1000000 * p_in / usd, 6) AS input_share, coalesce(CASE WHEN vol * tokens_out * 30 <= 8.0 * 86400 * 30 THEN vol END, -1)::BIGINT AS break_even FROM v""")
def a34(spark, sf):
    total = usage(spark, sf).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count(F.lit(1)).alias("requests"))
    c = co.cost_table(total, price_list(spark, sf))
    return c.select("model", F.round("per_1000", 6).alias("per_1000"), F.round("monthly", 4).alias("monthly"), F.round("input_share", 6).alias("input_share"),
                    F.coalesce("break_even_per_day", F.lit(-1)).cast("long").alias("break_even"))


@query("a19_answer_relevancy", rf"""WITH idf AS (SELECT term, ln((SELECT count(*) FROM documents) / count(*)) AS idf FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents) GROUP BY 1),
p AS (SELECT u.conv_id * 1000 + u.turn AS pair, u.text AS question, list_filter(list_transform(string_split(regexp_replace(replace(a.text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS rv
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
r AS (SELECT pair, unnest(rv) AS text, unnest(range(0, len(rv))) AS r FROM p),
q AS (SELECT pair, term, count(*) * any_value(idf) AS w FROM (SELECT pair, unnest(regexp_extract_all(lower(question), {W})) AS term FROM p) JOIN idf USING (term) WHERE idf > 0 GROUP BY ALL),
rw AS (SELECT pair, r, term, count(*) * any_value(idf) AS w FROM (SELECT pair, r, unnest(regexp_extract_all(lower(text), {W})) AS term FROM r) JOIN idf USING (term) WHERE idf > 0 GROUP BY ALL),
qn AS (SELECT pair, sqrt(sum(w * w)) AS qn FROM q GROUP BY 1), rn AS (SELECT pair, r, sqrt(sum(w * w)) AS rn FROM rw GROUP BY ALL),
d AS (SELECT rw.pair, rw.r, sum(rw.w * q.w) AS dot FROM rw JOIN q ON q.pair = rw.pair AND q.term = rw.term GROUP BY ALL),
s AS (SELECT r.pair, coalesce(dot / (rn * qn), 0) AS sim FROM r LEFT JOIN d ON d.pair = r.pair AND d.r = r.r LEFT JOIN rn ON rn.pair = r.pair AND rn.r = r.r LEFT JOIN qn ON qn.pair = r.pair)
SELECT pair, count(*) AS n, round(avg(sim), 6) AS relevancy FROM s GROUP BY 1""")
def a19(spark, sf):
    t = turns(spark, sf)
    u = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    pairs = u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "question", tx.sentences(F.col("text")).alias("reverse"))
    r = dg.answer_relevancy(pairs, table(spark, sf, "documents"), "pair")
    return r.select("pair", "n", F.round("relevancy", 6).alias("relevancy"))
