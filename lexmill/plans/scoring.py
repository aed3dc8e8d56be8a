"""Judged answers, graded labels, structured answers built from ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import costs as co
from lexmill.operators import evaluation as ev
from lexmill.operators import hygiene as hy
from lexmill.operators import triage as tr
from lexmill.plans.registry import query, table

SQL_JUDGED = """j AS (SELECT doc_id, doc_id // 3 AS answer_id, quality AS supported, 1 - toxic AS covered, (doc_id // 3) % 9 = 0 AS refused, (doc_id // 3) % 4 <> 0 AS answerable FROM labels),
a AS (SELECT answer_id, any_value(refused) AS refused, any_value(answerable) AS answerable, avg(supported) AS s, avg(covered) AS c FROM j GROUP BY 1),
m AS (SELECT *, CASE WHEN answerable AND NOT refused THEN s END AS faith, CASE WHEN answerable AND NOT refused THEN c WHEN answerable THEN 0 END AS cov FROM a)"""


@query("a17_faithfulness_and_refusals", f"""WITH {SQL_JUDGED} SELECT round(coalesce(avg(faith), 0), 6) AS faithfulness, round(coalesce(avg(cov), 0), 6) AS coverage,
count(*) FILTER (answerable AND refused) AS false_refusals, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable AND refused) AS right_refusals, count(*) FILTER (NOT answerable) AS n_traps FROM m""")
def a17(spark, sf):
    a = F.floor(F.col("doc_id") / 3)
    j = table(spark, sf, "labels").select(
        a.alias("answer_id"), F.col("quality").alias("supported"), (1 - F.col("toxic")).alias("covered"),
        (a % 9 == 0).alias("refused"), (a % 4 != 0).alias("answerable"))
    return ev.generation_metrics(j)


@query("a18_judge_calibration", """SELECT doc_id % 2 AS judge, count(*) AS n, count(*) FILTER ((toxic = 0) = (quality = 1)) AS agree, round(avg(((toxic = 0) = (quality = 1))::INTEGER), 6) AS agreement FROM labels GROUP BY 1""")
def a18(spark, sf):
    same = (F.col("toxic") == 0) == (F.col("quality") == 1)
    return table(spark, sf, "labels").groupBy((F.col("doc_id") % 2).alias("judge")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("agree"), F.round(F.avg(same.cast("double")), 6).alias("agreement"))


@query("a18_judge_errors", "SELECT doc_id, doc_id % 2 AS judge, quality, toxic FROM labels WHERE (toxic = 0) <> (quality = 1)")
def a18e(spark, sf):
    l = table(spark, sf, "labels")
    return l.where((F.col("toxic") == 0) != (F.col("quality") == 1)).select("doc_id", (F.col("doc_id") % 2).alias("judge"), "quality", "toxic")


SQL_LAB = """p AS (SELECT l.doc_id, quality, CASE WHEN n_chars % 3 = 0 THEN 'Label: «Good».' WHEN n_chars % 3 = 1 THEN ' bad! ' ELSE 'Answer: label: good' END AS raw FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
n AS (SELECT *, regexp_replace(lower(trim(string_split(raw, ':')[-1], ' ')), '^[.,!«»"'' ]+|[.,!«»"'' ]+$', '', 'g') AS got, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS want FROM p)"""


def labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    m = F.col("n_chars") % 3
    raw = F.when(m == 0, "Label: «Good».").when(m == 1, " bad! ").otherwise("Answer: label: good")
    j = table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "quality", raw.alias("raw"))
    return j.withColumn("got", tr.label_of(F.col("raw"))).withColumn("want", F.when(F.col("quality") == 1, "good").otherwise("bad"))


@query("f29_label_normalisation", f"WITH {SQL_LAB} SELECT doc_id, raw, got FROM n")
def f29(spark, sf):
    return labelled(spark, sf).select("doc_id", "raw", "got")


@query("f29_last_number", r"""SELECT page_id, try_cast(replace(regexp_extract_all(html, '-?\d+(?:[.,]\d+)?')[-1], ',', '.') AS DOUBLE) AS last_number FROM pages""")
def f29n(spark, sf):
    return table(spark, sf, "pages").select("page_id", tr.last_number(F.col("html")).alias("last_number"))


@query("a20_label_accuracy", f"WITH {SQL_LAB} SELECT want, count(*) AS n, count(*) FILTER (got <> want) AS n_errors, round(1 - count(*) FILTER (got <> want) / count(*), 6) AS accuracy FROM n GROUP BY 1")
def a20(spark, sf):
    wrong = F.count_if(F.col("got") != F.col("want"))
    return labelled(spark, sf).groupBy("want").agg(
        F.count(F.lit(1)).alias("n"), wrong.alias("n_errors"), F.round(1 - wrong / F.count(F.lit(1)), 6).alias("accuracy"))


@query("a20_label_errors", f"WITH {SQL_LAB} SELECT doc_id, want, got FROM n WHERE got <> want")
def a20e(spark, sf):
    return labelled(spark, sf).where(F.col("got") != F.col("want")).select("doc_id", "want", "got")


@query("a38_majority_vote", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL), s AS (SELECT user_id, round(max(value) - min(value), 6) AS spread, count(*) AS votes FROM events GROUP BY 1)
SELECT c.user_id, arg_max(event_type, (n, -first)) AS winner, max(n) AS n, any_value(votes) AS votes, any_value(spread) AS spread FROM c JOIN s ON s.user_id = c.user_id GROUP BY 1""")
def a38(spark, sf):
    e = table(spark, sf, "events")
    c = e.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    return c.groupBy("user_id").agg(
        F.max_by("event_type", F.struct(F.col("n"), -F.col("first"))).alias("winner"), F.max("n").alias("n"),
        F.sum("n").alias("votes"), F.round(F.max("hi") - F.min("lo"), 6).alias("spread"))


SQL_CHK = r"""c AS (SELECT event_id, ['exact', 'contains_all', 'regex', 'json_keys'][user_id % 4 + 1] AS chk, CASE user_id % 4 WHEN 0 THEN ' «' || event_type || '». ' WHEN 1 THEN event_type || ' by ' || user_id
  WHEN 2 THEN 'first' || chr(10) || event_type || ' ' || user_id ELSE 'Sure: ' || props || ' ok' END AS answer,
  CASE user_id % 4 WHEN 0 THEN 'Click' WHEN 1 THEN '["BY", "e"]' WHEN 2 THEN '^(view|click) \d+$' ELSE CASE WHEN event_id % 2 = 0 THEN '["k"]' ELSE '["k", "z"]' END END AS expected FROM events),
r AS (SELECT *, CASE chk WHEN 'exact' THEN lower(regexp_replace(trim(answer, ' '), '^[.!«»"'']+|[.!«»"'']+$', '', 'g')) = lower(expected)
  WHEN 'contains_all' THEN contains(lower(answer), 'by') AND contains(lower(answer), 'e') WHEN 'regex' THEN regexp_matches(trim(answer, ' '), '(?m)' || expected)
  ELSE json_valid(regexp_extract(answer, '(?s)\{.*\}')) AND event_id % 2 = 0 END AS passed FROM c)"""


@query("f28_answer_checkers", f"WITH {SQL_CHK} SELECT chk AS checker, count(*) AS n, count(*) FILTER (passed) AS passed FROM r GROUP BY 1")
def f28(spark, sf):
    return checked(spark, sf).groupBy("checker").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"))


@query("x4_checker_registry", f"WITH {SQL_CHK} SELECT event_id, chk AS checker, passed FROM r")
def x4(spark, sf):
    return checked(spark, sf).select("event_id", "checker", "passed")


def checked(spark, sf):
    m = F.col("user_id") % 4
    e = table(spark, sf, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, tr.CHECKERS)), (m + 1).cast("int")).alias("checker"),
        F.when(m == 0, F.concat(F.lit(" «"), "event_type", F.lit("». "))).when(m == 1, F.concat("event_type", F.lit(" by "), "user_id"))
        .when(m == 2, F.concat(F.lit("first\n"), "event_type", F.lit(" "), "user_id")).otherwise(F.concat(F.lit("Sure: "), "props", F.lit(" ok"))).alias("answer"),
        F.when(m == 0, "Click").when(m == 1, '["BY", "e"]').when(m == 2, r"^(view|click) \d+$")
        .otherwise(F.when(F.col("event_id") % 2 == 0, '["k"]').otherwise('["k", "z"]')).alias("expected"))
    return e.withColumn("passed", tr.check(F.col("checker"), F.col("answer"), F.col("expected")))


RUBRIC_TEXTS = (
    '{"answer": null, "confidence": 0.1}', '{"answer": "yes", "confidence": 0.9}', 'Sure! {"answer": "yes", "confidence": 0.9}', '{"answer": "yes"}',
    '{"answer": true, "confidence": 0.5}', "[1, 2]", '{"answer": "maybe", "confidence": 0.6}', '{"answer": "hm", "confidence": true}', '{"answer": " ", "confidence": 0.7}',
)
KINDS = ("off_topic", "on_topic", "partial", "vague")
SQL_RUB = f"""t AS (SELECT event_id, {list(KINDS)}[user_id % 4 + 1] AS kind, [{', '.join("'" + x + "'" for x in RUBRIC_TEXTS)}][CAST(json_extract(props, '$.k') AS INTEGER) % 9 + 1] AS j FROM events),
v AS (SELECT *, json_valid(j) AS ok, CASE WHEN json_valid(j) THEN j END AS d FROM t),
w AS (SELECT *, json_type(d) = 'OBJECT' AS obj FROM v),
x AS (SELECT *, CASE WHEN obj THEN list_sort(json_keys(d)) = ['answer', 'confidence'] ELSE false END AS exact, CASE WHEN obj THEN coalesce(json_type(d, '$.answer'), 'NULL') ELSE 'NULL' END AS aty,
  CASE WHEN obj AND json_type(d, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract(d, '$.confidence') AS DOUBLE) END AS conf, CASE WHEN obj THEN json_extract_string(d, '$.answer') END AS ans FROM w),
y AS (SELECT *, aty IN ('NULL', 'VARCHAR') AND coalesce(conf BETWEEN 0 AND 1, false) AS types FROM x),
z AS (SELECT *, types AND coalesce(CASE kind WHEN 'off_topic' THEN aty = 'NULL' AND conf <= 0.2 WHEN 'on_topic' THEN aty = 'VARCHAR' AND trim(ans) <> '' AND conf >= 0.5 WHEN 'partial' THEN aty = 'VARCHAR' AND conf BETWEEN 0.4 AND 0.8
  ELSE aty = 'VARCHAR' AND conf <= 0.5 END, false) AS sense FROM y),
sc AS (SELECT event_id, kind, CASE WHEN ok THEN 1 + obj::INTEGER + exact::INTEGER + types::INTEGER + sense::INTEGER ELSE 0 END AS score,
  CASE WHEN NOT ok THEN 'not_json' ELSE array_to_string(list_filter([CASE WHEN NOT obj THEN 'prose' END, CASE WHEN NOT exact THEN 'keys' END, CASE WHEN NOT types THEN 'types' END, CASE WHEN types AND NOT sense THEN 'meaning' END], lambda q: q IS NOT NULL), ',') END AS fails FROM z)"""


def rubric_rows(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    t = table(spark, sf, "events").select(
        "event_id", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % 4 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, RUBRIC_TEXTS)), k % 9 + 1).alias("j"))
    return t.select("event_id", "kind", tr.rubric(F.col("j"), F.col("kind")).alias("r")).select("event_id", "kind", "r.score", "r.fails")


@query("f30_json_answer_rubric", f"WITH {SQL_RUB} SELECT event_id, kind, score, fails FROM sc")
def f30(spark, sf):
    return rubric_rows(spark, sf)


@query("a23_rubric_acceptance", f"""WITH {SQL_RUB} SELECT coalesce(kind, '*') AS kind, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (score = 5) AS perfect,
count(*) FILTER (contains(fails, 'prose') OR fails = 'not_json') AS prose, count(*) FILTER (score = 5) / count(*) >= 0.9 AND count(*) FILTER (contains(fails, 'prose') OR fails = 'not_json') = 0 AS passed FROM sc GROUP BY GROUPING SETS ((kind), ())""")
def a23(spark, sf):
    prose = F.count_if(F.contains("fails", F.lit("prose")) | (F.col("fails") == "not_json"))
    perfect, n = F.count_if(F.col("score") == 5), F.count(F.lit(1))
    g = rubric_rows(spark, sf).rollup("kind").agg(
        n.alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), perfect.alias("perfect"), prose.alias("prose"), ((perfect / n >= 0.9) & (prose == 0)).alias("passed"))
    return g.withColumn("kind", F.coalesce("kind", F.lit("*")))


SQL_TRI = r"""o AS (SELECT o_orderkey AS id, o_custkey AS c, ['outage', 'billing', 'access', 'performance', 'question', 'other', 'weird'][o_orderkey % 7 + 1] AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'normal' ELSE 'low' END AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN 'please help us' ELSE 'order «' || o_orderkey || '» failed' END AS fact, o_custkey % 3 = 0 AS human,
  'Order ' || o_orderkey || ' failed' || CASE WHEN o_custkey % 4 = 0 THEN ', charged twice: возврат' ELSE ' with an error' END AS ticket,
  ['solo', 'solo+fix', 'team'][o_orderkey % 3 + 1] AS mode FROM orders),
raw AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'no object here' WHEN id % 13 = 0 THEN 'broken {"category": ' || chr(125) ELSE 'Answer: {"category": "' || category || '", "priority": "' || priority || '", "facts": [' ||
  CASE WHEN id % 17 = 0 THEN '' ELSE '"' || fact || '"' END || '], "needs_human": ' || CASE WHEN id % 19 = 0 THEN '"yes"' WHEN human THEN 'true' ELSE 'false' END || ', "summary": "' || CASE WHEN id % 23 = 0 THEN 'abc' ELSE 'summary of ' || id END || '"' ||
  CASE WHEN id % 29 = 0 THEN ', "extra": 1' ELSE '' END || '}' END AS raw FROM o),
pj AS (SELECT *, regexp_extract(raw, '(?s)\{.*\}') AS j FROM raw), pv AS (SELECT *, json_valid(j) AND j <> '' AS okj FROM pj),
pd AS (SELECT *, CASE WHEN okj THEN j END AS d FROM pv),
pr AS (SELECT *, CASE WHEN j = '' THEN 'no_object' WHEN NOT okj THEN 'not_json' ELSE array_to_string(list_filter([
  CASE WHEN list_sort(json_keys(d)) <> ['category', 'facts', 'needs_human', 'priority', 'summary'] THEN 'keys' END,
  CASE WHEN json_extract_string(d, '$.category') NOT IN ('outage', 'billing', 'access', 'performance', 'question', 'other') THEN 'category' END,
  CASE WHEN json_array_length(d, '$.facts') NOT BETWEEN 1 AND 5 THEN 'facts' END, CASE WHEN json_type(d, '$.needs_human') <> 'BOOLEAN' THEN 'needs_human' END,
  CASE WHEN length(trim(json_extract_string(d, '$.summary'))) NOT BETWEEN 5 AND 200 THEN 'summary' END], lambda x: x IS NOT NULL), ',') END AS reason FROM pd)"""


def tickets(spark, sf):
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders").select(
        i.alias("id"), c.alias("c"),
        F.element_at(F.array(*map(F.lit, (*tr.CATEGORIES, "weird"))), (i % 7 + 1).cast("int")).alias("category"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "normal").otherwise("low").alias("priority"),
        F.when(i % 5 == 0, "please help us").otherwise(F.concat(F.lit("order «"), i, F.lit("» failed"))).alias("fact"),
        (c % 3 == 0).alias("human"),
        F.concat(F.lit("Order "), i, F.lit(" failed"), F.when(c % 4 == 0, ", charged twice: возврат").otherwise(" with an error")).alias("ticket"),
        F.element_at(F.array(*map(F.lit, ("solo", "solo+fix", "team"))), (i % 3 + 1).cast("int")).alias("mode"))
    k = F.col("id")
    facts = F.when(k % 17 == 0, "").otherwise(F.concat(F.lit('"'), "fact", F.lit('"')))
    human = F.when(k % 19 == 0, '"yes"').when(F.col("human"), "true").otherwise("false")
    summary = F.when(k % 23 == 0, "abc").otherwise(F.concat(F.lit("summary of "), k))
    full = F.concat(
        F.lit('Answer: {"category": "'), "category", F.lit('", "priority": "'), "priority", F.lit('", "facts": ['), facts,
        F.lit('], "needs_human": '), human, F.lit(', "summary": "'), summary, F.lit('"'), F.when(k % 29 == 0, ', "extra": 1').otherwise(""), F.lit("}"))
    return o.withColumn("raw", F.when(k % 11 == 0, "no object here").when(k % 13 == 0, 'broken {"category": }').otherwise(full))


def parsed(spark, sf):
    t = tickets(spark, sf).withColumn("p", tr.parse_triage(F.col("raw")))
    return t.select("*", "p.ok", "p.reason", F.col("p.facts").alias("facts"), F.col("p.category").alias("got_category"),
                    F.col("p.priority").alias("got_priority"), F.col("p.needs_human").alias("got_human"))


@query("f31_schema_check", f"WITH {SQL_TRI} SELECT id, reason = '' AS ok, reason FROM pr")
def f31(spark, sf):
    return parsed(spark, sf).select("id", "ok", "reason")


SQL_POL = SQL_TRI + r""", po AS (SELECT *, array_to_string(list_filter([CASE WHEN category = 'outage' AND priority IN ('low', 'normal') THEN 'R1' END, CASE WHEN priority = 'critical' AND category NOT IN ('outage', 'access') THEN 'R2' END,
  CASE WHEN priority IN ('high', 'critical') AND NOT regexp_matches(fact, '[0-9]|error|denied') THEN 'R3' END, CASE WHEN category = 'billing' AND contains(ticket, 'возврат') AND NOT human THEN 'R4' END,
  CASE WHEN category = 'question' AND (priority IN ('high', 'critical') OR human) THEN 'R5' END, CASE WHEN (category = 'outage' OR priority IN ('high', 'critical')) AND NOT human THEN 'R6' END,
  CASE WHEN category = 'billing' AND priority IN ('high', 'critical') THEN 'R7' END], lambda x: x IS NOT NULL), ',') AS broken FROM pr WHERE reason = '')"""


@query("f32_business_rules", f"WITH {SQL_POL} SELECT id, broken FROM po")
def f32(spark, sf):
    p = parsed(spark, sf).where("ok")
    return p.select("id", tr.policy(F.col("got_category"), F.col("got_priority"), F.col("facts"), F.col("got_human"), F.col("ticket")).alias("broken"))


SQL_OUT = SQL_POL + """, g AS (SELECT id, mode, ['outage', 'billing', 'access', 'performance', 'question', 'other', 'other'][(id // 2) % 7 + 1] AS gold_category, CASE c % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'critical' END AS gold_priority, id % 2 = 0 AS gold_human FROM o),
ot AS (SELECT p.id, p.mode, p.reason = '' AS schema_ok, p.reason = '' AND id_ok AS grounded_ok, p.reason = '' AND coalesce(broken = '', false) AS rules_ok, p.reason = '' AND p.category = gold_category AS category_ok, p.reason = '' AND p.priority = gold_priority AS priority_ok,
  p.reason = '' AND abs(list_position(['low', 'normal', 'high', 'critical'], p.priority) - list_position(['low', 'normal', 'high', 'critical'], gold_priority)) <= 1 AS within_one, p.reason = '' AND p.human = gold_human AS human_ok,
  1 + p.id % 2 AS calls, p.id % 100 + p.c % 50 AS tokens, p.id % 10 AS seconds FROM (SELECT *, id % 5 <> 0 AS id_ok FROM pr) p JOIN g ON g.id = p.id LEFT JOIN po ON po.id = p.id)"""


def outcomes(spark, sf):
    """Predictions joined with gold labels on the ticket id, every check as a column."""
    p = parsed(spark, sf)
    i, c = F.col("id"), F.col("c")
    gold = tickets(spark, sf).select(
        "id", F.element_at(F.array(*map(F.lit, (*tr.CATEGORIES, "other"))), (F.floor(i / 2) % 7 + 1).cast("int")).alias("gold_category"),
        F.element_at(F.array(*map(F.lit, tr.PRIORITIES)), (c % 4 + 1).cast("int")).alias("gold_priority"), (i % 2 == 0).alias("gold_human"))
    ranks = F.array(*map(F.lit, tr.PRIORITIES))
    j = p.join(gold, "id")
    near = F.abs(F.array_position(ranks, F.col("got_priority")) - F.array_position(ranks, F.col("gold_priority"))) <= 1
    rules = tr.policy(F.col("got_category"), F.col("got_priority"), F.col("facts"), F.col("got_human"), F.col("ticket")) == ""
    cited = F.forall("facts", lambda f: tr.grounded(f, F.col("ticket")))

    def when_ok(x):
        return F.col("ok") & F.coalesce(x, F.lit(False))

    return j.select(
        "id", "mode", "reason", "got_category", "got_priority", "gold_category", "gold_priority", F.col("ok").alias("schema_ok"),
        when_ok(cited).alias("grounded_ok"), when_ok(rules).alias("rules_ok"), when_ok(F.col("got_category") == F.col("gold_category")).alias("category_ok"),
        when_ok(F.col("got_priority") == F.col("gold_priority")).alias("priority_ok"), when_ok(near).alias("within_one"),
        when_ok(F.col("got_human") == F.col("gold_human")).alias("human_ok"), (1 + i % 2).alias("calls"), (i % 100 + c % 50).alias("tokens"), (i % 10).alias("seconds"),
    ).withColumn("accepted", F.col("schema_ok") & F.col("grounded_ok") & F.col("rules_ok"))


@query("j16_prediction_gold_join", f"WITH {SQL_OUT} SELECT id, category_ok, priority_ok, within_one, human_ok FROM ot")
def j16(spark, sf):
    return outcomes(spark, sf).select("id", "category_ok", "priority_ok", "within_one", "human_ok")


A24_COLS = ("accepted", "schema_ok", "grounded_ok", "rules_ok", "category_ok", "priority_ok", "within_one", "human_ok")
SQL_A24 = SQL_OUT + """, ac AS (SELECT *, schema_ok AND grounded_ok AND rules_ok AS accepted FROM ot), sm AS (SELECT mode, count(*) AS n, """ + ", ".join(
    f"avg({c}::INTEGER) AS {c}" for c in A24_COLS) + """, sum(calls)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, sum(seconds)::BIGINT AS seconds, (avg(category_ok::INTEGER) + avg(priority_ok::INTEGER) + avg(human_ok::INTEGER)) / 3 AS quality FROM ac GROUP BY mode)"""


@query("a24_triage_summary", f"WITH {SQL_A24} SELECT mode, n, {', '.join(f'round({c}, 6) AS {c}' for c in (*A24_COLS, 'quality'))}, calls, tokens, seconds FROM sm")
def a24(spark, sf):
    s = tr.mode_summary(outcomes(spark, sf))
    return s.select("mode", "n", *[F.round(c, 6).alias(c) for c in (*A24_COLS, "quality")], "calls", "tokens", "seconds")


A24_MET = (*A24_COLS, "quality", "calls", "tokens", "seconds")


@query("a24_comparison_table", f"""WITH {SQL_A24}, un AS (SELECT mode, unnest({list(A24_MET)}) AS metric, unnest([{', '.join(f'round({c}::DOUBLE, 6)' for c in A24_MET)}]) AS v FROM sm)
SELECT metric, max(v) FILTER (mode = 'solo') AS solo, max(v) FILTER (mode = 'solo+fix') AS solo_fix, max(v) FILTER (mode = 'team') AS team FROM un GROUP BY 1""")
def a24t(spark, sf):
    s = tr.mode_summary(outcomes(spark, sf)).select("mode", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in A24_MET])
    long = s.unpivot("mode", list(A24_MET), "metric", "v")
    return long.groupBy("metric").pivot("mode", ["solo", "solo+fix", "team"]).agg(F.max("v")).withColumnRenamed("solo+fix", "solo_fix")


@query("a25_quality_per_cost", f"""WITH {SQL_A24} SELECT 'team' AS mode, 'solo' AS baseline, round((t.quality - b.quality) * 100, 4) AS points, round(t.tokens / b.tokens, 4) AS token_ratio, t.quality > b.quality AS paid_off
FROM sm t, sm b WHERE t.mode = 'team' AND b.mode = 'solo'""")
def a25(spark, sf):
    return co.compare_modes(tr.mode_summary(outcomes(spark, sf)), "team", "solo")


@query("j19_answer_key_grading", """WITH k AS (SELECT l.doc_id, quality, doc_id % 7 AS student, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS given FROM labels l),
g AS (SELECT student, count(*) AS n, count(*) FILTER (given IS NULL) AS skipped, count(*) FILTER (given = quality) AS correct, count(*) FILTER (given <> quality) AS wrong FROM k GROUP BY 1)
SELECT *, CASE WHEN correct * 100 // n >= 88 THEN 'excellent' WHEN correct * 100 // n >= 69 THEN 'good' WHEN correct * 100 // n >= 47 THEN 'review' ELSE 'repeat' END AS band FROM g""")
def j19(spark, sf):
    i = F.col("doc_id")
    key = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("answer"))
    given = table(spark, sf, "labels").where(i % 10 != 0).select("doc_id", F.when(i % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("given"))
    return ev.grade(key, given, "doc_id", (i % 7).alias("student"), ((88, 100, "excellent"), (69, 87, "good"), (47, 68, "review"), (0, 46, "repeat")))


@query("j19_wrong_answers", """SELECT doc_id % 7 AS student, doc_id, 1 - quality AS given, 'expected ' || quality AS explanation FROM labels WHERE doc_id % 10 <> 0 AND doc_id % 4 = 0""")
def j19w(spark, sf):
    i = F.col("doc_id")
    key = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("answer"))
    given = table(spark, sf, "labels").where(i % 10 != 0).select("doc_id", F.when(i % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("given"))
    j = key.join(given, "doc_id").where(F.col("given") != F.col("answer"))
    return j.select((i % 7).alias("student"), "doc_id", "given", F.concat(F.lit("expected "), "answer").alias("explanation"))


@query("j18_inventory_drift_and_promotion", """WITH a AS (SELECT doc_id, substr(sha256(text), 1, 12) AS digest FROM documents WHERE doc_id % 17 <> 3), b AS (SELECT doc_id, substr(sha256(CASE WHEN doc_id % 19 = 0 THEN text || '!' ELSE text END), 1, 12) AS digest FROM documents WHERE doc_id % 13 <> 0),
s AS (SELECT lang, avg(quality) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1),
x AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'unexpected' WHEN a.digest = b.digest THEN 'same' ELSE 'drifted' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT x.doc_id, status, CASE status WHEN 'missing' THEN 'stop' WHEN 'same' THEN 'nothing_to_do' WHEN 'drifted' THEN CASE WHEN score >= 0.9 THEN 'promote' ELSE 'hold' END ELSE 'review' END AS action
FROM x JOIN documents d ON d.doc_id = x.doc_id JOIN s ON s.lang = d.lang""")
def j18(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    a = d.where(i % 17 != 3).select("doc_id", hy.checksum(F.col("text")).alias("digest"))
    b = d.where(i % 13 != 0).select("doc_id", hy.checksum(F.when(i % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    score = table(spark, sf, "labels").join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg("quality").alias("score"))
    drift = ev.inventory_drift(a, b, "doc_id").join(d.select("doc_id", "lang"), "doc_id").join(score, "lang")
    return drift.select("doc_id", "status", ev.promotion(F.col("status"), F.col("score"), 0.9).alias("action"))
