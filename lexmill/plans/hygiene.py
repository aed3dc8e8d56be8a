"""Cleaning and checking of ``documents``, ``pages`` and dialogue texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import rules as ru
from lexmill.functions import text as tx
from lexmill.operators import hygiene as hy
from lexmill.operators import retrieval as rt
from lexmill.plans.registry import query, table


def sq(p: str) -> str:
    """A pattern as an SQL literal for RE2: Unicode classes spelled out."""
    p = p.replace("(?iU)", "(?i)").replace("(?U)", "")
    return "'" + p.replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''") + "'"


INV = r"'[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}]'"


def tidy_sql(x: str) -> str:
    x = f"regexp_replace({x}, {INV}, '', 'g')"
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    x = f"regexp_replace({x}, '[ \\t\\f\\v]{{3,}}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{4,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def report_sql(src: str, key: str) -> str:
    rules = [("hidden_html_comment", ru.HIDDEN_COMMENT_WEIGHT, ru.HTML_COMMENT)] + [
        (n, w, f"(?i){p}") for n, w, p in ru.INJECTION_RULES]
    cells = ", ".join(
        f"CASE WHEN regexp_matches(t, {sq(p)}) THEN {{'rule': '{n}', 'w': {w}, 'sample': substr(regexp_extract(t, {sq(p)}), 1, 160)}} END"
        for n, w, p in rules)
    return f"""{src}_h AS (SELECT *, list_filter([{cells}], lambda x: x IS NOT NULL) AS h FROM {src}),
{src}_r AS (SELECT *, coalesce(list_sum(list_transform(h, lambda x: x.w)), 0)::INTEGER AS score, array_to_string(list_transform(h, lambda x: x.rule), ',') AS rules,
  coalesce(h[1].sample, '') AS sample FROM {src}_h),
{src}_rep AS (SELECT *, CASE WHEN score >= 6 THEN 2 WHEN score >= 3 THEN 1 ELSE 0 END AS risk FROM {src}_r)"""


SQL_ND = f"nd AS (SELECT doc_id, {tidy_sql('nfc_normalize(text)')} AS t FROM documents)"


@query("f3_normalise_text", f"WITH {SQL_ND} SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM nd")
def f3(spark, sf):
    d = hy.normalise(table(spark, sf, "documents"))
    return d.select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@query("f4_injection_risk_documents", f"WITH {SQL_ND}, {report_sql('nd', 'doc_id')} SELECT doc_id, score, rules, sample, risk FROM nd_rep")
def f4(spark, sf):
    d = hy.normalise(table(spark, sf, "documents")).select("doc_id", hy.injection_report(F.col("text")).alias("r"))
    return d.select("doc_id", "r.score", F.array_join("r.rules", ",").alias("rules"), "r.sample", "r.risk")


SQL_NP = f"np AS (SELECT page_id, {tidy_sql('nfc_normalize(html)')} AS t FROM pages)"


@query("f4_injection_risk_pages", f"WITH {SQL_NP}, {report_sql('np', 'page_id')} SELECT page_id, score, rules, sample, risk FROM np_rep")
def f4p(spark, sf):
    d = hy.normalise(table(spark, sf, "pages"), "html").select("page_id", hy.injection_report(F.col("html")).alias("r"))
    return d.select("page_id", "r.score", F.array_join("r.rules", ",").alias("rules"), "r.sample", "r.risk")


SQL_NL = rf"""nl AS (SELECT doc_id, unnest(range(0, len(l))) AS idx, unnest(l) AS t FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents))"""


@query("f5_chunk_risk_inheritance", f"""WITH {SQL_ND}, {report_sql('nd', 'doc_id')}, {SQL_NL}, {report_sql('nl', 'doc_id')}
SELECT c.doc_id, max(greatest(c.risk, CASE WHEN c.doc_id % 7 = 0 THEN d.risk ELSE 0 END)) AS risk, count(*) AS n_chunks, sum(c.score)::BIGINT AS chunk_score
FROM nl_rep c JOIN nd_rep d ON d.doc_id = c.doc_id GROUP BY 1""")
def f5(spark, sf):
    d = table(spark, sf, "documents")
    doc = hy.normalise(d).select("doc_id", hy.injection_report(F.col("text"))["risk"].alias("doc_risk"))
    lines = rt.lines_of(d).select("doc_id", hy.injection_report(F.col("text")).alias("r"))
    per = lines.groupBy("doc_id").agg(F.max("r.risk").alias("chunk"), F.count(F.lit(1)).alias("n_chunks"), F.sum("r.score").alias("chunk_score"))
    return per.join(doc, "doc_id").select(
        "doc_id", hy.chunk_risk(F.col("chunk"), F.col("doc_risk"), F.col("doc_id") % 7 != 0).alias("risk"), "n_chunks", "chunk_score")


QPAT = ", ".join(f"CASE WHEN regexp_matches(n, {sq('(?i)' + p)}) THEN {i} END" for i, p in enumerate(ru.QUESTION_PATTERNS))


@query("f6_question_triage", rf"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS q FROM conversations WHERE role = 'user'),
n AS (SELECT *, regexp_replace(q, {sq(ru.SERVICE_TAG)}, '', 'g') AS n FROM q),
h AS (SELECT *, list_filter([{QPAT}], lambda x: x IS NOT NULL) AS hits, length(q) NOT BETWEEN 3 AND 500 AS bad FROM n)
SELECT conv_id, turn, CASE WHEN bad THEN 'rejected' WHEN n <> q OR len(hits) > 0 THEN 'suspicious' ELSE 'clean' END AS verdict,
CASE WHEN bad THEN 'length' WHEN n <> q THEN 'tags' WHEN len(hits) > 0 THEN 'pattern' ELSE '' END AS reason,
CASE WHEN bad THEN '' ELSE array_to_string(hits, ',') END AS patterns, sha256(CASE WHEN bad THEN substr(q, 1, 500) ELSE n END) AS question FROM h""")
def f6(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user")
    t = c.select("conv_id", "turn", hy.triage_question(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", "t.verdict", "t.reason", F.array_join("t.patterns", ",").alias("patterns"), F.sha2("t.question", 256).alias("question"))


SQL_STRIP = rf"""{SQL_NP}, s1 AS (SELECT page_id, regexp_replace(t, {sq(ru.HTML_COMMENT)}, ' ', 'g') AS t, CASE WHEN regexp_matches(t, {sq(ru.HTML_COMMENT)}) THEN ['html_comments'] ELSE [] END AS r FROM np),
s2 AS (SELECT page_id, regexp_replace(t, {sq(ru.HTML_TAG)}, ' ', 'g') AS t, CASE WHEN regexp_matches(t, {sq(ru.HTML_TAG)}) THEN list_append(r, 'html_tags') ELSE r END AS r FROM s1),
s3 AS (SELECT page_id, regexp_replace(t, {sq(ru.MD_LINK)}, '\1 (\2)', 'g') AS t, CASE WHEN regexp_matches(t, {sq(ru.MD_LINK)}) THEN list_append(r, 'md_links') ELSE r END AS r FROM s2),
s4 AS (SELECT page_id, regexp_replace(t, '(?i)(https?)://([^\s<>"''\)\]?#]*)([?#][^\s<>"''\)\]]*)?', '[ссылка: \1(:)//\2]', 'g') AS t, list_append(r, 'urls_neutralized') AS r FROM s3)"""


@query("f7_sanitise_untrusted_pages", f"WITH {SQL_STRIP} SELECT page_id, array_to_string(r, ',') AS removed, length({tidy_sql('t')}) AS n, sha256({tidy_sql('t')}) AS digest FROM s4")
def f7(spark, sf):
    p = hy.normalise(table(spark, sf, "pages"), "html").select("page_id", hy.strip_untrusted(F.col("html"), True).alias("s"))
    t = p.select("page_id", F.array_join("s.removed", ",").alias("removed"), hy.tidy(F.col("s.t")).alias("t"))
    return t.select("page_id", "removed", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"))


@query("f8_neutralise_urls", r"""SELECT page_id, regexp_replace(url, '(?i)(https?)://([^\s<>"''\)\]?#]*)([?#][^\s<>"''\)\]]*)?', '[ссылка: \1(:)//\2]', 'g') AS safe_url FROM pages""")
def f8(spark, sf):
    return table(spark, sf, "pages").select("page_id", hy.neutralise_urls(F.col("url")).alias("safe_url"))


@query("f9_pii_masking")
def f9(spark, sf):
    """All seven entity types; look-around patterns have no RE2 form, so no SQL twin."""
    d = table(spark, sf, "documents").select("doc_id", hy.mask_pii(F.col("text")).alias("m"))
    names = [n for n, _ in ru.PII_PATTERNS]
    return d.select(
        "doc_id", F.length("m.t").alias("n"), F.sha2("m.t", 256).alias("digest"),
        *[F.col("m.counts")[i].alias(f"n_{n.lower()}") for i, n in enumerate(names)])


EMAIL = sq(ru.PII_PATTERNS[0][1])


@query("f9_email_masking", f"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, {EMAIL}) AS a, regexp_extract_all(text, {EMAIL}) AS m FROM documents)
SELECT doc_id, len(m) AS n_email, sha256(array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || coalesce('[EMAIL:' || substr(sha256(m[i]), 1, 8) || ']', '')), '')) AS digest FROM p""")
def f9e(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", hy.mask_pii(F.col("text"), only=("EMAIL",)).alias("m"))
    return d.select("doc_id", F.col("m.counts")[0].alias("n_email"), F.sha2("m.t", 256).alias("digest"))


@query("f10_luhn_candidates", r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d{13,19}')) AS v FROM documents),
d AS (SELECT doc_id, v, list_transform(range(1, length(v) + 1), lambda i: CAST(reverse(v)[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) AS x FROM c)
SELECT doc_id, count(*) AS n, count(*) FILTER (list_sum(list_transform(x, lambda y: CASE WHEN y > 9 THEN y - 9 ELSE y END)) % 10 = 0) AS valid FROM d GROUP BY 1""")
def f10(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d{13,19}"), F.lit(0))).alias("v"))
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hy.luhn_ok(F.col("v"))).alias("valid"))


@query("f10_snils_checksum", """WITH s AS (SELECT o_orderkey, lpad(((o_orderkey * 104729) % 1000000000)::VARCHAR, 9, '0') AS b, o_custkey % 100 AS c FROM orders),
t AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(b[i] AS INTEGER) * (10 - i))) AS total FROM s),
e AS (SELECT *, CASE WHEN total < 100 THEN total WHEN total IN (100, 101) THEN 0 WHEN total % 101 IN (100, 101) THEN 0 ELSE total % 101 END AS want FROM t)
SELECT o_orderkey, substr(b, 1, 3) || '-' || substr(b, 4, 3) || '-' || substr(b, 7, 3) || ' ' || lpad(c::VARCHAR, 2, '0') AS snils, (b::BIGINT > 1001998 AND want = c) AS ok FROM e""")
def f10s(spark, sf):
    b = F.lpad(((F.col("o_orderkey") * 104729) % 1000000000).cast("string"), 9, "0")
    o = table(spark, sf, "orders").select("o_orderkey", b.alias("b"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0").alias("c"))
    v = o.select("o_orderkey", F.concat(F.substring("b", 1, 3), F.lit("-"), F.substring("b", 4, 3), F.lit("-"), F.substring("b", 7, 3), F.lit(" "), F.col("c")).alias("snils"))
    return v.withColumn("ok", hy.snils_ok(F.col("snils")))


SEC = [(n, sq(p)) for n, p in ru.SECRET_PATTERNS]
SQL_SEC = "x0 AS (SELECT doc_id, text AS t FROM documents)" + "".join(
    f", x{i + 1} AS (SELECT *  REPLACE (regexp_replace(t, {p}, '[SECRET:{n}]', 'g') AS t), len(regexp_extract_all(t, {p})) AS n_{n.lower()} FROM x{i})" for i, (n, p) in enumerate(SEC))


@query("f11_secret_redaction", f"WITH {SQL_SEC} SELECT doc_id, {', '.join('n_' + n.lower() for n, _ in SEC)}, sha256(t) AS digest FROM x{len(SEC)}")
def f11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", hy.redact_secrets(F.col("text")).alias("r"))
    return d.select("doc_id", *[F.col("r.counts")[i].alias(f"n_{n.lower()}") for i, (n, _) in enumerate(SEC)], F.sha2("r.t", 256).alias("digest"))


@query("f12_log_scrubbing")
def f12(spark, sf):
    """Composes the masking of f9, so no SQL twin."""
    d = table(spark, sf, "documents").select("doc_id", hy.scrub_for_logs(F.col("text")).alias("line"))
    return d.select("doc_id", F.length("line").alias("n"), F.sha2("line", 256).alias("digest"))


@query("f13_question_fingerprint", r"""SELECT length(text) AS question_len, substr(sha256(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 1, 12) AS question_hash, count(*) AS n
FROM conversations WHERE role = 'user' GROUP BY ALL""")
def f13(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "user").select(hy.fingerprint(F.col("text")).alias("f"))
    return c.groupBy("f.question_len", "f.question_hash").agg(F.count(F.lit(1)).alias("n"))


SQL_ANS = r"""an AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN '' ELSE ' [#' || turn || ']' END || CASE WHEN conv_id % 10 = 0 THEN ' https://evil.example/x?q=1.' ELSE '' END
  || CASE WHEN conv_id % 15 = 0 THEN ' CANARY-' || conv_id ELSE '' END || CASE WHEN conv_id % 21 = 0 THEN ' token = abcd1234' ELSE '' END
  || CASE WHEN conv_id % 12 = 0 THEN ' нет ответа' ELSE '' END AS answer,
  CASE WHEN conv_id % 20 = 0 THEN 'see https://evil.example/x?q=1' ELSE '' END AS ctx, 'CANARY-' || conv_id AS canary FROM conversations WHERE role = 'assistant')"""
MARK = " OR ".join(f"contains(lower(answer), '{m}')" for m in ru.REFUSAL_MARKERS)
URLS = "list_distinct(list_transform(regexp_extract_all({}, '(?i)https?://[^\\s<>\"''\\)\\]]+'), lambda u: regexp_replace(u, '[.,);]+$', '')))"


def answers(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    i, t = F.col("conv_id"), F.col("turn")

    def some(cond, text):
        return F.when(cond, text).otherwise(F.lit(""))

    answer = F.concat(
        "text", some(t % 3 != 0, F.concat(F.lit(" [#"), t, F.lit("]"))), some(i % 10 == 0, F.lit(" https://evil.example/x?q=1.")),
        some(i % 15 == 0, F.concat(F.lit(" CANARY-"), i)), some(i % 21 == 0, F.lit(" token = abcd1234")), some(i % 12 == 0, F.lit(" нет ответа")))
    return c.select(
        "conv_id", "turn", answer.alias("answer"), some(i % 20 == 0, F.lit("see https://evil.example/x?q=1")).alias("ctx"),
        F.concat(F.lit("CANARY-"), i).alias("canary"))


@query("f14_answer_guard", f"""WITH {SQL_ANS}, p AS (SELECT *, ({MARK}) AS refusal, len(list_filter({URLS.format('answer')}, lambda u: NOT list_contains({URLS.format('ctx')}, u))) AS unk,
  list_transform(regexp_extract_all(answer, '\\[#(\\d+)\\]', 1), lambda c: c::BIGINT) AS cited FROM an),
q AS (SELECT *, array_to_string(list_filter([CASE WHEN contains(answer, canary) THEN 'system_prompt_leak' END, CASE WHEN unk > 0 THEN 'unknown_urls:' || unk END,
  CASE WHEN len(list_filter(cited, lambda c: c NOT IN (1, 2, 3))) > 0 THEN 'invalid_citations:' || array_to_string(list_sort(list_distinct(list_filter(cited, lambda c: c NOT IN (1, 2, 3)))), ',') END,
  CASE WHEN NOT refusal AND len(cited) = 0 THEN 'no_citation' END,
  CASE WHEN {' OR '.join(f'regexp_matches(answer, {p})' for _, p in SEC)} THEN 'secret_in_answer' END], lambda x: x IS NOT NULL), ';') AS problems FROM p)
SELECT conv_id, turn, problems, CASE WHEN problems <> '' THEN 'blocked_output' WHEN refusal THEN 'refused_no_answer' ELSE 'answered' END AS outcome FROM q""")
def f14(spark, sf):
    a = answers(spark, sf)
    allowed = F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3)])
    codes = hy.answer_problems(F.col("answer"), F.col("ctx"), allowed, F.col("canary"), ~hy.is_refusal(F.col("answer")))
    g = a.select("conv_id", "turn", hy.is_refusal(F.col("answer")).alias("refusal"), F.array_join(codes, ";").alias("problems"))
    return g.select("conv_id", "turn", "problems", F.when(F.col("problems") != "", "blocked_output").when(F.col("refusal"), "refused_no_answer").otherwise("answered").alias("outcome"))


@query("f15_refusal_detection", f"WITH {SQL_ANS} SELECT conv_id, turn, ({MARK}) AS refusal FROM an")
def f15(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", hy.is_refusal(F.col("answer")).alias("refusal"))


@query("j14_unknown_urls", f"SELECT page_id, len({URLS.format('html')}) AS n_urls, len(list_filter({URLS.format('html')}, lambda u: NOT list_contains({URLS.format('url')}, u))) AS n_unknown FROM pages")
def j14(spark, sf):
    u, c = hy.urls(F.col("html")), hy.urls(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.size(u).alias("n_urls"), F.size(F.array_except(u, c)).alias("n_unknown"))


@query("f25_deterministic_ids", """WITH k AS (SELECT doc_id, 'main:' || doc_id || ':v1:' || lpad((doc_id % 7)::VARCHAR, 3, '0') AS key FROM documents),
h AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(key)) AS h FROM k)
SELECT doc_id, key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][(instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def f25(spark, sf):
    key = F.format_string("main:%d:v1:%03d", F.col("doc_id"), F.col("doc_id") % 7)
    return table(spark, sf, "documents").select("doc_id", key.alias("key")).withColumn("point_id", hy.uuid5(F.col("key")))


@query("f26_content_checksum", "SELECT substr(sha256(text), 1, 12) AS checksum, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def f26(spark, sf):
    return table(spark, sf, "documents").groupBy(hy.checksum(F.col("text")).alias("checksum")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("f27_iso_date_to_unix", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, coalesce(epoch(try_cast(s AS TIMESTAMP))::BIGINT, 0) AS unix_s FROM s""")
def f27(spark, sf):
    s = F.when(F.col("o_orderkey") % 9 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", hy.iso_to_unix(s).alias("unix_s"))


@query("a12_ingest_report", f"""WITH {SQL_ND}, {report_sql('nd', 'doc_id')}, {SQL_NL}, k AS (SELECT * FROM nd_rep WHERE doc_id % 7 <> 0)
SELECT 'documents' AS metric, '' AS key, count(*) AS value FROM k
UNION ALL SELECT 'chunks', '', count(*) FROM nl WHERE doc_id % 7 <> 0
UNION ALL SELECT 'skipped', '', coalesce(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') = ''))), 0)::BIGINT FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 'quarantined', '', count(*) FROM documents WHERE doc_id % 7 = 0
UNION ALL SELECT 'rules', doc_id || ': ' || array_to_string(list_transform(h, lambda x: x.rule), ','), len(h) FROM k WHERE len(h) > 0
UNION ALL SELECT 'injection', rule, count(*) FROM (SELECT unnest(list_transform(h, lambda x: x.rule)) AS rule FROM k) GROUP BY rule""")
def a12(spark, sf):
    d = table(spark, sf, "documents")
    kept = d.where(F.col("doc_id") % 7 != 0)

    def count(df, metric):
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "value")

    found = tx.once(hy.normalise(kept), ["doc_id"], rules=hy.injection_report(F.col("text"))["rules"]).where(F.size("rules") > 0)
    per_doc = found.select(F.lit("rules").alias("metric"), F.concat("doc_id", F.lit(": "), F.array_join("rules", ",")).alias("key"), F.size("rules").cast("bigint").alias("value"))
    blank = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) == ""))
    skipped = kept.agg(F.coalesce(F.sum(blank), F.lit(0)).alias("value")).select(F.lit("skipped").alias("metric"), F.lit("").alias("key"), "value")
    rules = found.select(F.explode("rules").alias("key"))
    inj = rules.groupBy("key").agg(F.count(F.lit(1)).alias("value")).select(F.lit("injection").alias("metric"), "key", "value")
    return (
        count(kept, "documents").unionByName(count(rt.lines_of(kept), "chunks"))
        .unionByName(count(d.where(F.col("doc_id") % 7 == 0), "quarantined")).unionByName(inj)
        .unionByName(skipped).unionByName(per_doc))


@query("a12_pii_per_type")
def a12p(spark, sf):
    names = F.array(*[F.lit(n) for n, _ in ru.PII_PATTERNS])
    m = table(spark, sf, "documents").select(hy.mask_pii(F.col("text"))["counts"].alias("c"))
    cells = m.select(F.explode(F.map_from_arrays(names, F.col("c"))).alias("entity", "n"))
    return cells.groupBy("entity").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


@query("f41_routing_label", f"""SELECT conv_id, turn, CASE WHEN conv_id % 8 = 0 OR regexp_matches(text, {EMAIL}) THEN CASE WHEN turn % 5 <> 0 THEN 'local' ELSE 'queue' END
WHEN 100 - conv_id % 103 <= 0 THEN CASE WHEN turn % 5 <> 0 THEN 'local' ELSE 'queue' END WHEN length(text) > 800 THEN 'cloud-flagship' ELSE 'cloud-mini' END AS route FROM conversations""")
def f41(spark, sf):
    c = table(spark, sf, "conversations")
    private = (F.col("conv_id") % 8 == 0) | F.regexp_like("text", F.lit(ru.PII_PATTERNS[0][1]))
    broke = 100 - F.col("conv_id") % 103 <= 0
    home = F.when(F.col("turn") % 5 != 0, "local").otherwise("queue")
    route = F.when(private | broke, home).when(F.length("text") > 800, "cloud-flagship").otherwise("cloud-mini")
    return c.select("conv_id", "turn", route.alias("route"))


X6 = [("secret", n, p) for n, p in SEC] + [("injection", n, sq("(?i)" + p)) for n, _, p in ru.INJECTION_RULES] + [("pii", "EMAIL", EMAIL)]


@query("x6_rule_registry_hits", f"WITH {SQL_ND} " + " UNION ALL ".join(f"SELECT '{f}' AS family, '{n}' AS rule, count(*) FILTER (regexp_matches(t, {p})) AS n_docs FROM nd" for f, n, p in X6))
def x6(spark, sf):
    """Rules are rows (family, rule, pattern); one pass counts the documents each one touches."""
    rules = [("secret", n, p) for n, p in ru.SECRET_PATTERNS] + [("injection", n, f"(?iU){p}") for n, _, p in ru.INJECTION_RULES] + [("pii", *ru.PII_PATTERNS[0])]
    d = hy.normalise(table(spark, sf, "documents"))
    hits = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("rule"), F.regexp_like("text", F.lit(p)).alias("hit")) for f, n, p in rules])
    return d.select(F.inline(hits)).groupBy("family", "rule").agg(F.count_if("hit").alias("n_docs"))
