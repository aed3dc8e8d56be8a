"""Access rules over ``documents`` with derived ACL and version columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import access as ac
from lexmill.operators import evaluation as ev
from lexmill.operators import lexical as lx
from lexmill.operators import retrieval as rt
from lexmill.plans.lexical import SQL_BM25, SQL_GOLD, docs_items
from lexmill.plans.registry import query, table
from lexmill.session import scratch
from lexmill.sources import pages as pg

ROLES = [p[1] for p in ac.PRINCIPALS]


def acl_docs(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "*",
        F.element_at(F.array(F.lit("all"), F.lit("eng"), F.lit("hr")), (i % 3 + 1).cast("int")).alias("department"),
        F.when(i % 5 == 0, 2).otherwise(i % 3).cast("int").alias("sensitivity"),
        F.when(i % 10 == 0, "acme").otherwise("main").alias("doc_tenant"),
        F.when(i % 7 == 0, "untrusted").otherwise("trusted").alias("source_type"),
        F.when(i % 11 == 0, 2).when(i % 11 == 1, 1).otherwise(0).alias("risk_level"),
        F.floor(i / 2).alias("logical_id"), (i % 2 + 1).cast("int").alias("version"),
        ((i % 2 == 1) | (i % 50 == 0)).alias("is_current"),
    )


SQL_ACL = """ad AS (SELECT *, ['all', 'eng', 'hr'][doc_id % 3 + 1] AS department, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE doc_id % 3 END AS sensitivity,
  CASE WHEN doc_id % 10 = 0 THEN 'acme' ELSE 'main' END AS tenant, CASE WHEN doc_id % 7 = 0 THEN 'untrusted' ELSE 'trusted' END AS source_type,
  CASE doc_id % 11 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS risk_level, doc_id // 2 AS logical_id, doc_id % 2 + 1 AS version,
  (doc_id % 2 = 1 OR doc_id % 50 = 0) AS is_current FROM documents),
pr AS (SELECT * FROM (VALUES ('u-1001', 'employee', 'main', ['all'], 0), ('u-2002', 'engineer', 'main', ['all', 'eng'], 1),
  ('u-3003', 'hr', 'main', ['all', 'hr'], 2), ('u-9009', 'other_tenant', 'acme', ['all', 'eng'], 2), ('anonymous', 'anonymous', 'main', []::VARCHAR[], 0))
  v(user_id, role, tenant_id, departments, clearance)),
rd AS (SELECT * FROM ad JOIN pr ON ad.tenant = pr.tenant_id AND (department = 'all' OR list_contains(departments, department)) AND sensitivity <= clearance)"""


@query("p1_row_level_security", f"WITH {SQL_ACL} SELECT role, doc_id FROM rd WHERE risk_level <= 1 AND is_current AND source_type = 'trusted'")
def p1(spark, sf):
    return ac.visible(acl_docs(spark, sf), ac.principals(spark), ac.pre_filter(allow_untrusted=False)).select("role", "doc_id")


@query("p2_can_read_predicate", f"WITH {SQL_ACL} SELECT role, department, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM rd GROUP BY ALL")
def p2(spark, sf):
    v = ac.visible(acl_docs(spark, sf), ac.principals(spark), ac.can_read())
    return v.groupBy("role", "department").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("p3_describe_filter", f"""WITH {SQL_ACL} SELECT role, 'tenant_id = ' || tenant_id || ' AND sensitivity <= ' || clearance || ' AND department in [' ||
array_to_string(CASE WHEN list_contains(departments, 'all') THEN departments ELSE list_prepend('all', departments) END, ', ') || '] AND risk_level <= 1 AND is_current = true' AS filter,
count(*) AS n_docs FROM rd WHERE risk_level <= 1 AND is_current GROUP BY ALL""")
def p3(spark, sf):
    v = ac.visible(acl_docs(spark, sf), ac.principals(spark), ac.pre_filter())
    return v.groupBy("role", ac.describe().alias("filter")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("p4_version_pinning", f"WITH {SQL_ACL} SELECT role, doc_id, version FROM rd WHERE risk_level <= 1 AND version = 1")
def p4(spark, sf):
    cond = ac.pre_filter(only_current=False, extra=(F.col("version") == 1,))
    return ac.visible(acl_docs(spark, sf), ac.principals(spark), cond).select("role", "doc_id", "version")


@query("p5_metadata_filter_algebra", """SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND n_chars < 5000
AND (source = 'src2' OR lang = 'fr' OR n_chars > 3000) AND NOT (source IN ('src1', 'src3')) AND source <> 'src4'""")
def p5(spark, sf):
    spec = {
        "must": [{"lang": {"$in": ["en", "fr"]}}, {"n_chars": {"$gte": 500, "$lt": 5000}}],
        "should": [{"source": "src2"}, {"lang": {"$eq": "fr"}}, {"n_chars": {"$gt": 3000}}],
        "must_not": [{"source": {"$in": ["src1", "src3"]}}],
        "$and": [{"source": {"$ne": "src4"}}],
    }
    return table(spark, sf, "documents").where(ac.where(spec)).select("doc_id", "lang", "source", "n_chars")


@query("p6_text_contains", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'license') OR contains(text, '@')")
def p6(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(F.contains("text", F.lit("license")) | F.contains("text", F.lit("@"))).select("doc_id", "n_chars")


@query("p7_source_pre_filter", f"""WITH {SQL_BM25}, f AS (SELECT s.*, lang FROM bm25_scores s JOIN documents d ON d.doc_id = s.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, lang ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f)
SELECT item_id, lang, doc_id, rank FROM r WHERE rank <= 5""")
def p7(spark, sf):
    d, q = docs_items(spark, sf)
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    s = lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=5, within=langs).join(langs, "doc_id")
    return rt.top_k_within(s, ["item_id", "lang"], "doc_id", 5).select("item_id", "lang", "doc_id", "rank")


@query("p9_quarantine_report", f"""WITH {SQL_ACL} SELECT source_type, CASE WHEN source_type = 'untrusted' THEN 'quarantined' ELSE 'indexed' END AS outcome,
count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM ad GROUP BY ALL""")
def p9(spark, sf):
    d = acl_docs(spark, sf)
    kept, held = d.where(F.col("source_type") == "trusted"), d.where(F.col("source_type") != "trusted")
    both = kept.withColumn("outcome", F.lit("indexed")).unionByName(held.withColumn("outcome", F.lit("quarantined")))
    return both.groupBy("source_type", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("p13_count_with_filter", """SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'en' AND n_chars > 1000) AS n_long_en,
count(*) FILTER (source IN ('src1', 'src2')) AS n_two_sources FROM documents""")
def p13(spark, sf):
    return table(spark, sf, "documents").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"),
        F.count_if((F.col("lang") == "en") & (F.col("n_chars") > 1000)).alias("n_long_en"),
        F.count_if(F.col("source").isin("src1", "src2")).alias("n_two_sources"))


@query("p14_row_contract", """WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id % 25 AS top_k, CASE WHEN event_type <> 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS fetch_k,
  event_type <> 'error' AS use_reranker, event_type || '-' || user_id || CASE WHEN event_type = 'signup' THEN '.txt' ELSE '.md' END AS source, json_keys(props) AS keys FROM events),
v AS (SELECT event_id, list_filter([CASE WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k_range' END, CASE WHEN fetch_k NOT BETWEEN 1 AND 100 THEN 'fetch_k_range' END,
  CASE WHEN fetch_k < top_k THEN 'fetch_k_below_top_k' END, CASE WHEN fetch_k IS NOT NULL AND NOT use_reranker THEN 'fetch_k_without_reranker' END,
  CASE WHEN NOT regexp_full_match(source, '[\\p{L}\\p{N}_][\\p{L}\\p{N}_.\\-]*\\.md') THEN 'source_name' END, CASE WHEN len(list_filter(keys, lambda x: x NOT IN ('k'))) > 0 THEN 'unknown_field' END], lambda x: x IS NOT NULL) AS c FROM r)
SELECT event_id, len(c) = 0 AS valid, array_to_string(c, ',') AS codes FROM v""".replace("\\\\", "\\"))
def p14(spark, sf):
    e = table(spark, sf, "events")
    r = e.select(
        "event_id", (F.col("user_id") % 25).alias("top_k"),
        F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("long")).alias("fetch_k"),
        (F.col("event_type") != "error").alias("use_reranker"),
        F.concat("event_type", F.lit("-"), "user_id", F.when(F.col("event_type") == "signup", ".txt").otherwise(".md")).alias("source"),
        F.json_object_keys("props").alias("keys"))
    return ev.search_request_contract(r, ["k"]).select("event_id", "valid", "codes")


SQL_ACL_RUN = f"""{SQL_BM25}, {SQL_ACL}, {SQL_GOLD}, vis AS (SELECT * FROM rd WHERE risk_level <= 1 AND is_current),
ar AS (SELECT * FROM (SELECT role, item_id, s.doc_id, row_number() OVER (PARTITION BY role, item_id ORDER BY round(score, 9) DESC, s.doc_id) AS rank
  FROM bm25_scores s JOIN vis ON vis.doc_id = s.doc_id WHERE score > 0) WHERE rank <= 3)"""


def acl_run(spark, sf, k=3):
    d, q = docs_items(spark, sf)
    seen = ac.visible(acl_docs(spark, sf), ac.principals(spark), ac.pre_filter()).select("role", "doc_id")
    scores = lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id", best=k, within=seen).where(F.col("score") > 0)
    run = rt.top_k_within(scores.join(seen, "doc_id"), ["role", "item_id"], "doc_id", k)
    return run, seen, lx.contained_in(d, q, "doc_id", "item_id")


@query("t2_bm25_under_access_rules", f"WITH {SQL_ACL_RUN} SELECT role, item_id, doc_id, rank FROM ar")
def t2a(spark, sf):
    return acl_run(spark, sf)[0].select("role", "item_id", "doc_id", "rank")


@query("a16_permission_aware_evaluation", f"""WITH {SQL_ACL_RUN}, gv AS (SELECT role, g.item_id, bool_or(v.doc_id IS NOT NULL) AS readable,
  bool_or(v.doc_id IS NOT NULL AND a.rank IS NOT NULL) AS hit, bool_or(v.doc_id IS NULL AND a.rank IS NOT NULL) AS leak
  FROM gold g CROSS JOIN (SELECT role FROM pr) LEFT JOIN vis v USING (role, doc_id) LEFT JOIN ar a USING (role, item_id, doc_id) GROUP BY ALL)
SELECT role, CASE WHEN leak THEN 'leak' WHEN hit THEN 'hit' WHEN readable THEN 'search_miss' ELSE 'correct_denial' END AS category, count(*) AS n FROM gv GROUP BY ALL""")
def a16(spark, sf):
    run, seen, gold = acl_run(spark, sf)
    return ev.permission_categories(run, seen, gold, ROLES)


@query("j10_access_matrix", f"""WITH {SQL_ACL} SELECT d.doc_id, """ + ", ".join(
    f"bool_or(rd.role IS NOT NULL AND rd.role = '{r}') AS {r}" for r in ROLES) + " FROM documents d LEFT JOIN rd ON rd.doc_id = d.doc_id GROUP BY 1")
def j10(spark, sf):
    return ac.access_matrix(acl_docs(spark, sf), ac.principals(spark), ROLES)


@query("u7_found_equals_allowed", f"""WITH {SQL_BM25}, {SQL_ACL}, fd AS (SELECT DISTINCT role, s.doc_id FROM bm25_scores s JOIN rd ON rd.doc_id = s.doc_id),
al AS (SELECT DISTINCT role, doc_id FROM rd), x AS (SELECT coalesce(f.role, a.role) AS role, f.doc_id AS fd, a.doc_id AS ad FROM fd f FULL JOIN al a ON a.role = f.role AND a.doc_id = f.doc_id)
SELECT role, count(fd) AS n_found, count(*) FILTER (ad IS NULL) AS extra, count(*) FILTER (fd IS NULL) AS missing,
count(*) FILTER (ad IS NULL) = 0 AND count(*) FILTER (fd IS NULL) = 0 AS equal FROM x GROUP BY 1""")
def u7(spark, sf):
    d, q = docs_items(spark, sf)
    acl, who = acl_docs(spark, sf), ac.principals(spark)
    allowed = ac.visible(acl, who, ac.can_read()).select("role", "doc_id")
    wide = ac.visible(acl, who, ac.pre_filter(only_current=False, max_risk="high")).select("role", "doc_id")
    found = lx.bm25_scores(lx.indexed(d, "doc_id"), q, "doc_id", "item_id").select("doc_id").distinct().join(wide, "doc_id")
    return ac.set_difference(found, allowed, ["role", "doc_id"])


@query("a10_documents_summary", f"""WITH {SQL_ACL} SELECT logical_id, version, source, department, sensitivity, is_current, source_type, risk_level,
len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS chunks FROM ad""")
def a10(spark, sf):
    lines = rt.lines_of(table(spark, sf, "documents")).select("doc_id")
    n = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    meta = ["source", "department", "sensitivity", "is_current", "source_type", "risk_level"]
    rows = acl_docs(spark, sf).join(n, "doc_id", "left").fillna(0, ["chunks"])
    return rows.groupBy("logical_id", "version").agg(*[F.first(c).alias(c) for c in meta], F.sum("chunks").alias("chunks"))


@query("a11_version_duplicate_audit", f"""WITH {SQL_ACL} SELECT logical_id, count(DISTINCT version) AS n_versions, count(*) FILTER (is_current) AS n_current,
count(*) FILTER (is_current) <> 1 AS broken, sum(n_chars)::BIGINT AS n_chars FROM ad GROUP BY 1 HAVING count(DISTINCT version) > 1""")
def a11(spark, sf):
    per = acl_docs(spark, sf).groupBy("logical_id", "version").agg(
        F.bool_or("is_current").alias("cur"), F.sum("n_chars").alias("c"))
    out = per.groupBy("logical_id").agg(
        F.count(F.lit(1)).alias("n_versions"), F.count_if("cur").alias("n_current"), F.sum("c").alias("n_chars"))
    return out.where(F.col("n_versions") > 1).withColumn("broken", F.col("n_current") != 1)


def paged(spark, sf):
    path = scratch(spark, "paged")
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"))
    pg.write_pages(d, "doc_id", path)
    return pg.Paged(spark, path, "doc_id")


@query("s12_keyset_pages", """WITH p AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 256 AS page FROM documents WHERE lang = 'en')
SELECT page, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM p GROUP BY page""")
def s12(spark, sf):
    return paged(spark, sf).bounds(F.col("lang") == "en", 256)


SQL_PAGE = "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents"


@query("s12_page_scan", f"""WITH d AS ({SQL_PAGE} WHERE lang = 'en'), one AS (SELECT * FROM d ORDER BY doc_id LIMIT 64),
two AS (SELECT * FROM d WHERE doc_id > (SELECT max(doc_id) FROM one) ORDER BY doc_id LIMIT 64), three AS (SELECT * FROM d WHERE doc_id > (SELECT max(doc_id) FROM two) ORDER BY doc_id LIMIT 64)
SELECT 1 AS page, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM three""")
def s12_scan(spark, sf):
    """Three pages of a filtered scan, each asked for by the last key of the one before."""
    t, out, after = paged(spark, sf), None, None
    for page in (1, 2, 3):
        rows = t.page(after, 64, F.col("lang") == "en")
        after = rows.agg(F.max("doc_id")).first()[0]
        part = rows.select(F.lit(page).alias("page"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("s12_filter_and_limit", f"{SQL_PAGE} WHERE lang = 'de' AND n_chars > 500 ORDER BY doc_id LIMIT 100")
def s12_limit(spark, sf):
    return paged(spark, sf).page(None, 100, (F.col("lang") == "de") & (F.col("n_chars") > 500))


@query("s12_key_lookup", f"{SQL_PAGE} WHERE doc_id % 97 = 5 AND doc_id < 2000 OR doc_id = 33")
def s12_lookup(spark, sf):
    return paged(spark, sf).lookup([*range(5, 2000, 97), 33, -4, 10**12])
