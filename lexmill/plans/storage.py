"""Sources and sinks: every query writes below the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.embed import TfidfEmbedder, make_embedder
from lexmill.operators import chunking as ck
from lexmill.functions import text as tx
from lexmill.operators import lexical as lx
from lexmill.operators import refresh as rf
from lexmill.plans.chunks import SQL_MDC, docs
from lexmill.plans.lexical import SQL_WORD_POST, W
from lexmill.plans.registry import query, table
from lexmill.plans.scoring import SQL_OUT, outcomes
from lexmill.session import scratch
from lexmill.sources import readers as rd
from lexmill.sources import sinks as sk


def text_files(spark, sf):
    """Benchmark items as files in directories named NN-itemK."""
    path = scratch(spark, "texts")
    b = table(spark, sf, "benchmark")
    b.select("text", F.format_string("%02d-item%d", F.col("item_id"), F.col("item_id")).alias("doc")).repartition("doc").write.partitionBy("doc").text(path)
    return path


@query("s1_text_directory_scan", r"""WITH b AS (SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM benchmark)
SELECT 'item' || item_id AS doc_id, trim(string_split(text, chr(10))[1], ' ') AS title, length(text) AS n_chars, CASE item_id WHEN 1 THEN 'hr' ELSE 'other' END AS topic FROM b""")
def s1(spark, sf):
    name = F.regexp_extract(F.col("_metadata.file_path"), r"doc=([^/]+)/[^/]+$", 1)
    t = rd.text_directory(spark, text_files(spark, sf), "*.txt", {"item1": "hr"}, name)
    return t.select("doc_id", "title", F.length("text").alias("n_chars"), "topic")


@query("s2_manifest_scan", "SELECT doc_id, lang, source, n_chars, strftime(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS updated_at FROM documents")
def s2(spark, sf):
    path = scratch(spark, "manifest")
    updated = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd")
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", updated.alias("updated_at"))
    blocks = d.groupBy(F.floor(F.col("doc_id") / 500).alias("b")).agg(F.collect_list(F.struct(*d.columns)).alias("documents"))
    # one multi-line JSON document per file, as a manifest is
    blocks.select("b", F.to_json(F.struct("documents"), {"pretty": "true"}).alias("value")).repartition("b").write.partitionBy("b").text(path)
    return rd.manifest(spark, path, "doc_id bigint, lang string, source string, n_chars bigint, updated_at string")


@query("s3_json_lines_scan", "SELECT conv_id, turn, role, text FROM conversations")
def s3(spark, sf):
    path = scratch(spark, "jsonl")
    c = table(spark, sf, "conversations")
    # a blank line follows every record
    c.select(F.concat(F.to_json(F.struct(*c.columns)), F.lit("\n")).alias("value")).write.text(path)
    return rd.json_lines(spark, path, c.schema)


@query("s4_json_lines_sink", "SELECT conv_id, turn, role, length(text) AS n, md5(text) AS digest FROM conversations")
def s4(spark, sf):
    path = scratch(spark, "sink")
    c = table(spark, sf, "conversations")
    sk.save_json_lines(c, path)
    raw = spark.read.text(path)
    # read as text: the accents must be on disk, not escapes
    return raw.select(F.from_json("value", c.schema).alias("r"), F.contains("value", F.lit("\\u")).alias("esc")).where(~F.col("esc")).select(
        "r.conv_id", "r.turn", "r.role", F.length("r.text").alias("n"), F.md5("r.text").alias("digest"))


@query("s5_markdown_directory_to_chunks", "SELECT 'item' || item_id AS doc_id, len(p)::INTEGER AS n_chunks, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id AS item_id, p FROM ("
       + "WITH documents AS (SELECT item_id AS doc_id, text FROM benchmark), " + SQL_MDC + " SELECT doc_id, p FROM w))")
def s5(spark, sf):
    path = scratch(spark, "md")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 4 == 3, F.concat(F.lit("## "), s)).otherwise(s)), "\n\n")
    md = b.select(F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), body).alias("text"), F.format_string("%02d-item%d", F.col("doc_id"), F.col("doc_id")).alias("doc"))
    md.repartition("doc").write.partitionBy("doc").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"doc=([^/]+)/[^/]+$", 1)
    t = rd.text_directory(spark, path, "*.txt", name=name)
    rows = ck.chunk_rows(t.select("doc_id", "text"), ["doc_id"], ck.markdown_chunks(F.col("text"), 400, 80))
    return rows.groupBy("doc_id").agg(F.first("n_chunks").alias("n_chunks"), F.max(F.length("text")).alias("longest"))


@query("s6_tolerant_log_scan", """SELECT coalesce(CASE WHEN event_id % 10 <> 0 THEN event_type END, 'broken') AS event, count(*) AS n, coalesce(sum(CASE WHEN event_id % 10 <> 0 THEN user_id END), 0)::BIGINT AS users FROM events GROUP BY 1""")
def s6(spark, sf):
    path = scratch(spark, "log")
    e = table(spark, sf, "events").select("event_id", F.struct(F.col("event_type").alias("event"), "user_id", "value").alias("r"))
    line = F.to_json("r")
    e.select(F.when(F.col("event_id") % 10 == 0, F.substr(line, F.lit(1), F.lit(20))).otherwise(line).alias("value")).write.text(path)
    log = rd.tolerant_log(spark, path, "event string, user_id bigint, value double")
    kind = F.when(F.col("_corrupt_record").isNotNull(), "broken").otherwise(F.col("event"))
    return log.groupBy(kind.alias("event")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("_corrupt_record").isNull(), F.col("user_id"))), F.lit(0)).alias("users"))


@query("s7_metrics_text_scan", """SELECT count(*)::DOUBLE AS total, count(*) FILTER (event_type = 'error')::DOUBLE AS errors, count(*) FILTER (event_type = 'error' AND user_id % 3 = 1)::DOUBLE AS errors_t1,
(count(*) + count(DISTINCT (event_type, user_id % 3)))::DOUBLE AS prefix_total FROM events""")
def s7(spark, sf):
    path = scratch(spark, "metrics")
    c = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    labels = F.concat(F.lit('{outcome="'), "event_type", F.lit('",tenant="t'), "t", F.lit('"} '))
    c.select(F.explode(F.array(
        F.lit("# TYPE requests_total counter"), F.concat(F.lit("requests_total"), labels, F.col("n").cast("double")),
        F.concat(F.lit("requests_created"), labels, F.lit("1.0")))).alias("value")).write.text(path)
    m = rd.metric_lines(spark, path)
    return m.agg(
        rd.read_counter(m, "requests_total").alias("total"), rd.read_counter(m, "requests_total", outcome="error").alias("errors"),
        rd.read_counter(m, "requests_total", outcome="error", tenant="t1").alias("errors_t1"), rd.read_counter(m, "requests_").alias("prefix_total"))


SQL_CHANGES = "ch AS (SELECT doc_id, text || ' v2' AS text, 1 AS seq FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text || ' v3', 2 FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT doc_id + 1000000, text, 1 FROM documents WHERE doc_id % 50 = 0)"


def changes(spark, sf):
    d, i = docs(spark, sf), F.col("doc_id")
    two = d.where(i % 3 == 0).select("doc_id", F.concat("text", F.lit(" v2")).alias("text"), F.lit(1).alias("seq"))
    three = d.where(i % 6 == 0).select("doc_id", F.concat("text", F.lit(" v3")).alias("text"), F.lit(2).alias("seq"))
    fresh = d.where(i % 50 == 0).select((i + 1000000).alias("doc_id"), "text", F.lit(1).alias("seq"))
    return two.unionByName(three).unionByName(fresh)


@query("s8_idempotent_upsert", f"WITH {SQL_CHANGES}, l AS (SELECT doc_id, arg_max(text, seq) AS text FROM ch GROUP BY 1) SELECT doc_id, md5(text) AS digest FROM (SELECT * FROM l UNION ALL SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l))")
def s8(spark, sf):
    one, two = scratch(spark, "table"), scratch(spark, "table")
    sk.upserted(docs(spark, sf), changes(spark, sf), "doc_id", "seq").write.parquet(one)
    # the same changes again leave the table as it is
    sk.upserted(spark.read.parquet(one), changes(spark, sf), "doc_id", "seq").write.parquet(two)
    return spark.read.parquet(two).select("doc_id", F.md5("text").alias("digest"))


@query("s9_rebuild_or_refresh", rf"""WITH o AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {W})) AS term FROM documents)
SELECT count(o.term) FILTER (n.term IS NOT NULL) AS kept, count(*) FILTER (o.term IS NULL) AS added, count(*) FILTER (n.term IS NULL) AS removed, 'rebuild' AS mode FROM o FULL JOIN n ON o.term = n.term""")
def s9(spark, sf):
    d = docs(spark, sf)
    return sk.refresh_mode(lx.idf_plain(d.where(F.col("doc_id") % 10 != 0), "doc_id"), lx.idf_plain(d, "doc_id"))


def line_chunks(documents):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return documents.select("doc_id", F.posexplode(lines).alias("chunk_index", "text"))


def word_counts(documents):
    return lx.postings(documents, "doc_id", tx.words).select("doc_id", "term", "tf")


def refreshed(spark, sf, then=None):
    """A store built from nine of ten documents, then brought to all of them but some that vanish and some that change."""
    d, i = docs(spark, sf), F.col("doc_id")
    path = scratch(spark, "store")
    store = rf.Store(spark, path, line_chunks, word_counts, {"chunks": "lines", "tokens": "words"})
    modes = [store.refresh(d.where(i % 10 != 0))]
    now = d.where(i % 11 != 0).withColumn("text", F.when(i % 13 == 0, F.concat(F.substring("text", 1, 40), F.lit(" refreshed\nzebra"))).otherwise(F.col("text")))
    modes.append(store.refresh(now))
    if then:
        store = rf.Store(spark, path, line_chunks, word_counts, then)
        modes.append(store.refresh(now))
    return store, modes


SQL_NOW = "now AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN substr(text, 1, 40) || ' refreshed' || chr(10) || 'zebra' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"


@query("s9_incremental_term_statistics", rf"""WITH {SQL_NOW}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), {W})) AS term FROM now)
SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM now) / count(*)), 6) AS idf, 'rebuild,incremental' AS modes FROM t GROUP BY term""")
def s9_terms(spark, sf):
    """Document frequencies after inserts, changes and deletes, by signed deltas."""
    store, modes = refreshed(spark, sf)
    return store.idf().select("term", "df", F.round("idf", 6).alias("idf"), F.lit(",".join(modes)).alias("modes"))


SQL_LINES = "l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS p FROM now), c AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS chunk_index FROM l)"


@query("s9_incremental_chunks", f"WITH {SQL_NOW}, {SQL_LINES} SELECT doc_id, chunk_index::INT AS chunk_index, md5(text) AS digest FROM c")
def s9_chunks(spark, sf):
    """Chunks after the same refresh: none of a vanished or shortened document stays."""
    store, _ = refreshed(spark, sf)
    return store.chunks().select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query("s9_rebuild_on_new_settings", f"WITH {SQL_NOW}, {SQL_LINES} SELECT 'rebuild,incremental,rebuild' AS modes, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks FROM c")
def s9_rebuild(spark, sf):
    store, modes = refreshed(spark, sf, {"chunks": "lines", "tokens": "words", "version": 2})
    return store.chunks().agg(F.lit(",".join(modes)).alias("modes"), F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"))


@query("s10_delete_by_document_and_version", "SELECT doc_id // 2 AS logical_id, doc_id % 2 + 1 AS version, n_chars FROM documents WHERE NOT (doc_id // 2 = 7) AND NOT (doc_id // 2 % 4 = 1 AND doc_id % 2 = 0)")
def s10(spark, sf):
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 2).alias("logical_id"), (F.col("doc_id") % 2 + 1).alias("version"), "n_chars")
    out = sk.deleted(d, F.col("logical_id") == 7)
    return sk.deleted(out, (F.col("logical_id") % 4 == 1) & (F.col("version") == 1))


@query("s11_partial_metadata_update", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'deleted' ELSE lang END AS lang, CASE WHEN doc_id % 8 = 0 THEN 'archive' ELSE source END AS source, n_chars FROM documents")
def s11(spark, sf):
    d, i = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), F.col("doc_id")
    patch = d.where(i % 4 == 0).select("doc_id", F.lit("deleted").alias("lang"), F.when(i % 8 == 0, "archive").alias("source"))
    return sk.patched(d, patch, "doc_id")


@query("s13_snapshot_and_restore", "SELECT '20260101' AS snapshot, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings UNION ALL SELECT '20260102', count(*), round(sum(list_sum(embedding::DOUBLE[])), 4) FROM embeddings WHERE label <> 0")
def s13(spark, sf):
    root, e = scratch(spark, "snapshots"), table(spark, sf, "embeddings")
    sk.snapshot(e, root, "20260101")
    sk.snapshot(e.where(F.col("label") != 0), root, "20260102")
    parts = None
    for stamp in ("20260101", "20260102"):
        r = sk.restore(spark, root, stamp).agg(F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))), 4).alias("total")).select(F.lit(stamp).alias("snapshot"), "total")
        parts = r if parts is None else parts.unionByName(r)
    return sk.snapshots(spark, root).withColumn("snapshot", F.col("snapshot").cast("string")).join(parts, "snapshot")


SQL_ENC = f"""WITH {SQL_WORD_POST}, raw AS (SELECT doc_id, term, tf / dl * idf AS raw FROM wpost JOIN widf USING (term)), nrm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1)
SELECT doc_id, count(*) AS n_terms, round(sum(CASE WHEN norm > 0 THEN raw / norm ELSE 0 END), 6) AS weight_sum FROM raw JOIN nrm USING (doc_id) GROUP BY 1"""


def encoded(spark, sf, emb):
    e = emb.encode_documents(docs(spark, sf), "doc_id")
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("weight_sum"))


@query("s14_persisted_term_statistics", SQL_ENC)
def s14(spark, sf):
    path = scratch(spark, "terms")
    TfidfEmbedder(version="7").fit(docs(spark, sf), "doc_id").save(path)
    return encoded(spark, sf, TfidfEmbedder.load(spark, path, "7"))


@query("x1_embedder_contract", SQL_ENC)
def x1(spark, sf):
    return encoded(spark, sf, make_embedder("tfidf").fit(docs(spark, sf), "doc_id"))


@query("x1_dense_backend", rf"""WITH t AS (SELECT 'document' AS kind, doc_id AS id, 'passage: ' || coalesce(text, '') AS text FROM documents UNION ALL SELECT 'query', item_id, 'query: ' || coalesce(text, '') FROM benchmark),
w AS (SELECT kind, id, unnest(regexp_extract_all(lower(text), {W})) AS w FROM t), c AS (SELECT kind, id, ('0x' || md5(w)[1:8])::BIGINT % 64 AS cell, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)) AS x FROM c)
SELECT kind, id, 64 AS dim, count(*) AS filled, round(max(x), 6) AS largest, round(sum(x * (cell + 1)), 6) AS moment FROM v GROUP BY kind, id""")
def x1_dense(spark, sf):
    """The same contract with a dense backend; documents and queries encoded apart."""
    e = make_embedder("hashing", dim=64)
    d = e.encode_documents(docs(spark, sf), "doc_id").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "vec")
    q = e.encode_queries(table(spark, sf, "benchmark").select("item_id", "text"), "item_id").select(F.lit("query").alias("kind"), F.col("item_id").alias("id"), "vec")
    moment = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.unionByName(q).select(
        "kind", "id", F.lit(e.dim).alias("dim"), F.size(F.filter("vec", lambda x: x > 0)).alias("filled"), F.round(F.array_max("vec"), 6).alias("largest"), F.round(moment, 6).alias("moment"))


@query("s15_interaction_history", """SELECT u.conv_id * 1000 + u.turn AS id, md5(u.text) AS question, md5(a.text) AS answer, 's' || u.turn || ',' || 's' || (u.turn + 1) AS sources FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant' ORDER BY 1 DESC LIMIT 20""")
def s15(spark, sf):
    path = scratch(spark, "history")
    t = table(spark, sf, "conversations")
    u = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = t.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = u.join(a, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("2026-08-28 13:53:12").cast("timestamp").alias("created_at"), "question", "answer",
        F.array(F.concat(F.lit("s"), "turn"), F.concat(F.lit("s"), F.col("turn") + 1)).alias("sources"), F.lit("m").alias("model"), F.length("answer").alias("took_ms"))
    sk.append_interactions(rows.where(F.col("id") % 2 == 0), path)
    sk.append_interactions(rows.where(F.col("id") % 2 == 1), path)
    r = sk.recent_interactions(spark, path, 20)
    return r.select("id", F.md5("question").alias("question"), F.md5("answer").alias("answer"), F.array_join("sources", ",").alias("sources"))


@query("s17_nested_outcome_sink", f"WITH {SQL_OUT} SELECT id, mode, schema_ok AND grounded_ok AND rules_ok AS accepted, 'schema=' || schema_ok || ',grounded=' || grounded_ok || ',rules=' || rules_ok AS checks, tokens FROM ot")
def s17(spark, sf):
    path = scratch(spark, "outcomes")
    o = outcomes(spark, sf)
    names = ("schema", "grounded", "rules")
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_ok").alias("ok"), F.coalesce("reason", F.lit("")).alias("detail")) for n in names])
    doc = o.select(
        F.col("id").alias("ticket"), "mode", "accepted", F.struct(F.col("got_category").alias("category"), F.col("got_priority").alias("priority")).alias("got"),
        F.struct(F.col("gold_category").alias("category"), F.col("gold_priority").alias("priority")).alias("gold"), checks.alias("checks"), F.col("tokens").alias("answer_tokens"))
    doc.write.partitionBy("mode").json(path)
    schema = "ticket bigint, accepted boolean, got struct<category string, priority string>, gold struct<category string, priority string>, checks array<struct<name string, ok boolean, detail string>>, answer_tokens bigint, mode string"
    back = spark.read.schema(schema).json(path)
    line = F.array_join(F.transform("checks", lambda c: F.concat(c["name"], F.lit("="), c["ok"].cast("string"))), ",")
    return back.select(F.col("ticket").alias("id"), "mode", "accepted", line.alias("checks"), F.col("answer_tokens").alias("tokens"))
