"""Chunkers over ``documents``; a single newline separates paragraphs there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as tx
from lexmill.operators import chunking as ck
from lexmill.plans.lexical import W
from lexmill.plans.registry import query, table

NL = "\n"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def digest(rows):
    return rows.select("doc_id", "chunk_index", "n_chunks", F.length("text").alias("n"), F.md5("text").alias("digest"))


def st(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


OUT = "SELECT doc_id, unnest(range(0, len(p)))::INTEGER AS chunk_index, len(p)::INTEGER AS n_chunks, unnest(list_transform(p, lambda x: length(x))) AS n, unnest(list_transform(p, lambda x: md5(x))) AS digest FROM "


def windows_sql(src: str, key: str, size: int, overlap: int, out: str) -> str:
    """Recursive cursor: (key, t) -> (key, pieces)."""
    end = f"CASE WHEN s + {size} >= length(t) THEN length(t) WHEN instr(reverse(substr(t, s + 2, {size} - 1)), ' ') > 0 THEN s + {size} - instr(reverse(substr(t, s + 2, {size} - 1)), ' ') ELSE s + {size} END"
    return f"""{out}_b AS (SELECT {key}, {st('t')} AS t FROM {src}),
{out}_c AS (SELECT {key}, t, s, {end} AS e FROM (SELECT *, 0 AS s FROM {out}_b WHERE length(t) > 0)
  UNION ALL SELECT {key}, t, s, {end} FROM (SELECT {key}, t, greatest(e - {overlap}, s + 1) AS s FROM {out}_c WHERE e < length(t))),
{out} AS (SELECT {key}, list({st('substr(t, s + 1, e - s)')} ORDER BY s) FILTER ({st('substr(t, s + 1, e - s)')} <> '') AS p FROM {out}_c GROUP BY ALL)"""


@query("f18_fixed_windows", f"WITH RECURSIVE src AS (SELECT doc_id, text AS t FROM documents), {windows_sql('src', 'doc_id', 400, 80, 'w')} {OUT} w")
def f18(spark, sf):
    return digest(ck.chunk_rows(docs(spark, sf), ["doc_id"], ck.fixed_windows(F.col("text"), 400, 80)))


SQL_PAR = f"par AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {st('x')}), lambda x: x <> '') AS a FROM documents)"


def reduce_sql(src: str, lst: str, merge: str, out: str, key: str = "doc_id") -> str:
    """Fold a list of strings with state {d: list, c: string}; e is the element."""
    return f"""{out} AS (SELECT {key}, CASE WHEN s.c <> '' THEN list_append(s.d, s.c) ELSE s.d END AS p FROM (
  SELECT {key}, list_reduce({lst}, lambda s, x: {merge}, {{'d': []::VARCHAR[], 'c': '', 'g': []::VARCHAR[]}}) AS s FROM {src}))"""


def elem(e: str) -> str:
    return f"list_transform({e}, lambda y: {{'d': []::VARCHAR[], 'c': y, 'g': []::VARCHAR[]}})"


def pack_sql(n: int, glue: str) -> str:
    j = f"CASE WHEN s.c = '' THEN x.c ELSE s.c || {glue} || x.c END"
    return f"""CASE WHEN s.c <> '' AND length({j}) > {n} THEN {{'d': list_append(s.d, s.c), 'c': x.c, 'g': []::VARCHAR[]}} ELSE {{'d': s.d, 'c': {j}, 'g': []::VARCHAR[]}} END"""


GLUE = "(chr(10) || chr(10))"


@query("f19_paragraph_packing", f"WITH {SQL_PAR}, {reduce_sql('par', elem('a'), pack_sql(500, GLUE), 'w')} {OUT} w")
def f19(spark, sf):
    d = tx.once(docs(spark, sf), ["doc_id"], a=ck.paragraphs(F.col("text"), NL))
    return digest(ck.chunk_rows(d, ["doc_id"], ck.pack(F.col("a"), 500)))


def pack_cut_sql(n: int, glue: str) -> str:
    j = f"CASE WHEN s.c = '' THEN x.c ELSE s.c || {glue} || x.c END"
    fl = "CASE WHEN s.c <> '' THEN list_append(s.d, s.c) ELSE s.d END"
    return f"""CASE WHEN len(x.g) > 1 THEN {{'d': list_concat({fl}, x.g), 'c': '', 'g': []::VARCHAR[]}} WHEN length({j}) <= {n} THEN {{'d': s.d, 'c': {j}, 'g': []::VARCHAR[]}}
 ELSE {{'d': list_append(s.d, s.c), 'c': x.c, 'g': []::VARCHAR[]}} END"""


def grouped_sql(src: str, n: int, overlap: int, out: str) -> str:
    """(doc_id, a) -> (doc_id, g): elements longer than n cut into windows."""
    return f"""{out}_u AS (SELECT doc_id, unnest(a) AS t, unnest(range(0, len(a))) AS i FROM {src}), {out}_long AS (SELECT * FROM {out}_u WHERE length(t) > {n}),
{windows_sql(f'{out}_long', 'doc_id, i', n, overlap, f'{out}_w')},
{out} AS (SELECT u.doc_id, list({{'d': []::VARCHAR[], 'c': u.t, 'g': coalesce(w.p, [u.t])}} ORDER BY u.i) AS g FROM {out}_u u LEFT JOIN {out}_w w ON w.doc_id = u.doc_id AND w.i = u.i GROUP BY 1)"""


@query("f19_paragraph_packing_with_cuts", f"WITH RECURSIVE {SQL_PAR}, {grouped_sql('par', 300, 100, 'gr')}, {reduce_sql('gr', 'g', pack_cut_sql(300, GLUE), 'w')} {OUT} w")
def f19c(spark, sf):
    d = tx.once(docs(spark, sf), ["doc_id"], a=ck.paragraphs(F.col("text"), NL))
    d = d.select("doc_id", ck.fixed_windows_each(F.col("a"), 300, 100).alias("g"))
    return digest(ck.chunk_rows(d, ["doc_id"], ck.pack_cut(F.col("g"), 300)))


def overlap_sql(n: int, o: int) -> str:
    j = f"CASE WHEN s.c = '' THEN x.c ELSE {st('(s.c || ' + GLUE + ' || x.c)')} END"
    tail = f"right(s.c, {o})"
    word = f"CASE WHEN instr({tail}, ' ') > 0 THEN substr({tail}, instr({tail}, ' ') + 1) ELSE {tail} END"
    return f"""CASE WHEN length({j}) <= {n} THEN {{'d': s.d, 'c': {j}, 'g': []::VARCHAR[]}} WHEN s.c = '' THEN {{'d': s.d, 'c': x.c, 'g': []::VARCHAR[]}}
 ELSE {{'d': list_append(s.d, s.c), 'c': CASE WHEN {word} = '' THEN x.c ELSE {st('(' + word + ' || ' + GLUE + ' || x.c)')} END, 'g': []::VARCHAR[]}} END"""


SQL_SPIECES = f"""un AS (SELECT doc_id, unnest(a) AS t, unnest(range(0, len(a))) AS i FROM par),
sp AS (SELECT doc_id, i, string_split(regexp_replace(t, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM un WHERE length(t) > 700),
{reduce_sql('sp', elem('a'), pack_sql(700, "' '"), 'sq', 'doc_id, i')},
pc AS (SELECT un.doc_id, flatten(list(coalesce(sq.p, [t]) ORDER BY un.i)) AS a FROM un LEFT JOIN sq ON sq.doc_id = un.doc_id AND sq.i = un.i GROUP BY 1)"""


@query("f20_sentence_packing_with_overlap", f"WITH {SQL_PAR}, {SQL_SPIECES}, {reduce_sql('pc', elem('a'), overlap_sql(700, 120), 'w')} {OUT} w")
def f20(spark, sf):
    return digest(ck.chunk_rows(docs(spark, sf), ["doc_id"], ck.sized_text(F.col("text"), 700, 120, NL)))


def markdown_docs(spark, sf):
    """Newlines become blank lines, lines 3, 7, 11 .. become level-two headings, a title goes on top."""
    lines = F.split("text", NL)
    body = F.array_join(F.transform(lines, lambda s, i: F.when(i % 4 == 3, F.concat(F.lit("## "), s)).otherwise(s)), "\n\n")
    return docs(spark, sf).select("doc_id", F.concat(F.lit("# Doc "), "doc_id", F.lit("\n\n"), body).alias("text"))


SQL_MD = """md AS (SELECT doc_id, '# Doc ' || doc_id || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: CASE WHEN i % 4 = 0 THEN '## ' || s ELSE s END), chr(10) || chr(10)) AS text FROM documents)"""


def md_fold(size: int, overlap: int) -> str:
    cat = "array_to_string({}, chr(10) || chr(10))"
    suf = "list_slice(s.g, len(s.g) - m + 1, len(s.g))"
    over = f"len(s.g) > 0 AND length({cat.format('list_append(s.g, x.c)')}) > {size}"
    fits = f"list_filter(range(0, len(s.g) + 1), lambda m: length({cat.format(suf)}) <= {overlap} AND length({cat.format(f'list_append({suf}, x.c)')}) <= {size})"
    keep = f"coalesce(list_max({fits}), 0)"
    return f"""CASE WHEN {over} THEN {{'d': list_append(s.d, {cat.format('s.g')}), 'c': '', 'g': list_append(list_slice(s.g, len(s.g) - {keep} + 1, len(s.g)), x.c)}}
 ELSE {{'d': s.d, 'c': '', 'g': list_append(s.g, x.c)}} END"""


SQL_MDC = f"""{SQL_MD}, se AS (SELECT doc_id, unnest(a) AS t, unnest(range(0, len(a))) AS i FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^## ', chr(1) || '## ', 'g'), chr(1)), lambda x: {st('x')}), lambda x: x <> '') AS a FROM md)),
ps AS (SELECT doc_id, i, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda x: {st('x')}), lambda x: x <> '') AS a FROM se),
us AS (SELECT doc_id, i, flatten(list_transform(a, lambda p: CASE WHEN length(p) > 400 THEN list_transform(range(0, (length(p) - 1) // 320 + 1), lambda k: substr(p, k * 320 + 1, 400)) ELSE [p] END)) AS a FROM ps),
fs AS (SELECT doc_id, i, list_reduce({elem('a')}, lambda s, x: {md_fold(400, 80)}, {{'d': []::VARCHAR[], 'c': '', 'g': []::VARCHAR[]}}) AS s FROM us),
w AS (SELECT doc_id, flatten(list(CASE WHEN len(s.g) > 0 THEN list_append(s.d, array_to_string(s.g, chr(10) || chr(10))) ELSE s.d END ORDER BY i)) AS p FROM fs GROUP BY 1)"""


@query("f21_markdown_section_chunks", f"WITH {SQL_MDC} {OUT} w")
def f21(spark, sf):
    return digest(ck.chunk_rows(markdown_docs(spark, sf), ["doc_id"], ck.markdown_chunks(F.col("text"), 400, 80)))


@query("f21_markdown_title", f"WITH {SQL_MD} SELECT doc_id, trim(substr(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '# '))[1], 3)) AS title, len(regexp_extract_all(text, '(?m)^## ')) AS n_sections FROM md")
def f21t(spark, sf):
    m = markdown_docs(spark, sf)
    return m.select("doc_id", ck.markdown_title(F.col("text"), F.lit("?")).alias("title"), F.regexp_count("text", F.lit("(?m)^## ")).alias("n_sections"))


SQL_SENT = rf"""sn AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents),
sm AS (SELECT doc_id, s, list_transform(s, lambda x: list_distinct(list_transform(list_filter(regexp_extract_all(lower(x), {W}), lambda w: length(w) > 2), lambda w: substr(w, 1, 5)))) AS m FROM sn),
wi AS (SELECT doc_id, s, list_transform(range(1, len(s)), lambda i: list_distinct(flatten(list_slice(m, greatest(i - 1, 1), i)))) AS a, list_transform(range(1, len(s)), lambda i: list_distinct(flatten(list_slice(m, i + 1, i + 2)))) AS b FROM sm),
cu AS (SELECT doc_id, s, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN len(list_distinct(list_concat(a[i], b[i]))) > 0 THEN len(list_intersect(a[i], b[i]))::DOUBLE / len(list_distinct(list_concat(a[i], b[i]))) ELSE 0.0 END) AS c FROM wi),
th AS (SELECT *, list_sort(c) AS o, (len(c) - 1) * 0.1::DOUBLE AS h FROM cu),
tt AS (SELECT *, o[floor(h)::INTEGER + 1] + (o[least(floor(h)::INTEGER + 2, len(c))] - o[floor(h)::INTEGER + 1]) * (h - floor(h)) AS t FROM th)"""


@query("w5_similarity_curve", f"WITH {SQL_SENT} SELECT doc_id, len(s) AS n_sentences, round(coalesce(list_sum(c), 0), 6) AS curve_sum, round(coalesce(t, -1), 6) AS threshold, len(list_filter(c, lambda x: x <= t)) AS n_valleys FROM tt")
def w5(spark, sf):
    s = tx.once(docs(spark, sf), ["doc_id"], s=tx.sentences(F.col("text")))
    s = tx.once(s, ["doc_id", "s"], m=F.transform("s", lambda x: tx.stems(x)))
    s = tx.once(s, ["doc_id", "s"], c=ck.similarity_curve(F.col("m"), ck.jaccard))
    s = s.withColumn("t", ck.linear_percentile(F.col("c"), 0.1))
    return s.select(
        "doc_id", F.size("s").alias("n_sentences"), F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("curve_sum"),
        F.round(F.coalesce("t", F.lit(-1.0)), 6).alias("threshold"), F.size(F.filter("c", lambda x: x <= F.col("t"))).alias("n_valleys"))


SQL_SEG = f"""{SQL_SENT}, ro AS (SELECT doc_id, len(s) AS n, list_transform(range(1, len(s) + 1), lambda i: {{'d': []::VARCHAR[], 'c': s[i], 'g': CASE WHEN i > 1 AND c[i - 1] <= t THEN ['cut'] ELSE []::VARCHAR[] END}}) AS r FROM tt),
sg AS (SELECT doc_id, n, list_reduce(r, lambda s, x: CASE WHEN s.c = '' THEN {{'d': s.d, 'c': x.c, 'g': []::VARCHAR[]}} WHEN len(x.g) > 0 THEN {{'d': list_append(s.d, s.c), 'c': x.c, 'g': []::VARCHAR[]}}
  ELSE {{'d': s.d, 'c': s.c || ' ' || x.c, 'g': []::VARCHAR[]}} END, {{'d': []::VARCHAR[], 'c': '', 'g': []::VARCHAR[]}}) AS s FROM ro),
un AS (SELECT sg.doc_id, n, CASE WHEN n >= 4 THEN CASE WHEN s.c <> '' THEN list_append(s.d, s.c) ELSE s.d END ELSE par.a END AS a FROM sg JOIN par ON par.doc_id = sg.doc_id)"""


@query("f22_semantic_chunks", f"""WITH RECURSIVE {SQL_PAR}, {SQL_SEG}, {grouped_sql('un', 500, 100, 'gr')}, g4 AS (SELECT gr.* FROM gr JOIN un ON un.doc_id = gr.doc_id WHERE n >= 4), g3 AS (SELECT gr.* FROM gr JOIN un ON un.doc_id = gr.doc_id WHERE n < 4),
{reduce_sql('g4', 'g', pack_cut_sql(500, "' '"), 'w4')}, {reduce_sql('g3', 'g', pack_cut_sql(500, GLUE), 'w3')}, w AS (SELECT * FROM w4 UNION ALL SELECT * FROM w3) {OUT} w""")
def f22(spark, sf):
    return digest(ck.chunk_rows(ck.semantic_chunks(docs(spark, sf), "doc_id", 500, NL), ["doc_id"], F.col("pieces")))


STOP = ("это", "для", "или", "что", "как", "при", "все", "его", "них")


@query("f23_sentences_and_stems", rf"""WITH sn AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS s FROM documents),
m AS (SELECT doc_id, list_filter(regexp_extract_all(lower(s), {W}), lambda w: length(w) > 2) AS w FROM sn)
SELECT doc_id, count(*) AS n_sentences, sum(len(list_distinct(list_transform(w, lambda x: substr(x, 1, 5)))))::BIGINT AS stems5,
sum(len(list_distinct(list_transform(list_filter(w, lambda x: x NOT IN {STOP}), lambda x: substr(x, 1, 4)))))::BIGINT AS stems4 FROM m GROUP BY 1""")
def f23(spark, sf):
    s = docs(spark, sf).select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum(F.size(tx.stems(F.col("s")))).alias("stems5"),
        F.sum(F.size(tx.stems(F.col("s"), 4, STOP))).alias("stems4"))


@query("f24_contextual_header", f"WITH {SQL_PAR} SELECT doc_id, i AS chunk_index, md5(CASE WHEN i > 0 THEN a[1] || '. ' || t ELSE t END) AS indexed FROM (SELECT doc_id, a, unnest(range(0, len(a)))::INTEGER AS i, unnest(a) AS t FROM par)")
def f24(spark, sf):
    d = tx.once(docs(spark, sf), ["doc_id"], a=ck.paragraphs(F.col("text"), NL))
    r = d.select("doc_id", F.try_element_at("a", F.lit(1)).alias("title"), F.posexplode("a").alias("chunk_index", "t"))
    return r.select("doc_id", "chunk_index", F.md5(ck.contextual(F.col("chunk_index"), F.col("title"), F.col("t"))).alias("indexed"))


@query("w14_chunk_index_and_count", f"WITH {SQL_PAR} SELECT doc_id, unnest(range(0, len(a)))::INTEGER AS chunk_index, len(a)::INTEGER AS n_chunks FROM par")
def w14(spark, sf):
    return ck.chunk_rows(docs(spark, sf), ["doc_id"], ck.paragraphs(F.col("text"), NL)).select("doc_id", "chunk_index", "n_chunks")


CHUNKERS = {
    "fixed": lambda t: ck.fixed_windows(t, 400, 80),
    "paragraphs": lambda t: ck.pack(ck.paragraphs(t, NL), 500),
    "sized": lambda t: ck.sized_text(t, 700, 120, NL),
}


@query("x7_chunker_as_table_function", f"""WITH RECURSIVE src AS (SELECT doc_id, text AS t FROM documents), {windows_sql('src', 'doc_id', 400, 80, 'w1')}, {SQL_PAR}, {reduce_sql('par', elem('a'), pack_sql(500, GLUE), 'w2')},
{SQL_SPIECES}, {reduce_sql('pc', elem('a'), overlap_sql(700, 120), 'w3')}, al AS (SELECT 'fixed' AS chunker, unnest(p) AS x FROM w1 UNION ALL SELECT 'paragraphs', unnest(p) FROM w2 UNION ALL SELECT 'sized', unnest(p) FROM w3)
SELECT chunker, count(*) AS n_chunks, max(length(x)) AS longest, round(avg(length(x)), 6) AS mean_chars FROM al GROUP BY 1""")
def x7(spark, sf):
    out = None
    for name, chunker in CHUNKERS.items():
        rows = ck.chunk_rows(docs(spark, sf), ["doc_id"], chunker(F.col("text"))).select(F.lit(name).alias("chunker"), F.length("text").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("chunker").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean_chars"))


SQL_X3 = SQL_SENT.split("wi AS")[0] + f"""w3 AS (SELECT doc_id, list_transform(range(1, len(s)), lambda i: list_distinct(flatten(list_slice(m, greatest(i - 2, 1), i)))) AS a, list_transform(range(1, len(s)), lambda i: list_distinct(flatten(list_slice(m, i + 1, i + 3)))) AS b FROM sm)
SELECT doc_id, round(coalesce(list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN least(len(a[i]), len(b[i])) > 0 THEN len(list_intersect(a[i], b[i]))::DOUBLE / least(len(a[i]), len(b[i])) ELSE 0 END)), 0), 6) AS overlap_sum FROM w3"""


def overlap_coefficient(a, b):
    """Another similarity for the curve: shared items over the smaller set."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


@query("x3_pluggable_similarity", "WITH " + SQL_X3)
def x3(spark, sf):
    s = tx.once(docs(spark, sf), ["doc_id"], s=tx.sentences(F.col("text")))
    s = tx.once(s, ["doc_id"], m=F.transform("s", lambda x: tx.stems(x)))
    s = tx.once(s, ["doc_id"], c=ck.similarity_curve(F.col("m"), overlap_coefficient, 3))
    return s.select("doc_id", F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("overlap_sum"))
