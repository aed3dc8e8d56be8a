"""Each operator against a plain version, on odd rows and on an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import bpe, jaccard, langid, mix, mtree, ordinal, secrets, simhash, tokenfile, warc
from lexmill.llm.common import filesystem
from lexmill.session import scratch
from tests.llm.rows import SCHEMA, frame, texts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(r[0], r[1]) for r in texts()]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(r):
    return tuple("" if x is None else str(x) for x in r)


# --- encoding --------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(docs, none):
    lib = Tokenizer.from_file(WORDS)

    def plain(i, t):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        return i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))

    assert Counter(map(tuple, bpe.digests(docs, WORDS).collect())) == Counter(plain(*r) for r in ROWS)
    assert bpe.digests(none, WORDS).count() == 0
    out = bpe.encoded(docs, WORDS)
    assert set(docs.columns) | {"ids", "decoded"} == set(out.columns) and out.count() == len(ROWS)


@pytest.mark.parametrize("text", ["<|startoftext|>a<|endoftext|> b", "İ ΣΑΣ ǅ ẞ", "é é́", "it's I'LL 'S x\x1cy", "a" * 3000, "\U0001f600" * 9, "</w> a</w>", "\u0000 ￿"])
def test_bpe_on_odd_strings(text):
    lib, code = Tokenizer.from_file(WORDS), bpe.codec(WORDS)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert code.encode(text) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))


def test_bpe_on_many_special_strings():
    lib, code = Tokenizer.from_file(WORDS), bpe.codec(WORDS)
    for text in ("<|startoftext|>" * 2000, "a<|endoftext|>" * 1500 + "b"):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert code.encode(text)[:2] == (len(ids), " ".join(map(str, ids)))


def test_users_columns_survive(spark):
    names = ["_key", "_text", "_places", "_langid", "_mx_size", "_mx_row", "_jk", "_jkept", "_jn", "_bpe", "ids", "decoded", "key", "guess", "one", "place", "c0"]
    rows = [(r[0], r[1], r[2], r[3], *(f"{n}-{i}" for n in names)) for i, r in enumerate(texts())]
    table = spark.createDataFrame(rows, ", ".join(["doc_id bigint", "text string", "lang string", "source string", *(f"`{n}` string" for n in names)]))
    for made in (langid.known(table), jaccard.one_of_each(table), secrets.redact(table), mix.mixed(table)):
        assert made.columns == table.columns
        assert {tuple(r[4:]) for r in made.collect()} <= {tuple(r[4:]) for r in rows}
    out = bpe.encoded(table, WORDS)
    assert out.columns == [*table.columns, "ids_", "decoded_"]
    assert Counter(tuple(r[4:-2]) for r in out.collect()) == Counter(tuple(r[4:]) for r in rows)


def test_bpe_hands_on_slices(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 1)
    lib = Tokenizer.from_file(WORDS)
    got = bpe.encoded(frame(spark), WORDS).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)


def test_token_shards(docs, none, monkeypatch):
    lib = Tokenizer.from_file(BYTES)
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in tokenfile.round_trip(docs, BYTES).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenfile.round_trip(none, BYTES).count() == 0


def test_ranges_of_a_shard(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 1000)
    rng = np.random.default_rng(1)
    lists = [rng.integers(3, 12, n).astype("<u4") for n in (0, 1, 5, 2500, 700, 1)]
    shard = tokenfile.Shard(str(tmp_path), "x.ids", 2, 50)
    for i, ids in enumerate(lists):
        shard.add(i, np.append(ids, 2).astype("<u4").tobytes())
    shard.close()
    flat = np.concatenate([np.append(x, 2) for x in lists])
    with filesystem(str(tmp_path))[0].open_input_file(f"{tmp_path}/x.ids") as f:
        reader = tokenfile.Reader(f)
        assert sum(b[2] for b in reader.blocks) < len(flat)  # pairs were replaced
        for a, b in [(0, len(flat)), (0, 1), (999, 1001), (17, 2900), (3000, len(flat))]:
            assert (reader.ids(a, b - a) == flat[a:b]).all()


def frequent(symbols, end_id):
    """Occurrences of the most frequent pair, counted from left to right without overlap."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
        if end_id in pair or last.get(pair) == i - 1:
            continue
        counts[pair], last[pair] = counts.get(pair, 0) + 1, i
    return max(counts.values(), default=0)


@pytest.mark.parametrize("seed", range(40))
def test_re_pair_runs_to_the_end(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(2, 2 + rng.integers(1, 6), rng.integers(0, 600)).astype("<u4")
    if seed % 4 == 0:
        ids = np.tile(ids, 20)  # copies: deep rules
    rules, symbols = tokenfile.re_pair(ids, 2, 50)
    sizes = tokenfile.lengths(rules, 50)
    assert (tokenfile.expand(symbols, rules, sizes, 50) == ids).all()
    assert frequent(symbols, 2) < tokenfile.LEAST
    assert not len(rules) or 2 not in tokenfile.expand(np.arange(50, 50 + len(rules)), rules, sizes, 50)


@pytest.mark.parametrize("text", [" ", "  ", "a  b", "a \nb", "a\n b", " a", "a ", "\t", "a\t", "<|endoftext|> a", "a <|endoftext|>b c", "é, ï. z", "日本 語。 x", "don't we'll  x", "x\u00a0 y", "a \u2003b"])
def test_encoder_at_blanks(text):
    code = tokenfile.encoder(BYTES)
    want = code.whole([text])
    assert list(code.encode([text])) == want and list(code.encode(["x " + text + " x"])) == code.whole(["x " + text + " x"])


# --- secrets ---------------------------------------------------------------------------------------------------------


def plain_base(text):
    kinds = {
        "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+",
    }
    least = {"assign": 12, "access": 18, "hex": 16}
    found = []
    for order, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text or "", re.ASCII):
            if len(m.group(2) if kind == "assign" else m.group()) >= least[kind]:
                found.append((m.start(), order, m.end(), kind))
    return found


def test_secrets_far_starts_and_endpoints_without_dot(spark):
    key = "Ab3dEf6hIj9kLm2nOp5q" * 30
    rows = [(1, "login: bob\ntoken = abcdefghijklmn\npostgres://db:5432/app"), (2, f"{key} login: bob"), (3, f"http://host/{'x' * 400} login: bob token = abcdefghijklmn"),
            (4, f"{key}{' ' * 201}login: bob"), (5, f"login: bob {'. ' * 95}{key}")]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "endpoint:34:56" in got[1] and got[2] == "weak:0:600,login:601:611" and "endpoint:0:412" in got[3] and "login" not in got[4] and "weak" in got[5]
    clean = secrets.redact(spark.createDataFrame(rows[:1], "doc_id long, text string")).first().text
    assert "postgres" not in clean


def test_secrets(spark, docs, none):
    extra = [(1, "password: 'secret: abcdefghijkl"), (2, "token=secret=abcdefghijklmn"), (3, "x" * 500 + " login: bob" + " y" * 300 + " Ab3dEf6hIj9kLm2nOp5q"),
             (4, "login: bob uses Ab3dEf6hIj9kLm2nOp5q here"), (5, "Ab3dEf6hIj9kLm2nOp5q"), (6, "login: bob\n\nAb3dEf6hIj9kLm2nOp5q"), (7, "ſecret = abcdefghijklmnop")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in df.collect()]
    want = Counter()
    for i, t in rows:
        base = sorted(plain_base(t))
        n = Counter(b[3] for b in base)
        want[i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in base))] += 1
    got = secrets.scan(df).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    linked = {(r.doc_id, r.spans) for r in got if r.n_linked}
    assert (4, "login:0:10,weak:16:36") in linked and not {i for i, _ in linked} & {3, 5, 6}
    assert any("endpoint" in s and "login" in s for i, s in linked if i == 12)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    text = clean.where("doc_id = 12").first().text
    assert "abcdef123456789" not in text and "AKIA" not in text and "[ACCESS]" in text
    assert Counter(r.text for r in clean.where("doc_id <> 12").collect()) == Counter(t for i, t in ROWS if i not in (12, None))
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_mix(spark, docs, none):
    rows = mix.mix(docs).collect()
    assert len(rows) == len(ROWS)
    total = sum(r.size for r in rows)
    per = {r.source_size: r.target for r in rows}
    assert all(t <= 2 * s + 1e-9 for s, t in per.items()) and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert math.isclose(sum({(r.source_size, r.target) for r in rows} and [t for _, t in {(r.source_size, r.target) for r in rows}]), 1.5 * total, rel_tol=1e-9)
    assert sorted(map(key, rows)) == sorted(map(key, mix.mix(docs.repartition(5)).collect()))
    copies = mix.mixed(docs)
    assert copies.columns == docs.columns
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in copies.collect()]
    assert sum(sizes) == sum(r.taken for r in rows)
    assert mix.mix(none).count() == 0 and mix.mixed(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 40), "abcde"[min(i % 9, 4)]) for i in range(4000)]
    out = mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = out.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert len(per) >= 4 and all(abs(r.n - r.t) <= 40 for r in per)


# --- languages and quality -------------------------------------------------------------------------------------------


def test_mix_of_repeated_and_null_ids(spark):
    rows = [(None, f"w w w {'v ' * (i % 4)}", "a") for i in range(600)] + [(7, "a b c d e f", "b")] * 500 + [(i, "x y z", "c") for i in range(901)] + [(9, "q " * (1 + i % 9), None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix.mix(docs).collect()
    assert sorted(map(key, out)) == sorted(map(key, mix.mix(docs.repartition(7)).collect()))
    for total, target in {(r.source_size, r.target) for r in out}:
        mine = [r for r in out if r.source_size == total]
        assert abs(sum(r.taken for r in mine) - target) <= max(r["size"] for r in mine)
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
    sizes = Counter()
    for r in mix.mixed(docs).collect():
        sizes[r.source] += len((r.text or "").split())
    per = {}
    for r in out:
        per[r.source_size] = per.get(r.source_size, 0) + r.taken
    assert sorted(sizes.values()) == sorted(per.values())


def test_language(spark, sf, none):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = out.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("r"), F.min("score").alias("low"), F.max("score").alias("high")).collect()
    assert all(r.r >= 0.97 and r.low >= 0 and r.high <= 1 for r in right) and len(right) == 2
    assert langid.identify(none).count() == 0 and langid.known(none).count() == 0


def test_language_of_odd_rows(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6, 7, 13))
    assert got[4].lang_pred == "en" and got[14].held_out == (zlib.crc32(b"14") % 4 == 2)
    assert langid.known(docs).columns == docs.columns


def test_blocks_of_long_texts(monkeypatch):
    text = "wort und satz " * 400
    whole = [np.sort(langid.grams(langid.code_points(text), n)[1]) for n in langid.ORDERS]
    monkeypatch.setattr(langid, "BLOCK", 101)
    for n, want in zip(langid.ORDERS, whole):
        found = []
        for points, owner in langid.blocks([text], n - 1):
            at, h = langid.grams(points, n)
            found.append(h[langid._within(at, owner, n)])
        assert (np.sort(np.concatenate(found)) == want).all()


def test_quality(spark, sf, docs, none):
    big = sf.replace("0.001", "0.1")
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = ordinal.rate(d, labels, learn_from=~langid.held_out()).join(ordinal.grades(labels).withColumnRenamed("id", "doc_id"), "doc_id")
    per = {r.grade: r for r in out.where(langid.held_out()).groupBy("grade").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("e")).collect()}
    assert per[0].kept < 0.15 and per[2].kept > 0.97 and per[0].e < per[1].e < per[2].e
    rated = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (9, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    odd = ordinal.rate(docs, rated).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.p_good <= r.p_clean <= 1 for r in odd)
    unrated = ordinal.rate(docs, rated.limit(0)).collect()
    assert len(unrated) == len(ROWS) and all(r.keep and r.expected_grade is None for r in unrated)
    assert ordinal.rate(none, rated).count() == 0


# --- archives --------------------------------------------------------------------------------------------------------


def test_warc(spark, none):
    big = 2**60 + 1
    html = ["<p>a</p>", "<p>a</p>", "", None, "<b>é🎉</b>", "x" * 300_000, "<p>a</p>", "<p>a</p>"]
    ids = [1, 5, 3, big, 7, 8, None, 5]
    pages = spark.createDataFrame([(i, "u", h, "clash") for i, h in zip(ids, html)], "page_id long, url string, html string, sha string")
    folder = scratch(spark, "warc-test")
    index = warc.write(pages, folder, bundle_bytes=1000, frame_bytes=900)
    rows = warc.read(index, folder).collect()
    digest = {h or "": warc.digest_of((h or "").encode()) for h in html}
    want = Counter()
    for i, h in zip(ids, html):
        keeper = max(x for x, y in zip(ids, html) if (y or "") == (h or "") and x is not None)
        want[i, len((h or "").encode()), digest[h or ""], "response" if i == keeper else "revisit", None if i == keeper else keeper] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    one = index.where(F.col("record_bytes") > 300_000).first()
    fields, block, _ = warc.parse(warc.read_record(folder, *one[1:]))
    assert block == b"x" * 300_000 and fields["WARC-Record-ID"] == f"<{one.record_id}>"
    every = index.collect()
    assert len({r.record_id for r in every}) == len(every) == len(html)  # equal rows too
    for r in every:
        fields, _, end = warc.parse(warc.read_record(folder, *r[1:]))
        assert fields["WARC-Record-ID"] == f"<{r.record_id}>" and end == r.record_bytes
    assert warc.round_trip(pages.limit(0)).count() == 0
    kept = warc.round_trip(pages, min_bytes=5).where("payload_bytes = 0").collect()
    assert [r.record_type for r in kept] == ["response"] * 2


def test_bundles_are_read_by_many_tasks(spark):
    folder = scratch(spark, "warc-test")
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.repeat(F.col("id").cast("string"), 50).alias("html")).repartition(8)
    index = warc.write(pages, folder)
    assert index.groupBy("bundle", "frame_offset").count().agg(F.max("count")).first()[0] > 1  # records share frames
    n = index.select("bundle").distinct().count()
    tasks = warc.read(index, folder).select(F.spark_partition_id().alias("p"), "bundle").distinct()
    assert n >= 4 and tasks.select("p").distinct().count() > n / 2


# --- fingerprints ----------------------------------------------------------------------------------------------------


def test_simhash(docs, none):
    got = simhash.compare_with_edits(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        q = len(t) // 4
        want[i, len(t), sha(t[: len(t) - q] + after[:q])] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    texts_of = Counter(ROWS)
    for r in got:
        for (i, t) in texts_of:
            if i == r.doc_id and len(t or "") == r.n_chars:
                by_text.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert simhash.compare_with_edits(none).count() == 0


def test_fingerprint_is_a_vote(spark):
    text = "one two three four five six one"
    hashed = spark.createDataFrame([(1, text)], "id long, t string").select(simhash.word_hashes(F.col("t")).alias("h")).withColumn("x", simhash.terms(F.col("h"))).first().x
    votes = [sum((1 if (x.h >> k) & 1 else -1) * x.w for x in hashed) for k in range(64)]
    fp = sum(1 << k for k in range(64) if votes[k] > 0)
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "id long, t string"), ["id"], "t").first().fp
    assert got % (1 << 64) == fp and len(hashed) == 6 + 6 + 3 + 1


def test_block_tables(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    fps = set(base)
    for x in base:
        for n in (1, 2, 3, 4):
            y = x % (1 << 64)
            for k in rng.choice(64, n, replace=False):
                y ^= 1 << int(k)
            fps.add(y - (1 << 64) if y >> 63 else y)
    fps = list(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a in base for b in fps if bin((a ^ b) % (1 << 64)).count("1") <= 3}
    got = simhash.within(df, spark.createDataFrame([(x,) for x in base], "qfp long")).collect()
    assert {(r.qfp, r.fp) for r in got} == want and len(got) == len(want)


# --- search ----------------------------------------------------------------------------------------------------------


def test_mtree(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * rng.uniform(0.2, 3, (6, 1))
    vectors = [centres[i % 6] + rng.normal(size=16) * 0.1 for i in range(1500)] + [np.ones(16)] * 300 + [np.zeros(16)] * 20
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vectors)]
    odd = [(9000, None, "c"), (9001, [], "c"), (9050, [1.0, float("nan")], "c"), (9100, [float("inf")] * 16, "c"), (9150, [None] + [1.0] * 15, "c"), (None, [1.0] * 16, "c"),
           (9200, [1.0, 2.0], "c"), (9201, [3.0, 1.0], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id string")
    got = mtree.top_k(df, F.col("vec_id") % 50 == 0, block_vectors=400, block_queries=7).collect()
    whole = np.floor(np.array(vectors) * 256).astype(np.int64)
    want = []
    for q in range(0, len(vectors), 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:5]
        want += [(q, n + 1, int(i), int(s[i])) for n, i in enumerate(order)]
    want.append((9200, 1, 9201, 256 * 3 * 256 + 512 * 256))
    assert sorted(map(tuple, got)) == sorted(want)
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
