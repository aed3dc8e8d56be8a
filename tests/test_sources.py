"""Readers and sinks on real files."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions.embed import ModelEmbedder
from lexmill.sources import readers as rd
from lexmill.sources import sinks as sk


def test_text_directory(spark, tmp_path):
    (tmp_path / "01-vpn.txt").write_text("VPN\n\nHow to connect", encoding="utf-8")
    (tmp_path / "02-nowhere.txt").write_text("  Title  \nbody", encoding="utf-8")
    (tmp_path / "03-empty.txt").write_text("", encoding="utf-8")
    (tmp_path / "note.md").write_text("# skip", encoding="utf-8")
    got = {r.doc_id: (r.title, r.topic, r.source) for r in rd.text_directory(spark, str(tmp_path), topics={"vpn": "it"}).collect()}
    assert got == {"vpn": ("VPN", "it", "01-vpn.txt"), "nowhere": ("Title", "other", "02-nowhere.txt")}
    assert [r.doc_id for r in rd.text_directory(spark, str(tmp_path), "*.md").collect()] == ["note"]
    with pytest.raises(FileNotFoundError):
        rd.require_rows(rd.text_directory(spark, str(tmp_path), "*.xyz"), "texts")


def test_json_lines_keep_accents_and_skip_blanks(spark, tmp_path):
    p = str(tmp_path / "j")
    sk.save_json_lines(spark.createDataFrame([(1, "Ünïcode привет", None)], "id int, t string, n string"), p)
    raw = spark.read.text(p).first().value
    assert "привет" in raw and '"n":null' in raw
    (tmp_path / "blank.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert rd.json_lines(spark, str(tmp_path / "blank.jsonl"), "id int").count() == 2


def test_broken_log_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"event": "x"}\n{"event": "y\nnot json\n')
    rows = rd.tolerant_log(spark, str(tmp_path / "a.log"), "event string").select("event", "_corrupt_record").collect()
    assert sum(r._corrupt_record is not None for r in rows) == 2 and [r.event for r in rows if r.event] == ["x"]


def test_counter_matches_by_name_prefix(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP x\nreq_total{outcome="ok",t="a"} 7.0\nreq_total{outcome="no",t="a"} 2.0\nreq_total_created{outcome="ok"} 1.0\n')
    m = rd.metric_lines(spark, str(tmp_path / "m.txt"))
    r = m.agg(rd.read_counter(m, "req_total").alias("a"), rd.read_counter(m, "req_total", outcome="ok").alias("b"),
              rd.read_counter(m, "nothing").alias("c")).first()
    assert (r.a, r.b, r.c) == (10.0, 8.0, 0.0)


def test_upsert_is_idempotent_and_last_write_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    ch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    once = sk.upserted(base, ch, "id", "seq")
    twice = sk.upserted(once, ch, "id", "seq")
    want = [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_patch_and_delete(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "id int, v string, n int")
    patch = spark.createDataFrame([(2, "q", None)], "id int, v string, n int")
    assert sorted(map(tuple, sk.patched(base, patch, "id").collect())) == [(1, "a", 5), (2, "q", 6)]
    assert [r.id for r in sk.deleted(base, F.col("v") == "a").collect()] == [2]


def test_model_embedder_uses_prefixes(spark):
    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    e = ModelEmbedder(load, 2)
    df = spark.createDataFrame([(1, "ab")], "id int, text string")
    assert e.encode_queries(df, "id").first().vec == [9.0, 1.0] and e.encode_documents(df, "id").first().vec == [11.0, 1.0]
