"""Fill-in-middle over frames against slicing of plain strings."""

import hashlib
import random
import re
from collections import Counter

import pytest
import zstandard

from lexmill.llm import fim
from tests.llm.rows import SCHEMA, frame, texts

MARKS = tuple(m.encode() for m in fim.MARKS)


def plain(doc_id, text):
    """Units, form, lengths, output."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ODD = [(200 + i, t) for i, t in enumerate(["a<P>b", "<", "<P", "<S>", "x" * 200_000, "é" * 70_000 + "b" * 70_000, "\n\n", "<M", "\u0000a"])]


def test_digests_and_texts(spark):
    rows = [*((r[0], r[1]) for r in texts()), *ODD, *((i, f"some text number {i} <é>") for i in range(1000, 1100))]
    docs = spark.createDataFrame([(i, t, "f", "g") for i, t in rows], "doc_id bigint, text string, frames string, form string")
    want = [(i, *plain(i, t), t or "") for i, t in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = Counter(tuple(r) for r in fim.digests(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect())
    assert got == Counter((i, n, form, p, m, sha(out), sha(t)) for i, n, form, p, m, out, t in want)
    forms = fim.fill_in_middle(docs)
    assert Counter(map(tuple, fim.texts(forms).collect())) == Counter((w[0], w[5]) for w in want)
    assert Counter(map(tuple, fim.texts(forms, restored=True).collect())) == Counter((w[0], w[6]) for w in want)


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fim.digests(frame(spark)).count() == len(texts())


@pytest.mark.parametrize("size", [7, 64])
def test_small_frames(monkeypatch, size):
    monkeypatch.setattr(fim, "FRAME", size)
    packer, opener, rnd = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor(), random.Random(size)
    for doc_id in range(1500):
        text = "".join(rnd.choice(["a", "bc", "Z", " ", "\n", "é", "日", "🎉", "<", "P>", "<P", "S", ">"]) for _ in range(rnd.randrange(60)))
        if rnd.random() < 0.2:
            text += "<M>"
        writer, data = fim.Writer(packer), text.encode()
        for at in range(0, len(data), 5):
            writer.add(data[at : at + 5])
        reader = fim.Reader(writer.close(), opener)
        assert b"".join(reader.stream(0, reader.bytes)) == data and reader.chars == len(text)
        form, p, m, out, digest = fim.transform(reader, doc_id, packer, MARKS)
        n, *want, output = plain(doc_id, text)
        assert (reader.units, form, p, m, digest) == (n, *want, sha(output))
        assert b"".join(fim.restore(fim.Reader(out, opener), form, MARKS)) == data


def test_a_cut_opens_one_frame(monkeypatch):
    monkeypatch.setattr(fim, "FRAME", 100)
    writer = fim.Writer(zstandard.ZstdCompressor())
    writer.add(b"word and " * 1000)
    opened = []

    class Opener:
        def decompress(self, data):
            opened.append(data)
            return zstandard.ZstdDecompressor().decompress(data)

    reader = fim.Reader(writer.close(), Opener())
    assert len(reader.frames) >= 90 and reader.cut(1777) == ((1777 // 4) * 9 + 4, (1777 // 4) * 9 + 4) and len(opened) == 1
