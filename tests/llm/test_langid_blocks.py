"""Texts are looked up in small blocks without a change of any count."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lexmill.llm import langid


def model():
    words = [("en", "the thin thread of the weather "), ("fr", "le temps de la pluie et du vent ")]
    grams = [(i, langid.grams(langid.code_points(t), n)[1]) for i, (_, t) in enumerate(words) for n in langid.ORDERS]
    lang = np.concatenate([np.full(len(g), i) for i, g in grams])
    return langid.Model([x for x, _ in words], lang, np.concatenate([g for _, g in grams]).view(np.int64))


def test_blocks_keep_to_their_size():
    texts = ["a" * 1000, None, "", "bc " * 40]
    found = list(langid.blocks(texts, 2, 64))
    assert len(found) > 10 and all(len(p) < 2 * 64 and len(p) == len(o) for p, o in found)


def test_prediction_does_not_depend_on_the_block(monkeypatch):
    texts = ["The weather, the thread. " * 9, None, "12 34", "la pluie et le vent " * 7, "x", "The temps " * 30]
    want = model().predict(texts)
    monkeypatch.setattr(langid, "LOOKED_UP", 23)
    got = model().predict(texts)
    assert got[0] == want[0] == ["en", "und", "und", "fr", want[0][4], want[0][5]] and np.array_equal(got[1], want[1])


@pytest.mark.parametrize("pending", [1, 40, 1 << 20])
def test_counting_takes_bounded_blocks(monkeypatch, pending):
    monkeypatch.setattr(langid, "PENDING", pending)
    seen, plain = [], langid.grams
    monkeypatch.setattr(langid, "grams", lambda points, order: seen.append(len(points)) or plain(points, order))
    texts = ["the cat sat on the mat " * 30_000, "der hut", "the end", "", "12"]
    batch = pd.DataFrame({"text": texts, "lang": ["en", "de", "en", "de", "de"]})
    rows = pd.concat(langid._counts(["en", "de"])(iter([batch[:2], batch[2:]])))
    got = rows.groupby(["lang", "ord", "gram"]).n.sum().to_dict()
    assert max(seen) <= 1 << 19
    want = Counter()
    for lang, name in enumerate(["en", "de"]):
        for text in batch["text"][batch["lang"] == name]:
            for order in langid.ORDERS:
                want.update((lang, order, int(g)) for g in plain(langid.code_points(text), order)[1].view(np.int64))
    assert got == dict(want)
