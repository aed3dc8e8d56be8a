"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning counts n-grams per language over all learning documents. An n-gram belongs to a language if its share there
reaches ``min_rate`` (so no language has more than ``1 / min_rate`` of an order) and a tenth of its largest share in any
language. All languages share one filter: a slot holds one bit per language, a member sets its language's bit in
``HASHES`` slots, and the bits common to an n-gram's slots name every language that contains it, in one look. Of a text,
the n-grams found are counted per language; a share ``f`` of absent n-grams shows up by chance, so of ``n``
n-grams ``(found - n f) / (1 - f)`` are counted; the language with most wins, ties going to the more frequent one.

Only sums of counts are shuffled. The filter is built from at most ``languages x orders / min_rate`` n-grams and has a
fixed size, which is what the tasks get.

Defined cases: texts that are null or have no letter are ``und`` with score 0, as is every text if nothing could be
learned; texts are counted whole at any length, in blocks; null ids count as learning rows; null languages are not
learned from; repeated rows count repeatedly; extra columns are ignored by :func:`identify` and kept by :func:`known`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import masked, unmasked, written

ORDERS = (2, 3, 4)
MIN_RATE = 2e-5
TENTH = 0.1
SLOTS = 1 << 21
HASHES = 2
BLOCK = 1 << 18  # code points counted at once: every one takes up to a hundred bytes meanwhile
LOOKED_UP = 1 << 17  # code points looked up at once: every one takes some hundred bytes meanwhile
PENDING = 1 << 20  # distinct n-grams a task gathers before it hands them on
UND = "und"

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(text: str) -> np.ndarray:
    """Lower-case code points between two blanks, everything but letters a blank."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[points], points, np.uint32(32))


def grams(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the n-grams of one order; those with a blank inside or two at the rims are left out."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    blank = points == 32
    keep = ~(blank[:n] & blank[order - 1 : order - 1 + n]) if order == 2 else np.ones(n, bool)
    for i in range(1, order - 1):
        keep &= ~blank[i : i + n]
    at = np.flatnonzero(keep)
    h = np.full(len(at), order, np.uint64)
    for i in range(order):
        h = (h ^ points[at + i]) * _ODD[i]
        h ^= h >> np.uint64(31)
    return at, h


def blocks(texts: list[str | None], overlap: int, size_of_block: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of many texts in blocks, with the number of the text that each belongs to.

    Texts are set apart by the blanks around them. A long text continues in the next block with ``overlap``
    code points repeated, so every n-gram of a higher order lies in a block; ``grams`` of lower orders would count
    the repeated ones twice, which is why callers pass the order minus one.
    """
    most = size_of_block or BLOCK
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        points = code_points(text)
        at = 0
        while True:
            piece = points[at : at + most]
            held.append(piece)
            owner.append(np.full(len(piece), i, np.int64))
            size += len(piece)
            if size >= most:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, size = [], [], 0
            if at + most >= len(points):
                break
            at += most - overlap
    if held:
        yield np.concatenate(held), np.concatenate(owner)


def _within(at: np.ndarray, owner: np.ndarray, order: int) -> np.ndarray:
    return owner[at] == owner[at + order - 1]


def _counts(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def added() -> int:
            for key, parts in held.items():
                if len(parts) > 1:
                    h, c = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(h)
                    h = h[order]
                    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
                    held[key] = [(h[first], np.add.reduceat(c[order], first))]
            return sum(len(parts[0][0]) for parts in held.values())

        def out():
            for (lang, order), [(h, c)] in held.items():
                yield pd.DataFrame({"lang": np.int32(lang), "ord": np.int32(order), "gram": h.view(np.int64), "n": c})

        for batch in batches:
            langs = batch["lang"].map(index).to_numpy()
            for lang in np.unique(langs):
                texts = batch["text"][langs == lang].tolist()
                for order in ORDERS:
                    for points, owner in blocks(texts, order - 1):
                        at, h = grams(points, order)
                        h, c = np.unique(h[_within(at, owner, order)], return_counts=True)
                        if len(h):
                            held.setdefault((lang, order), []).append((h, c))
                            size += len(h)
                        if size > PENDING:  # added up first, handed on if they are that many different ones
                            size = added()
                            if size > PENDING // 2:
                                yield from out()
                                held, size = {}, 0
        added()
        yield from out()

    return run


class Model:
    """The shared filter and what corrects its counts."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray):
        self.languages = languages
        words = max(1, -(-len(languages) // 64))
        self.table = np.zeros((SLOTS, words), np.uint64)
        gram = gram.view(np.uint64)
        for slot in self.slots(gram):
            np.bitwise_or.at(self.table, (slot, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        fill = [np.count_nonzero(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS for i in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    @staticmethod
    def slots(gram: np.ndarray) -> list[np.ndarray]:
        return [((gram * _ODD[i]) >> np.uint64(64 - 21)).astype(np.int64) & (SLOTS - 1) for i in range(HASHES)]

    def containing(self, gram: np.ndarray) -> np.ndarray:
        """For each n-gram, the bits of all languages that contain it."""
        first, *others = self.slots(gram)
        bits = self.table[first]
        for slot in others:
            bits &= self.table[slot]
        return bits

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        found, total, letters = np.zeros((k, n)), np.zeros(n), np.zeros(n)
        for order in ORDERS:
            for points, owner in blocks(texts, order - 1, LOOKED_UP):
                at, h = grams(points, order)
                inside = _within(at, owner, order)
                at, h = at[inside], h[inside]
                if order == ORDERS[0]:
                    letters += np.bincount(owner, points != 32, minlength=n)
                own, bits = owner[at], self.containing(h)
                total += np.bincount(own, minlength=n)
                for i in range(k):
                    found[i] += np.bincount(own, bits[:, i // 64] >> np.uint64(i % 64) & np.uint64(1), minlength=n)
        if not k:
            return [UND] * n, np.zeros(n)
        real = (found - total * self.false[:, None]) / (1 - self.false[:, None])
        best = real.argmax(0)
        score = np.clip(real[best, np.arange(n)] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if x else UND for b, x in zip(best, letters)], np.where(letters > 0, score, 0.0)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_rate: float = MIN_RATE) -> Model:
    """Learn from the rows of ``docs`` that have a text and a language."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    per = rows.groupBy("lang").count().collect()  # one row per language
    languages = [r["lang"] for r in sorted(per, key=lambda r: (-r["count"], r["lang"]))]
    counts = rows.mapInPandas(_counts(languages), "lang int, ord int, gram bigint, n bigint")
    counts = written(counts.groupBy("ord", "gram", "lang").agg(F.sum("n").alias("n")), "langid-counts")
    counts = counts.join(F.broadcast(counts.groupBy("lang", "ord").agg(F.sum("n").alias("all"))), ["lang", "ord"])
    shares = counts.withColumn("rate", F.col("n") / F.col("all")).where(F.col("rate") >= min_rate)
    most = shares.groupBy("ord", "gram").agg(F.collect_list(F.struct("lang", "rate")).alias("in"), F.max("rate").alias("most"))
    kept = most.select("gram", F.explode("in").alias("x"), "most").where(F.col("x.rate") >= TENTH * F.col("most"))
    got = kept.select(F.col("x.lang").alias("lang"), "gram").toPandas()
    return Model(languages, got["lang"].to_numpy(np.int64), got["gram"].to_numpy(np.int64))


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(spark: SparkSession, model: Model):
    """A column function: text to (lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = shared.value.predict(texts.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})

    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language and score of each document, learned from those that are not held out."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    guess = predictor(docs.sparkSession, model)(F.col(text_col)).alias("_g")
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), guess)
    return out.select("doc_id", "held_out", F.col("_g.lang").alias("lang_pred"), F.col("_g.score").alias("score"))


def known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3) -> DataFrame:
    """The rows whose text is in a learned language: at least ``min_score`` of its n-grams belong to it."""
    model = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    rows, new = masked(docs)
    guess = predictor(docs.sparkSession, model)(F.col(new[text_col]))
    return unmasked(rows.withColumn("guess", guess).where((F.col("guess.lang") != UND) & (F.col("guess.score") >= min_score)), new)
