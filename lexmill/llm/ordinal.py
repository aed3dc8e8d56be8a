"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A document's rating is a grade: 0 toxic, 1 clean but of low quality, 2 clean and good. One weighted sum ``s`` of hashed text features and
ordered thresholds ``t0 <= t1`` give ``P(grade <= j) = 1 / (1 + exp(s - tj))``: all grades share the weights, and the thresholds cut the
same scale. The expected grade and the tail probability ``P(grade >= g)`` follow; selection keeps documents by the tail.

Features are present or not: each token as it stands, its letters in lower case, their first four and six, and its
shape, hashed into ``2^20`` places. Learning takes a bounded sample, the ``SAMPLE`` labelled rows that come first in the order
of a hash of their id. In the sample, a feature counts if its frequency in some tail of the grades is at least
``CUT`` standard deviations off, which random words never are; at most ``FEATURES`` are kept. Counting runs as a Spark job; the fit
is over the sample's few kept features.

Defined cases: a null or empty text has no features and gets the grade of the thresholds alone; labels without an id, a document or both
ratings are not learned from; documents rated more than once count as often; without any labelled row all scores are null and every document
is kept; null ids and repeated rows give a row each; an empty table gives an empty result; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import written

SAMPLE = 20_000
FEATURES = 8_192
CUT = 8.0
LEAST = 5  # documents of the sample that have a feature
PLACES = 1 << 20
GRADES = 3
STEPS, RATE, DECAY = 80, 0.3, 1e-4
REMEMBERED = 300_000

_OTHER, _LETTERS = re.compile(r"[\W_]+"), re.compile(r"[^\W\d_]+")


def features_of(token: str) -> tuple[int, ...]:
    bare = _OTHER.sub("", token.lower())
    shape = _LETTERS.sub("A" if token.isupper() else "a", token)
    names = {f"t{token}", f"w{bare}", f"p{bare[:4]}", f"q{bare[:6]}", f"s{shape[:24]}"}
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) % PLACES for n in names)


class Features:
    """Distinct features of texts; tokens seen before come from a bounded store. ``chosen`` maps the places that count to numbers."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen, self.known = chosen, {}

    def token(self, token: str) -> tuple[int, ...]:
        got = features_of(token)
        if self.chosen is not None:
            got = tuple(self.chosen[f] for f in got if f in self.chosen)
        if len(self.known) >= REMEMBERED:
            self.known = {}
        self.known[token] = got
        return got

    def text(self, text: str | None) -> list[int]:
        found: set[int] = set()
        for token in set((text or "").split()):
            got = self.known.get(token)
            if got is None:
                got = self.token(token)
            if got:
                found.update(got)
        return sorted(found)


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, chosen: dict[int, int], weights: np.ndarray, thresholds: np.ndarray):
        self.chosen, self.weights, self.thresholds = chosen, weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), a row per score."""
        return _logistic(scores[:, None] - self.thresholds[None, :])


def fit(rows: list[np.ndarray], grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of the grades, with weight decay, by scaled gradient steps.

    A grade's likelihood is the difference of two neighbouring cumulative probabilities; grades weigh by the root of
    their rarity, so that the largest one does not decide alone.
    """
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    feature = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    share = np.bincount(grades, minlength=GRADES) / n
    each = 1 / np.sqrt(np.maximum(share, 1 / n))[grades]
    each /= each.mean()
    w, t = np.zeros(n_features), np.linspace(-1, 1, GRADES - 1)
    sum_w, sum_t = np.full(n_features, 1e-8), np.full(GRADES - 1, 1e-8)
    below = np.arange(GRADES - 1)[None, :]
    upper, lower = (below == grades[:, None]), (below == grades[:, None] - 1)  # thresholds above and below the grade
    for _ in range(STEPS):
        s = np.bincount(owner, w[feature], n)
        cum = _logistic(t[None, :] - s[:, None])
        slope = cum * (1 - cum)
        top = np.where(upper.any(1), (cum * upper).sum(1), 1.0)
        p = np.maximum(top - (cum * lower).sum(1), 1e-9)
        pull = slope * (upper.astype(float) - lower) / p[:, None] * each[:, None]  # of log p by each threshold
        g_w = np.bincount(feature, pull.sum(1)[owner], n_features) / n + DECAY * w
        g_t = -pull.sum(0) / n
        sum_w += g_w**2
        sum_t += g_t**2
        w -= RATE * g_w / np.sqrt(sum_w)
        t = np.sort(t - RATE * g_t / np.sqrt(sum_t))
    return w, t


def grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from the two ratings: toxic documents lie lowest, then those of low quality."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("id"), grade.alias("grade"))


def learn(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Learn from documents and their grades (``id``, ``grade``); None if there are none."""
    first = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(first), "id")
    rows = written(rows.select("grade", "text"), "ordinal-sample")
    tails = [F.count_if(F.col("grade") <= j) for j in range(GRADES - 1)]
    n, *below = rows.select(F.count(F.lit(1)), *tails).first()
    if not n:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Features()
        for batch in batches:
            total = np.zeros((GRADES, PLACES), np.int32)
            for grade, text in zip(batch["grade"], batch["text"]):
                total[grade, find.text(text)] += 1
            at = np.flatnonzero(total.any(0))
            yield pd.DataFrame({"place": at, **{f"n{g}": total[g, at] for g in range(GRADES)}})

    counts = rows.mapInPandas(count, "place int, " + ", ".join(f"n{g} int" for g in range(GRADES)))
    counts = counts.groupBy("place").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(GRADES)])
    having = sum((F.col(f"n{g}") for g in range(GRADES)), F.lit(0))
    off = []
    for j in range(GRADES - 1):
        p = below[j] / n
        seen = sum((F.col(f"n{g}") for g in range(j + 1)), F.lit(0))
        off.append(F.abs(seen - having * p) / F.sqrt(having * max(p * (1 - p), 1e-9)))
    kept = counts.withColumn("off", F.greatest(*off)).where((having >= LEAST) & (F.col("off") >= CUT))
    places = [r["place"] for r in kept.orderBy(F.desc("off"), "place").limit(FEATURES).collect()]
    chosen = {p: i for i, p in enumerate(places)}

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Features(chosen)
        for batch in batches:
            yield pd.DataFrame({"grade": batch["grade"], "found": [find.text(t) for t in batch["text"]]})

    got = rows.mapInPandas(pick, "grade int, found array<int>").toPandas()  # the bounded sample
    got = got.assign(key=got["found"].map(bytes_of)).sort_values(["grade", "key"])  # the same sum in every run
    w, t = fit([np.array(f, np.int64) for f in got["found"]], got["grade"].to_numpy(np.int64), len(chosen))
    return Model(chosen, w, t)


def bytes_of(found) -> bytes:
    return np.asarray(found, "<i4").tobytes()


SCORES = T.StructType([T.StructField("p1", T.DoubleType()), T.StructField("p2", T.DoubleType())])


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: int = 2, least: float = 0.3,
         learn_from=None, sample: int = SAMPLE) -> DataFrame:
    """One row per document: expected grade, tail probabilities, and whether ``P(grade >= tail)`` reaches ``least``.

    ``learn_from`` is a condition on the documents to learn from.
    """
    model = learn(docs if learn_from is None else docs.where(learn_from), grades(labels), id_col, text_col, sample)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select(F.col(id_col).alias("doc_id"), *[nothing.alias(c) for c in ("expected_grade", "p_clean", "p_good")], F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORES)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        find = Features(m.chosen)
        for texts in batches:
            s = np.array([m.weights[find.text(t)].sum() for t in texts])
            yield pd.DataFrame(m.tails(s), columns=["p1", "p2"])

    out = docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("_s"))
    return out.select(
        "doc_id", (F.col("_s.p1") + F.col("_s.p2")).alias("expected_grade"), F.col("_s.p1").alias("p_clean"), F.col("_s.p2").alias("p_good"),
        (F.col(f"_s.p{tail}") >= least).alias("keep"),
    )
