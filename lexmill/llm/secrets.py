"""Secret scans with multipart credential linking.

Three strong kinds of secret are found by pattern alone. A credential that is split into parts (an account name here, a
random-looking value there, the address next to it) is weak evidence part by part: ``login``, ``weak`` and
``endpoint`` candidates are reported only where at most ``reach`` code points lie between complementary parts in
one scope (a paragraph, ended by an empty line). Parts meet in an interval join: every part falls into the buckets it
covers, candidates also into those within reach, and parts in a bucket of the same row and scope are compared; parts do
not overlap within a kind, so a bucket holds at most ``reach`` of them. Texts are scanned once, where they lie; only
parts move.

* ``weak`` (a long value with lower case, upper case and digits, or an assigned value too short to count alone) needs
  an identifier: an access key or a login.
* ``login`` needs a secret: an assigned one or a weak candidate.
* ``endpoint`` needs both.

Defined cases: a null or empty text has no spans; null ids and repeated rows give one result row each; an empty table
gives an empty result; texts are scanned whole at any length; extra columns are ignored by :func:`scan` and kept by
:func:`redact`. Offsets are code points, ends exclusive. Base kinds may overlap each other; redaction merges overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import masked, unmasked, written

# The base patterns, in order of listing, with their least lengths.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "login", "weak", "endpoint")
BASE = 3  # so many of KINDS are base kinds

LOGIN = re.compile(r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""")
VALUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]+|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b")
EMPTY_LINE = re.compile(r"\n[ \t]*\n")
REACH = 200

SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("scope", T.LongType()),
]))


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and value.lower() != value and value.upper() != value


def _free(values: Iterable[tuple[int, int, int]], strong: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """The values that overlap no strong span; both come by start, and values do not overlap each other."""
    at, reached = 0, 0
    for s, k, e in values:
        while at < len(strong) and strong[at][0] < e:
            reached = max(reached, strong[at][1])
            at += 1
        if reached <= s:
            yield s, k, e


def find_parts(text: str | None) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, scope) of every strong secret and weak candidate of one text."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= 12:
                found.append((m.start(), 0, m.end()))
            elif size >= 6:
                found.append((m.start(), 4, m.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        found += [(m.start(), 3, m.end()) for m in LOGIN.finditer(text)]
    found += _free(((m.start(), 4, m.end()) for m in VALUE.finditer(text) if _mixed(m.group())), sorted((s, e) for s, k, e in found if k != 3))
    if "." in text or "://" in text:
        found += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if len(found) == 0:
        return []
    found.sort()
    out, scope, breaks = [], 0, [m.start() for m in EMPTY_LINE.finditer(text)]
    for s, k, e in found:
        while scope < len(breaks) and breaks[scope] < s:
            scope += 1
        out.append((s, k, e, scope))
    return out


@F.pandas_udf(SPANS)
def _parts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: [dict(zip(("start", "ord", "end", "scope"), (s, k, e, c))) for s, k, e, c in find_parts(x)])


def _confirmed(rows: DataFrame, reach: int) -> DataFrame:
    """The weak candidates that have their complementary parts in reach, as one list per row."""
    parts = rows.where(F.exists("parts", lambda p: p["ord"] >= BASE)).select("rid", F.explode("parts").alias("p")).select(
        "rid", "p.*", F.col("p.ord").isin(1, 3).alias("names"), F.col("p.ord").isin(0, 4).alias("secret"),
    )

    def buckets(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach)))

    near = parts.where("names or secret").select(
        "rid", "scope", buckets(F.col("start"), F.col("end")).alias("b"), F.col("start").alias("at"), F.col("end").alias("to"),
        F.col("names").alias("is_name"), F.col("secret").alias("is_secret"),
    )
    weak = parts.where(F.col("ord") >= BASE)
    weak = weak.withColumn("b", buckets(F.col("start") - reach, F.col("end") + reach))
    met = weak.join(near, ["rid", "scope", "b"]).where((F.col("at") - F.col("end") <= reach) & (F.col("start") - F.col("to") <= reach))
    met = met.groupBy("rid", "start", "ord", "end", "scope").agg(F.max("is_name").alias("name"), F.max("is_secret").alias("secret"))
    kept = met.where(
        ((F.col("ord") == 4) & F.col("name")) | ((F.col("ord") == 3) & F.col("secret")) | ((F.col("ord") == 5) & F.col("name") & F.col("secret"))
    )
    return kept.groupBy("rid").agg(F.collect_list(F.struct("start", "ord", "end", "scope")).alias("linked"))


def spans(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: the columns to keep, base spans and all spans, both ordered."""
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.monotonically_increasing_id().alias("rid"), _parts(F.col(text_col)).alias("parts"))
    rows = written(rows, "secret-parts")  # the row number is fixed with the parts
    out = rows.join(_confirmed(rows, reach), "rid", "left")
    base = F.filter("parts", lambda p: p["ord"] < BASE)
    everything = F.array_sort(F.concat(base, F.coalesce(F.col("linked"), F.array().cast(SPANS))))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], F.array_sort(base).alias("base"), everything.alias("spans"))


def rendered(spans_col: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans_col, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"]))
    return F.array_join(each, ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: counts per base kind, the digest of the base spans, and all spans."""
    found = spans(docs, text_col, (id_col,), reach)

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["ord"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(
        F.col(id_col).alias("doc_id"), *[number(k) for k in range(BASE)], F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, found: pd.Series) -> pd.Series:
    def one(text, places):
        if text is None or places is None or len(places) == 0:
            return text
        out, at = [], 0
        for start, order, end in sorted((p["start"], p["ord"], p["end"]) for p in places):
            if start >= at:
                out += [text[at:start], f"[{KINDS[order].upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    return pd.Series([one(t, p) for t, p in zip(texts, found)], dtype=object)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """The same table with every span of a secret replaced by its kind; all rows and columns stay."""
    rows, new = masked(docs)
    text = F.col(new[text_col])
    key = F.struct(F.col(new[id_col]).alias("id"), F.sha2(text, 256).alias("sha"))
    found = spans(rows.select(key.alias("key"), text.alias("text")), "text", ("key",), reach).where(F.size("spans") > 0)
    found = found.groupBy("key").agg(F.first("spans").alias("places"))  # equal rows have equal spans
    joined = rows.withColumn("key", key).join(found, "key", "left")
    return unmasked(joined.withColumn(new[text_col], F.when(F.col("places").isNull(), text).otherwise(_cut(text, F.col("places")))), new)
