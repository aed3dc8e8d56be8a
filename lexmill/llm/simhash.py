"""SimHash fingerprints of documents and search within a Hamming radius, in DataFrame operations only.

Terms of a text are its distinct words, word pairs and runs of five words, in lower case, weighing 1, 2 and 4: long
runs decide, words speak where a text is too short for runs. A term's 64-bit hash votes with its weight for or against
each bit; bits with more votes for than against make up the fingerprint. For two texts with fingerprints ``h`` bits apart,
``cos(pi h / 64)`` estimates the cosine of their term vectors; clipped at 0 it is the likeness.

Votes are summed per text before anything is shuffled. The order of ids that "next document" needs comes from cells of
neighbouring ids, each a window of its own; only a cell's last document looks up the next cell's first.

:func:`within` cuts fingerprints into six blocks. Two fingerprints at most three bits apart agree on at least three whole blocks, so
twenty tables, one for each choice of three blocks, each keyed by these blocks put first, find every such pair in an
equi-join; each pair is checked and reported once.

Defined cases: a null text is an empty one; texts without words have fingerprint 0; null ids come first in order; rows of
one id follow each other in the order of their texts; a single document is its own next; an empty table
gives an empty result; texts count whole at any length; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import once
from lexmill.llm.common import written

BITS = 64
WIDTHS = {1: 1, 2: 2, 5: 4}  # words of a term: its weight
CELL = 2_000  # ids of a cell, if they are dense
BLOCKS = (11, 11, 11, 11, 10, 10)
RADIUS = 3


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def terms(hashed: Column) -> Column:
    """Distinct terms as (hash, weight), from the hashes of a text's words. ``hashed`` is read once per word: it must be a column."""

    def runs(width: int) -> Column:
        if width == 1:
            return hashed
        n = F.size(hashed) - (width - 1)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.element_at(hashed, i + j) for j in range(width)]))

    def weighed(width: int) -> Column:
        return F.transform(F.array_distinct(runs(width)), lambda h: F.struct(h.alias("h"), F.lit(WIDTHS[width]).alias("w")))

    nothing = F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("w")))  # keeps texts without words
    return F.concat(*[weighed(width) for width in WIDTHS], nothing)


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per key with terms: its fingerprint. Keys must tell rows apart."""
    rows = once(rows, keys, _words=word_hashes(F.col(text_col)))
    votes = rows.select(*keys, F.explode(terms(F.col("_words"))).alias("_t")).select(*keys, F.col("_t.h").alias("_h"), F.col("_t.w").alias("_w"))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(1)) * F.col("_w")).alias(f"_b{k}") for k in range(BITS)]
    per = votes.groupBy(*keys).agg(F.sum("_w").alias("_all"), *sums)
    bits = [F.when(F.col(f"_b{k}") * 2 > F.col("_all"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(BITS)]
    return per.select(*keys, reduce(Column.bitwiseOR, bits).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.bit_count(a.bitwiseXOR(b)) * (math.pi / BITS)))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row number, id, text, and the number and text of the next row in ascending order of ids, the first after the last."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low, high, n = docs.select(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long")), F.count(F.lit(1))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // CELL))))
    rows = rows.withColumn("cell", F.coalesce(F.floor((F.col("doc_id") - F.lit(low or 0)) / F.lit(width)), F.lit(-1)))
    order = Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_first(), "text", "rid")
    rows = rows.withColumn("after", F.lead(F.struct("rid", "text")).over(order))
    firsts = _first_of_next_cell(rows)
    return rows.join(firsts, "cell", "left").select(
        "rid", "doc_id", "text", F.coalesce(F.col("after.rid"), F.col("f_rid")).alias("next_rid"), F.coalesce(F.col("after.text"), F.col("f_text")).alias("next_text"),
    )


def _first_of_next_cell(rows: DataFrame) -> DataFrame:
    """For each cell, row number and text of the first row of the next cell that has rows, the first cell after the last.

    Cells follow each other within groups of 4096, and groups follow each other: two levels of small windows.
    """
    first = rows.groupBy("cell").agg(F.min(F.struct("doc_id", "text", "rid")).alias("f"))
    first = written(first.select("cell", F.floor(F.col("cell") / 4096).alias("super"), F.col("f.rid").alias("f_rid"), F.col("f.text").alias("f_text")), "simhash-cells")
    ids = first.select("cell", "super")
    inner = ids.withColumn("next", F.lead("cell").over(Window.partitionBy("super").orderBy("cell")))
    outer = ids.groupBy("super").agg(F.min("cell").alias("least"))
    whole = Window.orderBy("super")
    start = F.first("least").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    outer = outer.select("super", F.coalesce(F.lead("least").over(whole), start).alias("beyond"))
    nexts = inner.join(outer, "super").select("cell", F.coalesce("next", "beyond").alias("next"))
    return nexts.join(first.select(F.col("cell").alias("next"), "f_rid", "f_text"), "next").select("cell", "f_rid", "f_text")


def within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (query ``qfp``, ``fp``) of distinct fingerprints at most ``radius`` (up to 3) bits apart, with ``bits``."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the block tables hold for a radius up to {RADIUS}")
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]

    def tables(df: DataFrame, col: str) -> DataFrame:
        keys = []
        for t, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)):
            mask = sum(((1 << BLOCKS[i]) - 1) << starts[i] for i in chosen)
            mask = mask - (1 << 64) if mask >= 1 << 63 else mask
            keys.append(F.struct(F.lit(t).alias("t"), F.col(col).bitwiseAND(F.lit(mask).cast("long")).alias("k")))
        return df.select(col, F.explode(F.array(*keys)).alias("_e")).select(col, "_e.t", "_e.k")

    left = tables(queries.select("qfp").distinct(), "qfp")
    right = tables(fps.select("fp").distinct(), "fp")
    pairs = left.join(right, ["t", "k"]).withColumn("bits", F.bit_count(F.col("qfp").bitwiseXOR(F.col("fp"))))
    return pairs.where(F.col("bits") <= radius).select("qfp", "fp", "bits").distinct()


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last quarter of the code points replaced by the first as many of the next document. For ids
    divisible by 100, ``edited_found`` is the number of different fingerprints of documents within ``RADIUS`` bits
    of the edited text's; else null.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    versions = F.array(
        F.struct(F.lit(False).alias("edit"), F.col("text").alias("t"), F.lit(None).cast("string").alias("sha")),
        F.struct(F.lit(True).alias("edit"), edited.alias("t"), F.sha2(edited, 256).alias("sha")),
    )
    known = ["rid", "next_rid", "doc_id", "n_chars", "edit", "sha"]
    both = rows.select("rid", "next_rid", "doc_id", n.cast("long").alias("n_chars"), F.explode(versions).alias("v"))
    both = both.select("rid", "next_rid", "doc_id", "n_chars", "v.edit", "v.sha", "v.t")
    fps = written(fingerprints(both, known, "t"), "simhash-fingerprints")
    own = fps.where("not edit").drop("edit", "sha")
    of_edit = fps.where("edit").select("rid", F.col("sha").alias("edited_sha256"), F.col("fp").alias("qfp"))
    of_next = own.select(F.col("rid").alias("next_rid"), F.col("fp").alias("next_fp"))
    asked = of_edit.join(own.where(F.col("doc_id") % 100 == 0).select("rid"), "rid").select("qfp")
    found = within(own, asked).groupBy("qfp").agg(F.count(F.lit(1)).alias("found"))
    out = own.join(of_edit, "rid").join(of_next, "next_rid").join(found, "qfp", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("qfp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("qfp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.coalesce("found", F.lit(0))).alias("edited_found"),
    )
