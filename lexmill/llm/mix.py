"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every document of a source gets the same certain number of whole copies; the rest of the source's target is filled
with a sample without replacement. A document's random number ``u`` gives random odds ``u / (1 - u)``; divided by its
inclusion odds they rank it, and the smallest ranks are taken until the sample has the wanted number of words. The
inclusion odds are the odds of the source's sampling fraction times a preference for longer documents,
``sqrt((1 + size) / (1 + mean size))``, so probabilities are unequal and always below one.

Row numbers, sizes and keys move, texts do not (but for :func:`mixed`, which joins them with their copies): sizes and ranks are summed
per source and rank bucket, the bucket that holds the cut is ordered alone, and the cut comes back as one row per source.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order; equal rows (id, text and
source) have random numbers of their own, null ids too, so a source made of them comes near its target like any other;
an empty table gives an empty result. Extra columns are kept by :func:`mixed` whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import masked, n_words, unmasked, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2  # times a document's size
BUCKETS = 65536
CHUNK = 8192  # neighbouring rows that are numbered at once


def uniform(key: Column) -> Column:
    """A number in (0, 1) with 52 random bits that depends on the key alone."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """Row number, source key, size, and a random number that also tells equal rows apart. Written, so that row numbers hold.

    Equal rows (of one id, text and source) are numbered in chunks of at most ``CHUNK`` rows, and chunks by a running sum over
    their counts: a row that stands a million times is spread over its chunks.
    """
    source = F.struct(F.col(source_col).isNull().alias("last"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_mx_row"), source.alias("_mx_source"), F.col(id_col).alias("_mx_id"), n_words(F.col(text_col)).alias("_mx_size"),
        F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text).alias("_mx_key"),
    )
    rows = written(rows, "mix-sizes").withColumn("_mx_chunk", F.floor(F.col("_mx_row") / CHUNK))
    equal = ["_mx_source", "_mx_key"]
    counts = rows.groupBy(*equal, "_mx_chunk").agg(F.count(F.lit(1)).alias("_mx_n"))
    upto = Window.partitionBy(*equal).orderBy("_mx_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*equal, "_mx_chunk", F.coalesce(F.sum("_mx_n").over(upto), F.lit(0)).alias("_mx_base"))
    inside = F.row_number().over(Window.partitionBy(*equal, "_mx_chunk").orderBy("_mx_row")) - 1
    rows = rows.withColumn("_mx_inside", inside).join(counts, [*equal, "_mx_chunk"])
    number = (F.col("_mx_base") + F.col("_mx_inside")).cast("string")
    return written(rows.select("_mx_row", "_mx_source", "_mx_id", "_mx_size", uniform(F.concat_ws("|", "_mx_key", number)).alias("_mx_u")), "mix-rows")


def targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: words, documents and target.

    Sources that their weight would carry above ``most`` times their words stop there; what they leave is shared by
    weight among the others. Filling all sources at a common level per weight says the same at once: in ascending
    order of capacity per weight, the first source that the level left by its predecessors does not fill sets it.
    """
    per = rows.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_total"), F.count(F.lit(1)).alias("_mx_docs"))
    place = F.row_number().over(Window.orderBy("_mx_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    per = per.withColumn("_mx_w", weight).withColumn("_mx_cap", F.col("_mx_total") * F.lit(float(most)))
    per = per.withColumn("_mx_r", F.col("_mx_cap") / F.col("_mx_w"))
    order = Window.orderBy("_mx_r", "_mx_source")
    before = F.coalesce(F.sum("_mx_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    others = F.sum("_mx_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_mx_level", (F.sum("_mx_total").over(everything) * F.lit(float(share)) - before) / others)
    fits = F.when(F.col("_mx_level") <= F.col("_mx_r"), F.struct("_mx_r", "_mx_source", "_mx_level"))
    per = per.withColumn("_mx_level", F.min(fits).over(everything)["_mx_level"])
    target = F.coalesce(F.least(F.col("_mx_cap"), F.col("_mx_level") * F.col("_mx_w")), F.col("_mx_cap"))
    return per.select("_mx_source", "_mx_total", "_mx_docs", target.alias("_mx_target"))


def _ranked(df: DataFrame) -> DataFrame:
    """Whole copies, words still wanted, and each row's rank and rank bucket."""
    ratio = F.when(F.col("_mx_total") > 0, F.col("_mx_target") / F.col("_mx_total")).otherwise(F.lit(0.0))
    df = df.withColumn("_mx_whole", F.floor(ratio)).withColumn("_mx_part", ratio - F.floor(ratio))
    df = df.withColumn("_mx_want", F.col("_mx_target") - F.col("_mx_whole") * F.col("_mx_total"))
    preference = F.sqrt((F.lit(1.0) + F.col("_mx_size")) / (F.lit(1.0) + F.col("_mx_total") / F.col("_mx_docs")))
    odds = F.col("_mx_part") / (F.lit(1.0) - F.col("_mx_part")) * preference
    rank = F.when(F.col("_mx_part") > 0, F.col("_mx_u") / (F.lit(1.0) - F.col("_mx_u")) / odds)
    df = df.withColumn("_mx_rank", rank)
    return df.withColumn("_mx_bucket", F.floor(F.col("_mx_rank") / (F.lit(1.0) + F.col("_mx_rank")) * BUCKETS))


def cuts(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Adds to each source the last (rank, row) that its sample takes; null where it takes none."""
    ranked = _ranked(rows.join(per, "_mx_source")).where(F.col("_mx_rank").isNotNull())
    hist = ranked.groupBy("_mx_source", "_mx_bucket").agg(F.sum("_mx_size").alias("_mx_sum"), F.first("_mx_want").alias("_mx_want"))
    upto = Window.partitionBy("_mx_source").orderBy("_mx_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_mx_before", F.sum("_mx_sum").over(upto) - F.col("_mx_sum"))
    straddle = (F.col("_mx_before") < F.col("_mx_want")) & (F.col("_mx_before") + F.col("_mx_sum") >= F.col("_mx_want"))
    cut = hist.where(straddle).select("_mx_source", "_mx_bucket", F.col("_mx_before").alias("_mx_base"))
    inside = ranked.join(cut, ["_mx_source", "_mx_bucket"])
    order = Window.partitionBy("_mx_source").orderBy("_mx_rank", "_mx_row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_mx_base") + F.coalesce(F.sum("_mx_size").over(order), F.lit(0))
    taken = inside.withColumn("_mx_before", before).where(F.col("_mx_before") + F.col("_mx_size") / 2 < F.col("_mx_want"))
    key = F.struct("_mx_rank", "_mx_row")
    last = taken.groupBy("_mx_source").agg(F.max(key).alias("_mx_last"))
    whole_buckets = cut.select("_mx_source", (F.col("_mx_bucket") - 1).alias("_mx_upto"))
    return per.join(last, "_mx_source", "left").join(whole_buckets, "_mx_source", "left")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    df = _ranked(rows.join(plan, "_mx_source"))
    key = F.struct("_mx_rank", "_mx_row")
    extra = (F.col("_mx_bucket") <= F.col("_mx_upto")) | (key <= F.col("_mx_last"))
    return df.withColumn("_mx_copies", F.col("_mx_whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0))


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float,
           row_col: str | None = None) -> DataFrame:
    rows = sized(docs, id_col, text_col, source_col, row_col)
    per = written(targets(rows, weights, share, most), "mix-targets")
    return _with_copies(rows, written(cuts(rows, per), "mix-cuts"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: its size, its source's words and target, and how many of its words the mix takes."""
    out = _taken(docs, id_col, text_col, source_col, weights, share, most)
    return out.select(
        F.col("_mx_id").alias("doc_id"), F.col("_mx_size").alias("size"), F.col("_mx_total").alias("source_size"),
        F.col("_mx_target").alias("target"), (F.col("_mx_size") * F.col("_mx_copies")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixed table itself: each row of ``docs`` as often as the mix takes it, all columns kept."""
    rows, new = masked(docs)
    rows = written(rows.withColumn("_mx_row", F.monotonically_increasing_id()), "mix-docs")
    out = _taken(rows, new[id_col], new[text_col], new[source_col], weights, share, most, "_mx_row")
    copies = out.where("_mx_copies > 0").select("_mx_row", F.col("_mx_copies").cast("int").alias("_mx_copies"))
    taken = rows.join(copies, "_mx_row").withColumn("_mx_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mx_copies"))))
    return unmasked(taken, new)
