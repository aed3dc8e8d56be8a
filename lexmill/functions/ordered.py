"""Ordered computations that never put a whole key into one task.

A key may own a third of all rows, so ``Window.partitionBy(key).orderBy(..)`` is
replaced by two levels: rows are cut by a *bucket* that follows the order (an hour
of a timestamp, a block of a running number), bucket totals are aggregated before the
shuffle, and a window over the few bucket rows carries the prefix from one bucket
to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_b") -> DataFrame:
    """The rows in ranges of (keys, order), numbered by ``name``: a bucket for running sums that no busy hour or key can fill.

    Ranges come from Spark's own sample of the sort keys, so a key with a third of the rows spreads over a third of the buckets. The
    table is written once, which fixes the numbers.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return materialise(ranged.withColumn(name, F.spark_partition_id()), "dealt")


def with_running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Add inclusive running sums per key in the given order.

    ``bucket`` must be monotone in ``order``. Key and bucket travel as one struct: it is
    never null (null keys form a key of their own), and the join and the window inside a
    bucket share its hash partitioning. The window across buckets sees one row per bucket.
    """
    keys = list(keys)
    rows = df.withColumn("_kb", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("b")))
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy("_kb").agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    across = (
        Window.partitionBy(*[F.col(f"_kb.k{i}") for i in range(len(keys))])
        .orderBy("_kb.b").rowsBetween(Window.unboundedPreceding, -1)
    )
    prefix = totals.select(
        "_kb", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_p_{n}") for n in sums]
    )
    inside = Window.partitionBy("_kb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(prefix, "_kb")
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_p_{name}") + F.sum(f"_v_{name}").over(inside))
    return joined.drop("_kb", *[f"_{x}_{name}" for name in sums for x in "vp"])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "pos"
) -> DataFrame:
    """Exact 1-based position of every row inside its key."""
    return with_running_sums(df, keys, order, bucket, {name: F.lit(1)})


def in_segments(
    df: DataFrame, pos: str = "pos", size: int = 4096, back: int = 0, ahead: int = 0
) -> DataFrame:
    """Cut each key into segments of ``size`` rows with context rows on both sides.

    Adds ``seg`` and ``ctx``. Windows over (key, seg) that look at most ``back`` rows
    behind and ``ahead`` rows in front are exact on the rows with ``ctx = false``; at
    most ``size + back + ahead`` rows meet in one group.
    """
    if back > size or ahead > size:
        raise ValueError("context must not exceed the segment size")
    zero = F.col(pos) - 1
    seg = F.floor(zero / F.lit(size)).cast("long")
    inside = zero % size
    homes = [F.struct(seg.alias("seg"), F.lit(False).alias("ctx"))]
    if back:
        homes.append(
            F.when(inside >= size - back, F.struct((seg + 1).alias("seg"), F.lit(True).alias("ctx")))
        )
    if ahead:
        homes.append(
            F.when(
                (inside < ahead) & (seg > 0),
                F.struct((seg - 1).alias("seg"), F.lit(True).alias("ctx")),
            )
        )
    return (
        df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
        .withColumn("seg", F.col("_home.seg"))
        .withColumn("ctx", F.col("_home.ctx"))
        .drop("_home")
    )


def block_of(col: str, size: int = 4096) -> Column:
    """A bucket for dense integer orders: turn numbers, token positions, line numbers."""
    return F.floor(F.col(col) / F.lit(size)).cast("long")


def hour_of(col: str, unit: str = "hour") -> Column:
    """A bucket for timestamps; a finer ``unit`` splits denser keys further."""
    return F.date_trunc(unit, F.col(col))


def rank_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Column],
    splits: int = 64,
) -> DataFrame:
    """Exact order statistics per key without sorting a key in one task.

    ``ranks`` maps an output name to a 1-based rank, a column over ``n`` (row count of
    the key). Equal values are merged into counts first; a mergeable quantile sketch gives
    ``splits`` cut points per key; bucket totals locate the bucket that holds each wanted
    rank, and only that bucket is ordered, in ranges that no hot key or bucket can fill.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull())
    hist = src.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = src.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(
            value, F.array(*[F.lit(i / splits) for i in range(1, splits)]), F.lit(splits * 20)
        ).alias("_cuts"),
    )
    if keys:
        cut = hist.join(cuts, keys)
    else:
        cut = hist.withColumn("n", cuts.select("n").scalar()).withColumn("_cuts", cuts.select("_cuts").scalar())
    cut = cut.withColumn(
        "_b", F.size(F.filter(F.col("_cuts"), lambda s: s < F.col(value)))
    ).drop("_cuts")
    totals = cut.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"), F.first("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("_hi", F.sum("_t").over(upto)).withColumn(
        "_lo", F.col("_hi") - F.col("_t")
    )
    wanted = totals.select(
        *keys,
        "_b",
        "n",
        "_lo",
        "_hi",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("q"), rank.cast("long").alias("r"))
                    for name, rank in ranks.items()
                ]
            )
        ).alias("_w"),
    ).select(*keys, "_b", "n", "_lo", "_hi", "_w.q", "_w.r")
    wanted = wanted.where((F.col("r") > F.col("_lo")) & (F.col("r") <= F.col("_hi")))
    rows = cut.select(*keys, "_b", F.col(value).alias("_val"), "_c").join(wanted, [*keys, "_b"])
    # a located bucket may still hold many values: it is ordered in ranges, so no task sorts it whole
    ranged = dealt(rows.drop("_b"), [*keys, "q"], ["_val"], "_range")
    rows = with_running_sums(ranged, [*keys, "q"], ["_val"], F.col("_range"), {"_inside": F.col("_c")})
    rows = rows.where(F.col("_lo") + F.col("_inside") >= F.col("r"))
    out = rows.groupBy(*keys, "q").agg(F.min("_val").alias("v"), F.first("n").alias("n"))
    return out.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("q") == name, F.col("v"))).alias(name) for name in ranks],
    )


def nearest_rank(q: float) -> Column:
    """Rank of the q-quantile as ``sorted[min(floor(n*q), n-1)]`` counts it, 1-based."""
    return F.least(F.floor(F.col("n") * F.lit(float(q))), F.col("n") - 1) + 1
