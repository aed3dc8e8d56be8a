"""Sorted tables with a page directory: page reads, filtered scans with a limit, and key lookups that open few files.

The table lies in files that are ranges of the key, each sorted by it and cut into pages of ``page_rows`` rows; file and page are columns, the
file is a folder. The directory has a row per page: file, page, least and greatest key, rows. A reader
picks files and pages in the directory first; Spark then prunes folders by file and row groups by page and key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_ROWS = 256
PLACE = ("_file", "_page")


def write_pages(df: DataFrame, key: str, path: str, page_rows: int = PAGE_ROWS, files: int | None = None) -> None:
    """Lay the table out by ``key``. Rows of one key share a file; null keys come first and belong to the first page."""
    first = F.col(key).asc_nulls_first()
    dealt = df.repartitionByRange(files, first) if files else df.repartitionByRange(first)
    dealt = dealt.withColumn("_file", F.spark_partition_id()).sortWithinPartitions("_file", first)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its sorted file
    dealt.withColumn("_page", F.floor(at / page_rows).cast("int")).write.partitionBy("_file").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    pages = rows.groupBy(*PLACE).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n"))
    pages.repartitionByRange("_file").sortWithinPartitions("_file", "_page").write.parquet(f"{path}/pages")


class Paged:
    """A laid-out table."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.key = key
        self.rows = spark.read.parquet(f"{path}/rows")
        self.pages = spark.read.parquet(f"{path}/pages")
        self.page_rows = self.pages.agg(F.max("n")).first()[0] or 1
        self.columns = [c for c in self.rows.columns if c not in PLACE]

    def files(self) -> list[tuple[int, Any, Any, int]]:
        """(file, least key, greatest key, rows) in order: one entry per file, as a table format's manifest has."""
        per = self.pages.groupBy("_file").agg(F.min("first").alias("a"), F.max("last").alias("b"), F.sum("n").alias("n"))
        return sorted((tuple(r) for r in per.collect()), key=lambda r: r[0])

    def _ahead(self, after: Any, n: int) -> list:
        """The next ``n`` pages that reach beyond ``after``."""
        d = self.pages if after is None else self.pages.where(F.col("last") > F.lit(after))
        return d.orderBy(*PLACE).limit(n).collect()

    def page(self, after: Any = None, limit: int = PAGE_ROWS, where: Column | None = None) -> DataFrame:
        """The first ``limit`` rows with a key beyond ``after`` that pass the filter, by key.

        Opens as many pages as the limit needs, and four times as many, and so on, while the filter leaves too few rows.
        """
        n = limit // self.page_rows + 2
        while True:
            pages = self._ahead(after, n)
            part = self._within(pages, after)
            if where is not None:
                part = part.where(where)
            if len(pages) < n or part.select(self.key).limit(limit).count() >= limit:
                return part.orderBy(self.key).limit(limit).select(*self.columns)
            n *= 4

    def _within(self, pages: list, after: Any) -> DataFrame:
        out = self.rows.where(F.col("_file").isin(sorted({p["_file"] for p in pages})) if pages else F.lit(False))
        if pages:
            ends = (F.lit(pages[-1]["_file"]), F.lit(pages[-1]["_page"]))
            out = out.where((F.col("_file") < ends[0]) | ((F.col("_file") == ends[0]) & (F.col("_page") <= ends[1])))
            if pages[-1]["last"] is not None:  # lets row groups be skipped by their statistics
                out = out.where((F.col(self.key) <= F.lit(pages[-1]["last"])) | F.col(self.key).isNull())
        return out if after is None else out.where(F.col(self.key) > F.lit(after))

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows with one of the keys; only files whose range holds a key are opened."""
        wanted, hit = sorted(set(keys)), []
        for file, a, b, _ in self.files():
            i = bisect_left(wanted, a) if a is not None else len(wanted)
            if i < len(wanted) and wanted[i] <= b:
                hit.append(file)
        return self.rows.where(F.col("_file").isin(hit) if hit else F.lit(False)).where(F.col(self.key).isin(wanted)).select(*self.columns)

    def bounds(self, where: Column, limit: int = PAGE_ROWS) -> DataFrame:
        """(page, first_id, last_id, n): the pages that paging through all rows under the filter gives.

        Rows are counted per stored page, positions run on from file to file and inside a file from page to page; a stored page is
        ordered by itself.
        """
        passing = self.rows.where(where).select(self.key, *PLACE)
        per_page = passing.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
        per_file = sorted((r["_file"], r["n"]) for r in per_page.groupBy("_file").agg(F.sum("n").alias("n")).collect())  # one entry per file
        if not per_file:
            return passing.select(F.lit(0).cast("bigint").alias("page"), F.col(self.key).alias("first_id"), F.col(self.key).alias("last_id"), F.lit(0).cast("bigint").alias("n"))
        starts, total = [], 0
        for file, n in per_file:
            starts.append((file, total))
            total += n
        spark = passing.sparkSession
        base = spark.createDataFrame(starts, "_file int, base bigint")
        per_page = per_page.join(base, "_file").withColumn("before", F.col("base") + F.sum("n").over(_upto(["_file"], "_page")) - F.col("n")).select(*PLACE, "before")
        at = passing.join(per_page, list(PLACE)).withColumn("pos", F.col("before") + F.count(F.lit(1)).over(_upto(PLACE, self.key)) - 1)
        return at.groupBy(F.floor(F.col("pos") / limit).alias("page")).agg(
            F.min(self.key).alias("first_id"), F.max(self.key).alias("last_id"), F.count(F.lit(1)).alias("n"))


def _upto(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
