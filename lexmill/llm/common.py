"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import posixpath
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import scratch

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: a word is a run without ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of the table has it (Spark's names ignore case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under column names of its own (``c0``, ``c1``, ...), and the new name of each old one: an operator's names clash with none."""
    new = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def unmasked(docs: DataFrame, new: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(c).alias(old) for old, c in new.items()])


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path that a shared-folder URI names, for tasks that write raw files."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")


class SharedFile:
    """A file that a task writes in pieces and names at the end.

    Each attempt writes under a name of its own and moves it into place when whole, so a lost executor leaves
    at most an unnamed leftover and a second attempt never mixes with the first.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path = posixpath.join(root, name)
        self.part = posixpath.join(root, f"_{name}.{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.part)
        self.at = 0

    def write(self, data: bytes) -> int:
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)
