"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DEFAULT: dict[str, str] = {}


def get_spark(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here expects."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A session in one process (unit tests) may name none and gets a local folder; on a cluster that is an error, since
    executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL_DEFAULT:
        _LOCAL_DEFAULT["dir"] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _LOCAL_DEFAULT["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def version(df: DataFrame) -> tuple | None:
    """What a table read from files is, as a key: application, plan, and the names, sizes and times of its files; None without files."""
    spark, named = df.sparkSession, df.inputFiles()
    if not named:  # nothing tells when it changes
        return None
    files = spark.read.parquet(*named).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)"))).first()
    return (spark.sparkContext.applicationId, df.semanticHash(), *stamp)


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a table has fewer input splits than there are cores.

    A large table has many splits and passes through untouched; a small one (a single
    parquet row group of long texts) would otherwise keep its token work in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
