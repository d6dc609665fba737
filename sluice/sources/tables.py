"""State tables as versioned snapshots, blobs by content, and the loader of the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """One version of a table in a folder of its own, written once."""
    at = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(at)
    return at


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the newest by default."""
    df = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == version).drop("version")


def append_changes(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


_OWN_DIR: list[str] = []


def working_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of our own only where it is unset (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="sluice-"))
    return _OWN_DIR[0]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the working folder that nothing has been written to."""
    return f"{working_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the working folder, read again: lineage and estimates of size start afresh, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_blobs(df: DataFrame, path: str) -> None:
    """sha256, data: each content once, whatever earlier calls wrote, in partitions by the first two digits of its hash."""
    new = df.dropDuplicates(["sha256"])
    if exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(path)
