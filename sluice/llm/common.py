"""What the corpus operators share: the shared working folder, written intermediate tables, word hashing, components."""

from __future__ import annotations

import functools
import gc
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
KEPT: dict = {}  # what a Python worker's tasks keep for later tasks of their kind


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="sluice-"))
    return _OWN_DIR[0]


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh, existing folder in the shared one."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return uri


def bound_batches(spark: SparkSession, size: int = 16 << 20, rows: int = 2_000) -> None:
    """Python tasks take rows in batches of at most this size; a setting that is smaller already stays."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", rows)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df in the shared folder and read it again: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    bound_batches(spark)
    uri = f"{new_dir(spark, label)}/data"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Hand freed memory back to the machine: a Python worker serves one stage after the other, and each starts with what the last one kept."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(task):
    """A task over batches that needs nothing of what is kept: it lets that go and hands freed memory back before it begins, and
    hands its own back once it has ended, so neither the next stage's task nor a worker that waits holds it."""

    @functools.wraps(task)
    def run(batches):
        if KEPT:
            KEPT.clear()
            gc.collect()
        give_back()
        yield from task(batches)
        give_back()

    return run


def write_bytes(uri: str, data: bytes) -> None:
    """Write one file whole: under a name of its own first, then moved, so a repeated or parallel attempt does no harm."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, path)


def open_bytes(uri: str):
    """An open file, to be read from its start."""
    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri)
    return fs.open_input_stream(path, compression=None)


def named_files(spark: SparkSession, uri: str, pattern: str, manifest: DataFrame | None = None) -> DataFrame:
    """path of the files under uri that the manifest's column `file` names, a file a task; of all that fit the pattern without one."""
    if manifest is None:
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(uri).select("path")
    files = manifest.select(F.concat(F.lit(f"{uri}/"), "file").alias("path"))
    return files.repartitionByRange(max(1, min(10_000, files.count())), "path")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class WordHash(dict):
    """word -> signed 64-bit hash, kept for the words seen so far; bounded, as it starts afresh when full."""

    def __init__(self, normal=None, most: int = 150_000):
        super().__init__()
        self.normal, self.most = normal, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        key = self.normal(word) if self.normal else word
        h = xxhash.xxh3_64_intdigest(key) if key else 0
        h -= (h >> 63) << 64
        self[word] = h
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps, each a grouping whose hot groups only hold distinct neighbours, and stops
    when a round changes no edge. Nodes without edges aren't returned.
    """
    e = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).filter("u <> v").distinct()
    e = materialize(e, "cc")
    while True:
        # large star: every neighbour greater than v goes to the least neighbour of v (itself included)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # small star: every neighbour at most v, and v, go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("v"), F.col("m").alias("u"))
            .filter("u <> v").select("u", "v").distinct()
        )
        new = materialize(small, "cc")
        same = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == new.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        e = new
        if same:
            break
    return e.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component").union(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    ).groupBy("node").agg(F.min("component").alias("component"))
