"""Keyed tables in plain folders: upserts copy the touched buckets, and one manifest makes several tables' changes visible at once.

    store/manifests/000000007.json     which folder holds each bucket of each table, and the last epoch of each writer
    store/data/<table>-<id>/bucket=12  rows whose key hashes to bucket 12

A write reads and rewrites only the buckets that its keys fall into, and then renames its manifest to the next version, which fails
if another writer has it already. Readers take the newest manifest, so a write that was stopped, or lost, is never seen, and older
versions stay readable. A write with an epoch (writer, number) that the store has seen changes nothing; `sink` makes the epochs of a
stream's micro-batches. Folders that no manifest names are left behind by lost writes; `unused` lists them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Rows(NamedTuple):
    """Changes of one table: rows with distinct keys, or the newest of each key by `order`; insert: rows that are there stay."""

    data: DataFrame
    key: list[str]
    order: str | None = None
    insert: bool = False


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    _, fs, p = _fs(spark, f"{path}/manifests")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = versions(spark, path)
    if version is None and not known:
        return {"version": 0, "epochs": {}, "tables": {}}
    at = known[-1] if version is None else version
    _, fs, p = _fs(spark, f"{path}/manifests/{at:09d}.json")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, m: dict) -> None:
    jvm, fs, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{uuid.uuid4().hex}.tmp")
    out = fs.create(part)
    try:
        out.write(bytearray(json.dumps(m).encode()))
    finally:
        out.close()
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{m['version']:09d}.json")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(part, to, spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(part, False)
        if "exist" in str(e).lower():
            raise Conflict(f"version {m['version']} of {path} is there already") from e
        raise


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, table: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    folders = [f"{path}/data/{table['folders'][b]}/bucket={b}" for b in buckets if b in table["folders"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the newest by default."""
    table = manifest(spark, path, version)["tables"][name]
    return _read(spark, path, table, list(table["folders"]))


def upsert(spark: SparkSession, path: str, changes: dict[str, Rows], epoch: tuple[str, int] | None = None, buckets: int = BUCKETS) -> int:
    """Make all changes in one version; returns it, or the newest one where the epoch was seen before."""
    old = manifest(spark, path)
    if epoch is not None and old["epochs"].get(epoch[0], -1) >= epoch[1]:
        return old["version"]
    new = {"version": old["version"] + 1, "epochs": dict(old["epochs"]), "tables": dict(old["tables"])}
    if epoch is not None:
        new["epochs"][epoch[0]] = epoch[1]
    for name, rows in changes.items():
        table = old["tables"].get(name) or {"key": rows.key, "buckets": buckets, "schema": rows.data.schema.jsonValue(), "folders": {}}
        if table["key"] != rows.key or StructType.fromJson(table["schema"]).names != rows.data.schema.names:
            raise ValueError(f"table {name} has another key or other columns")
        d = rows.data
        if rows.order is not None:
            rest = [c for c in d.columns if c not in rows.key]
            d = d.groupBy(*rows.key).agg(F.max_by(F.struct(*rest), rows.order).alias("r")).select(*rows.key, "r.*").select(*d.columns)
        folder, bucket = f"{name}-{uuid.uuid4().hex[:12]}", _bucket(rows.key, table["buckets"])
        touched = [str(r[0]) for r in d.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
        if not touched:
            new["tables"][name] = table
            continue
        held = _read(spark, path, table, touched)
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in rows.key]
        keep, add = (held, d.alias("x").join(held.alias("y"), same, "left_anti")) if rows.insert else (held.alias("x").join(d.alias("y"), same, "left_anti"), d)
        keep.unionByName(add).withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        new["tables"][name] = {**table, "folders": {**table["folders"], **dict.fromkeys(touched, folder)}}
    _commit(spark, path, new)
    return new["version"]


def sink(path: str, split: Callable[[DataFrame], dict[str, Rows]], writer: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch's rows, split into tables, in one version, once however often it is run."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, path, split(batch), epoch=(writer, number))

    return write


def claim(spark: SparkSession, path: str, sends: DataFrame, key: list[str], table: str = "sends") -> DataFrame:
    """The send ledger: of sends those that no earlier call has claimed, now claimed by this one. Two callers can't claim the same:
    the later commit fails with Conflict and may be tried again."""
    mark = uuid.uuid4().hex
    upsert(spark, path, {table: Rows(sends.dropDuplicates(key).withColumn("claim", F.lit(mark)), key, insert=True)})
    return read(spark, path, table).filter(F.col("claim") == mark).drop("claim")


def unused(spark: SparkSession, path: str) -> list[str]:
    """Data folders that no manifest names."""
    _, fs, p = _fs(spark, f"{path}/data")
    named = {f for v in versions(spark, path) for t in manifest(spark, path, v)["tables"].values() for f in t["folders"].values()}
    return sorted({s.getPath().getName() for s in fs.listStatus(p)} - named) if fs.exists(p) else []
