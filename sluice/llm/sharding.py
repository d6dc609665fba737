"""Sharding by sampled splitters, in DataFrame functions only.

Keys are the hash of the text, then doc_id, so equal texts lie side by side. A size-weighted sample of distinct keys (bounded)
gives quantile boundaries, which deal the records into ranges; ranges that turn out overfull are sampled again and cut, a hot text
by doc_id. Exact sums of the ranges then place each record at its middle byte in the whole order, and that byte gives its shard.
Groups of equal texts up to KEEP_WHOLE of a shard aren't cut, as that moves a shard's size by as little; larger ones are, since
shards of near equal sizes are the law.

Edge cases: a null text counts no bytes and equals other null texts; a null doc_id sorts first; rows repeated whole are
kept, each with a slot of its own, in one range, as nothing tells them apart; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import load, materialize

ROW_BYTES = 16
SAMPLE = 20_000  # keys drawn, the most that reaches the driver
KEEP_WHOLE = 0.01  # of a shard: groups of equal texts up to this size stay in one shard


def _unit(seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone, so that a repeated task draws the same sample."""
    return F.pmod(F.xxhash64("doc_id", "h", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are at or below (h, doc_id), in two steps, so that a record meets about 2 sqrt(cuts) of them."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    key = F.struct(F.col("h").alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    item = "array<struct<h:bigint,d:bigint>>"
    lit = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)  # noqa: E731  one literal, which is read once
    row = lambda cs: [{"h": h, "d": d} for h, d in cs]
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    coarse = F.size(F.filter(lit(row(r[0] for r in rows), item), lambda c: c <= key))
    fine = F.element_at(lit([row(r) for r in rows], f"array<{item}>"), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.size(F.filter(fine, lambda c: c <= key)))


def _cuts(sample: list, share: float, ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of sampled keys, each of which stands for `share` bytes or its own size. A text that outweighs a range
    is hot and is cut by doc_id, others whole."""
    sample = sorted((r["h"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], max(share, float(r["size"]))) for r in sample)
    if not sample:
        return []
    weight: dict[int, float] = {}
    for h, _, w in sample:
        weight[h] = weight.get(h, 0.0) + w
    step = sum(weight.values()) / ranges
    out, upto, edge = set(), 0.0, step
    for h, d, w in sample:
        upto += w
        if upto >= edge:
            out.add((h, d if weight[h] > step else -(1 << 63)))
            edge = step * (math.floor(upto / step) + 1)
    return sorted(out)


def sampled_cuts(keys: DataFrame, ranges: int, sample: int = SAMPLE) -> list[tuple[int, int]]:
    """Boundaries of about `ranges` ranges of near-equal bytes over keys (h, doc_id, size); overfull ranges are cut again."""
    one = materialize(keys.groupBy("h", "doc_id").agg(F.sum("size").alias("size")), "shard-distinct")
    total = one.agg(F.sum("size")).first()[0]
    if not total:
        return []
    draw = lambda d, seed, weight: d.filter(_unit(seed) * F.lit(float(weight)) < F.col("size") * F.lit(float(sample))).select("h", "doc_id", "size").collect()  # noqa: E731  about `sample` rows
    cuts = _cuts(draw(one, 1, total), total / sample, ranges)
    for again in range(3):
        sizes = one.groupBy(_range_of(cuts).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        over = {r["r"]: r["b"] for r in sizes if r["b"] > 2.5 * total / ranges and r["n"] > 1}
        if not over:
            break
        weight = sum(over.values())
        new = _cuts(draw(one.filter(_range_of(cuts).isin(list(over))), 2 + again, weight), weight / sample, max(2, round(weight / (total / ranges))))
        if set(new) <= set(cuts):
            break
        cuts = sorted({*cuts, *new})
    return cuts


def shard(docs: DataFrame, shards: int, *, ranges: int | None = None, keep_whole: float = KEEP_WHOLE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law `bytes`: the shards' sizes are near equal."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keys = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("text").alias("h"),
        ),
        "shard-keys",
    )
    rows, total = keys.agg(F.count("*"), F.sum("size")).first()
    if not rows:
        return keys.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    ranges = ranges or max(16, min(4096, rows // 250))
    dealt = keys.withColumn("r", _range_of(sampled_cuts(keys, ranges)))
    sums = dealt.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # one row a range, at most a few thousand
    before, at, n = {}, 0, 0
    for s in sorted(sums, key=lambda s: s["r"]):
        before[s["r"]] = (at, n)
        at, n = at + s["b"], n + s["n"]
    base = F.broadcast(keys.sparkSession.createDataFrame([(r, b, k) for r, (b, k) in before.items()], "r int, base_bytes long, base_rows long"))
    inside = Window.partitionBy("r").orderBy("h", "doc_id", "size")
    group = Window.partitionBy("r", "h")
    target = total / shards
    placed = (
        dealt.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("k", F.row_number().over(inside))
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_upto", F.min(F.col("upto") - F.col("size")).over(group))
        .join(base, "r")
        .withColumn("at", F.col("base_bytes") + F.when(F.col("group_bytes") <= keep_whole * target, F.col("group_upto") + F.col("group_bytes") / 2).otherwise(F.col("upto") - F.col("size") / 2))
        .withColumn("shard", F.least(F.floor(F.col("at") * shards / F.lit(float(total))), F.lit(shards - 1)).cast("int"))
        .withColumn("row", F.col("base_rows") + F.col("k") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    placed = materialize(placed, "shard-rows")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first_row")))  # at most `shards` rows
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"), 40)
