"""Percentiles over long spans: mergeable sketches by hour, and the exact nearest rank by narrowing brackets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.tables import written

K = 200  # a sketch's rank error is below 1.7 % of its rows, in 99 of 100 cases; each sketch is a few KB whatever its rows
STEPS, AROUND = 64, 3  # a bracket reaches this many of so many steps of rank to either side of its middle


def hourly_sketches(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, hour, n, least, most, sketch: one row for each key and hour with a value, to be kept as a table.

    Rows with a null or NaN value or a null time aren't counted; null keys are a key. Tasks sketch their own rows before the shuffle.
    """
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(time).isNotNull())
    known = known.select(*keys, F.date_trunc("hour", time).alias("hour"), F.col(value).cast("double").alias("v"))
    return known.groupBy(*keys, "hour").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.kll_sketch_agg_double("v", F.lit(K)).alias("sketch"))


def merged_percentiles(sketches: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """keys, n, and for each name of `quantiles` about that quantile, over all the hours given; reads no row again."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()])


def nearest_rank_exact(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys, nearest: the value at rank round(q (n - 1)), half to even, of each key's values; nulls and NaNs have no rank.

    No key is sorted. A round sketches each key's values within its bracket, reads three pivots around the wanted rank off the
    sketch, counts the values between them and keeps the class that holds the rank: exact whatever the sketch's error, as counts
    decide. A class is as a rule a tenth of its bracket, and as the middle pivot is a value of its own class every round leaves
    fewer distinct values, so it ends for ties, too. Brackets are one row a key; keys with a found rank leave the rounds.
    """
    v = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    v = v.select(F.struct(*keys).alias("key"), F.col(value).cast("double").alias("v"))
    state = v.groupBy("key").agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = written(state.withColumn("rank", F.bround(F.lit(q) * (F.col("m") - 1)).cast("long")), "rank-brackets")  # rank: within the bracket
    found = state.filter("lo = hi").select("key", "lo")
    ranks = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    while not (state := state.filter("lo < hi")).isEmpty():
        inside = v.join(state, "key").filter("v between lo and hi")
        sketched = inside.groupBy("key").agg(F.kll_sketch_agg_double("v", F.lit(K)).alias("sketch"))
        step = F.round((F.col("rank") + 0.5) / F.col("m") * STEPS).cast("int")
        at = lambda d: F.element_at("at", F.greatest(F.lit(0), F.least(F.lit(STEPS), step + d)) + 1)
        cut = state.join(sketched.select("key", F.kll_sketch_get_quantile_double("sketch", ranks).alias("at")), "key")
        cut = written(cut.select("key", "lo", "hi", "rank", at(-AROUND).alias("a"), at(0).alias("b"), at(AROUND).alias("c")), "rank-pivots")
        place = F.when(F.col("v") < F.col("a"), 0).when(F.col("v") < F.col("b"), 1).when(F.col("v") == F.col("b"), 2).when(F.col("v") <= F.col("c"), 3).otherwise(4)
        classes = v.join(cut, "key").filter("v between lo and hi").groupBy("key", "rank", place.alias("class")).agg(F.count("*").alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # five rows a key at most
        classes = classes.groupBy("key", "rank").agg(F.array_sort(F.collect_list(F.struct("class", "m", "lo", "hi"))).alias("classes"))
        one = classes.select("key", "rank", "classes", F.posexplode("classes").alias("i", "c"))
        one = one.withColumn("below", F.aggregate(F.slice("classes", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["m"]))
        one = one.filter("rank >= below and rank < below + c.m")
        state = written(one.select("key", F.col("c.m").alias("m"), F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), (F.col("rank") - F.col("below")).alias("rank")), "rank-brackets")
        found = found.unionByName(state.filter("lo = hi").select("key", "lo"))
    return found.select("key.*", F.col("lo").alias("nearest"))
