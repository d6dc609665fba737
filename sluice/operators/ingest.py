"""Ingest: de-duplication, attachments, cursors, budgets, poison messages, queue leases, health and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; rows with a null in the key all stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.withColumn("__n", F.when(known, F.row_number().over(w)).otherwise(1)).filter("__n = 1").drop("__n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns, all descending."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def anchor_duplicates(df: DataFrame, key: str, time: str, ident: str, days: int = 7) -> DataFrame:
    """Adds duplicate_of: a row repeats the last anchor of its key if it comes at most `days` after it, else it is an anchor.

    Rows stream through each task in order of key and time, and only the current anchor is held, so a key of any number of
    rows takes no memory. Rows with a null key repeat nothing and stay out of it.
    """
    schema = df.schema.simpleString()[7:-1]
    kind = dict(df.dtypes)[ident]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, since, anchor = None, None, None
        for batch in batches:
            found = []
            for k, t, i in zip(batch[key], batch[time], batch[ident]):
                if k == last and t - since <= pd.Timedelta(days=days):
                    found.append(anchor)
                else:
                    last, since, anchor = k, t, i
                    found.append(None)
            batch["duplicate_of"] = pd.array(found, dtype="Int64") if kind in ("bigint", "int") else found
            yield batch

    known = df.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, time, ident).mapInPandas(fold, f"{schema.replace(':', ' ')}, duplicate_of {kind}")
    return known.unionByName(df.filter(F.col(key).isNull()).withColumn("duplicate_of", F.lit(None).cast(kind)))


def copies(links: DataFrame, message: str, source: str) -> DataFrame:
    """How many sources brought a message, one at least."""
    return links.groupBy(message).agg(F.greatest(F.lit(1), F.countDistinct(source)).cast("long").alias("copies"))


def capped_children(df: DataFrame, parent: str, order: list, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(the first `cap` children of each parent, how many each parent has beyond)."""
    kept = df.withColumn("position", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).filter(F.col("position") <= cap)
    over = df.groupBy(parent).agg(F.greatest(F.lit(0), F.count("*") - cap).cast("long").alias("overflow"))
    return kept, over


def nearest_rank(df: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    """The value at rank round(q (n - 1)), half to even, of each key."""
    w = Window.partitionBy(*keys)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__k", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count("*").over(w))
    return ranked.filter(F.col("__k") == F.bround(F.lit(q) * (F.col("__n") - 1))).select(*keys, F.col(value).alias("nearest"))


def poll_metrics(polls: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, success rate (null without polls) and lag percentiles over columns ok, lag_s, value."""
    return polls.groupBy(*keys).agg(
        F.count("*").alias("polls"), F.count_if(~F.col("ok")).alias("failed"), F.try_divide(F.count_if(F.col("ok")).cast("double"), F.count("*")).alias("success_rate"),
        F.percentile("lag_s", 0.5).alias("lag_p50"), F.percentile("lag_s", 0.95).alias("lag_p95"), F.count_if(F.col("lag_s") < 0).alias("clock_skew"),
    )


def safe_cursor(items: DataFrame, group: str, position: str, settled: str) -> DataFrame:
    """How far the cursor of each group may move: just before its first unsettled position, or to its last."""
    return items.groupBy(group).agg(
        F.coalesce(F.min(F.when(~F.col(settled), F.col(position))) - 1, F.max(position)).alias("cursor"), F.count_if(~F.col(settled)).alias("unsettled")
    )


def within_budget(items: DataFrame, group: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """The items a batch takes: in order until the byte budget or the count is used up, the first one always."""
    w = Window.partitionBy(group).orderBy(order)
    d = items.withColumn("__sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    return d.filter(((F.col("__sum") <= budget) | (F.col("__n") == 1)) & (F.col("__n") <= most)).drop("__sum", "__n")


def poison(attempts: DataFrame, key: str, time: str, ok: str, most: int = 5) -> DataFrame:
    """Keys with failures since their last success: how many, and whether they are given up."""
    last = F.max(F.when(F.col(ok), F.col(time))).over(Window.partitionBy(key))
    since = attempts.withColumn("__last", last).filter(~F.col(ok) & (F.col("__last").isNull() | (F.col(time) > F.col("__last"))))
    return since.groupBy(key).agg(F.count("*").alias("attempts")).withColumn("given_up", F.col("attempts") >= most)


def next_run(attempts: Column, failed_at: Column, base_s: int = 30) -> Column:
    """When a failed job runs again: base times two for each further attempt."""
    return failed_at + F.make_dt_interval(secs=(F.lit(base_s) * F.pow(F.lit(2.0), attempts - 1)).cast("decimal(18,6)"))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that a worker may take, the next first."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < now)
    return jobs.filter(F.col("status").isin("pending", "leased") & (F.col("run_at") <= now) & free).orderBy("priority", "run_at")


def health(minutes: Column, paused: Column) -> Column:
    """paused, down (never or over an hour), degraded (over half an hour), ok."""
    return F.when(paused, "paused").when(minutes.isNull() | (minutes > 60), "down").when(minutes > 30, "degraded").otherwise("ok")


def status_changes(log: DataFrame, key: str, time: str, status: str, alarm: str) -> DataFrame:
    """The rows at which a key enters the alarm status: one alert an outage, armed again by any other status."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(time))
    return log.withColumn("__before", before).filter((F.col(status) == alarm) & (F.col("__before").isNull() | (F.col("__before") != alarm))).drop("__before")


def version_chain(df: DataFrame, key: str, order: list[str], ident: str) -> DataFrame:
    """Adds version and superseded_by: rows of a key numbered in order, each naming the next."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumns({"version": F.row_number().over(w), "superseded_by": F.lead(ident).over(w)})


def prune(df: DataFrame, time: str, now: Column, days: int = 30) -> DataFrame:
    return df.filter(F.col(time) >= now - F.make_dt_interval(days=F.lit(days)))


def close_abandoned(polls: DataFrame, state: str, running: str, time: str, now: Column, minutes: int = 30) -> DataFrame:
    """Polls that run for longer than `minutes` count as abandoned."""
    return polls.withColumn(state, F.when((F.col(state) == running) & (F.col(time) < now - F.make_dt_interval(mins=F.lit(minutes))), "abandoned").otherwise(F.col(state)))


def backfill(batches: DataFrame, source: str, order: str, count: str, errors: str, *, full: int = 50, stuck: int = 20) -> DataFrame:
    """State of each source's backfill: done when its last batch wasn't full and had no error, stuck at `stuck` errors, else running."""
    out = batches.groupBy(source).agg(F.count("*").alias("batches"), F.sum(errors).alias("errors"), F.max_by((F.col(count) < full) & (F.col(errors) == 0), order).alias("__done"))
    return out.withColumn("state", F.when(F.col("__done"), "done").when(F.col("errors") >= stuck, "stuck").otherwise("running")).drop("__done")
