"""Curation by hand: merging two opportunities, splitting one, undoing either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import constants as K
from sluice.operators.resolve import components


def refusals(pairs: DataFrame, opps: DataFrame) -> DataFrame:
    """Why a merge (victim, survivor) is refused: itself, missing, or two different decided statuses; null when it isn't."""
    o = lambda x: opps.select(F.col("id").alias(x), F.col("status").alias(f"{x}_status"))
    d = pairs.join(o("victim"), "victim", "left").join(o("survivor"), "survivor", "left")
    both = F.col("victim_status").isin(K.DECIDED) & F.col("survivor_status").isin(K.DECIDED) & (F.col("victim_status") != F.col("survivor_status"))
    missing = F.col("victim_status").isNull() | F.col("survivor_status").isNull()
    return d.select("victim", "survivor", F.when(F.col("victim") == F.col("survivor"), "same").when(missing, "missing").when(both, "decided").alias("refusal"))


def aliases(pairs: DataFrame, opps: DataFrame) -> DataFrame:
    """(id, survivor) for every opportunity, through chains of merges."""
    found = components(pairs.select(F.col("victim").alias("a"), F.col("survivor").alias("b")), opps.select("id"))
    last = found.join(pairs.select(F.col("victim").alias("id")).distinct(), "id", "left_anti").groupBy("component").agg(F.min("id").alias("survivor"))
    return found.join(last, "component").select("id", "survivor")


def apply_aliases(rows: DataFrame, alias: DataFrame, key: str) -> DataFrame:
    a = alias.select(F.col("id").alias(key), F.col("survivor").alias("__s"))
    return rows.join(a, key, "left").withColumn(key, F.coalesce("__s", key)).drop("__s")


def merged(opps: DataFrame, alias: DataFrame) -> DataFrame:
    """Survivors with the earliest first_seen, the latest activity, and blanks filled from those they absorbed."""
    d = opps.join(alias, "id")
    own = F.col("id") == F.col("survivor")
    fill = [F.coalesce(F.max(F.when(own, F.col(c))), F.max(c)).alias(c) for c in opps.columns if c not in ("id", "first_seen", "last_activity")]
    return d.groupBy(F.col("survivor").alias("id")).agg(F.min("first_seen").alias("first_seen"), F.max("last_activity").alias("last_activity"), *fill, F.count("*").alias("absorbed"))


def split(sources: DataFrame, message: str, moved: DataFrame, key: str = "opp_id") -> DataFrame:
    """Sources with the moved messages (message, new_id) under new ids; an opportunity's only source stays."""
    count = sources.groupBy(key).agg(F.countDistinct(message).alias("__n"))
    d = sources.join(moved, message, "left").join(count, key)
    return d.withColumn(key, F.when(F.col("new_id").isNotNull() & (F.col("__n") > 1), F.col("new_id")).otherwise(F.col(key))).drop("new_id", "__n")


def undoable(log: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Merges that can still be undone, newest first."""
    return log.filter(~F.col("undone") & (F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))).orderBy(F.desc("created_at"))


def undo(rows: DataFrame, moves: DataFrame, key: str, ident: str) -> DataFrame:
    """Rows back under the key that the log of moves (ident, old) names."""
    return rows.join(moves.select(ident, F.col("old").alias("__old")), ident, "left").withColumn(key, F.coalesce("__old", key)).drop("__old")
