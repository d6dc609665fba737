"""Undoing merges and splits from the log of what they moved.

An entry of the log moved rows (a child of some kind from one owner to another) and changed records (of which it kept a snapshot).
It is undone only where no later entry has moved the same rows or changed the same records, but for entries that are undone with
it; so what comes back is what was there before it. Refusals spread backwards over the chain of entries that touch an item, a
round a link, and each item goes back to where it was before the earliest of its entries that are undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.tables import written

ITEM = ["kind", "item"]


def merge_moves(children: DataFrame, merges: DataFrame) -> DataFrame:
    """(entry, kind, item, old, new) of the children that merges (entry, victim, survivor) move; no victim may be merged twice."""
    m = merges.select("entry", F.col("victim").alias("owner"), F.col("survivor").alias("new"))
    return children.join(m, "owner").filter("owner <> new").select("entry", *ITEM, F.col("owner").alias("old"), "new")


def split_moves(children: DataFrame, splits: DataFrame) -> DataFrame:
    """(entry, kind, item, old, new) of the children that splits (entry, kind, item, new) move."""
    return children.join(splits, ITEM).filter("owner <> new").select("entry", *ITEM, F.col("owner").alias("old"), "new")


def apply_moves(children: DataFrame, moves: DataFrame) -> DataFrame:
    """Children (kind, item, owner) under their new owners."""
    m = moves.select(*ITEM, F.col("new").alias("moved_to"))
    return children.join(m, ITEM, "left").select(*ITEM, F.coalesce("moved_to", "owner").alias("owner"))


def judged(log: DataFrame, moves: DataFrame, snapshots: DataFrame, asked: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(entry, refusal) of each asked entry; null where it can be undone: missing, undone, expired or moved_since.

    log: entry, seq (its order), created_at, undone; moves: entry, kind, item; snapshots: entry, opp_id; asked: entry.
    """
    known = log.select("entry", "seq", "created_at", "undone")
    first = F.when(F.col("seq").isNull(), "missing").when(F.col("undone"), "undone").when(F.col("created_at") < now - F.make_dt_interval(days=F.lit(days)), "expired")
    state = written(asked.select("entry").distinct().join(known, "entry", "left").select("entry", first.alias("refusal")), "asked")
    touched = moves.select("entry", *ITEM).unionByName(snapshots.select("entry", F.lit("record").alias("kind"), F.col("opp_id").alias("item")))
    live = touched.join(known.filter(~F.col("undone")).select("entry", "seq"), "entry")
    chain = live.withColumn("later", F.lead("entry").over(Window.partitionBy(*ITEM).orderBy("seq"))).filter("later is not null")
    chain = written(chain.select("entry", "later").distinct(), "chain")
    while True:
        stays = state.select(F.col("entry").alias("later"), F.col("refusal").isNull().alias("goes"))
        stuck = chain.join(stays, "later", "left").filter(~F.coalesce("goes", F.lit(False))).select("entry", F.lit(True).alias("stuck")).distinct()
        new = written(state.join(stuck, "entry", "left").select("entry", F.coalesce("refusal", F.when(F.col("stuck"), "moved_since")).alias("refusal")), "judged")
        more = new.filter("refusal is not null").count() - state.filter("refusal is not null").count()
        state = new
        if not more:
            return state


def undone(children: DataFrame, records: DataFrame, log: DataFrame, moves: DataFrame, snapshots: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(children, records, log) after the entries without a refusal are undone.

    children: kind, item, owner; records: opp_id, record; snapshots: entry, opp_id, before, which is null where the record wasn't
    there. Children that an undone split's opportunity got from elsewhere since then make that split's records touched, so it stays.
    """
    go = log.join(verdicts.filter("refusal is null").select("entry"), "entry").select("entry", "seq")
    back = moves.join(go, "entry").groupBy(*ITEM).agg(F.min_by("old", "seq").alias("back"))
    home = children.join(back, ITEM, "left").select(*ITEM, F.coalesce("back", "owner").alias("owner"))
    before = snapshots.join(go, "entry").groupBy("opp_id").agg(F.min_by(F.struct("before"), "seq").alias("b")).select("opp_id", F.col("b.before").alias("record"), F.lit(True).alias("restored"))
    kept = records.join(before.select("opp_id"), "opp_id", "left_anti").select("opp_id", "record")
    marked = log.join(go.select("entry", F.lit(True).alias("goes")), "entry", "left").withColumn("undone", F.col("undone") | F.coalesce("goes", F.lit(False))).drop("goes")
    return home, kept.unionByName(before.filter("record is not null").select("opp_id", "record")), marked
