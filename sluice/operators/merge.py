"""Rules by which later messages change an opportunity. Python functions serve the ordered fold, columns the set-wise queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import constants as K

LABELS = {"bid_due": "Due date", "rfi_deadline": "RFI deadline", "intent_due": "Intent to bid", "prebid": "Pre-bid"}
SIZE_KEYS = ["stated_electrical_value", "stated_project_value", "square_feet", "stories", "units_or_beds"]
MARGIN = 0.15  # by which a new value's confidence must exceed the old one's
MATERIAL_DAYS, MATERIAL_RATIO = 7, 0.5


def merge_date(old: datetime | None, new: datetime | None, kind: str, sent: datetime | None, as_of: datetime | None, locked: bool = False) -> tuple[datetime | None, str]:
    """(value, outcome): none, set, same, moved, stale, locked, conflict or kept."""
    if new is None:
        return old, "none"
    if old is not None and kind in K.DATE_MOVERS and sent is not None and as_of is not None and sent < as_of:
        return old, "stale"
    if locked:
        return old, "conflict" if old is not None and old != new else "locked"
    if old is None:
        return new, "set"
    if kind == "reminder":
        return old, "same" if old.date() == new.date() else "conflict"
    if kind not in K.DATE_MOVERS:
        return old, "kept"
    return (old, "same") if old == new else (new, "moved")


def merge_text(old: str | None, old_confidence: float, new: str | None, new_confidence: float, locked: bool = False) -> tuple[str | None, float, bool]:
    """(value, confidence, changed): a blank is filled, else the new value must be clearly surer."""
    if not new or locked or old and new_confidence <= old_confidence + MARGIN:
        return old, old_confidence, False
    return new, new_confidence, new != old


def worst_change(pairs: list[tuple[Column, Column]]) -> Column:
    """The largest relative change among sizes that are known and not zero on both sides; null if there is none."""
    ratios = [F.abs(b - a) / F.nullif(F.abs(a), F.lit(0.0)) * F.when(b != 0, 1.0) for a, b in pairs]
    return F.greatest(*ratios) if len(ratios) > 1 else ratios[0]


def material(old_due: Column, new_due: Column, ratio: Column) -> Column:
    moved = F.abs(F.unix_timestamp(new_due.cast("timestamp")) - F.unix_timestamp(old_due.cast("timestamp"))) > MATERIAL_DAYS * 86_400
    return F.coalesce(moved, F.lit(False)) | F.coalesce(ratio > MATERIAL_RATIO, F.lit(False))


def date_moves(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each change of a date along its messages in order: old, new, and how many changes of the key came so far."""
    w = Window.partitionBy(key).orderBy(time)
    moved = df.withColumn("old", F.lag(value).over(w)).filter(F.col("old").isNotNull() & (F.col("old") != F.col(value)))
    return moved.withColumn("change", F.row_number().over(w)).withColumnRenamed(value, "new")


def addenda(df: DataFrame, key: str, label: str, message: str) -> DataFrame:
    """One row a key and label: copies are the messages that carry it."""
    return df.groupBy(key, label).agg(F.countDistinct(message).alias("copies"))


def addendum_gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """The numbers missing below the highest one seen."""
    seen = df.filter(F.col(number) >= 1).groupBy(key).agg(F.collect_set(number).alias("seen"), F.max(number).alias("top"))
    return seen.select(key, F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("top").cast("int")), F.transform("seen", lambda x: x.cast("int")))).alias("missing")).filter(F.size("missing") > 0)


def union_arrays(df: DataFrame, key: str, *arrays: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in arrays])


def archive_stale(opps: DataFrame, now: Column, days: int = 180) -> DataFrame:
    stale = F.col("status").isin("new", "undecided", "passed", "lost", "cancelled") & (F.col("last_activity") < now - F.make_dt_interval(days=F.lit(days)))
    return opps.withColumn("archived", stale).withColumn("status", F.when(stale, "archived").otherwise(F.col("status")))


def unsnooze(opps: DataFrame, now: Column) -> DataFrame:
    over = (F.col("status") == "snoozed") & (F.col("snooze_until") <= now)
    return opps.withColumns({"note": F.when(over, "snooze ended"), "status": F.when(over, "undecided").otherwise(F.col("status"))})


def breaks_snooze(due: Column, until: Column) -> Column:
    return F.coalesce(due <= until, F.lit(False))
