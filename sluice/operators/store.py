"""The score store: hashes of inputs and explanations, the latest score, what is worth writing; lookups of organisations and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import constants as K


def inputs_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, keys in order of the alphabet; null columns are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def stable_hash(columns: list[str], clock: tuple[str, ...] = ("inputs_hash", "computed_at")) -> Column:
    """The hash of an explanation without what only the clock moves."""
    return inputs_hash(*[c for c in columns if c not in clock])


def latest_scores(scores: DataFrame) -> DataFrame:
    """The last score of each opportunity, by time and then by id."""
    w = Window.partitionBy("opp_id").orderBy(F.desc("computed_at"), F.desc("id"))
    return scores.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def with_latest_score(opps: DataFrame, scores: DataFrame) -> DataFrame:
    """Opportunities with score and band of their last score; 0 and pass where there is none."""
    last = latest_scores(scores).select(F.col("opp_id").alias("id"), "score", "band")
    return opps.join(last, "id", "left").withColumns({"score": F.coalesce("score", F.lit(0)), "band": F.coalesce("band", F.lit("pass"))})


def listed(opps: DataFrame, scores: DataFrame, band: str | None, most: int = 100) -> DataFrame:
    """A page of opportunities: the last active ones, and of those the ones of a band. The limit comes before the band, as a list's reader sees it."""
    page = opps.orderBy(F.desc("last_activity"), "id").limit(most)
    d = with_latest_score(page, scores)
    return d if band is None else d.filter(F.col("band") == band)


def with_organisation(opps: DataFrame, gcs: DataFrame, stats: DataFrame) -> DataFrame:
    """Opportunities with their organisation's tier, submissions and hit rate of twelve months; unknown, 0 and null where there is
    none. owner_direct: an owner or developer asks, or an owner is named and no contractor."""
    g = gcs.select(F.col("id").alias("gc_id"), "tier", F.col("kind").alias("__kind"))
    s = stats.select("gc_id", F.col("submitted").alias("submitted_12m"), F.col("hit_rate").alias("hit_rate_12m"))
    d = opps.join(g, "gc_id", "left").join(s, "gc_id", "left")
    named = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    direct = F.when(F.col("__kind").isNotNull(), F.col("__kind").isin("owner", "developer")).otherwise(named("owner_name") & ~named("gc_name"))
    return d.withColumns({"tier": F.coalesce("tier", F.lit("unknown")), "submitted_12m": F.coalesce("submitted_12m", F.lit(0)), "owner_direct": direct}).drop("__kind")


def set_tier(gcs: DataFrame, changes: DataFrame, opps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(organisations with the changed tiers (id, tier), the live opportunities that must be scored again)."""
    new = gcs.join(changes.select("id", F.col("tier").alias("__tier")), "id", "left").withColumn("tier", F.coalesce("__tier", "tier")).drop("__tier")
    moved = gcs.join(changes.select("id", F.col("tier").alias("__tier")), "id").filter("tier <> __tier").select(F.col("id").alias("gc_id"))
    return new, opps.filter(~F.col("archived")).join(moved, "gc_id", "left_semi")


def labelled(labels: DataFrame, opps: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels with their opportunity's last score, labels that match no scored opportunity). Positive labels: bid, 1, true, yes."""
    d = labels.select(F.col("opportunity_id").alias("id"), F.lower(F.trim("label")).isin("bid", "1", "true", "yes").alias("actual"))
    last = latest_scores(scores).select(F.col("opp_id").alias("id"), "score", "band")
    return d.join(opps, "id").join(last, "id"), d.join(last, "id", "left_anti")


def rescored(previous: DataFrame, current: DataFrame, note: str | None) -> DataFrame:
    """Current scores that differ from the last stored one by their stable hash or profile, with a note where the band changed and
    a profile was activated (note given)."""
    last = latest_scores(previous).select("opp_id", F.col("stable").alias("__stable"), F.col("profile").alias("__profile"), F.col("band").alias("__band"))
    d = current.join(last, "opp_id", "left").filter(F.col("__stable").isNull() | (F.col("__stable") != F.col("stable")) | (F.col("__profile") != F.col("profile")))
    moved = F.col("__band").isNotNull() & (F.col("__band") != F.col("band"))
    return d.withColumn("note", F.when(moved, F.lit(note).cast("string"))).drop("__stable", "__profile", "__band")


def profile_rows(profiles: DataFrame, activated: int) -> DataFrame:
    """Profiles with exactly one active: the version that was activated."""
    return profiles.withColumn("active", F.col("version") == activated)


def attachment_counts(messages: DataFrame, attachments: DataFrame, since: Column) -> DataFrame:
    """One row: how many attachments of messages stored since then have a text, and how many failed or were too large."""
    d = attachments.join(messages.filter(F.col("created_at") >= since).select("message_id"), "message_id")
    failed = F.col("text").isNull() & (F.col("error").isNotNull() | F.col("large") | F.col("oversize"))
    return d.agg(F.count_if(F.col("text").isNotNull()).alias("extracted"), F.count_if(failed).alias("failed"))


def visible(items: DataFrame, least: str) -> DataFrame:
    """Items whose band isn't below `least`."""
    return items.filter(F.col("band").isin(K.BANDS[: K.BANDS.index(least) + 1]))
