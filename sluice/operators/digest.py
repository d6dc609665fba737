"""The morning digest: sections, order, limits, watermarks, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import constants as K
from sluice.functions.text import addendum_number, addendum_scheme
from sluice.operators.ingest import health
from sluice.operators.store import with_latest_score

CHANGED = ["new", "undecided", "snoozed", "bidding", "submitted", "passed", "won"]
TOP = 10


def sections(items: DataFrame, now: Column) -> DataFrame:
    """A row for each section an item belongs to. Columns: status, bid_due, prebid_at, first_seen, watermark, mine, changed, material.

    What needs a decision isn't shown as new too.
    """
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    soon = lambda c: F.coalesce((F.col(c) >= now) & (F.col(c) <= now + days(7)), F.lit(False))
    needs = F.col("status").isin("new", "undecided") & F.col("mine") & (F.coalesce(F.col("bid_due") <= now + days(10), F.lit(False)) | (F.col("first_seen") <= now - days(3)))
    fresh = (F.col("watermark").isNull() | (F.col("first_seen") > F.col("watermark"))) & ~needs
    belongs = {
        "needs_decision": needs, "new": fresh, "due_this_week": F.col("status").isin("bidding", "undecided") & (soon("bid_due") | soon("prebid_at")),
        "changed": F.col("changed") & F.col("status").isin(CHANGED), "passed_changed": F.col("changed") & F.col("material") & (F.col("status") == "passed"),
        "prebid_today": F.coalesce(F.to_date("prebid_at") == F.to_date(now), F.lit(False)) & F.col("status").isin("bidding", "undecided", "new"),
    }
    return items.withColumn("section", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in belongs.items()]))))


def ordered(items: DataFrame, keys: list[str]) -> DataFrame:
    """Adds position within keys: by due date, unknown last, then by score."""
    w = Window.partitionBy(*keys).orderBy(F.col("bid_due").asc_nulls_last(), F.desc("score"), "id")
    return items.withColumn("position", F.row_number().over(w))


def top_by_band(items: DataFrame, most: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(the best `most` items of each band, how many each band has beyond)."""
    w = Window.partitionBy("band").orderBy(F.desc("score"), F.col("bid_due").asc_nulls_last(), "id")
    best = items.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)
    return best, items.groupBy("band").agg(F.greatest(F.lit(0), F.count("*") - most).cast("long").alias("overflow"))


def hide_below(items: DataFrame, least: str) -> DataFrame:
    rank = F.create_map(*[F.lit(x) for i, b in enumerate(K.BANDS) for x in (b, i)])
    return items.withColumn("hidden", F.try_element_at(rank, F.col("band")) > K.BANDS.index(least))


def header(items: DataFrame, now: Column) -> DataFrame:
    """Counts over items with their sections, as one row."""
    n = lambda c: F.count_if(c)
    s = F.col("section")
    return items.agg(
        n(s == "new").alias("new"), n((s == "new") & (F.col("band") == "bid")).alias("new_bid"), n(s == "due_this_week").alias("due_this_week"), n(s == "changed").alias("changed"),
        n(s == "needs_decision").alias("needs_decision"), F.min(F.when(F.col("bid_due") >= now, F.col("bid_due"))).alias("next_due"), (F.count("*") == 0).alias("quiet"),
    )


def subject_line(now: Column, new: Column, to_bid: Column, due: Column, decide: Column, quiet: Column, degraded: Column) -> Column:
    text = lambda n: n.cast("string")
    parts = F.concat_ws(
        " · ", F.concat(text(new), F.lit(" new"), F.when(to_bid > 0, F.concat(F.lit(" ("), text(to_bid), F.lit(" to bid)"))).otherwise("")), F.concat(text(due), F.lit(" due this week")),
        F.when(decide > 0, F.concat(text(decide), F.lit(" need decision"))),
    )
    head = F.concat(F.lit("Bids · "), F.date_format(now, "EEE MMM d"), F.lit(" · "))
    return F.when(quiet, F.concat(head, F.lit("quiet morning"))).otherwise(F.concat(F.when(degraded, "⚠︎ ").otherwise(""), head, parts))


def items(opps: DataFrame, scores: DataFrame, addenda: DataFrame, users: DataFrame) -> DataFrame:
    """A digest's rows: live opportunities with their last score, tier, addenda, the assignee's name and the first known host of their documents.

    opps: archived, tier, assignee, project_name, document_links (array of struct with host_class), flags; addenda: opp_id, label,
    number; users: user_id, user_name. Missing numbers are told only where all labels are one numbered sequence.
    """
    d = with_latest_score(opps.filter(~F.col("archived")).drop("score", "band"), scores)
    scheme, number = addendum_scheme(F.regexp_replace("label", r"\b\d{1,3}\b", " ")), F.col("number").cast("int")
    a = addenda.groupBy(F.col("opp_id").alias("id")).agg(
        F.count("*").alias("addenda_count"), F.countDistinct(scheme).alias("__schemes"), F.count_if(addendum_number(F.col("label")).isNull()).alias("__bare"), F.collect_set(F.when(number >= 1, number)).alias("__seen"),
    )
    none = F.array().cast("array<int>")
    missing = F.when((F.col("__schemes") == 1) & (F.col("__bare") == 0) & (F.size("__seen") > 0), F.array_sort(F.array_except(F.sequence(F.lit(1), F.array_max("__seen")), F.col("__seen")))).otherwise(none)
    host = F.try_element_at(F.filter(F.transform("document_links", lambda x: x["host_class"]), lambda h: h != "other"), F.lit(1))
    d = d.join(a, "id", "left").join(users.select(F.col("user_id").alias("assignee"), F.col("user_name").alias("assignee_name")), "assignee", "left")
    return d.withColumns({
        "addenda_count": F.coalesce("addenda_count", F.lit(0)), "missing_addenda": F.coalesce(missing, none), "gc_tier": F.coalesce("tier", F.lit("unknown")), "docs_host": host,
        "project_name": F.coalesce(F.nullif("project_name", F.lit("")), F.lit("Untitled")), "flags": F.filter("flags", lambda f: f.isin(K.DIGEST_FLAGS)),
    }).drop("__schemes", "__bare", "__seen")


def review_items(messages: DataFrame, skips: DataFrame, opps: DataFrame, least: float = 0.6) -> DataFrame:
    """(kind, title) of all that a person must look at: failed and doubtful extractions, messages given up, possible duplicates, orphans."""
    title = lambda c: F.substring(c, 1, 70)
    failed = messages.filter("status = 'failed'").select(F.lit("extraction_failed").alias("kind"), title(F.col("subject")).alias("title"))
    doubtful = messages.filter((F.col("status") == "done") & (F.col("kind_confidence") < least)).select(F.lit("low_confidence_kind").alias("kind"), title(F.col("subject")).alias("title"))
    skipped = skips.filter("given_up").select(F.lit("ingest_skipped").alias("kind"), F.concat(F.lit("could not ingest "), F.col("key"), F.lit(" after "), F.col("attempts").cast("string"), F.lit(" attempts")).alias("title"))
    kinds = F.array_intersect("flags", F.array(F.lit("possible_duplicate"), F.lit("orphan_update")))
    flagged = opps.filter(~F.col("archived")).select(F.explode(kinds).alias("kind"), F.coalesce("project_name", F.col("id").cast("string")).alias("title"))
    return failed.unionByName(doubtful).unionByName(skipped).unionByName(flagged)


def health_lines(sources: DataFrame, now: Column) -> DataFrame:
    """Each source's status and detail; a stuck backfill makes a healthy source degraded and says why."""
    minutes = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_success").cast("timestamp"))) / 60
    status = health(minutes, F.col("paused"))
    told = F.when(status != "ok", F.when(F.col("last_success").isNull(), "never succeeded").otherwise(F.concat(F.floor(minutes).cast("string"), F.lit(" minutes since the last success"))))
    stuck = F.when(F.col("backfill_stuck"), F.concat(F.lit("backfill stuck: "), F.coalesce("backfill_error", F.lit(""))))
    return sources.select("*", F.when((status == "ok") & F.col("backfill_stuck"), "degraded").otherwise(status).alias("status"), F.substring(F.concat_ws("; ", told, stuck), 1, 200).alias("detail"))


def move_watermarks(watermarks: DataFrame, sent: DataFrame) -> DataFrame:
    """(user_id, at): the time of the last scheduled digest of each recipient, moved only for those that were sent one."""
    new = sent.groupBy("user_id").agg(F.max("sent_at").alias("sent_at"))
    return watermarks.join(new, "user_id", "full").select("user_id", F.greatest("at", "sent_at").alias("at"))


def clear_changes(items: DataFrame, sent: DataFrame) -> DataFrame:
    """Change flags off where a digest was sent."""
    s = sent.select("id", F.lit(True).alias("__sent")).distinct()
    return items.join(s, "id", "left").withColumn("changed", F.col("changed") & F.col("__sent").isNull()).drop("__sent")
