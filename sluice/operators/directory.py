"""The directory of organisations: seeding, lookup by domain, alias and likeness, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import constants as K
from sluice.functions.similarity import edit_ratio
from sluice.functions.text import normalize_domain, organisation, organisation_core, organisation_squashed
from sluice.operators.prefix import candidates, ratio_sql, text_grams
from sluice.sources.tables import written


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """CSV of canonical_name, kind, domains, aliases; the last two are lists with semicolons."""
    parts = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    raw = spark.read.csv(path, header=True, schema="canonical_name string, kind string, domains string, aliases string")
    return raw.withColumns({"domains": parts(F.col("domains")), "aliases": parts(F.col("aliases"))})


def seed(directory: DataFrame, rows: DataFrame, key: str = "canonical_name") -> DataFrame:
    """The directory with the rows whose key it lacks; what is there, tiers above all, isn't touched."""
    new = rows.dropDuplicates([key]).join(directory.select(key), key, "left_anti")
    return directory.unionByName(new, allowMissingColumns=True)


def is_platform(domain: Column) -> Column:
    """Whether a normal domain is a bidding platform's or below it."""
    c = domain.isin(K.PLATFORM_DOMAINS)
    for p in K.PLATFORM_DOMAINS:
        c = c | domain.endswith(f".{p}")
    return c


def by_domain(messages: DataFrame, domains: DataFrame) -> DataFrame:
    """message_id, gc_id by the sender's domain; platforms and free mail say nothing. Of several the smallest id."""
    d = messages.select("message_id", normalize_domain(F.col("sender")).alias("domain")).filter(~F.col("domain").isin(K.GENERIC_DOMAINS) & ~is_platform(F.col("domain")))
    known = domains.select(normalize_domain(F.col("domain")).alias("domain"), "gc_id")
    return d.join(known, "domain").groupBy("message_id").agg(F.min("gc_id").alias("gc_id"))


BLOCKS = 16  # into which the ids of one name are dealt


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.9) -> DataFrame:
    """(left_id, right_id, ratio) of names whose edit ratio, or that of their cores, reaches `least`; rows without an id have none.

    Each distinct name is compared once: exact candidates by rare trigrams of either form, then the ratio. The ids of each two
    names that are alike meet as blocks, dealt out evenly and multiplied out last. No side is broadcast by what its files weigh.
    """
    forms = {"name": organisation, "core": organisation_core}
    side = lambda d, s: d.filter("id is not null").select(F.col("id").alias(f"{s}_id"), *[f(F.col("name")).alias(f"{s}_{k}") for k, f in forms.items()])
    a, b = side(left, "left"), side(right, "right")
    # written, as a filter on their grams would else be pushed down to every row
    apart = lambda d, s: written(d.select(f"{s}_name", f"{s}_core").distinct(), "names")
    names = {"left": apart(a, "left"), "right": apart(b, "right")}
    # candidates() leaves pairs of equal ids to one side alone
    grams = lambda s, x, k: names[s].select(F.concat(F.lit(f"{x}:"), F.col(f"{s}_name")).alias(x), text_grams(F.col(f"{s}_{k}")).alias("grams"))
    found = None
    for k in forms:
        pairs = candidates(grams("left", "a", k), grams("right", "b", k), *ratio_sql(least))
        found = pairs if found is None else found.unionByName(pairs)
    pairs = found.distinct().select(F.substring("a", 3, 1 << 30).alias("left_name"), F.substring("b", 3, 1 << 30).alias("right_name"))
    both = pairs.join(names["left"].hint("merge"), "left_name").join(names["right"].hint("merge"), "right_name")
    ratio = F.greatest(edit_ratio("left_name", "right_name"), edit_ratio("left_core", "right_core"))
    alike = both.select("left_name", "right_name", ratio.alias("ratio")).filter(F.col("ratio") >= least)
    blocks = lambda d, s: d.groupBy(f"{s}_name", F.pmod(F.xxhash64(f"{s}_id"), F.lit(BLOCKS)).alias(f"{s}_block")).agg(F.collect_list(f"{s}_id").alias(f"{s}_ids")).hint("merge")
    met = alike.join(blocks(a, "left"), "left_name").join(blocks(b, "right"), "right_name")
    # a number is given, as partitions of few bytes would be joined that multiply out to many rows
    dealt = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "left_name", "right_name", "left_block", "right_block")
    return dealt.select(F.explode("left_ids").alias("left_id"), "right_ids", "ratio").select("left_id", F.explode("right_ids").alias("right_id"), "ratio")


def resolve(messages: DataFrame, directory: DataFrame, domains: DataFrame, aliases: DataFrame) -> DataFrame:
    """message_id, gc_id, confidence, method: by domain (.98), alias (.95), likeness (its ratio), or none."""
    dom = by_domain(messages, domains).select("message_id", "gc_id", F.lit(0.98).alias("confidence"), F.lit("domain").alias("method"), F.lit(1).alias("rank"))
    names = messages.filter("gc_name is not null").select("message_id", organisation(F.col("gc_name")).alias("norm"), "gc_name")
    every = aliases.select(F.col("alias").alias("name"), "gc_id").unionByName(directory.select("name", F.col("id").alias("gc_id")))
    forms = lambda c: F.explode(F.array_distinct(F.array(organisation(F.col(c)), organisation_squashed(F.col(c))))).alias("form")
    ali = names.select("message_id", forms("gc_name")).join(every.select("gc_id", forms("name")), "form").groupBy("message_id").agg(F.min("gc_id").alias("gc_id")).select("message_id", "gc_id", F.lit(0.95).alias("confidence"), F.lit("alias").alias("method"), F.lit(2).alias("rank"))
    distinct = names.select(F.col("norm").alias("id"), F.col("norm").alias("name")).distinct()
    fuzzy = similar_names(distinct, every.select(F.col("gc_id").alias("id"), "name")).groupBy("left_id").agg(F.max_by("right_id", F.struct("ratio", -F.col("right_id"))).alias("gc_id"), F.max("ratio").alias("confidence"))
    fuz = names.join(fuzzy, names["norm"] == fuzzy["left_id"]).select("message_id", "gc_id", "confidence", F.lit("fuzzy").alias("method"), F.lit(3).alias("rank"))
    best = dom.unionByName(ali).unionByName(fuz).groupBy("message_id").agg(F.min_by(F.struct("gc_id", "confidence", "method"), "rank").alias("m")).select("message_id", "m.*")
    return messages.select("message_id").join(best, "message_id", "left").withColumn("method", F.coalesce("method", F.lit("none")))


def gc_stats(opps: DataFrame, now: Column, days: int = 365, least: int = 5) -> DataFrame:
    """Twelve months by organisation: invites, bids, submitted, won, hit rate (null under `least` submissions), days of notice."""
    recent = opps.filter(F.col("first_seen") >= now - F.make_dt_interval(days=F.lit(days)))
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = recent.groupBy("gc_id").agg(
        F.count("*").alias("invites"), n("bidding", "submitted", "won", "lost").alias("bids"), n("submitted", "won", "lost").alias("submitted"), n("won").alias("won"),
        F.avg(F.when(F.col("bid_due").isNotNull(), F.datediff("bid_due", "first_seen"))).alias("avg_days_notice"),
    )
    return out.withColumn("hit_rate", F.when(F.col("submitted") >= least, F.col("won") / F.col("submitted")))


def internal_senders(messages: DataFrame, own_domains: list[str], users: DataFrame) -> DataFrame:
    """Messages from the home domains or from a user's address."""
    own = normalize_domain(F.col("sender")).isin(own_domains)
    mine = messages.join(users.select(F.lower("email").alias("__e")), F.lower("sender") == F.col("__e"), "left_semi")
    return messages.filter(own).unionByName(mine).dropDuplicates(["message_id"])


