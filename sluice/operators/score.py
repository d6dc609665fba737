"""Fit scores: a pure row function of the opportunity, its organisation and the calendar, all in column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import constants as K
from sluice.functions.dates import days_between
from sluice.functions.geo import piecewise


@dataclass(frozen=True)
class Profile:
    """A versioned scoring profile; literals of the plan once validated."""

    version: int = 1
    weights: dict = field(default_factory=lambda: {"project_type": 0.25, "size": 0.25, "gc": 0.25, "distance": 0.10, "timing": 0.10, "bid_type": 0.05})
    type_table: dict = field(default_factory=lambda: dict(K.TYPE_FACTOR))
    share: dict = field(default_factory=lambda: dict(K.ELECTRICAL_SHARE))
    cost: dict = field(default_factory=lambda: dict(K.COST_PER_SF))
    tier: dict = field(default_factory=lambda: dict(K.GC_TIER))
    bid_type: dict = field(default_factory=lambda: dict(K.BID_TYPE))
    size_band: tuple = (75_000.0, 250_000.0, 4_000_000.0, 8_000_000.0, 15_000_000.0)  # floor, sweet low, sweet high, ceiling, hard maximum
    ceiling_value: float = 0.2
    size_unknown: float = 0.5
    distance: tuple = ((25.0, 1.0), (50.0, 0.7), (90.0, 0.3))
    distance_beyond: float = 0.1
    distance_unknown: float = 0.6
    timing: tuple = (0.2, 0.6, 1.0, 0.9, 0.7)  # under 3 days, under 7, up to 21, up to 45, later
    timing_unknown: float = 0.5
    congestion: tuple = (0.8, 0.6)  # two others, three or more
    partial: float = 0.6
    owner_direct: float = 0.6
    hit_rate: tuple = (0.05, 0.25, 0.1, 5)  # low, high, step, least submissions
    thresholds: tuple = (70, 45, 20)
    boosts: dict = field(default_factory=lambda: {"renewables": 5, "key_account": 8, "design_build_or_bim": 3, "sustainability": 2, "requested_by_name": 5})
    caps: dict = field(default_factory=lambda: {"no_electrical_scope": 5, "open_shop": 20, "mandatory_prebid_passed": 10, "due_passed": 5, "above_hard_max": 15, "residential": 5})
    key_accounts: tuple = ()

    def problems(self) -> list[str]:
        """What is wrong with the profile; empty when it is valid."""
        out = []
        if abs(sum(self.weights.values()) - 1) > 0.001:
            out.append("weights don't sum to 1")
        if list(self.size_band) != sorted(self.size_band) or [x for x, _ in self.distance] != sorted(x for x, _ in self.distance):
            out.append("breakpoints aren't in order")
        if not self.thresholds[0] > self.thresholds[1] > self.thresholds[2]:
            out.append("thresholds aren't in order")
        if any(not 0 <= v <= 1 for t in (self.type_table, self.tier, self.bid_type, self.share) for v in t.values()):
            out.append("a factor lies outside 0 to 1")
        if max(self.type_table.values()) != 1.0:
            out.append("no project type scores 1")
        return out


def _look(table: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def electrical_value(p: Profile) -> Column:
    share = _look(p.share, F.col("project_type"), p.share["unknown"])
    given = lambda c: F.nullif(F.col(c), F.lit(0.0))  # noqa: E731  zero counts as not stated
    return F.coalesce(given("stated_electrical_value"), given("stated_project_value") * share, given("square_feet") * _look(p.cost, F.col("project_type"), p.cost["unknown"]) * share)


def size_factor(v: Column, p: Profile) -> Column:
    floor, low, high, ceiling, most = p.size_band
    return F.when(v.isNull(), p.size_unknown).otherwise(piecewise(v, [(floor, 0.0), (low, 1.0), (high, 1.0), (ceiling, p.ceiling_value), (most, 0.0)], 0.0, 0.0))


def distance_factor(miles: Column, p: Profile) -> Column:
    return F.when(miles.isNull(), p.distance_unknown).when(miles <= p.distance[0][0], p.distance[0][1]).otherwise(piecewise(miles, list(p.distance), 1.0, p.distance_beyond))


def timing_factor(days: Column, others: Column, p: Profile) -> Column:
    a, b, c, d, e = p.timing
    base = F.when(days.isNull(), p.timing_unknown).when(days < 0, 0.0).when(days < 3, a).when(days < 7, b).when(days <= 21, c).when(days <= 45, d).otherwise(e)
    return base * F.when(others >= 3, p.congestion[1]).when(others == 2, p.congestion[0]).otherwise(1.0)


def gc_factor(p: Profile) -> Column:
    low, high, step, least = p.hit_rate
    base = _look(p.tier, F.col("tier"), p.tier["unknown"])
    enough = F.col("hit_rate_12m").isNotNull() & (F.col("submitted_12m") >= least)
    moved = F.when(enough & (F.col("hit_rate_12m") >= high), F.least(F.lit(1.0), base + step)).when(enough & (F.col("hit_rate_12m") < low), F.greatest(F.lit(0.0), base - step)).otherwise(base)
    return F.when(F.col("owner_direct") & (F.col("tier") == "unknown"), p.owner_direct).otherwise(moved)


def band(score: Column, p: Profile) -> Column:
    return F.when(score >= p.thresholds[0], "bid").when(score >= p.thresholds[1], "consider").when(score >= p.thresholds[2], "likely_pass").otherwise("pass")


# Columns of the snapshot with the value an absent one takes.
SNAPSHOT = {
    "project_type": ("string", "unknown"), "trade_relevance": ("string", "primary"), "stated_electrical_value": ("double", None), "stated_project_value": ("double", None),
    "square_feet": ("double", None), "distance_miles": ("double", None), "bid_due": ("timestamp", None), "bid_type": ("string", "unknown"), "sector": ("string", "unknown"),
    "status": ("string", "new"), "flags": ("array<string>", None), "scope_items": ("array<string>", None), "owner_name": ("string", None), "tier": ("string", "unknown"),
    "submitted_12m": ("long", 0), "hit_rate_12m": ("double", None), "key_account": ("boolean", False), "owner_direct": ("boolean", False), "others_due_same_week": ("long", 0),
    "prebid_mandatory": ("boolean", None), "prebid_at": ("timestamp", None),
}


def score(snapshot: DataFrame, now: Column, p: Profile = Profile()) -> DataFrame:
    """The snapshot with factors, raw_weighted, boosts, caps (arrays of names in their order), score and band."""
    if p.problems():
        raise ValueError("; ".join(p.problems()))
    d = snapshot
    for name, (kind, default) in SNAPSHOT.items():
        if name not in d.columns:
            d = d.withColumn(name, F.lit(default).cast(kind))
    none = F.array().cast("array<string>")
    flags, scope = F.coalesce("flags", none), F.coalesce("scope_items", none)
    value = electrical_value(p)
    relevance = F.when(F.col("trade_relevance") == "partial", p.partial).when(F.col("trade_relevance") == "none", 0.0).otherwise(1.0)
    hard = F.when(F.col("sector").isin("public", "federal"), "hard_bid_public").otherwise("hard_bid_private")
    kind = F.when(F.col("bid_type") == "hard_bid", hard).otherwise(F.col("bid_type"))
    d = d.withColumns({
        "electrical_value": value,
        "f_project_type": _look(p.type_table, F.col("project_type"), p.type_table.get("other", 0.4)) * relevance,
        "f_size": size_factor(value, p),
        "f_gc": gc_factor(p),
        "f_distance": distance_factor(F.col("distance_miles"), p),
        "f_timing": timing_factor(days_between(F.col("bid_due"), now), F.coalesce("others_due_same_week", F.lit(0)), p),
        "f_bid_type": _look(p.bid_type, kind, p.bid_type["unknown"]),
    })
    parts = [F.lit(p.weights[k]) * F.col(f"f_{k}") * F.lit(100) for k in ("project_type", "size", "gc", "distance", "timing", "bid_type")]
    raw = parts[0]
    for x in parts[1:]:
        raw = raw + x
    owner = F.lower(F.coalesce("owner_name", F.lit("")))
    key_owner = F.lit(False)
    for k in p.key_accounts:
        key_owner = key_owner | owner.contains(k.lower())
    earned = {
        "renewables": F.arrays_overlap(scope, F.array(*map(F.lit, ("solar_pv", "battery_storage", "ev_charging")))),
        "key_account": F.coalesce("key_account", F.lit(False)) | key_owner,
        "design_build_or_bim": F.arrays_overlap(scope, F.array(*map(F.lit, ("design_build_engineering", "bim_coordination")))),
        "sustainability": F.array_contains(flags, "sustainability"),
        "requested_by_name": F.array_contains(flags, "requested_by_name"),
    }
    d = d.withColumn("raw", raw)
    d = d.withColumn("boosts", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in earned.items()])))
    total = F.col("raw")
    for k, c in earned.items():
        total = total + F.when(F.coalesce(c, F.lit(False)), p.boosts[k]).otherwise(0)
    passed = lambda c: F.coalesce(F.col(c) < now, F.lit(False))
    labour = F.array_contains(flags, "union_required") | F.array_contains(flags, "pla")
    limits = [
        ("no_electrical_scope", F.col("trade_relevance") == "none"),
        ("open_shop", F.array_contains(flags, "open_shop_indicated") & ~labour),
        ("mandatory_prebid_passed", F.coalesce("prebid_mandatory", F.lit(False)) & passed("prebid_at") & ~F.col("status").isin("bidding", "submitted")),
        ("due_passed", passed("bid_due") & ~F.col("status").isin("submitted", "won", "lost")),
        ("above_hard_max", F.coalesce(F.col("electrical_value") > p.size_band[-1], F.lit(False))),
        ("residential", F.col("project_type") == "residential_single_family"),
    ]
    blocked = F.col("tier") == "blocked"
    d = d.withColumns({"__t0": F.when(blocked, 0.0).otherwise(total), "__c0": F.when(blocked, "gc_blocked")})
    for i, (name, holds) in enumerate(limits, 1):  # each is recorded only where it lowers what stands by then
        bites = holds & (F.col(f"__t{i - 1}") > p.caps[name])
        d = d.withColumns({f"__t{i}": F.when(bites, float(p.caps[name])).otherwise(F.col(f"__t{i - 1}")), f"__c{i}": F.when(bites, name)})
    n = len(limits)
    final = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(f"__t{n}")))).cast("int")
    d = d.withColumns({"raw_weighted": F.bround("raw", 3), "caps": F.array_compact(F.array(*[F.col(f"__c{i}") for i in range(n + 1)])), "score": final})
    return d.withColumn("band", band(F.col("score"), p)).drop("raw", *[f"__{x}{i}" for x in "tc" for i in range(n + 1)])


def ranked_factors(p: Profile = Profile()) -> tuple[Column, Column]:
    """(up to three factors that help most, the one that hurts most), by points above and below knowing nothing; ties keep the profile's order."""
    neutral = {"project_type": p.type_table.get("unknown", 0.5), "size": p.size_unknown, "gc": p.tier["unknown"], "distance": p.distance_unknown, "timing": p.timing_unknown, "bid_type": p.bid_type["unknown"]}
    rows = F.array(*[F.struct((-(F.col(f"f_{k}") - v) * p.weights[k] * 100).alias("loss"), F.lit(i).alias("i"), F.lit(k).alias("factor")) for i, (k, v) in enumerate(neutral.items())])
    up = F.slice(F.array_sort(F.filter(rows, lambda r: r["loss"] < -1e-9)), 1, 3)
    down = F.slice(F.array_sort(F.transform(F.filter(rows, lambda r: r["loss"] > 1e-9), lambda r: F.struct((-r["loss"]).alias("loss"), r["i"].alias("i"), r["factor"].alias("factor")))), 1, 1)
    return F.transform(up, lambda r: r["factor"]), F.transform(down, lambda r: r["factor"])


def others_due_same_week(opps: DataFrame, board: list[str], statuses: tuple[str, ...] = ("bidding",)) -> DataFrame:
    """Adds how many other rows of a board with one of the statuses are due in the same week: one aggregate, joined back."""
    week = F.date_trunc("week", F.col("bid_due"))
    d = opps.withColumn("__week", week)
    open_ = F.col("status").isin(*statuses)
    counts = d.filter(open_ & F.col("__week").isNotNull()).groupBy(*board, "__week").agg(F.count("*").alias("__n"))
    return d.join(counts, [*board, "__week"], "left").withColumn("others_due_same_week", F.coalesce("__n", F.lit(0)) - F.when(open_ & F.col("__n").isNotNull(), 1).otherwise(0)).drop("__week", "__n")


def changed_scores(previous: DataFrame, current: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """Rows of current that differ from the last stored score of the same key, or have none: what is worth writing."""
    old = previous.select(*keys, F.col(hash_col).alias("__old"))
    return current.join(old, keys, "left").filter(F.col("__old").isNull() | (F.col("__old") != F.col(hash_col))).drop("__old")
