"""The triage tables as views of the driver's tables: opportunities from orders, organisations from customers, messages from
documents and pages, polls and jobs from events. The same views stand here as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import constants as K
from sluice.functions.geo import road_miles
from sluice.sources.tables import load

NOW_TEXT = "2001-09-01 06:30:00"
EVENTS_NOW_TEXT = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


def events_now():
    return F.lit(EVENTS_NOW_TEXT).cast("timestamp_ntz")


SEGMENT_TYPE = {
    "AUTOMOBILE": "light_industrial_utility", "BUILDING": "commercial_office", "FURNITURE": "retail_restaurant", "HOUSEHOLD": "multifamily_hotel_mixed_use",
    "MACHINERY": "heavy_industrial",
}
PRIORITY_BID = {"1-URGENT": "hard_bid", "2-HIGH": "negotiated", "3-MEDIUM": "design_build", "4-NOT SPECIFIED": "budget", "5-LOW": "gmp"}
STATUS = {"O": "bidding", "P": "undecided", "F": "submitted"}
TIERS = ["A", "B", "C", "D", "blocked", "unknown"]


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders", "customer")
    pick = lambda table, key, rest: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(rest))
    d = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    days = (F.col("o_orderkey") * 7) % 60 - 5
    d = d.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gc_id"), F.concat(F.lit("Project "), F.col("o_orderkey").cast("string")).alias("name"),
        (F.col("o_totalprice") * 20).alias("stated_project_value"), pick(STATUS, F.col("o_orderstatus"), "new").alias("status"), F.col("o_orderdate").alias("first_seen"),
        (now() + F.make_dt_interval(days=days.cast("int"))).alias("bid_due"), pick(SEGMENT_TYPE, F.col("c_mktsegment"), "other").alias("project_type"),
        F.element_at(F.array(*map(F.lit, TIERS)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("tier"), pick(PRIORITY_BID, F.col("o_orderpriority"), "unknown").alias("bid_type"),
        F.when(F.col("c_nationkey") % 3 == 0, "public").otherwise("private").alias("sector"), (F.lit(36.0) + F.col("c_nationkey") % 9 * 1.0).alias("lat"), (F.lit(-84.0) + F.col("c_nationkey") % 7 * 1.0).alias("lon"),
        F.array_compact(F.array(F.when(F.col("o_orderkey") % 11 == 0, "open_shop_indicated"), F.when(F.col("o_orderkey") % 22 == 0, "union_required"), F.when(F.col("o_orderkey") % 13 == 0, "sustainability"))).alias("flags"),
        F.array_compact(F.array(F.when(F.col("o_orderkey") % 5 == 0, "solar_pv"), F.when(F.col("o_orderkey") % 7 == 0, "bim_coordination"))).alias("scope_items"),
        (F.col("c_acctbal") > 9000).alias("key_account"), F.lit(False).alias("owner_direct"), F.when(F.col("o_orderkey") % 17 == 0, "partial").otherwise("primary").alias("trade_relevance"),
    )
    return d.withColumn("distance_miles", road_miles(F.lit(K.SHOP[0]), F.lit(K.SHOP[1]), F.col("lat"), F.col("lon")))


_case = lambda table, col, rest: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{rest}' END"
NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"
OPPORTUNITIES = f"""opp0 AS (
 SELECT o_orderkey AS id, o_custkey AS gc_id, 'Project ' || o_orderkey AS name, o_totalprice * 20 AS stated_project_value, {_case(STATUS, 'o_orderstatus', 'new')} AS status,
  o_orderdate AS first_seen, {NOW_SQL} + to_days(CAST((o_orderkey * 7) % 60 - 5 AS INTEGER)) AS bid_due, (o_orderkey * 7) % 60 - 5 AS due_days, {_case(SEGMENT_TYPE, 'c_mktsegment', 'other')} AS project_type,
  (['A','B','C','D','blocked','unknown'])[CAST(c_custkey % 6 AS INTEGER) + 1] AS tier, {_case(PRIORITY_BID, 'o_orderpriority', 'unknown')} AS bid_type,
  CASE WHEN c_nationkey % 3 = 0 THEN 'public' ELSE 'private' END AS sector, 36.0::DOUBLE + c_nationkey % 9 AS lat, -84.0::DOUBLE + c_nationkey % 7 AS lon,
  o_orderkey % 11 = 0 AS open_shop, o_orderkey % 22 = 0 AS union_required, o_orderkey % 13 = 0 AS sustainability, o_orderkey % 5 = 0 AS solar, o_orderkey % 7 = 0 AS bim,
  c_acctbal > 9000 AS key_account, CASE WHEN o_orderkey % 17 = 0 THEN 'partial' ELSE 'primary' END AS trade_relevance
 FROM orders JOIN customer ON o_custkey = c_custkey),
opp AS (SELECT *, 1.3 * 2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - {K.SHOP[0]}) / 2), 2) + cos(radians({K.SHOP[0]})) * cos(radians(lat)) * pow(sin(radians(lon - {K.SHOP[1]}) / 2), 2))) AS distance_miles FROM opp0)"""


def _table(values: dict, name: str) -> str:
    return f"{name}(k, v) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in values.items()) + ")"


SCORED = f"""{OPPORTUNITIES},
{_table(K.TYPE_FACTOR, 'type_factor')}, {_table(K.ELECTRICAL_SHARE, 'share')}, {_table(K.GC_TIER, 'tiers')}, {_table(K.BID_TYPE, 'bids')},
weeks AS (SELECT gc_id, date_trunc('week', bid_due) AS week, count(*) AS n FROM opp WHERE status = 'bidding' GROUP BY ALL),
s1 AS (SELECT opp.*, coalesce(weeks.n, 0) - CASE WHEN opp.status = 'bidding' THEN 1 ELSE 0 END AS others, nullif(stated_project_value, 0) * share.v AS electrical_value, type_factor.v * CASE WHEN trade_relevance = 'partial' THEN 0.6 ELSE 1 END AS f_project_type,
  tiers.v AS f_gc, bids.v AS f_bid_type
 FROM opp JOIN share ON share.k = project_type JOIN type_factor ON type_factor.k = project_type JOIN tiers ON tiers.k = tier
 JOIN bids ON bids.k = CASE WHEN bid_type = 'hard_bid' THEN CASE WHEN sector IN ('public', 'federal') THEN 'hard_bid_public' ELSE 'hard_bid_private' END ELSE bid_type END
 LEFT JOIN weeks ON weeks.gc_id = opp.gc_id AND weeks.week = date_trunc('week', opp.bid_due)),
s2 AS (SELECT *, CASE WHEN electrical_value IS NULL THEN 0.5 WHEN electrical_value < 75000 THEN 0 WHEN electrical_value <= 250000 THEN (electrical_value - 75000) / 175000
   WHEN electrical_value <= 4000000 THEN 1 WHEN electrical_value <= 8000000 THEN 1 - 0.8 * (electrical_value - 4000000) / 4000000
   WHEN electrical_value <= 15000000 THEN 0.2 - 0.2 * (electrical_value - 8000000) / 7000000 ELSE 0 END AS f_size,
  CASE WHEN distance_miles <= 25 THEN 1 WHEN distance_miles <= 50 THEN 1 - 0.3 * (distance_miles - 25) / 25 WHEN distance_miles <= 90 THEN 0.7 - 0.4 * (distance_miles - 50) / 40 ELSE 0.1 END AS f_distance,
  CASE WHEN due_days < 0 THEN 0 WHEN due_days < 3 THEN 0.2 WHEN due_days < 7 THEN 0.6 WHEN due_days <= 21 THEN 1 WHEN due_days <= 45 THEN 0.9 ELSE 0.7 END
   * CASE WHEN others >= 3 THEN 0.6 WHEN others = 2 THEN 0.8 ELSE 1 END AS f_timing FROM s1),
s3 AS (SELECT *, 0.25 * f_project_type * 100 + 0.25 * f_size * 100 + 0.25 * f_gc * 100 + 0.10 * f_distance * 100 + 0.10 * f_timing * 100 + 0.05 * f_bid_type * 100 AS raw FROM s2),
s4 AS (SELECT *, CASE WHEN tier = 'blocked' THEN 0 ELSE raw + CASE WHEN solar THEN 5 ELSE 0 END + CASE WHEN key_account THEN 8 ELSE 0 END + CASE WHEN bim THEN 3 ELSE 0 END + CASE WHEN sustainability THEN 2 ELSE 0 END END AS t0 FROM s3),
s5 AS (SELECT *, CASE WHEN open_shop AND NOT union_required AND t0 > 20 THEN 20 ELSE t0 END AS t1 FROM s4),
s6 AS (SELECT *, CASE WHEN due_days < 0 AND status NOT IN ('submitted', 'won', 'lost') AND t1 > 5 THEN 5 ELSE t1 END AS t2 FROM s5),
s7 AS (SELECT *, CASE WHEN electrical_value > 15000000 AND t2 > 15 THEN 15 ELSE t2 END AS t3 FROM s6),
scored AS (SELECT *, CAST(round_even(greatest(0, least(100, t3)), 0) AS INTEGER) AS score FROM s7),
banded AS (SELECT *, CASE WHEN score >= 70 THEN 'bid' WHEN score >= 45 THEN 'consider' WHEN score >= 20 THEN 'likely_pass' ELSE 'pass' END AS band FROM scored)"""
