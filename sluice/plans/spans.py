"""Queries over long spans of polls: sketches by hour and exact nearest ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import lags
from sluice.plans.registry import query
from sluice.sources.tables import load


@query("SELECT user_id % 20 AS source_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, count(*) AS sketched, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def lag_sketches(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    kept = lags.hourly_sketches(e.select((F.col("user_id") % 20).alias("source_id"), "ts", "value"), ["source_id"], "ts", "value")
    sketched = F.kll_sketch_get_n_double("sketch").alias("sketched")
    return kept.select("source_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", sketched, F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("WITH r AS (SELECT user_id % 20 AS source_id, event_type, value, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id % 20, event_type) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id % 20, event_type ORDER BY value)) SELECT source_id, event_type, round(value, 6) AS nearest FROM r WHERE k = round_even(0.95 * (n - 1), 0)")
def lag_nearest_unsorted(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    rows = e.select((F.col("user_id") % 20).alias("source_id"), "event_type", "value")
    return lags.nearest_rank_exact(rows, ["source_id", "event_type"], "value", 0.95).withColumn("nearest", F.round("nearest", 6))
