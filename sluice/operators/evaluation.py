"""Calibration of scores against labels, and accuracy of extraction against its gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import constants as K

GOALS = {"precision": 0.80, "recall": 0.85}
GATES = {"bid_due": 0.97, "gc_name": 0.98, "project_type": 0.90, "size_band": 0.80, "kind": 0.97}


def truth(label):
    return F.lower(F.trim(label)).isin("bid", "1", "true", "yes")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV of opportunity_id, label; rows without an id say nothing and are left out."""
    return spark.read.csv(path, header=True, schema="opportunity_id string, label string").filter("trim(opportunity_id) <> ''")


def confusion(df: DataFrame, predicted: str, actual: str, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn with precision and recall (null on nothing to divide by), by keys."""
    p, a = F.col(predicted), F.col(actual)
    out = df.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    return out.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})


def confusion_sets(df: DataFrame, predicted: str, actual: str, first: str, second: str) -> DataFrame:
    """The confusion by one key, by another and overall, in one pass of grouping sets."""
    d = df.select(F.col(first), F.col(second), F.col(predicted).alias("p"), F.col(actual).alias("a"))
    out = d.groupingSets([[F.col(first)], [F.col(second)], []], F.col(first), F.col(second)).agg(
        F.count_if(F.col("p") & F.col("a")).alias("tp"), F.count_if(F.col("p") & ~F.col("a")).alias("fp"), F.count_if(~F.col("p") & F.col("a")).alias("fn"), F.count_if(~F.col("p") & ~F.col("a")).alias("tn")
    )
    return out


def by_band(df: DataFrame, actual: str) -> DataFrame:
    """Rows and positives of each band in the fixed order, empty bands too."""
    bands = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(K.BANDS)], "position int, band string")
    counts = df.groupBy("band").agg(F.count("*").alias("n"), F.count_if(actual).alias("positive"))
    return F.broadcast(bands).join(counts, "band", "left").select("position", "band", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positive", F.lit(0)).alias("positive"))


def field_accuracy(df: DataFrame, fields: list[str]) -> DataFrame:
    """Of columns <field> and expected_<field>: share correct and whether the gate is met; equal nulls are correct."""
    d = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"expected_{f}")).alias("ok")) for f in fields])).alias("r")).select("r.*")
    gates = F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv])
    out = d.groupBy("field").agg(F.count("*").alias("total"), F.count_if("ok").alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total")).withColumn("passed", F.col("accuracy") >= F.coalesce(F.try_element_at(gates, F.col("field")), F.lit(0.0)))


def size_band(value):
    return F.when(value.isNull(), "unknown").when(value <= 250_000, "<=250K").when(value <= 1_000_000, "<=1M").when(value <= 4_000_000, "<=4M").when(value <= 15_000_000, "<=15M").otherwise(">15M")


def llm_cost(tokens_in, tokens_out, price_in: float, price_out: float):
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
