"""Streams: de-duplication within a watermark, tumbling and session windows, poison counts, incremental digests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with zone; tables may hold one without."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def recent_unique(df: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Rows whose key wasn't seen within the watermark's span; state older than it is dropped."""
    return timed(df, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def bucket_counts(df: DataFrame, time: str, keys: list[str], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts by keys: the buckets that make repeated jobs idempotent."""
    d = timed(df, time).withWatermark(time, late)
    return d.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *keys, "n")


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    d = timed(df, time).withWatermark(time, late)
    return d.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def poison_counts(attempts: DataFrame, key: str, ok: str, most: int = 5) -> DataFrame:
    """Failures of each key since its last success, and whether it is given up; success clears the state."""
    kind = dict(attempts.dtypes)[key]

    def step(keys: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for batch in batches:
            for good in batch[ok]:
                n = 0 if good else n + 1
        if n:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [keys[0]], "attempts": [n], "given_up": [n >= most]})

    return attempts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, attempts long, given_up boolean", "n long", "update", GroupStateTimeout.NoTimeout)
