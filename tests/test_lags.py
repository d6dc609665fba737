import numpy as np
import pandas as pd

from sluice.operators import lags


def rows(spark):
    r = np.random.default_rng(3)
    key = np.where(np.arange(30_000) % 3 == 0, 0, r.integers(1, 40, 30_000))  # one key has a third of all rows
    value = np.select([key % 4 == 0, key % 4 == 1, key % 4 == 2], [r.normal(0, 50, 30_000), np.where(r.random(30_000) < 0.97, 1.0, 2.0), r.integers(0, 3, 30_000)], r.lognormal(0, 3, 30_000))
    d = pd.DataFrame({"key": key, "value": value, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 86_400, 30_000), "s")})
    odd = spark.createDataFrame([(90, None), (91, float("nan")), (91, 5.0), (None, 7.0), (None, 9.0), (92, float("inf")), (92, float("-inf"))], "key long, value double").selectExpr("key", "value", "timestamp'2024-01-01' AS ts")
    return d, spark.createDataFrame(d).unionByName(odd)


def test_nearest_rank_is_exact_for_ties_and_a_hot_key(spark):
    d, df = rows(spark)
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["key"]: r["nearest"] for r in lags.nearest_rank_exact(df, ["key"], "value", q).collect()}
        want = {k: np.sort(g.to_numpy())[round(q * (len(g) - 1))] for k, g in d.groupby("key")["value"]}
        assert {k: got[k] for k in want} == want
        assert set(got) == {*want, 91, 92, None} and got[91] == 5.0 and got[None] in (7.0, 9.0)


def test_empty(spark):
    _, df = rows(spark)
    assert lags.nearest_rank_exact(df.limit(0), ["key"], "value", 0.5).count() == 0
    assert lags.hourly_sketches(df.filter("key = 90"), ["key"], "ts", "value").count() == 0


def test_merged_sketches_stay_within_their_error(spark):
    d, df = rows(spark)
    kept = lags.hourly_sketches(df.filter("key < 90"), ["key"], "ts", "value")
    assert kept.agg({"n": "sum"}).first()[0] == len(d)
    for r in lags.merged_percentiles(kept, ["key"], {"p50": 0.5, "p95": 0.95}).collect():
        x = np.sort(d.loc[d["key"] == r["key"], "value"].to_numpy())
        assert r["n"] == len(x)
        for name, q in (("p50", 0.5), ("p95", 0.95)):
            low, high = np.searchsorted(x, r[name], "left") / len(x), np.searchsorted(x, r[name], "right") / len(x)
            assert low - 0.02 <= q <= high + 0.02
