"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from sluice.llm import queries
from sluice.llm import runs as R
from tests.llm.test_llm import SF

sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def plain_runs(words):
    """(start, length, period) by trying every period; of equal stretches the least period."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([codes[w] for w in words], np.int64), {}
    for p in range(1, len(x) // 3 + 1):
        same = np.concatenate(([False], x[:-p] == x[p:], [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b + p - a >= max(24, 3 * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapsed(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_nested_periods():
    rnd, total = random.Random(13), 0

    def build(depth, letters):
        if depth == 0:
            return [rnd.choice(letters) for _ in range(rnd.randint(1, 8))]
        if rnd.random() < 0.6:
            b = build(depth - 1, letters)
            return (b * rnd.randint(2, 9))[: -rnd.randint(0, len(b)) or None]
        return build(depth - 1, letters) + build(depth - 1, letters)

    for _ in range(1200):
        letters = list(range(rnd.choice([1, 2, 3, 6])))
        x = build(rnd.choice([1, 2, 3, 4, 5]), letters)[: rnd.choice([60, 200, 500])]
        y = [rnd.choice(letters) for _ in range(rnd.randint(0, 20))] + [0] * rnd.randint(0, 40)
        want = plain_runs(x) + [(a + len(x), n, p) for a, n, p in plain_runs(y)]
        got = R.find_runs(np.array([100 + v for v in x] + [200 + v for v in y], np.int64))
        assert list(zip(*(g.tolist() for g in got))) == want
        total += len(want)
    assert total > 1000


@pytest.mark.parametrize("n, period", [(300_000, 1), (300_000, 1000), (250_000, 77_777)])
def test_long_runs(n, period):
    x = np.arange(n) % period
    assert [v.tolist() for v in R.find_runs(x)] == [[0], [n], [period]]
    assert [len(v) for v in R.find_runs(np.arange(n))] == [0, 0, 0] and [len(v) for v in R.find_runs(np.empty(0, np.int64))] == [0, 0, 0]


def test_wavelet_by_sorting():
    rnd = np.random.default_rng(5)
    v = rnd.permutation(500)[:300]
    w = R.Wavelet(v, 9)
    lo = rnd.integers(0, 300, 400)
    hi = np.array([rnd.integers(a, 301) for a in lo])
    t = rnd.integers(0, 511, 400)
    assert w.below(lo, hi, t).tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, t)]
    full = hi > lo
    k = np.array([rnd.integers(0, max(1, b - a)) for a, b in zip(lo, hi)])
    assert w.kth(lo[full], hi[full], k[full]).tolist() == [int(np.sort(v[a:b])[c]) for a, b, c in zip(lo[full], hi[full], k[full])]


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 2000)
    texts = [None, "", " \t\n", "a", "x " * 24, "x " * 23, "\x0bé  ü\x0c" * 40, "a b " * 5 + "c " * 30, "p q r " * 9 + "p q", "日本 " * 50_000, ("k " * 40 + "stop ") * 4, "a\xa0b " * 30, "a\x1cb c " * 20]
    rows = [(None, "z " * 30)] + [(i % 9, t) for i, t in enumerate(texts * 2)]
    d = spark.createDataFrame([(*r, 0, "") for r in rows], "doc_id long, text string, n_words long, runs string")
    got = R.periodic_runs(d).collect()
    want = []
    for i, t in rows:
        w = [b.decode() for b in (t or "").encode().split()]
        r = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        want.append((i, len(w), r, collapsed(w, r)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=key) == sorted(want, key=key)
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op13_by_all_periods(spark):
    texts = {i: t or "" for i, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)}
    got, found = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}, 0
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = [b.decode() for b in t.encode().split()]
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        found += len(runs)
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{n},{p}\n" for a, n, p in runs)), sha(collapsed(w, runs)))
        assert tuple(got[i])[1:] == want, i
    assert found > 5
