"""Periodic runs of words: every maximal stretch that repeats itself at least three times, found by internal pattern matching.

Words of a batch of texts become numbers that no two texts share, so one index serves the whole batch:

* Basic factors: ranks of the stretches of 1, 2, 4, ... words at each place, by prefix doubling; only stretches that occur more
  than once are sorted on. The last ranks give the suffix array, and an entry's rank on level k is where the stretches equal to
  its first 2^k words begin there. Two places are compared in log n steps, forwards and backwards.
* A wavelet matrix over the suffix array (of places whose eight words occur again) answers how many entries of a range are
  below a place, and which is the k-th smallest; so the successor of a place within a range.

A run of period q has at least max(24, 3 q) words. So it holds a block of 2^k words, k the greatest with 2^k <= max(8, q), at a
multiple of 2^k, that occurs q words later within the run. Each block that occurs again asks for its occurrences in the window in
which q can lie. Up to two are candidates themselves. Three or more are a progression whose difference p is the block's period;
then the run isn't p-periodic throughout, so where the p-periodic stretch around the block and that around the progression
begin, or where they end, is q apart. Candidates are extended both ways and kept if long enough; of equal stretches the least
period stays.

A word is dropped if a run holds it behind the run's first period; what is kept, joined by one space, is the collapsed text.

Edge cases: a null text, an empty one or one of white space alone has no words, no runs and an empty collapsed text; a null
doc_id is kept; equal rows give equal results; an empty table gives no rows; other columns are ignored, whatever their names.
A task holds a slice of one batch (SLICE bytes or one longer text) and four bytes for each word and level; there are as many
levels as the longest repeated stretch has binary digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import load

LEAST, TIMES, BASE = 24, 3, 3  # words of a run, and periods; 2**BASE words are the smallest block: 3 * 2**BASE <= LEAST
SLICE = 4 << 20
SPACE = rb"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


class Factors:
    """Ranks of all stretches of 2^k numbers, and the suffix array."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        sorted_codes = codes[self.order]
        fresh = np.concatenate(([True], sorted_codes[1:] != sorted_codes[:-1])) if n else np.empty(0, bool)
        rank = np.full(n + 1, -1, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0)) if n else 0
        self.levels = [rank]
        at = np.arange(n, dtype=np.int64)
        step = 1
        while True:
            shared = ~(fresh & np.append(fresh[1:], True)) if len(fresh) else fresh
            at = at[shared]  # entries of the suffix array that are one of several on this level
            if not len(at):
                return
            places = self.order[at]
            key = rank[places].astype(np.int64) * (n + 1) + rank[np.minimum(places.astype(np.int64) + step, n)] + 1
            o = np.argsort(key, kind="stable")
            places, key = places[o], key[o]
            fresh = np.concatenate(([True], key[1:] != key[:-1]))
            self.order[at] = places
            rank = rank.copy()
            rank[places] = np.maximum.accumulate(np.where(fresh, at, 0))
            self.levels.append(rank)
            step *= 2

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on, i < j."""
        a, b = i.copy(), j.copy()
        for k in reversed(range(len(self.levels) - 1)):
            rank = self.levels[k]
            step = (rank[a] == rank[b]).astype(np.int64) << k
            a += step
            b += step
        return a - i

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i equal those before j, i < j."""
        a, b = i.copy(), j.copy()
        for k in reversed(range(len(self.levels) - 1)):
            rank = self.levels[k]
            room = a >= 1 << k
            step = (room & (rank[np.where(room, a - (1 << k), 0)] == rank[np.where(room, b - (1 << k), 1 if self.n > 1 else 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return i - a


class Wavelet:
    """A wavelet matrix: order statistics of any range of an array of numbers below 2**bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            bit = (values >> b) & 1
            upto = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append((b, upto, len(values) - int(upto[-1])))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many of the entries lo .. hi are below v."""
        count = np.zeros(len(lo), np.int64)
        for b, upto, zeros in self.levels:
            ones_lo, ones_hi = upto[lo], upto[hi]
            one = (v >> b) & 1 == 1
            count += np.where(one, (hi - ones_hi) - (lo - ones_lo), 0)
            lo, hi = np.where(one, zeros + ones_lo, lo - ones_lo), np.where(one, zeros + ones_hi, hi - ones_hi)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest, from 0, of the entries lo .. hi."""
        out = np.zeros(len(lo), np.int64)
        for b, upto, zeros in self.levels:
            ones_lo, ones_hi = upto[lo], upto[hi]
            small = (hi - ones_hi) - (lo - ones_lo)
            one = k >= small
            out |= one.astype(np.int64) << b
            k = np.where(one, k - small, k)
            lo, hi = np.where(one, zeros + ones_lo, lo - ones_lo), np.where(one, zeros + ones_hi, hi - ones_hi)
        return out


def candidates(f: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) among which each run of the codes has its period."""
    none = np.empty(0, np.int64)
    if len(f.levels) - 1 <= BASE:
        return none, none
    base = f.levels[BASE][f.order]
    kept = np.bincount(base, minlength=f.n)[base] > 1
    place = np.cumsum(kept) - kept
    wave = Wavelet(f.order[kept].astype(np.int64), int(f.n).bit_length())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(BASE, len(f.levels) - 1):
        b, rank = 1 << k, f.levels[k]
        i = np.arange(0, f.n, b, dtype=np.int64)
        size = np.bincount(rank[:-1], minlength=f.n)
        i = i[size[rank[i]] > 1]
        lo = place[rank[i]]
        hi = lo + size[rank[i]]
        # places of an equal block at most b apart: of one window its occurrences are one progression
        for near, far in ((1, b + 1), (b + 1, 2 * b)) if k == BASE else ((b, 2 * b),):
            before = wave.below(lo, hi, np.minimum(i + near, f.n))
            count = wave.below(lo, hi, np.minimum(i + far, f.n)) - before
            some = count > 0
            x, l, r, c, s = i[some], lo[some], hi[some], count[some], before[some]
            first = wave.kth(l, r, s)
            found.append((x, first - x))
            more = c > 1
            x, first, c = x[more], first[more], c[more]
            second = wave.kth(l[more], r[more], s[more] + 1)
            found.append((x[c == 2], (second - x)[c == 2]))
            many = c > 2
            x, first, p = x[many], first[many], (second - first)[many]
            begins = (first - f.backwards(first, first + p)) - (x - f.backwards(x, x + p))
            ends = (first + f.forwards(first, first + p)) - (x + f.forwards(x, x + p))
            found += [(x[ok], d[ok]) for d in (begins, ends) for ok in [(d >= near) & (d < far)]]
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def find_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period. Codes of different texts must differ."""
    f = Factors(codes)
    i, d = candidates(f)
    inside = i + d < f.n
    i, d = i[inside], d[inside]
    start, stop = i - f.backwards(i, i + d), i + d + f.forwards(i, i + d)
    long = stop - start >= np.maximum(LEAST, TIMES * d)
    start, stop, d = start[long], stop[long], d[long]
    o = np.lexsort((d, stop, start))
    start, stop, d = start[o], stop[o], d[o]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))) if len(o) else np.empty(0, bool)
    start, stop, d = start[least], stop[least], d[least]
    o = np.lexsort((d, start))
    return start[o], (stop - start)[o], d[o]


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())


def runs_of_texts(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(n_words, runs, collapsed) of a slice of binary texts."""
    lists = pc.split_pattern_regex(texts, SPACE.decode())
    parents, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(words), 0)
    parents, words = parents.filter(real).to_numpy(), words.filter(real)
    coded = words.dictionary_encode()
    codes = parents.astype(np.int64) * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    n = np.bincount(parents, minlength=len(texts)).astype(np.int64)
    start, length, period = find_runs(codes)
    owner = parents[start] if len(start) else np.empty(0, np.int64)
    parts = [pa.array(start - (np.cumsum(n) - n)[owner]), pa.array(length), pa.array(period)]
    runs = pa.ListArray.from_arrays(_offsets(np.bincount(owner, minlength=len(texts))), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    stays = np.cumsum(change)[:-1] == 0
    kept = pa.ListArray.from_arrays(_offsets(np.bincount(parents[stays], minlength=len(texts))), words.filter(pa.array(stays)))
    return pa.array(n), runs, pc.binary_join(kept, pa.scalar(b" ", words.type))


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, number) of rows of about `most` bytes together; a larger one stands alone."""
    at, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > at and total + size > most:
            yield at, k - at
            at, total = k, 0
        total += size
    if len(sizes):
        yield at, len(sizes) - at


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), collapsed, of doc_id and text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw = b.column("text").cast(pa.string()).view(pa.binary())
            for at, rows in slices(pc.binary_length(raw).to_numpy()):
                n, runs, collapsed = runs_of_texts(raw.slice(at, rows))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, rows), n, runs, collapsed.view(pa.string())], schema=OUT)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(batches, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period; of equal ones the first."""
    stronger = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(stronger(best, r), r).otherwise(best))


def _repeating(docs: DataFrame) -> DataFrame:
    """The contract's texts: of one doc_id in ten the words from some place on repeat with some period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    a = F.when(n > 0, F.col("g") % n)
    d = d.select("doc_id", "text", "words", a.alias("a"), F.when(n > 0, 1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p"))
    other = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(other, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = periodic_runs(_repeating(load(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = F.col("best")
    return d.select("doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
