"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of marks. Fixed masks pick some positions of a window and ignore the others, so a hit
survives substitutions at ignored places. The benchmark's seed hashes make an index; documents' hashes first pass a Bloom
bitmap that every task holds, sized by the index, and those that pass are joined with the index by hash. A join result names a
document, an item and a diagonal; each diagonal is verified once by comparing the hashes of the words of both along it. Overlaps
are the best-scoring runs (+1 for equal words, -MISS for others), the best first and then those beside it. A run is reported when
its score reaches MIN_SCORE, or when it spans SPAN of the item and EQUAL of the item's words are equal in it, so short items may
differ too. Items of SHORT to WINDOW - 1 words have no room for a mask: they are sought whole and word for word.

Edge cases: null and empty texts and items match nothing; items of fewer than SHORT words are never reported, as such words
stand in any text; an item with a null item_id matches nothing; a document with a null doc_id is searched like any other; equal
items and documents all are reported; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import WordHash, fresh, lean, load, materialize, mix64

# Fixed masks of weight 6: 1 counts, 0 is ignored. Each leaves out a residue of 3, 4, 5 or 6, so one of them fits between changes that recur so often.
MASKS = ("111111", "1111011", "1110111", "11011011")
SHORT, WINDOW = 4, 8  # words of the shortest items, and of the longest mask
MIN_SCORE = 8.0
SPAN, EQUAL = 0.8, 2 / 3
MISS = 1.0
BLOOM_BITS = (1 << 23, 1 << 28)  # of the bitmap at least and at most; SPARSE bits a seed between
SPARSE = 16
CHUNK = 32_768  # words of documents that are hashed in one array; a longer text is one
INDEX_ROWS = 1_000_000  # seeds up to which the index is broadcast; beyond it the join shuffles
_MARKS = re.compile(r"[^\w]+")
_P = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(64)]


def bare(word: bytes) -> bytes:
    if word.isalnum():  # ASCII letters and digits alone
        return word.lower()
    return _MARKS.sub("", word.decode("utf-8", "surrogatepass").lower()).encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_array(text: str | None, hashes: WordHash) -> np.ndarray:
    """Hashes of the words that aren't marks alone."""
    w = hashes.array(words_of(text))
    return w[w != 0]


def seeds(w: np.ndarray) -> Iterator[np.ndarray]:
    """Of each mask the hash of the picked words at each place."""
    times = [w * p for p in _P[: max(mask.count("1") for mask in MASKS)]]
    for m, mask in enumerate(MASKS):
        n = len(w) - len(mask) + 1
        if n > 0:
            h = np.full(n, np.uint64(m + 1))
            for k, picked in enumerate(i for i, c in enumerate(mask) if c == "1"):
                h += times[k][picked : picked + n]
            yield mix64(h)


def whole_seeds(w: np.ndarray, lengths: list[int]) -> Iterator[np.ndarray]:
    """Of each length the hash of so many words at each place."""
    for length in lengths:
        n = len(w) - length + 1
        if n > 0:
            h = np.full(n, np.uint64(len(MASKS) + length))
            for k in range(length):
                h = h + w[k : k + n] * _P[k]
            yield mix64(h)


def best_run(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, float]:
    """(start, stop, equal words, score) of the best-scoring run of two aligned word arrays."""
    gain = np.where(x == y, 1.0, -MISS)
    total = np.concatenate(([0.0], np.cumsum(gain)))
    low = np.minimum.accumulate(total)
    stop = int(np.argmax(total - low))
    start = int(np.argmin(total[: stop + 1]))
    return start, stop, int((x[start:stop] == y[start:stop]).sum()), float(total[stop] - total[start])


def runs(x: np.ndarray, y: np.ndarray, words: int) -> list[tuple[int, int, int, float]]:
    """The reported runs of an item of so many words along a diagonal: the best one, then those in what lies beside it."""
    out, parts = [], [(0, len(x))]
    while parts:
        a, b = parts.pop()
        start, stop, equal, score = best_run(x[a:b], y[a:b])
        if score >= MIN_SCORE or (words >= SHORT and equal >= EQUAL * words and stop - start >= SPAN * words):
            out.append((a + start, a + stop, equal, score))
            parts += [(a, a + start), (a + stop, b)]
    return out


def seed_index(benchmark: DataFrame) -> DataFrame:
    """(hash, item_id, place, short) of every seed of every item, written; short: the words of an item without room for a mask, else 0."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash(bare)
        for batch in batches:
            for item, text in zip(batch["item_id"].tolist(), batch["text"].tolist()):
                w = word_array(text, hashes)
                for h in seeds(w) if len(w) >= WINDOW else whole_seeds(w, [len(w)]) if len(w) >= SHORT else ():
                    yield pd.DataFrame({"hash": h.view(np.int64), "item_id": int(item), "place": np.arange(len(h)), "short": len(w) if len(w) < WINDOW else 0})

    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return materialize(items.mapInPandas(lean(index), "hash long, item_id long, place long, short int"), "seed-index")


def bloom(index: DataFrame, seeds_in_all: int) -> np.ndarray:
    """A bitmap of a power of two of places, SPARSE for each seed within BLOOM_BITS; two of them are set for each hash."""
    size = min(BLOOM_BITS[1], max(BLOOM_BITS[0], 1 << (SPARSE * seeds_in_all).bit_length()))
    bits = np.zeros(size // 64, np.uint64)
    spot = F.explode(F.array(F.pmod("hash", F.lit(size)), F.pmod(F.shiftright("hash", 32), F.lit(size)))).alias("spot")
    words = index.select(spot).distinct().groupBy(F.shiftright("spot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("v"))
    for r in words.toLocalIterator():  # a row for each 64 places at most
        bits[r["w"]] = np.uint64(r["v"] & 0xFFFFFFFFFFFFFFFF)
    return bits


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in h of the hashes that pass the bitmap."""
    at, m = np.arange(len(h)), np.uint64(64 * len(bits) - 1)
    for shift in (np.uint64(0), np.uint64(32)):  # few pass the first
        spot = (h[at] >> shift if shift else h) & m
        at = at[(bits[(spot >> np.uint64(6)).view(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
    return at


def candidates(bits: np.ndarray, words: list[list[bytes]], short: list[int], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which of the documents, hash, place in it) of the seeds that pass the bitmap. All documents lie in one array, behind one
    another; a seed that reaches beyond its document doesn't count."""
    w = hashes.array(list(itertools.chain.from_iterable(words)))
    kept = np.concatenate(([0], np.cumsum(w != 0)))  # marks alone don't count
    ends = kept[np.cumsum([len(x) for x in words])]
    starts, w = np.concatenate(([0], ends[:-1])), w[w != 0]
    found = []
    for span, h in itertools.chain(zip(map(len, MASKS), seeds(w)), zip(short, whole_seeds(w, short))):
        at = _in(bits, h)
        doc = np.searchsorted(ends, at, "right")
        inside = at + span <= ends[doc]
        at, doc = at[inside], doc[inside]
        found.append((doc, h[at].view(np.int64), at - starts[doc]))
    none = np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip((none,) * 3, *found)))


def _key() -> Column:
    """What a document goes by: its id, without one its text's hash."""
    return F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce("text", F.lit("")), 256)))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_words, n_equal, score: verified overlaps, places and lengths in words."""
    found = keyed_overlaps(docs, benchmark)
    return found.select(F.when(~F.col("key").startswith("text:"), F.col("key")).cast("long").alias("doc_id"), *[c for c in found.columns if c != "key"])


def keyed_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """overlaps() by _key() instead of doc_id."""
    spark = docs.sparkSession
    texts = docs.select(_key().alias("key"), "text")
    index = seed_index(benchmark)
    rows = index.count()
    bits = spark.sparkContext.broadcast(bloom(index, rows))
    short = sorted(r["short"] for r in index.filter("short > 0").select("short").distinct().collect())  # WINDOW - SHORT rows at most

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, bitmap = WordHash(bare), bits.value
        for batch in batches:
            keys, words, size = [], [], 0
            for key, text in zip(itertools.chain(batch["key"].tolist(), [None]), itertools.chain(batch["text"].tolist(), [None])):
                if key is None or size >= CHUNK:
                    if words:
                        doc, h, at = candidates(bitmap, words, short, hashes)
                        yield pd.DataFrame({"key": np.array(keys, object)[doc], "hash": h, "at": at})
                    keys, words, size = [], [], 0
                if key is not None:
                    keys.append(key)
                    words.append(words_of(text))
                    size += len(words[-1])

    hits = texts.mapInPandas(lean(search), "key string, hash long, at long")
    small = rows <= INDEX_ROWS
    diagonals = hits.join(F.broadcast(index) if small else index, "hash").select("key", "item_id", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    diagonals = materialize(diagonals, "diagonals")
    hit_texts = texts.join(diagonals.select("key").distinct(), "key", "left_semi")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash(bare)
        last, w = None, None
        for batch in batches:
            out = []
            for key, text, item, item_text, diagonal in batch[["key", "text", "item_id", "item", "diagonal"]].itertuples(index=False):
                if last != (key, text):
                    last, w = (key, text), word_array(text, hashes)
                v = word_array(item_text, hashes)
                lo, hi = max(0, -diagonal), min(len(v), len(w) - diagonal)
                for start, stop, equal, score in runs(v[lo:hi], w[lo + diagonal : hi + diagonal], len(v)):
                    out.append((key, item, lo + start + diagonal, lo + start, stop - start, equal, score))
            if out:
                yield pd.DataFrame(out, columns=["key", "item_id", "doc_start", "item_start", "n_words", "n_equal", "score"])

    both = diagonals.join(items, "item_id").join(hit_texts, "key")
    return both.mapInPandas(lean(verify), "key string, item_id long, doc_start long, item_start long, n_words long, n_equal long, score double").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any verified overlap, with all their columns. Without a doc_id, a document goes by its text."""
    key, hit = fresh(docs, "key"), fresh(docs, "hit_key")
    hits = materialize(keyed_overlaps(docs, benchmark).select(F.col("key").alias(hit)).distinct(), "contaminated")
    return docs.withColumn(key, _key()).join(hits, F.col(key) == F.col(hit), "left_anti").drop(key)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
