"""Packing documents into sequences of bounded length by length patterns.

Documents become pieces of at most `capacity` tokens. Their histogram of lengths (at most `capacity` numbers) goes to the
driver, which enumerates patterns of two to four lengths that fill a sequence, fits repeat counts to the histogram by
non-negative least squares, rounds them down, and fills what is left length by length, the best fitting length first, again as
patterns with counts. Pieces then take the places of their length by rank; ranks are counted in salted groups, so that a
length which a third of all pieces share isn't one group.

Edge cases: a null or empty text is the end id alone; a document of exactly `capacity` tokens is one piece; equal documents
are packed one by one; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import give_back, load, materialize
from sluice.llm.tokens import END_ID, encode_slices, encoder

CAPACITY = 1024
PIECES = 150_000  # pieces of text whose ids a worker keeps
PER_LENGTH = 12  # patterns of three that start with a length, and as many of four


def piece_rows(docs: DataFrame, path: str, *, kind: str = "byte", capacity: int = CAPACITY, end_id: int = END_ID, most: int = PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids cut from its end, so only the first piece can be short."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        enc, end = encoder(path, kind, most), struct.pack("<I", end_id)
        for batch in batches:
            owners = batch["doc_id"].tolist()
            rows = []
            for i, ids in encode_slices(batch["text"].tolist(), enc):
                ids += end
                n = len(ids) // 4
                stops = range(n - capacity * ((n - 1) // capacity), n + 1, capacity)
                for piece, stop in enumerate(stops):
                    start = max(0, stop - capacity)
                    rows.append((owners[i], piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([None if pd.isna(d) else int(d) for d in out["doc_id"]], dtype="Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Lengths, longest first, that fill a sequence: for each length its best partner, and spread choices of three and four."""
    have = np.array(sorted(length for length, n in hist.items() if n and length < capacity), np.int64)
    if not len(have):
        return []
    fit = lambda room: have[np.searchsorted(have, room, "right") - 1] if room >= have[0] else 0
    found = set()
    for a in have.tolist():
        b = int(fit(capacity - a))
        found.add(tuple(sorted((x for x in (a, b) if x), reverse=True)))
        smaller = have[(have <= a) & (have <= capacity - a)]
        for b in smaller[np.unique(np.linspace(0, len(smaller) - 1, PER_LENGTH).astype(int))].tolist() if len(smaller) else []:
            c = int(fit(capacity - a - b))
            if c:
                found.add(tuple(sorted((a, b, c), reverse=True)))
                d = int(fit((capacity - a - b) // 2))
                e = int(fit(capacity - a - b - d)) if d else 0
                if e:
                    found.add(tuple(sorted((a, b, d, e), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(pats: list[tuple[int, ...]], hist: dict[int, int], capacity: int, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of the patterns' lengths to the histogram, by multiplicative updates."""
    rows = np.concatenate([np.full(len(p), i) for i, p in enumerate(pats)])
    cols = np.concatenate([np.array(p) for p in pats])
    h = np.zeros(capacity + 1)
    for length, n in hist.items():
        h[length] = n
    x = np.full(len(pats), h.sum() / max(1, len(rows)) + 1e-9)
    want = np.bincount(rows, h[cols], len(pats))
    for _ in range(rounds):
        made = np.bincount(cols, x[rows], capacity + 1)
        x = x * want / np.maximum(np.bincount(rows, made[cols], len(pats)), 1e-12)
    return x


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which together use the histogram up."""
    left = {length: n for length, n in hist.items() if n}
    out: list[tuple[tuple[int, ...], int]] = []

    def take(p: tuple[int, ...], most: int) -> None:
        uses = Counter(p)
        n = min(most, *(left.get(length, 0) // k for length, k in uses.items()))
        if n > 0:
            out.append((p, n))
            for length, k in uses.items():
                left[length] -= n * k

    if capacity in left:
        take((capacity,), left[capacity])
    full = [p for p in patterns(left, capacity) if sum(p) == capacity]
    if full:
        x = fit_counts(full, left, capacity)
        for i in np.argsort(-x, kind="stable").tolist():
            take(full[i], int(x[i]))
    while True:
        have = sorted((length for length, n in left.items() if n), reverse=True)
        if not have:
            return out
        p, room, spare = [have[0]], capacity - have[0], dict(left)
        spare[have[0]] -= 1
        for length in have:
            while length <= room and spare[length] > 0:
                p.append(length)
                spare[length] -= 1
                room -= length
        take(tuple(p), 1 << 62)


def places(planned: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, stop rank, first sequence, pieces of the length in a sequence, offset of the first of them)."""
    rows, used, seq = [], Counter(), 0
    for p, n in planned:
        at = 0
        for length, k in Counter(p).items():
            rows.append((length, used[length], used[length] + n * k, seq, k, at))
            used[length] += n * k
            at += length * k
        seq += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id, offset to written pieces."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = sum(hist.values())
    salts = max(1, min(4096, rows // 500))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    table = places(plan(hist, capacity))  # a few rows for each length: bounded by the capacity, not by the input
    seats = F.broadcast(spark.createDataFrame(table, "length long, lo long, hi long, seq long, per long, at long"))
    return ranked.join(seats, (ranked["length"] == seats["length"]) & (ranked["rank"] >= seats["lo"]) & (ranked["rank"] < seats["hi"])).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("seq") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(F.col("rank") - F.col("lo"), F.col("per")) * ranked["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, most: int = PIECES) -> DataFrame:
    """most: pieces of text whose ids a worker keeps."""
    return pack(materialize(piece_rows(docs, path, capacity=capacity, most=most), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
