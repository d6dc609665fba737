"""Token-id files: Simple-8b word-aligned coding with escapes and per-block offsets.

File: magic; blocks of 64-bit words; footer (npz-free, plain arrays): per block its first word, first id and counts, per
document its id and number of tokens; the footer's length; magic. A word holds a 4-bit selector above 60 payload bits:
selector s packs COUNT[s] ids of WIDTH[s] bits; selector 15 is the escape: the following word is one id of up to 64 bits.

Edge cases: a null text counts as empty and gives the end id only; a null doc_id is kept, sorts first and is marked in the
footer; repeated doc_ids and rows are kept as they are; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import load, materialize, named_files, new_dir, open_bytes, write_bytes
from sluice.llm.tokens import END_ID, encode_slices, encoder

MAGIC = b"S8BTOKS1"
# Fixed values of Simple-8b: ids per word and bits per id of the selectors used here; runs of zero aren't used.
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 15
_LIMITS = np.uint64(1) << WIDTH.astype(np.uint64)
_NEED = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.int8)  # narrowest selector of small ids
BLOCK_IDS = 1 << 14
FILE_IDS = 4_000_000


def pack_words(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids: from each place the selector that takes most ids, found for all places at once."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if n == 0:
        return np.empty(0, "<u8")
    small = ids < np.uint64(len(_NEED))
    if small.all():
        need = _NEED[ids.astype(np.intp)]
    else:
        need = np.searchsorted(_LIMITS, ids, "right").astype(np.int8)  # len(WIDTH) where only an escape holds the id
    sel = np.where(need == len(WIDTH), ESCAPE, len(WIDTH) - 1).astype(np.int8)
    step = np.ones(n, np.int8)
    span, top = 1, need.copy()  # top[i]: the widest need of ids i .. i + span - 1, ids past the end need nothing
    for s in range(len(WIDTH) - 2, -1, -1):
        while span < COUNT[s]:
            grow = int(min(span, COUNT[s] - span))
            if grow < n:
                top[: n - grow] = np.maximum(top[: n - grow], top[grow:])
            span += grow
        fits = top <= s
        if not fits.any():
            break
        np.putmask(sel, fits, np.int8(s))
        np.putmask(step, fits, np.int8(COUNT[s]))
    jumps, at = step.tolist(), 0
    starts = []
    while at < n:
        starts.append(at)
        at += jumps[at]
    starts = np.array(starts, np.int64)
    chosen = sel[starts].astype(np.int64)
    long = chosen == ESCAPE
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(long)[:-1]))
    words = np.zeros(len(starts) + int(long.sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(int(COUNT[0]), np.uint64)))
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[rows]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[rows] + 1] = ids[starts[rows]]
            continue
        word = np.full(len(rows), np.uint64(s) << np.uint64(60), np.uint64)
        for j in range(int(COUNT[s])):
            word |= padded[starts[rows] + j] << np.uint64(j * int(WIDTH[s]))
        words[place[rows]] = word
    return words.astype("<u8")


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the words, selector by selector."""
    words = words.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    payload = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # the word behind an escape is an id, whatever its upper bits say
        for i in np.flatnonzero(sel == ESCAPE):
            if not payload[i]:
                payload[i + 1] = True
    head = np.flatnonzero(~payload)
    chosen = sel[head]
    counts = np.where(chosen == ESCAPE, 1, COUNT[np.minimum(chosen, len(COUNT) - 1)])
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[first[rows]] = words[head[rows] + 1]
            continue
        shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
        vals = (words[head[rows]][:, None] >> shifts) & np.uint64((1 << int(WIDTH[s])) - 1)
        cols = first[rows][:, None] + np.arange(COUNT[s])
        keep = cols < n
        out[cols[keep]] = vals[keep]
    return out


def file_bytes(ids: np.ndarray, doc_ids: list, n_tokens: np.ndarray) -> bytes:
    """One file of ids and its documents."""
    blocks = [pack_words(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    sizes = np.array([len(b) for b in blocks], "<u8")
    offsets = np.concatenate((np.zeros(1, "<u8"), np.cumsum(sizes, dtype="<u8")))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    footer = struct.pack("<QQQ", len(ids), len(blocks), len(docs)) + offsets.tobytes() + docs.tobytes() + known.tobytes() + n_tokens.astype("<u8").tobytes()
    return MAGIC + b"".join(b.tobytes() for b in blocks) + footer + struct.pack("<Q", len(footer)) + MAGIC


def read_file(data: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids, doc_ids, n_tokens) of a file."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token file, or cut off")
    (size,) = struct.unpack("<Q", data[-16:-8])
    foot = data[-16 - size : -16]
    n_ids, n_blocks, n_docs = struct.unpack("<QQQ", foot[:24])
    at = 24
    offsets = np.frombuffer(foot, "<u8", n_blocks + 1, at)
    at += 8 * (n_blocks + 1)
    docs = np.frombuffer(foot, "<i8", n_docs, at)
    known = np.frombuffer(foot, np.uint8, n_docs, at + 8 * n_docs)
    n_tokens = np.frombuffer(foot, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(offsets[-1]), 8)
    parts = [
        unpack_words(words[int(offsets[b]) : int(offsets[b + 1])], min(BLOCK_IDS, n_ids - b * BLOCK_IDS)) for b in range(n_blocks)
    ]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), [int(d) if k else None for d, k in zip(docs, known)], n_tokens


def write_token_files(docs: DataFrame, path: str, uri: str, *, kind: str = "word", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode doc_id, text in ascending doc_id order into files under uri; returns (file, part, seq, n_docs, n_ids), written.

    Rows are range-partitioned by doc_id, so part and seq give the order of the files; a task holds one file's ids at most
    (plus one document). Names hold the task's attempt, and readers take the manifest's files only, so what a lost task left is
    never read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, attempt, seq = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        enc, end = encoder(path, kind), struct.pack("<I", end_id)
        held: list[bytes] = []
        doc_ids: list = []
        size = 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            name = f"part-{part:07d}-{attempt}-{seq:05d}.s8b"
            write_bytes(f"{uri}/{name}", file_bytes(ids, doc_ids, np.array([len(h) // 4 for h in held], np.int64)))
            return pd.DataFrame({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for batch in batches:
            owners = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for i, ids in encode_slices(batch["text"].tolist(), enc):
                held.append(ids + end)
                doc_ids.append(owners[i])
                size += len(ids) // 4 + 1
                if size >= file_ids:
                    yield flush()
                    held.clear(), doc_ids.clear()
                    size, seq = 0, seq + 1
        if doc_ids:
            yield flush()

    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id")
    return materialize(ranged.mapInPandas(write, "file string, part long, seq long, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, uri: str, manifest: DataFrame | None = None) -> DataFrame:
    """(file, pos, doc_id, start_in_file, n_tokens, ids_crc32) of each document in the files under uri: those that the manifest
    names, or all without one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["path"]:
                with open_bytes(name) as stream:
                    ids, doc_ids, n_tokens = read_file(stream.read())
                stops = np.cumsum(n_tokens)
                raw = ids.astype("<u4").tobytes()
                starts = stops - n_tokens
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                yield pd.DataFrame({
                    "file": name.rsplit("/", 1)[-1], "pos": np.arange(len(doc_ids)), "doc_id": pd.array(doc_ids, dtype="Int64"),
                    "start_in_file": starts, "n_tokens": n_tokens, "ids_crc32": np.array(crcs, np.int64),
                })

    return named_files(spark, uri, "*.s8b", manifest).mapInPandas(read, "file string, pos long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")


def token_starts(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before. The running sum is over files, one small row each."""
    w = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("file", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("base"))
    return rows.join(base, "file").withColumn("start", F.col("base") + F.col("start_in_file"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = new_dir(spark, "token-files")
    manifest = write_token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), uri)
    return token_starts(manifest, read_token_files(spark, uri, manifest)).select("doc_id", "start", "n_tokens", "ids_crc32")
