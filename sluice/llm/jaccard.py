"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct 5-word shingles. Two sets of sizes a and b link when 100 |A n B| >= 80 |A u B|, so their
symmetric difference is at most (a + b) / 9. Per size band a sketch of K parts holds, in each part, the exclusive-or of the
hashes of the tokens that fall there: the parity of a very wide bit sketch, part by part. Each token of the symmetric
difference changes one part at most, so of two linked sets all but d = floor((a + b) / 9) parts agree, and a set with more
than d non-empty parts shares one with each of its partners (pigeonhole). Parts meet by equality of (band, part, value).

* A value that few sets share gives all their pairs. A value that many share is hot: its members pair with one pivot only, and
  only pairs that many hot values bring together are tried, as near copies share most of their values.
  Tasks do the same to values that are hot among their own rows before the shuffle, so no key carries many rows.
* Pairs pass the size test, then the Hamming distance of folded bit sketches, which never exceeds the symmetric
  difference; then the shingles of both texts decide.
* Hot values whose members are one component by then lose nothing. A set whose other parts don't exceed d, because of hot
  values of several components, is left over; left-over sets meet by a prefix join on their rarest shingles instead and,
  in groups of near copies, on their differences from one of them. Those that share such a key meet its pivot first; only
  sets of components that this leaves apart meet in pairs, so a group whose members all link doesn't take all its pairs.

Edge cases: null, empty and white texts have the empty set and link with nothing; fewer than five words are one shingle; equal
texts and equal sets link; rows with equal doc_id are one node; a null doc_id links with nothing and has a null component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import WordHash, components, fresh, lean, load, materialize, mix64

WORDS = 5
HOT = 20  # sets that may share a value and still give all their pairs
# Hot values that must bring a set and a pivot together: so many, and this share of a set's parts. Linked sets share more than
# half of theirs as a rule. No link depends on this, as left-over sets meet by their shingles; it saves trying other pairs.
PIVOT_VALUES, PIVOT_SHARE = 4, 0.25
FLUSH = 700_000  # keys a task holds before it deals them out
MANY = 10_000  # sets, at most, that count as those of very many documents
_PAIRS = 500_000  # pairs made at once
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(WORDS)]


def _bands() -> np.ndarray:
    at, out = 1, []
    while at < 1 << 34:
        out.append(at)
        at = max(at + 1, at * 3 // 2)
    return np.array(out, np.int64)


BANDS = _bands()
assert len(BANDS) < 64


def shingle_set(words: list[bytes], hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = hashes.array(words)
    m = min(n, WORDS)
    h = w[: n - m + 1] * _P[m - 1]
    for k in range(1, m):
        h = h + w[k : n - m + 1 + k] * _P[m - 1 - k]
    return np.unique(mix64(h + np.uint64(m)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def parts_of_band(band: int) -> int:
    return int(0.48 * BANDS[band]) + 16


def usual_parts(band: int) -> float:
    """Non-empty parts of the band's smallest sets, on average."""
    k = parts_of_band(band)
    return k * -np.expm1(-float(BANDS[band]) / k)


def band_keys(s: np.ndarray, band: int) -> np.ndarray:
    """A key for each non-empty part; the band is its lowest six bits."""
    k = np.uint64(parts_of_band(band))
    part = ((s >> np.uint64(32)) * k) >> np.uint64(32)  # grows with s, so parts are runs
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    value = np.bitwise_xor.reduceat(s, starts)
    key = mix64(value ^ mix64(part[starts] * np.uint64(64) + np.uint64(band)))
    return (key & ~np.uint64(63)) | np.uint64(band)


def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, parts needed) where a set of n meets its partners: its own band, and those of smaller partners below."""
    own = int(np.searchsorted(BANDS, n, "right")) - 1
    low = int(np.searchsorted(BANDS, -(-4 * n // 5), "right")) - 1
    return [(b, (n + (5 * n // 4 if b == own else int(BANDS[b + 1]) - 1)) // 9 + 1) for b in range(low, own + 1)]


def bit_sketch(s: np.ndarray) -> bytes:
    """Parities of s over a power of two of places, at least twice the set's size."""
    m = 1 << min(22, max(6, int(2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two sketches, the wider folded to the narrower."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


_OUT = "kind string, a long, b long, c long, d long, s binary"
_KEYS = "bucket int, base long, n long, width int, blob binary"
_TYPES = {"kind": pa.string(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "d": pa.int64(), "s": pa.binary()}
_KEY_TYPES = {"bucket": pa.int32(), "base": pa.int64(), "n": pa.int64(), "width": pa.int32(), "blob": pa.binary()}


def _batch(types: dict, rows: int, /, **cols) -> pa.RecordBatch:
    """Columns that aren't given are null."""
    arrays = [pa.array(cols[c], t) if c in cols else pa.nulls(rows, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _pairs(kind: str, a: np.ndarray, b: np.ndarray) -> dict:
    """Distinct pairs of different documents, the smaller first."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    lo, hi = lo[lo != hi], hi[lo != hi]
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    starts = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))) if len(lo) else np.empty(0, np.int64)
    return {"kind": [kind] * len(starts), "a": lo[starts], "b": hi[starts]}


def _pivot_pairs(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """Distinct pairs of a pivot and a member by band, with how many hot values each shares here."""
    lo, hi, band = np.minimum(a, b), np.maximum(a, b), (keys & np.uint64(63)).astype(np.int64)
    keep = lo != hi
    order = np.lexsort((band[keep], hi[keep], lo[keep]))
    lo, hi, band = lo[keep][order], hi[keep][order], band[keep][order]
    starts = np.flatnonzero(np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (band[1:] != band[:-1])))) if len(lo) else np.empty(0, np.int64)
    return {"kind": ["q"] * len(starts), "a": lo[starts], "b": hi[starts], "c": np.diff(np.append(starts, len(lo))), "d": band[starts]}


def _hot_rows(keys: np.ndarray, docs: np.ndarray) -> dict:
    return {"kind": ["h"] * len(keys), "a": keys.view(np.int64), "b": docs}


def _deal(keys: np.ndarray, docs: np.ndarray, buckets: int) -> tuple[list[dict], dict]:
    """A task's entries: values hot in the task go down to one entry, and their members' rows go out at once; the others
    become one packed row for each bucket."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    keep = np.concatenate(([True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])))
    keys, docs = keys[keep], docs[keep]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(starts, len(keys)))
    hot = np.repeat(counts > HOT, counts)
    head = np.zeros(len(keys), bool)
    head[starts] = True
    pivots = np.repeat(docs[starts], counts)
    rows = [_hot_rows(keys[hot], docs[hot]), _pivot_pairs(keys[hot & ~head], pivots[hot & ~head], docs[hot & ~head])]
    stay = ~hot | head
    keys, docs, hot = keys[stay], docs[stay], hot[stay]
    bucket = ((keys >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, docs, hot = bucket[order], keys[order], docs[order], hot[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    out: dict = {c: [] for c in _KEY_TYPES}
    for a, b in itertools.pairwise([*edges.tolist(), len(bucket)]):
        base = int(docs[a:b].min())
        width = 8 if int(docs[a:b].max()) - base >= 1 << 32 else 4
        blob = keys[a:b].astype("<u8").tobytes() + (docs[a:b] - base).astype(f"<u{width}").tobytes() + np.packbits(hot[a:b]).tobytes()
        for c, v in zip(out, (int(bucket[a]), base, b - a, width, blob)):
            out[c].append(v)
    return rows, out


def sketch_rows(docs: DataFrame) -> DataFrame:
    """Rows of six kinds, written: m (doc, size, fingerprint, bit sketch), k (doc, band, non-empty parts, parts needed),
    p and r (pairs by values that aren't hot: with the pivot, and the rest), q (pairs with the pivot of a hot value), h (hot value, doc)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * 8

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes = WordHash()
        keys, owners, size, turn = [], [], 0, 0

        def through(rows: dict) -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            n = len(rows["a"])
            bucket = (TaskContext.get().partitionId() * 104_729 + turn * 7_919 + np.arange(n) // 256) % buckets  # spread, to be passed on
            return _batch(_KEY_TYPES | _TYPES, n, bucket=bucket, **rows)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, dealt = _deal(np.concatenate(keys), np.concatenate(owners), buckets)
            yield from map(through, rows)
            yield _batch(_KEY_TYPES | _TYPES, len(dealt["bucket"]), **dealt)

        for batch in batches:
            meta, need = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                s = shingle_set(words_of(text), hashes)
                f1 = int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0
                f2 = int(mix64(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                meta.append((doc, len(s), f1, f2, bit_sketch(s) if len(s) else b""))
                if doc is None or not len(s):
                    continue
                for band, parts in bands_of(len(s)):
                    k = band_keys(s, band)
                    keys.append(k)
                    owners.append(np.full(len(k), doc, np.int64))
                    need.append((doc, band, len(k), parts))
                    size += len(k)
                if size > FLUSH:
                    yield from flush()
                    keys, owners, size = [], [], 0
            if meta:
                yield through(dict(zip("abcds", zip(*meta))) | {"kind": ["m"] * len(meta)})
            if need:
                yield through(dict(zip("abcd", zip(*need))) | {"kind": ["k"] * len(need)})
        if keys:
            yield from flush()

    def send(rows: dict) -> Iterator[pa.RecordBatch]:
        if len(rows["a"]):
            yield _batch(_TYPES, len(rows["a"]), **rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, hots = [], [], []
        for batch in batches:
            entry = pc.is_null(batch.column("kind"))
            yield batch.filter(pc.invert(entry)).select(list(_TYPES))
            packed = batch.filter(entry)
            for base, n, width, blob in zip(*(packed.column(c).to_pylist() for c in ("base", "n", "width", "blob"))):
                keys.append(np.frombuffer(blob, "<u8", n))
                docs.append(np.frombuffer(blob, f"<u{width}", n, 8 * n).astype(np.int64) + base)
                hots.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=(8 + width) * n), count=n).astype(bool))
        if not keys:
            return
        keys, docs, hots = np.concatenate(keys), np.concatenate(docs), np.concatenate(hots)
        order = np.argsort(keys, kind="stable")
        keys, docs, hots = keys[order], docs[order], hots[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(starts, len(keys)))
        shared = np.repeat(counts > 1, counts)
        starts_hot = np.logical_or.reduceat(hots, starts) | (counts > HOT)
        all_hot = np.repeat(starts_hot, counts)
        out = all_hot & ~hots  # those with the mark have had their members' rows written
        pivot = np.repeat(np.minimum.reduceat(docs, starts), counts)
        for rows in (_pairs("p", pivot[shared & ~all_hot], docs[shared & ~all_hot]), _pivot_pairs(keys[shared & all_hot], pivot[shared & all_hot], docs[shared & all_hot]), _hot_rows(keys[out], docs[out])):
            yield from send(rows)
        for g in range(3, HOT + 1):
            at = starts[(counts == g) & ~starts_hot]
            i, j = np.triu_indices(g, 1)
            for k in range(0, len(at), _PAIRS // len(i)):
                members = docs[at[k : k + _PAIRS // len(i), None] + np.arange(g)]
                yield from send(_pairs("r", members[:, i].ravel(), members[:, j].ravel()))

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(sketch), f"{_KEYS}, {_OUT}")
    return materialize(dealt.repartition(partitions, "bucket").mapInArrow(lean(meet), _OUT), "jaccard-sketches")


def _close(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the tests of sizes and of folded sketches."""
    m = lambda x: meta.select(F.col("a").alias(x), F.col("b").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    sized = pairs.join(m("a"), "a").join(m("b"), "b").filter("100 * least(n_a, n_b) >= 80 * greatest(n_a, n_b)")

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = ((batch["n_a"] + batch["n_b"]) // 9).tolist()
            ok = [hamming(x, y) <= d for x, y, d in zip(batch["s_a"], batch["s_b"], most)]
            yield batch.loc[ok, ["a", "b"]]

    return sized.mapInPandas(lean(test), "a long, b long").distinct()


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets link, by both texts."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        last, s = None, None
        for batch in batches:
            ok = []
            for a, x, y in zip(batch["a"], batch["text_a"], batch["text_b"]):
                if last != (a, x):
                    last, s = (a, x), shingle_set(words_of(x), hashes)
                t = shingle_set(words_of(y), hashes)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(len(s) > 0 and 100 * both >= 80 * (len(s) + len(t) - both))
            yield batch.loc[ok, ["a", "b"]]

    t = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(t("b"), "b").join(t("a"), "a").select("a", "b", "text_a", "text_b").mapInPandas(lean(test), "a long, b long").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), "jaccard-texts")


def _leftover_links(left: DataFrame, docs: DataFrame, labels: DataFrame, meta: DataFrame) -> DataFrame:
    """Links between left-over documents of different components: a prefix join on their shingles, rarest first.

    Documents that share many of their rare shingles have one of them as their root, and all are compared with it first. Pairs
    with the same root then meet by their differences from it, pairs with different roots by their shingles. Of each such key all
    documents meet one first, and only those of components that are then apart meet in pairs. So documents that link with a root or
    a pivot take a few pairs each; those that share keys, but link with neither, still meet in pairs.
    """
    ids = materialize(left.select("doc_id").distinct(), "jaccard-left")
    texts = _texts(docs, ids)
    meta = materialize(meta.join(ids.withColumnRenamed("doc_id", "a"), "a", "left_semi"), "jaccard-left")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(words_of(text), hashes).view(np.int64)
                yield pd.DataFrame({"doc_id": doc, "n": len(s), "token": s})

    tokens = texts.mapInPandas(lean(explode), "doc_id long, n long, token long")
    first = materialize(_ranked(tokens, []).filter("k <= n - ceil(0.8 * n) + 1 and df > 1").select("doc_id", "n", "token", "k"), "jaccard-prefix")
    root = _roots(first)
    to_root = root.filter("doc_id <> root").select(F.least("doc_id", "root").alias("a"), F.greatest("doc_id", "root").alias("b")).distinct()
    links = materialize(_linked(_close(to_root, meta), texts), "jaccard-links")
    # a component of which a document links with its root is the root's component; equal labels still mean one component
    of = _joined(root, links).join(labels, "doc_id").join(labels.select(F.col("doc_id").alias("root"), F.col("component").alias("to")), "root")
    of = of.filter("component <> to").groupBy("component").agg(F.min("to").alias("to"))
    now = root.join(labels, "doc_id").join(of, "component", "left").select("doc_id", "root", F.coalesce("to", "component").alias("component"))
    now, apart = materialize(now, "jaccard-labels"), _differences(root, texts)
    met = _stars(first, ["token"], now).unionByName(_stars(apart, ["root", "token"], now)).distinct()
    new = materialize(_linked(_close(met, meta), texts), "jaccard-links")
    links, now = links.unionByName(new), _merged(now, new)
    pairs = _pairs_of_roots(first, now).unionByName(_pairs_of_root(apart, now)).distinct()
    return links.unionByName(_linked(_close(pairs, meta), texts))


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, root) of documents whose link with their root was found."""
    both = links.select(F.col("a").alias("doc_id"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("doc_id"), F.col("a").alias("root")))
    return root.join(both, ["doc_id", "root"], "left_semi")


def _between(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): the components that links join, each pair once."""
    c = lambda x: labels.select(F.col("doc_id").alias(x), F.col("component").alias(f"c_{x}"))
    both = links.join(c("a"), "a").join(c("b"), "b").filter("c_a <> c_b")
    return both.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels once these links count, too, written; all columns stay."""
    to = components(_between(labels, links)).select(F.col("node").alias("component"), F.col("component").alias("to"))
    now = labels.join(to, "component", "left").withColumn("component", F.coalesce("to", "component"))
    return materialize(now.select(*labels.columns), "jaccard-labels")


def _stars(rows: DataFrame, key: list[str], labels: DataFrame) -> DataFrame:
    """Of each key its documents with one of them, where their components differ."""
    rows = rows.select(*key, "doc_id").join(labels.select("doc_id", "component"), "doc_id")
    pivots = rows.groupBy(*key).agg(F.min_by(F.struct(F.col("doc_id").alias("p"), F.col("component").alias("c")), F.xxhash64("doc_id")).alias("of"))
    met = rows.join(pivots, key).filter("component <> of.c")
    return met.select(F.least("doc_id", "of.p").alias("a"), F.greatest("doc_id", "of.p").alias("b")).distinct()


def _ranked(tokens: DataFrame, within: list[str]) -> DataFrame:
    """Adds df, in how many documents (of the same `within`) a token is, and k, its place among its document's, rarest first."""
    tokens = materialize(tokens, "jaccard-tokens")
    seen = tokens.groupBy(*within, "token").agg(F.count("*").alias("df"))
    return tokens.join(seen, [*within, "token"]).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "token")))


def _mixed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of keys that documents of several components have, each with its document's tokens in order, written."""
    mixed = rows.groupBy(*key).agg((F.min("component") != F.max("component")).alias("many")).filter("many").select(*key)
    rows = rows.join(mixed, key)
    prefix = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "token"))), lambda t: t["token"]).alias("prefix"))
    return materialize(rows.join(prefix, "doc_id"), "jaccard-mixed")


def _pairs_of_roots(first: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different roots and components that may link. In a link 9 |A n B| >= 4 (n + m), and of two sets in one order of
    shingles with c in common, the first common one is among the first n - c + 1."""
    rows = _mixed(first.join(labels, "doc_id"), ["token"])
    side = lambda x: rows.select("token", F.col("doc_id").alias(x), *[F.col(c).alias(f"{v}{x}") for c, v in (("component", "c"), ("n", "n"), ("k", "k"), ("prefix", "p"), ("root", "r"))])
    x, y = side("a").filter("ka <= na - (8 * na + 8) div 9 + 1"), side("b")  # the smaller set and the larger one
    common = "(4 * (na + nb) + 8) div 9"
    meet = f"(na < nb or na = nb and a < b) and ca <> cb and ra <> rb and ka <= na - {common} + 1 and kb <= nb - {common} + 1 and element_at(array_intersect(pa, pb), 1) = x.token"  # a pair once, at its first
    return x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr(meet)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _roots(first: DataFrame) -> DataFrame:
    """(doc_id, root): of documents that share many prefix shingles one is the root of all, as far as three steps lead to it."""
    pivots = first.groupBy("token").agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("p"))
    met = first.join(pivots, "token").groupBy("doc_id", "p").agg(F.count("*").alias("shared"))
    root = materialize(met.groupBy("doc_id").agg(F.max_by("p", F.struct("shared", -F.col("p"))).alias("root")), "jaccard-roots")
    for _ in range(3):
        root = root.join(root.select(F.col("doc_id").alias("root"), F.col("root").alias("next")), "root").select("doc_id", F.col("next").alias("root"))
    return materialize(root, "jaccard-roots")


def _differences(root: DataFrame, texts: DataFrame) -> DataFrame:
    """Prefixes of the documents' differences from their roots, rarest first: the shingles that one of both has, written."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for batch in batches:
            for doc, of, x, r in batch[["doc_id", "root", "text", "root_text"]].itertuples(index=False):
                s, t = shingle_set(words_of(x), hashes), shingle_set(words_of(r), hashes)
                more, less = np.setdiff1d(s, t, assume_unique=True), mix64(np.setdiff1d(t, s, assume_unique=True) ^ np.uint64(1))
                yield pd.DataFrame({"doc_id": doc, "root": of, "n": len(s), "m": len(more) + len(less), "token": np.concatenate((more, less)).view(np.int64)})

    both = root.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("root"), F.col("text").alias("root_text")), "root")
    tokens = both.select("doc_id", "root", "text", "root_text").mapInPandas(lean(explode), "doc_id long, root long, n long, m long, token long")
    # the least common count for a partner that differs from the root in nothing: no prefix is longer
    rows = _ranked(tokens, ["root"]).filter("df > 1 and k <= m - greatest(1, (m - (n + 5 * n div 4) div 9 + 1) div 2) + 1")
    return materialize(rows.select("root", "token", "doc_id", "n", "m", "k"), "jaccard-differences")


def _pairs_of_root(apart: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components with the same root r that may link, when all links with roots are known.

    A and B of n and m shingles differ in |A r| + |B r| - 2 |A r n B r|, with X r the difference of X and r. They link if that
    is (n + m) / 9 at most; so without a common element of A r and B r both link with r and are one component already. Others
    meet by a prefix join on these differences, rarest first, in which the many shingles that a group of copies has in common
    don't occur.
    """
    rows = _mixed(apart.join(labels.select("doc_id", "component"), "doc_id"), ["root", "token"])
    side = lambda x: rows.select("root", "token", F.col("doc_id").alias(x), *[F.col(c).alias(f"{v}{x}") for c, v in (("component", "c"), ("n", "n"), ("m", "m"), ("k", "k"), ("prefix", "p"))])
    least = "(ma + mb - (na + nb) div 9 + 1) div 2"  # elements that both differences must have
    meet = f"a < b and ca <> cb and ka <= ma - {least} + 1 and kb <= mb - {least} + 1 and element_at(array_intersect(pa, pb), 1) = x.token"
    on = (F.col("x.root") == F.col("y.root")) & (F.col("x.token") == F.col("y.token"))
    return side("a").alias("x").join(side("b").alias("y"), on & F.expr(meet)).select("a", "b")


def _representatives(meta: DataFrame) -> DataFrame:
    """doc_id and the smallest doc_id with an equal set. Sets that very many documents have are at most MANY, so their
    representatives are broadcast and their documents aren't shuffled by set."""
    key = ["b", "c", "d"]
    reps = materialize(meta.groupBy(*key).agg(F.min("a").alias("rep"), F.count("*").alias("n")), "jaccard-sets")
    most = max(1_000, (reps.agg(F.sum("n")).first()[0] or 0) // MANY)
    of_hot = meta.join(F.broadcast(reps.filter(F.col("n") > most).select(*key, F.col("rep").alias("hot"))), key, "left")
    of_rest = of_hot.filter("hot is null").drop("hot").join(reps.filter(F.col("n") <= most), key)
    return of_hot.filter("hot is not null").select(F.col("a").alias("doc_id"), F.col("hot").alias("rep")).unionByName(of_rest.select(F.col("a").alias("doc_id"), "rep")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: of each document the smallest doc_id that links reach."""
    rows = sketch_rows(docs)
    of = lambda kind: rows.filter(F.col("kind") == kind)
    meta = of("m").select("a", "b", "c", "d", "s").filter("a is not null and b > 0")
    rep = materialize(_representatives(meta), "jaccard-reps")
    same = rep.filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    def of_reps(pairs: DataFrame) -> DataFrame:
        r = lambda x: rep.select(F.col("doc_id").alias(x), F.col("rep").alias(f"r_{x}"))
        out = pairs.select("a", "b").distinct().join(r("a"), "a").join(r("b"), "b")
        return out.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).filter("a <> b").distinct()

    least = F.array(*[F.lit(max(PIVOT_VALUES, int(PIVOT_SHARE * usual_parts(b)))) for b in range(len(BANDS))])
    pivots = of("q").groupBy("a", "b", "d").agg(F.sum("c").alias("n")).filter(F.col("n") >= F.element_at(least, (F.col("d") + 1).cast("int")))
    stars = of("p").select("a", "b").unionByName(pivots.select("a", "b"))
    close = materialize(
        _close(of_reps(stars), meta).withColumn("star", F.lit(True)).unionByName(_close(of_reps(of("r")), meta).withColumn("star", F.lit(False))), "jaccard-close"
    )
    texts = _texts(docs, close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    links = materialize(same.unionByName(_linked(close.filter("star").select("a", "b"), texts)), "jaccard-links")
    found = materialize(components(links), "jaccard-labels")

    def labelled(comp: DataFrame) -> DataFrame:
        return rep.select("doc_id").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))

    labels = materialize(labelled(found), "jaccard-labels")
    c = lambda x: labels.select(F.col("doc_id").alias(x), F.col("component").alias(f"c_{x}"))
    rest = close.filter("not star").select("a", "b").join(c("a"), "a").join(c("b"), "b").filter("c_a <> c_b").select("a", "b")
    hot = materialize(of("h").select(F.col("a").alias("key"), F.col("b").alias("doc_id")).distinct().join(labels, "doc_id"), "jaccard-hot")
    several = materialize(hot.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key"), "jaccard-several")
    lost = hot.join(several, "key").groupBy("doc_id", F.col("key").bitwiseAND(63).cast("long").alias("band")).agg(F.count("*").alias("lost"))
    parts = of("k").select(F.col("a").alias("doc_id"), F.col("b").alias("band"), F.col("c").alias("parts"), F.col("d").alias("needed")).distinct()
    left = parts.join(lost, ["doc_id", "band"], "left").filter("parts - coalesce(lost, 0) < needed").select("doc_id", "band")
    left = materialize(left.join(rep.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi"), "jaccard-left")
    more = _linked(rest, texts)
    if left.limit(1).count():
        more = more.unionByName(_leftover_links(left, docs, labels, meta))
    more = materialize(more, "jaccard-links")
    final = _merged(labels, more) if more.limit(1).count() else labels
    return (
        of("m").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
        .join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their near copies: of each component the smallest doc_id stays, and of rows with that doc_id one.
    Documents with a null doc_id stay. All columns are kept."""
    found = jaccard_components(docs)
    gone, place = fresh(docs, "lost"), fresh(docs, "place")
    lost = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct(), "near-copies")
    kept = docs.join(lost, docs["doc_id"].cast("long") == F.col(gone), "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "text"))
        kept = kept.withColumn(place, F.when(F.col("doc_id").isNull(), 1).otherwise(first)).filter(F.col(place) == 1).drop(place)
    return kept


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))
