"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated output.

A word is a unit (its bare letters, hashed to VOCABULARY ids) with a shape unit (case, marks around it, hashed to SHAPES ids).
Each unit has a fixed sparse random index vector. A unit's word vector is the sum of the index vectors of its neighbours over
the whole corpus, scaled to length one; each task sums its own and the sums meet by unit. A document is the mean of its units'
word vectors and index vectors, with a few pooled numbers about repetition. A two-layer network, fitted in numpy on FIT_ROWS
labelled rows at most, scores it; a temperature fitted on rows set aside calibrates the probabilities.

Edge cases: null, empty and wordless texts pool to zeros and are scored; equal texts score alike; with one class only in the
labels or none at all the score is the smoothed share; documents with equal doc_id are scored one by one; a null doc_id is
scored and counts as not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import load
from sluice.llm.toxicity import fit_sample, held_out

FIT_ROWS = 20_000
VOCABULARY, SHAPES = 1 << 14, 1 << 10
UNITS = VOCABULARY + SHAPES
DIM = 40
WINDOW = 2
STATS = 8
SLICE = 100_000  # words whose vectors are summed at once


def index_vectors(seed: int = 7) -> np.ndarray:
    """Fixed ternary vectors: four ones and four minus ones in each of UNITS rows."""
    rng = np.random.default_rng(seed)
    out = np.zeros((UNITS, DIM), np.float32)
    spots = np.argsort(rng.random((UNITS, DIM), np.float32), axis=1)[:, :8]
    rows = np.arange(UNITS)[:, None]
    out[rows, spots[:, :4]], out[rows, spots[:, 4:]] = 1.0, -1.0
    return out


class Units(dict):
    """raw word -> word unit and shape unit in one integer. Full, it becomes the older half, from which words still in use come back."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most, self.older, self.shapes = most, {}, {}

    def _make(self, raw: bytes) -> int:
        core, marks = raw, ""
        if not raw.isalpha() and raw[:-1].isalpha() and raw[-1] < 128 and raw[-1] not in b"0123456789_":
            core, marks = raw[:-1], chr(raw[-1])
        if core.isalpha():  # ASCII letters, as most words are, with a mark behind at most
            case = "l" if core.islower() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "m"
            return (xxhash.xxh3_64_intdigest(core.lower()) % VOCABULARY << 20) | self._shape(case, len(core), "", marks)
        s = raw.decode("utf-8", "surrogatepass")
        i, j = 0, len(s)
        while i < j and not (s[i].isalnum() or s[i] == "_"):
            i += 1
        while i < j and not (s[j - 1].isalnum() or s[j - 1] == "_"):
            j -= 1
        core = s[i:j]
        case = "d" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "m" if core else "-"
        return (xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "surrogatepass")) % VOCABULARY << 20) | self._shape(case, len(core), s[: min(i, 4)], s[max(j, len(s) - 4) :])

    def _shape(self, case: str, length: int, left: str, right: str) -> int:
        look = (case, min(3, length // 6), left, right)
        shape = self.shapes.get(look)
        if shape is None:
            if len(self.shapes) > 10_000:
                self.shapes.clear()
            shape = VOCABULARY + xxhash.xxh3_64_intdigest(f"{case}{look[1]}\0{left}\0{right}".encode("utf-8", "surrogatepass")) % SHAPES
            self.shapes[look] = shape
        return shape

    def __missing__(self, raw: bytes) -> int:
        v = self.older.get(raw)
        if v is None:
            v = self._make(raw)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[raw] = v
        return v


_UNITS: list[Units] = []


def shared_units() -> Units:
    """One for each Python worker; later batches and tasks of the worker find its words."""
    if not _UNITS:
        _UNITS.append(Units())
    return _UNITS[0]


def units_of(text: str | None, units: Units) -> tuple[np.ndarray, np.ndarray]:
    raw = (text or "").encode("utf-8", "surrogatepass").split()
    v = np.fromiter(map(units.__getitem__, raw), np.int64, len(raw))
    return v >> 20, v & ((1 << 20) - 1)


def _slices(texts: list, units: Units) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(first position, word units, shape units of each text) of runs of texts with about SLICE words."""
    first, words, shapes, size = 0, [], [], 0
    for i, text in enumerate(texts):
        w, s = units_of(text, units)
        words.append(w)
        shapes.append(s)
        size += len(w)
        if size > SLICE:
            yield first, words, shapes
            first, words, shapes, size = i + 1, [], [], 0
    if words:
        yield first, words, shapes


def _starts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)


def context_sums(docs: DataFrame) -> np.ndarray:
    """Sum of the neighbours' index vectors for each unit, over all documents. A task sends UNITS rows at most."""
    names = [f"c{i}" for i in range(DIM)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, units = np.concatenate([index_vectors(), np.zeros((1, DIM))]).astype(np.int8), shared_units()  # small whole numbers
        total = np.zeros((UNITS, DIM), np.float32)
        gap = np.full(WINDOW, UNITS)  # between texts, so that no word has a neighbour in another one

        for batch in batches:
            for _, words, shapes in _slices(batch["text"].tolist(), units):
                words, shapes = (np.concatenate([x for t in ts for x in (t, gap)]) for ts in (words, shapes))
                own = index[words] + index[shapes]
                around = np.zeros_like(own)
                for k in range(1, WINDOW + 1):
                    around[:-k] += own[k:]
                    around[k:] += own[:-k]
                for ids in (words, shapes):
                    order = np.argsort(ids.astype(np.uint16), kind="stable")
                    starts = _starts(ids[order])
                    sums, at = np.add.reduceat(around[order], starts, axis=0, dtype=np.float32), ids[order[starts]]
                    total[at[at < UNITS]] += sums[at < UNITS]
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pd.DataFrame(total[used], columns=names).assign(unit=used)

    schema = ", ".join(f"{c} float" for c in names) + ", unit int"
    rows = docs.select("text").mapInPandas(count, schema).groupBy("unit").agg(*[F.sum(c).cast("float").alias(c) for c in names]).toPandas()  # UNITS rows at most
    out = np.zeros((UNITS, DIM), np.float32)
    out[rows["unit"].to_numpy()] = rows[names].to_numpy(np.float32)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """UNITS rows of word vector beside index vector, the former of length one."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.concatenate([sums / np.maximum(size, 1e-6), index_vectors() / math.sqrt(8)], axis=1).astype(np.float32)


def pool(texts: list, units: Units, vectors: np.ndarray) -> np.ndarray:
    """A row of features for each text: means by distinct unit, as few shapes occur and many words repeat, then the numbers about repetition."""
    out = np.zeros((len(texts), 4 * DIM + STATS), np.float32)
    for first, words, shapes in _slices(texts, units):
        n = np.array([len(w) for w in words])
        w, s, doc = np.concatenate(words), np.concatenate(shapes), np.repeat(np.arange(len(n)), n)
        if not len(w):
            continue
        rows = out[first : first + len(n)]
        some = n > 0
        m = np.maximum(n, 1)
        for at, ids in ((0, w), (2 * DIM, s)):
            key = np.sort(doc << 20 | ids)
            starts = _starts(key)
            counts, owner, unit = np.diff(np.append(starts, len(key))), key[starts] >> 20, key[starts] & ((1 << 20) - 1)
            heads = _starts(owner)
            rows[some, at : at + 2 * DIM] = np.add.reduceat(vectors[unit] * counts[:, None].astype(np.float32), heads, axis=0)
            rows[:, at : at + 2 * DIM] /= m[:, None]
            if at == 0:
                rows[:, 4 * DIM + 1] = np.bincount(owner, minlength=len(n)) / m
            else:
                rows[some, 4 * DIM + 6] = np.maximum.reduceat(counts, heads)
                rows[:, 4 * DIM + 6] /= m
        inner = doc[1:] == doc[:-1]
        grams = np.sort((doc[1:] << 28 | w[:-1] << 14 | w[1:])[inner])
        pairs = np.maximum(n - 1, 1)
        rows[:, 4 * DIM + 2] = np.where(n == 1, 1.0, np.bincount(grams[_starts(grams)] >> 28, minlength=len(n)) / pairs)
        rows[:, 4 * DIM + 3] = np.bincount(doc[1:][inner & (w[1:] == w[:-1])], minlength=len(n)) / pairs
        for i in np.flatnonzero(some).tolist():
            text = texts[first + i]
            lines = [x for x in text.split("\n") if x]
            rows[i, 4 * DIM + 4] = len(set(lines)) / max(1, len(lines))
            rows[i, 4 * DIM + 5] = math.log1p(n[i] / max(1, len(lines))) / 10
            rows[i, 4 * DIM + 7] = len(text) / n[i] / 20
        rows[some, 4 * DIM] = np.log1p(n[some]) / 10
    return out


class Network:
    """Standardised input, one hidden layer of tanh, a logistic output with a temperature."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.p = [rng.normal(0, 1 / math.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.p
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 2e-3, decay: float = 1e-3, seed: int = 5) -> None:
        """Adam with weight decay on all but every tenth row, which fit the temperature by Newton's method."""
        aside = np.arange(len(y)) % 10 == 9
        xt, yt = x[~aside], y[~aside]
        self.mean, self.scale = xt.mean(0), np.maximum(xt.std(0), 1e-4)
        z = (xt - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(q) for q in self.p], [np.zeros_like(q) for q in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(yt))
            for i in range(0, len(yt), batch):
                r = order[i : i + batch]
                h = np.tanh(z[r] @ self.p[0] + self.p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3][0], -30, 30))) - yt[r]) / len(r)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                grads = [z[r].T @ back, back.sum(0), h.T @ e, np.array([e.sum()])]
                t += 1
                step = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= step * (m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + decay * self.p[k] * (k in (0, 2)))
        if aside.sum() >= 20 and 0 < y[aside].mean() < 1:
            s, inv = self.logit(x[aside]), 1.0
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(s * inv, -30, 30)))
                grad, hess = ((p - y[aside]) * s).sum() + 0.1 * (inv - 1), (p * (1 - p) * s * s).sum() + 0.1
                inv = min(5.0, max(0.1, inv - grad / hess))
            self.temperature = 1 / inv


class Constant:
    def __init__(self, p: float):
        self.p = p

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


def fit(docs: DataFrame, labels: DataFrame, vectors, rows: int = FIT_ROWS):
    """The model of labels.quality; vectors: a broadcast of word_vectors()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = pool(batch["text"].tolist(), shared_units(), vectors.value)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [r.tobytes() for r in x], "label": batch["label"]})

    got = fit_sample(docs, labels, "quality", rows).mapInPandas(run, "doc_id long, x binary, label int").toPandas()  # `rows` rows at most
    got["turn"] = [xxhash.xxh3_64_intdigest(str(d)) for d in got["doc_id"]]
    got = got.sort_values(["turn", "doc_id"])
    y = got["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return Constant((y.sum() + 0.5) / (len(y) + 1.0))
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]]).astype(float)
    net = Network(x.shape[1])
    net.fit(x, y, epochs=max(40, min(400, 400_000 // len(y))))
    return net


def scorer(model, vectors):
    """A column function: the probability of quality 1."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(pool(texts.tolist(), shared_units(), vectors.value).astype(float)))

    return run


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    vectors = spark.sparkContext.broadcast(word_vectors(context_sums(docs)))  # UNITS rows, whatever the input
    score = scorer(fit(docs, labels, vectors), vectors)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
