"""Byte-pair encoding of whole texts, long ones by trees of halves, and decoding.

A text of at most `leaf` characters is encoded where it stands. A longer one is halved until its parts are that short; the parts
are encoded apart, in as many tasks as there are; and neighbours are joined, pair by pair up the tree. A join looks at a window
around the seam and lets it grow until both sides agree with it exactly:

* Words. The vocabulary cuts a text into words from left to right, and where a word ends depends on what follows it by a few
  characters only. The words of the left half that end well inside it stand. From the first one that doesn't, the text is cut
  into words again across the seam, until a word ends where a word of the right half ends too; from there on the right half stands.
* Tokens of one word that the seam cuts (a run without a cut may be as long as the text). The last tokens of the left and the
  first of the right are encoded together; while the result doesn't begin with the left side's first token of the window and end
  with the right side's last one, that side of the window doubles. Then every two neighbours in the joined sequence are
  neighbours in an exact encoding, and merges by rank that stop at the border of each such pair stop there in the whole word.

Halves carry ids only, as ids of a byte-level vocabulary give the text back. Strings of added tokens are ids of their own and
split a text before all else.

Edge cases: a null text counts as empty and has no ids; a null doc_id is kept; equal rows stay as many as they were (copies of a
long text are encoded once, and counted before the shuffle); an empty table gives no rows; other columns are ignored, whatever
their names; a text without any white space takes the same way, in O(n log n). A task holds one batch, or one document's ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import load
from sluice.llm.tokens import PieceEncoder, encode_slices, encoder

LEAF = 1 << 14  # characters that one task encodes at a stretch
PIECES = 150_000  # pieces of text whose ids a worker keeps
AHEAD = 3  # characters behind a word's end that can have a say in it


class Part(NamedTuple):
    """Ids of a stretch of text, and what a join needs to know of its words."""

    ids: np.ndarray
    head: int  # tokens of its first word
    tail: int  # tokens of the words at its end that what follows may change
    single: bool  # these are one word, and no contraction


class Halves:
    """Encoding of parts, and their joins."""

    def __init__(self, enc: PieceEncoder):
        self.enc = enc
        back = {c: b for b, c in enc.letters.items()}
        added = {i: t.content for i, t in enc.tokenizer.get_added_tokens_decoder().items()}
        vocab = enc.tokenizer.get_vocab(with_added_tokens=True)
        spelled = lambda i, s: s.encode() if i in added and not set(s) <= set(back) else bytes(map(back.__getitem__, s))
        self.bytes: dict[int, bytes] = {i: spelled(i, s) for s, i in vocab.items()}
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for i, b in self.bytes.items():
            self.size[i] = len(b)

    def text(self, ids: np.ndarray) -> str:
        """As the library decodes: bytes of all ids together, what isn't UTF-8 replaced; unknown ids are left out."""
        return b"".join([self.bytes.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")

    def _spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def _whole_chars(self, ids: np.ndarray) -> str:
        """The whole characters at the start."""
        return self._spelled(ids).decode("utf-8", "ignore")

    def _words(self, text: str) -> list[tuple[str, int]]:
        """The words of a text in the vocabulary's letters, each with its end in characters."""
        return [(w, b) for w, (_, b) in self.enc.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _ids(self, word: str) -> np.ndarray:
        return np.frombuffer(self.enc._ids(word), "<u4")

    def _tail(self, text: str) -> tuple[int, bool]:
        """(bytes, whether they are one word) of the words at the end that what follows may change; text must begin where a word does."""
        n, start, words = len(text), 0, self._words(text)
        for k, (_, end) in enumerate(words):
            closed = end < n and not text[end - 1].isspace() and text[start] != "'"
            if not (closed or end <= n - AHEAD):
                return len(text[start:].encode()), k == len(words) - 1 and text[start] != "'"
            start = end
        return 0, False

    def _tokens(self, ids: np.ndarray, n_bytes: int, last: bool = False) -> int:
        """How many of the first (last) ids have n_bytes together."""
        k = 64
        while n_bytes:
            upto = np.cumsum(self.size[ids[::-1][:k] if last else ids[:k]])
            if upto[-1] >= n_bytes:
                return int(np.searchsorted(upto, n_bytes)) + 1
            k *= 8
        return 0

    def part(self, text: str) -> Part:
        ids, k = np.frombuffer(self.enc.encode([text])[0], "<u4"), 64
        if not text:
            return Part(ids, 0, 0, False)
        while (first := self._words(text[:k])[0][1]) > k - AHEAD and k < len(text):
            k *= 8
        near = max(text.rfind(" ", 0, len(text) - AHEAD - 1), 0)
        if not (near and not text[near - 1].isspace() and not text[near + 1].isspace()):  # else a word begins there, whatever came before
            near = 0
        tail, single = self._tail(text[near:])
        return Part(ids, self._tokens(ids, len(text[:first].encode())), self._tokens(ids, tail, last=True), single)

    def seam(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of a word of which a and b are the ids of both parts."""
        i = j = 4
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self._spelled(np.concatenate((a[len(a) - i :], b[:j])))
            w = self._ids(window.decode("latin-1").translate(self.enc.letters))
            left, right = i == len(a) or w[0] == a[len(a) - i], j == len(b) or w[-1] == b[j - 1]
            if left and right:
                return np.concatenate((a[: len(a) - i], w, b[j:]))
            i, j = i if left else 2 * i, j if right else 2 * j

    def _one_word(self, x: Part, y: Part) -> bool:
        """Whether the last word of x and the first of y are one word, and y's other words stand."""
        if not x.single or y.tail > len(y.ids) - y.head and not (y.single and y.head == len(y.ids)):
            return False
        before, behind = self._spelled(x.ids[-4:]).decode("utf-8", "ignore")[-1:], self._whole_chars(y.ids[:4])[:1]
        if not before or not behind or "'" in before + behind or before == "\ufffd" or before.isspace() or behind.isspace():
            return False
        return len(self._words(before + behind)) == 1

    def join(self, x: Part, y: Part) -> Part:
        a, b = x.ids, y.ids
        if not len(a) or not len(b):
            return x if len(a) else y
        kept, open_word = a[: len(a) - x.tail], a[len(a) - x.tail :]
        if self._one_word(x, y):
            word, whole = self.seam(open_word, b[: y.head]), y.head == len(b)
            return Part(np.concatenate((kept, word, b[y.head :])), x.head if len(kept) else len(word), len(word) if whole else y.tail, y.single)
        left, k = self._whole_chars(open_word), 16
        while True:
            right, whole = self._whole_chars(b[:k]), k >= len(b)
            both = left + right
            new = self._words(both)
            stands = {0, *(e for _, e in self._words(right) if whole or e <= len(right) - AHEAD)}
            stop = next((e for _, e in new if (whole or e <= len(both) - AHEAD) and e - len(left) in stands), None)
            if stop is not None:
                break
            k *= 4
        # word by word: what stands alone at the end of a text may be cut otherwise before what follows
        words = [self._ids(w) for w, e in new if e <= stop]
        used = self._tokens(b, len(both[len(left) : stop].encode()))
        ids = np.concatenate((kept, *words, b[used:]))
        head = x.head if len(kept) else len(words[0])
        if len(b) - used > y.tail:
            return Part(ids, head, y.tail, y.single)
        tail, single = self._tail(both[:stop] + self._whole_chars(b[used:]))  # no word of the right half surely stands
        return Part(ids, head, self._tokens(ids, tail, last=True), single)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """The whole tree in one place."""
        stack: list[tuple[int, Part]] = []
        for k, piece in enumerate(halves(text, leaf)):
            self.push(stack, k, self.part(piece))
        return self.top(stack)

    def push(self, stack: list[tuple[int, Part]], k: int, part: Part) -> None:
        """Put leaf k on a stack of subtrees; those of equal height join."""
        height = 0
        while stack and k & 1:
            part, k, height = self.join(stack.pop()[1], part), k >> 1, height + 1
        stack.append((height, part))

    @staticmethod
    def top(stack: list[tuple[int, Part]]) -> np.ndarray:
        return stack[0][1].ids if stack else np.empty(0, "<u4")


def halves(text: str, leaf: int) -> list[str]:
    """The leaves of a full binary tree over a text, each of at most `leaf` characters."""
    n, parts = len(text), 1
    while -(-n // parts) > leaf:
        parts *= 2
    cuts = [n * k // parts for k in range(parts + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


_HALVES: dict = {}


def _coder(path: str) -> Halves:
    if path not in _HALVES:
        _HALVES[path] = Halves(encoder(path, "byte", PIECES))
    return _HALVES[path]


def _ids_column(ids: pd.Series) -> pd.array:
    return pd.array([None if pd.isna(d) else int(d) for d in ids], dtype="Int64")


def encode(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of doc_id and text, by the byte-level vocabulary at `path`."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, "byte", PIECES)
        for b in batches:
            yield pd.DataFrame({"doc_id": _ids_column(b["doc_id"]), "ids": [ids for _, ids in encode_slices(b["text"].tolist(), enc)]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        added = encoder(path, "byte", PIECES).added
        for b in batches:
            for doc, digest, text in zip(_ids_column(b["doc_id"]), b["digest"], b["text"]):
                spans = [s for m in added.finditer(text) for s in m.span()]
                edges = [0, *spans, len(text)]
                stretches = [text[x:y] for x, y in zip(edges, edges[1:]) if x < y]
                for s, stretch in enumerate(stretches):
                    rows = halves(stretch, leaf)
                    for at in range(0, len(rows), 256):
                        some = rows[at : at + 256]
                        yield pd.DataFrame({"doc_id": pd.array([doc] * len(some), dtype="Int64"), "digest": digest, "stretch": s, "leaf": range(at, at + len(some)), "text": some})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(path)
        for b in batches:
            parts = [coder.part(t) for t in b["text"]]
            out = b[["doc_id", "digest", "stretch", "leaf", "copies"]].copy()
            out["doc_id"] = _ids_column(out["doc_id"])
            yield out.assign(ids=[p.ids.tobytes() for p in parts], head=[p.head for p in parts], tail=[p.tail for p in parts], single=[p.single for p in parts])

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, now, copies, done, stack, stretch = _coder(path), None, 0, [], [], None

        def document() -> Iterator[pd.DataFrame]:
            ids = b"".join([*done, coder.top(stack).tobytes()])
            for _ in range(copies):
                yield pd.DataFrame({"doc_id": pd.array([now[0]], dtype="Int64"), "ids": [ids]})

        for b in batches:
            for doc, digest, s, k, n, *part in zip(_ids_column(b["doc_id"]), *[b[c] for c in ("digest", "stretch", "leaf", "copies", "ids", "head", "tail", "single")]):
                key = (None if doc is pd.NA else doc, digest)
                if key != now:
                    if now is not None:
                        yield from document()
                    now, copies, done, stack, stretch = key, n, [], [], s
                elif s != stretch:
                    done.append(coder.top(stack).tobytes())
                    stack, stretch = [], s
                coder.push(stack, k, Part(np.frombuffer(part[0], "<u4"), *part[1:]))
        if now is not None:
            yield from document()

    short = d.filter(F.length("text") <= leaf).mapInPandas(at_once, "doc_id long, ids binary")
    long = d.filter(F.length("text") > leaf).select("doc_id", F.sha2("text", 256).alias("digest"), "text")
    rows = long.mapInPandas(cut, "doc_id long, digest string, stretch long, leaf long, text string")
    rows = rows.groupBy("doc_id", "digest", "stretch", "leaf", "text").agg(F.count("*").alias("copies"))  # deals the leaves of a text out, too
    coded = rows.mapInPandas(leaves, "doc_id long, digest string, stretch long, leaf long, copies long, ids binary, head long, tail long, single boolean")
    order = ["doc_id", "digest", "stretch", "leaf"]
    grown = coded.repartition("doc_id", "digest").sortWithinPartitions(*order).mapInPandas(grow, "doc_id long, ids binary")
    return short.unionByName(grown)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text to doc_id, ids: as the library decodes, special tokens kept."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(path)
        for b in batches:
            for at in _slices(b["ids"]):
                some = b.iloc[at]
                yield pd.DataFrame({"doc_id": _ids_column(some["doc_id"]), "ids": some["ids"].tolist(), "text": [None if x is None else coder.text(np.frombuffer(x, "<u4")) for x in some["ids"]]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(texts, "doc_id long, ids binary, text string")


def _slices(column: pd.Series, most: int = 4 << 20) -> list[slice]:
    """Slices of about `most` bytes."""
    group = [n // most for n in accumulate(len(x or b"") for x in column)]
    starts = [k for k in range(len(group)) if k == 0 or group[k] != group[k - 1]]
    return [slice(a, b) for a, b in zip(starts, [*starts[1:], len(group)])]


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    d = decode(encode(load(spark, sf_dir, "documents"), path), path)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
