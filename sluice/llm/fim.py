"""Fill-in-middle: a text's units in the order prefix, suffix, middle (psm) or suffix, prefix, middle (spm), marked.

Which rows change, and where they are cut, is read from a hash of the seed and the doc_id, so a rerun or another partitioning
gives the same rows; those are columns. The text itself goes through a pipeline of Arrow kernels, a batch at a time: units split
into list arrays, flattened with the index of their parent, numbered within it, filtered by role, rebuilt as lists, and joined.
No step looks at a single row in Python. `restore` rebuilds the text from output and form alone, by column functions.

Units are `[ws]*[other]+|[ws]+`, with the six white-space characters of ASCII, so they cover the text. Edge cases: a null or
empty text has no units and is plain; white space alone is one unit; a text that holds one of the marks is plain, as it couldn't
be rebuilt; a null doc_id counts as an empty number; equal rows give equal results; an empty table gives no rows; other columns
are ignored, whatever their names. Memory is a few times one batch of rows (16 MB, or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import load

UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
NEVER = [bytes([b]) for b in (0xFF, 0xFE, 0xFD, 0xFC, 0xFB, 0xFA, 0xF9, 0xF8, 0xC1, 0xC0)]  # bytes that UTF-8 doesn't have
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def choices(doc_id: Column, seed: int, rate: int, spm: int) -> list[Column]:
    """h1 and h2 (where to cut), moved (whether to), and spm (which form): of the hex sha256 of seed:doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    return [h(1).alias("h1"), h(2).alias("h2"), (h(3) % 100 < rate).alias("moved"), (h(4) % 100 < spm).alias("spm")]


def _offsets(counts: np.ndarray) -> pa.Array:
    stops = np.cumsum(counts)
    if len(stops) and stops[-1] >= 1 << 31:
        raise ValueError("a batch has more units than a list array holds; take fewer rows in a batch")
    return pa.array(np.concatenate(([0], stops)), pa.int32())


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(parents, units) of binary texts: every unit, flattened, with the row that it stands in."""
    for end in NEVER:
        if not pc.any(pc.match_substring(texts, end)).as_py():
            break
    else:
        raise ValueError("texts aren't UTF-8")
    lists = pc.split_pattern(pc.replace_substring_regex(texts, UNIT, rb"\1" + end), end)
    parents, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(flat), 0)  # behind the last unit of each row stands an empty one
    return parents.filter(real), flat.filter(real)


def middle_moved(texts: pa.Array, h1: pa.Array, h2: pa.Array, moved: pa.Array, spm: pa.Array) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars, output of one batch."""
    texts = pc.fill_null(texts, "").cast(pa.large_string() if texts.type == pa.large_string() else pa.string())
    raw = texts.view(pa.large_binary() if texts.type == pa.large_string() else pa.binary())
    parents, flat = units(raw)
    n = np.bincount(parents.to_numpy(), minlength=len(raw)).astype(np.int64)
    a, b = np.mod(h1.to_numpy(), n + 1), np.mod(h2.to_numpy(), n + 1)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    rows = parents.to_numpy()
    ordinal = np.arange(len(flat)) - (np.cumsum(n) - n)[rows]
    role = (ordinal >= lo[rows]).astype(np.int8) + (ordinal >= hi[rows])
    pieces = []
    for k, count in enumerate((lo, hi - lo, n - hi)):
        lists = (pa.LargeListArray if raw.type == pa.large_binary() else pa.ListArray).from_arrays(_offsets(count), flat.filter(pa.array(role == k)))
        pieces.append(pc.binary_join(lists, pa.scalar(b"", raw.type)))
    prefix, middle, suffix = pieces
    marked = pa.array(np.zeros(len(raw), bool))
    for mark in MARKS.values():
        marked = pc.or_(marked, pc.match_substring(raw, mark))
    plain = pc.or_(pc.or_(marked, pc.invert(moved)), pa.array(n == 0))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    p, s, m, none = (pa.scalar(x, raw.type) for x in (*MARKS.values(), b""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    output = pc.if_else(plain, raw, pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none), psm))
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.view(texts.type)).cast(pa.int64()))
    return {"n": pa.array(n), "form": form, "prefix_chars": chars(prefix), "middle_chars": chars(middle), "output": output.view(texts.type)}


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points, null where plain) and output, of doc_id and text.

    `rate` of 100 rows are moved, `spm` of 100 of these in the form spm.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            done = middle_moved(*[b.column(c) for c in ("text", "h1", "h2", "moved", "spm")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[done[f.name].cast(f.type) for f in list(OUT)[1:]]], schema=OUT)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select("*", *choices(F.col("doc_id"), seed, rate, spm)).mapInArrow(batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that a row was made from: the parts between its marks, in the order of the text."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_in_middle(load(spark, sf_dir, "documents"))
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
 ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(out) AS output_sha256, sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN regexp_extract(out, '(?s)^<P>(.*)<S>', 1) || regexp_extract(out, '(?s)<M>(.*)$', 1) || regexp_extract(out, '(?s)<S>(.*)<M>', 1)
 ELSE regexp_extract(out, '(?s)<P>(.*)<M>', 1) || regexp_extract(out, '(?s)<M>(.*)$', 1) || regexp_extract(out, '(?s)^<S>(.*)<P>', 1) END) AS restored_sha256 FROM o"""
