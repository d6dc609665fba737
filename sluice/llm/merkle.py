"""Merkle fingerprints of documents, in DataFrame functions only.

Leaves are chunks of at most 32 code points of a paragraph (a line); a paragraph's node hashes its leaves, a section's node
hashes eight paragraphs, the root hashes the sections. The fingerprint is the tree as text, `root/section:paragraph=leaf.leaf,
paragraph=leaf;section:...`: roots test equality. Two trees are compared from the top: sections that both have are equal to the
last leaf, of the others the paragraphs are compared, and of paragraphs that differ the leaves. edits() walks two trees place by
place and names the leaves that differ, entering no branch whose nodes are equal.

Edge cases: a null text counts as empty; an empty text has one empty paragraph and a root of its own; likeness of two empty
texts is 1, of an empty and another text 0; a table of one document is its own successor; documents with equal doc_id are
ordered by their text's hash, and rows repeated whole follow each other; a null doc_id comes first; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import load

LEAF_CHARS = 32
LEAF_HEX = 10
BRANCH_HEX, NODE_HEX = 16, 32  # of paragraphs and sections, and of the root
SECTION_PARAGRAPHS = 8
BLOCK, MANY = 1024, 4096  # documents a range has, about, and ranges


def _leaf(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, LEAF_HEX)


def _node(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, BRANCH_HEX)


def _hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, NODE_HEX)


def leaves(text: Column) -> Column:
    """array of paragraphs, each an array of leaf hashes."""
    return F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF_CHARS}}}"), F.lit(0)), _leaf))


def fingerprint(tree: Column) -> Column:
    """The tree over paragraphs of leaves, as text."""
    paragraphs = F.transform(tree, lambda ls: F.concat(_node(F.array_join(ls, ".")), F.lit("="), F.array_join(ls, ".")))
    count = F.floor((F.size(tree) + SECTION_PARAGRAPHS - 1) / SECTION_PARAGRAPHS).cast("int")

    def section(i: Column) -> Column:
        own = F.slice(paragraphs, i * SECTION_PARAGRAPHS + 1, SECTION_PARAGRAPHS)
        return F.concat(_node(F.array_join(F.transform(own, lambda p: F.substring_index(p, "=", 1)), ".")), F.lit(":"), F.array_join(own, ","))

    sections = F.transform(F.sequence(F.lit(0), count - 1), section)
    return F.concat(_hash(F.array_join(F.transform(sections, lambda x: F.substring_index(x, ":", 1)), ".")), F.lit("/"), F.array_join(sections, ";"))


def sections_of(fp: Column) -> Column:
    """`section:paragraph=leaf.leaf,...` of each section."""
    return F.split(F.substring_index(fp, "/", -1), ";")


def paragraphs_of(sections: Column) -> Column:
    """`paragraph=leaf.leaf` of all paragraphs of an array of sections."""
    return F.flatten(F.transform(sections, lambda x: F.split(F.substring_index(x, ":", -1), ",")))


def leaves_of(paragraphs: Column) -> Column:
    return F.filter(F.flatten(F.transform(paragraphs, lambda x: F.split(F.substring_index(x, "=", -1), "\\."))), lambda x: x != "")


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), then), F.lit(1))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal roots, else twice the common leaves over the leaves of both. Each branch counts once."""
    size = lambda c: F.size(leaves_of(c))
    level = lambda common, x, y: F.struct(common.alias("common"), F.array_distinct(x).alias("x"), F.array_distinct(y).alias("y"))
    below = lambda s, part: (part(F.array_except(s["x"], s["y"])), part(F.array_except(s["y"], s["x"])))  # noqa: E731  of what differs
    sections = level(F.lit(0), sections_of(a), sections_of(b))
    paragraphs = lambda s: level(size(paragraphs_of(F.array_intersect(s["x"], s["y"]))), *below(s, paragraphs_of))
    leaf_level = lambda p: level(p["common"] + size(F.array_intersect(p["x"], p["y"])), *below(p, leaves_of))

    def share(f: Column) -> Column:
        same = f["common"] + F.size(F.array_intersect(f["x"], f["y"]))
        return F.coalesce(F.try_divide(2.0 * same, 2 * f["common"] + F.size(f["x"]) + F.size(f["y"])), F.lit(0.0))

    return F.when(a == b, 1.0).otherwise(_let(sections, lambda s: _let(paragraphs(s), lambda p: _let(leaf_level(p), share))))


def edits(a: Column, b: Column) -> Column:
    """array of (section, paragraph, leaf), counted from 0, at which two fingerprints differ, as far as either reaches."""
    def differing(x: Column, y: Column, split) -> Column:
        """(place, of a, of b) of the parts of x and y that differ."""
        parts = F.zip_with(split(F.coalesce(x, F.lit(""))), split(F.coalesce(y, F.lit(""))), lambda p, q: F.struct(p.alias("x"), q.alias("y")))
        placed = F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["x"].alias("x"), p["y"].alias("y")))
        return F.filter(placed, lambda p: ~p["x"].eqNullSafe(p["y"]))

    tail = lambda mark, sep: lambda c: F.split(F.substring_index(c, mark, -1), sep)
    of_section = lambda s: F.flatten(F.transform(differing(s["x"], s["y"], tail(":", ",")), lambda p: F.transform(differing(p["x"], p["y"], tail("=", "\\.")), lambda f: F.struct(s["at"].alias("section"), p["at"].alias("paragraph"), f["at"].alias("leaf")))))
    return F.flatten(F.transform(differing(a, b, tail("/", ";")), of_section))


def _blocks(d: DataFrame) -> Column:
    """The number of a row's range of doc_id. Ranges hold about BLOCK rows, whatever the ids are, and there are at most MANY or a
    range for each shuffle partition. A row meets about 2 sqrt(ranges) of the cuts."""
    rows = d.count()
    n = min(-(-rows // BLOCK), max(MANY, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n < 2:
        return F.lit(0)
    cuts = sorted(set(d.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0]))
    width = max(1, math.isqrt(len(cuts)))
    lit = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)  # noqa: E731  one literal, which is read once
    rows_of = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    coarse = F.size(F.filter(lit([r[0] for r in rows_of], "array<bigint>"), lambda c: c <= F.col("key")))
    fine = F.element_at(lit(rows_of, "array<array<bigint>>"), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.size(F.filter(fine, lambda c: c <= F.col("key"))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text: that of the next document by doc_id, after the last that of the first.

    Ranges of neighbouring doc_ids take their successors in a window each; only a range's last document needs the first of the
    next range, and those come from one row a range.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    d = d.withColumn("block", _blocks(d.select("key")))
    order = ["key", F.xxhash64("text")]
    inside = d.withColumn("in_block", F.lead("text").over(Window.partitionBy("block").orderBy(*order)))
    heads = d.groupBy("block").agg(F.min_by("text", F.struct("key", F.xxhash64("text"))).alias("head"))
    chain = Window.orderBy("block")  # numbers of ranges alone
    blocks = heads.select("block").withColumn("after", F.coalesce(F.lead("block").over(chain), F.min("block").over(Window.partitionBy(F.lit(0)))))
    heads = blocks.join(heads.select(F.col("block").alias("after"), "head"), "after").select("block", "head")
    ends = inside.filter("in_block is null").join(heads, "block").select("doc_id", "text", F.col("head").alias("next_text"))
    return inside.filter("in_block is not null").select("doc_id", "text", F.col("in_block").alias("next_text")).unionByName(ends)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""
    tree = docs.select("doc_id", leaves(F.coalesce("text", F.lit(""))).alias("tree"))
    return tree.select("doc_id", fingerprint(F.col("tree")).alias("fingerprint"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(load(spark, sf_dir, "documents")).withColumn("n", F.length("text")).withColumn("h", F.floor(F.col("n") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("h")), F.substring("next_text", F.lit(1), F.col("h")))
    d = d.withColumn("edited", edited)
    trees = d.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[leaves(F.col(c)).alias(c) for c in ("text", "edited", "next_text")])
    prints = trees.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
