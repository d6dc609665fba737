"""Left-over sets of the Jaccard join: large families of near copies around and below the threshold, against brute force."""

import random

from pyspark.sql import functions as F

from sluice.llm import jaccard
from tests.llm.test_llm import brute_components, mutate, prose, table


def family_rows(seed):
    """Two families whose members lie at every distance from their base, a line that all have, and members of members."""
    rnd, line, rows = random.Random(seed), prose(12, 77, 10**6), []
    for f in range(2):
        base = line + " " + prose(110, 500 + f, 10**6)
        variants = [mutate(base, rnd.choice([0.0, 0.01, 0.02, 0.03, 0.05, 0.08]), rnd) for _ in range(60)]
        variants += [mutate(rnd.choice(variants), 0.01, rnd) for _ in range(20)] + [" ".join(base.split()[: rnd.randint(90, 122)]) for _ in range(10)]
        rows += [(1000 * f + k, v) for k, v in enumerate(variants)]
    return rows


def test_families_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    rows = family_rows(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert len({c for _, c in got.values()}) > 10


def test_left_over_documents_alone_by_brute_force(spark):
    """All documents are left over and each its own component, so the rounds, roots and prefix joins find every component."""
    rows = family_rows(4)
    docs = table(spark, rows)
    sketches = jaccard.sketch_rows(docs)
    meta = sketches.filter("kind = 'm'").select("a", "b", "c", "d", "s")
    own = docs.select("doc_id", F.col("doc_id").alias("component"))
    links = jaccard._leftover_links(docs.select("doc_id", F.lit(1).alias("band")), docs, own, meta)
    label = {r["node"]: r["component"] for r in jaccard.components(links).collect()}
    assert {i: label.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_equal_sets_that_very_many_have(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MANY", 10_000)
    rows = [(i, "the same five words here") for i in range(1_100)] + [(2_000 + i, f"other {i // 2} words stand in here") for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert all(got[i] == 0 for i in range(1_100)) and all(got[2_000 + i] == 2_000 + i - i % 2 for i in range(10))


def test_null_ids_and_clashing_names(spark):
    """Documents without an id are searched by their text; working names give way to the input's."""
    from sluice.llm import decontaminate, jaccard

    item = " ".join(f"word{i}" for i in range(30))
    rows = [(None, f"before {item} after"), (None, "clean words " * 9), (1, item), (2, "other clean words " * 9), (2, "other clean words " * 9), (3, None)]
    d = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, key int, hit_key int, lost int, place int")
    bench = spark.createDataFrame([(7, item), (None, "clean words " * 9)], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(d, bench).collect()), key=str)
    assert found == [(1, 7), (None, 7)]
    left = decontaminate.decontaminate(d, bench)
    assert left.columns == d.columns and sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in rows if not (t and "word3" in t))
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3]


def test_keys_of_letters_alone_are_candidates():
    from sluice.llm import pii

    assert pii.candidates("token ghp_" + "abCD" * 9, []) == [("secret", 6, 46)]
    assert pii.candidates("AKIA" + "Q" * 16, []) and pii.candidates("f" * 32, []) and pii.candidates("me (at) host.org", []) and not pii.candidates("nothing here at all", [])
