"""Links of left-over sets: not one for each pair of a group."""

import random

from pyspark.sql import functions as F

from sluice.llm import jaccard
from tests.llm.test_llm import brute_components, mutate, prose, table


def test_left_over_groups_give_few_links(spark):
    """Members of a group that all link with one another, but not with the group's root: far fewer links than pairs."""
    rnd, rows = random.Random(8), []
    for f in range(2):
        base = prose(120, 900 + f, 10**6)
        for g in range(3):
            near = mutate(base, 0.03, rnd)
            rows += [(1000 * f + 100 * g + k, mutate(near, 0.008, rnd)) for k in range(50)]
    docs = table(spark, rows)
    meta = jaccard.sketch_rows(docs).filter("kind = 'm'").select("a", "b", "c", "d", "s")
    own = docs.select("doc_id", F.col("doc_id").alias("component"))
    links = jaccard._leftover_links(docs.select("doc_id", F.lit(1).alias("band")), docs, own, meta).collect()
    assert len(links) < 6 * len(rows)
    label = dict(jaccard.components(spark.createDataFrame(links)).collect())
    assert {i: label.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in brute_components(rows).items()}
