"""Phrases within names, by both ways, against a search of each in each."""

import random

import pytest

from sluice.operators.accounts import accounts_in_names


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_phrases_in_names(spark, most):
    rnd = random.Random(8)
    text = lambda a, b: "".join(rnd.choice("abAé ") for _ in range(rnd.randint(a, b)))
    names = [(i, text(0, 14)) for i in range(120)] + [(3, "twice"), (None, "ab"), (500, None), (501, "a" * 3000)]
    accounts = [(i, text(0, 5)) for i in range(80)] + [(7, "twice"), (7, "twice"), (None, "a"), (90, None), (91, "é"), (92, "bA")]
    d = spark.createDataFrame(names, "id long, name string"), spark.createDataFrame(accounts, "account long, phrase string")
    want = {(i, a) for i, n in names for a, p in accounts if None not in (i, n, a, p) and p.strip(" ") and p.strip(" ").lower() in n.lower()}
    got = [tuple(r) for r in accounts_in_names(*d, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert accounts_in_names(d[0], d[1].limit(0), most=most).count() == 0 and accounts_in_names(d[0].limit(0), d[1], most=most).count() == 0
