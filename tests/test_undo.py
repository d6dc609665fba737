"""Random merges, splits and undoings against a plain simulation that undoes one entry after the other, the latest first."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import undo

NOW = datetime(2026, 9, 30)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories(spark, seed):
    rnd = random.Random(seed)
    owner = {("source", i): rnd.randint(0, 9) for i in range(40)} | {("addendum", i): rnd.randint(0, 9) for i in range(15)}
    record = {i: f"record {i}" for i in range(10)}
    log, moves, snaps, fresh = [], [], [], 100
    for e in range(18):
        if rnd.random() < 0.5 and len(record) > 2:
            victim, survivor = rnd.sample(sorted(record), 2)
            moved = {k: survivor for k, o in owner.items() if o == victim}
            before = {victim: record.pop(victim), survivor: record[survivor]}
            record[survivor] += f" with {victim}"
        else:
            key = rnd.choice(sorted(owner))
            moved, before = {key: fresh}, {owner[key]: record[owner[key]], fresh: None}
            record[owner[key]] += " less one"
            record[fresh] = f"split {fresh}"
            fresh += 1
        moves += [(e, *k, owner[k], to) for k, to in moved.items()]
        snaps += [(e, i, b) for i, b in before.items()]
        log.append((e, e, NOW - timedelta(days=rnd.choice([1, 2, 40])), rnd.random() < 0.1))
        owner |= moved
    asked = rnd.sample(range(18), 11) + [77]
    children, records = ([(*k, o) for k, o in owner.items()], sorted(record.items()))
    touch = {e: {(k, i) for f, k, i, *_ in moves if f == e} | {("record", i) for f, i, _ in snaps if f == e} for e in range(18)}
    live, refusal = {e for e, *_, gone in log if not gone}, {}
    for e in sorted(asked, reverse=True):
        if e == 77:
            refusal[e] = "missing"
        elif e not in live:
            refusal[e] = "undone"
        elif log[e][2] < NOW - timedelta(days=30):
            refusal[e] = "expired"
        elif any(touch[e] & touch[f] for f in live if f > e):
            refusal[e] = "moved_since"
        else:
            refusal[e] = None
            live.remove(e)
            owner |= {(k, i): old for f, k, i, old, _ in moves if f == e}
            for _, i, b in [s for s in snaps if s[0] == e]:
                record.pop(i, None)
                record |= {i: b} if b is not None else {}
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = d(log, "entry int, seq int, created_at timestamp, undone boolean"), d(moves, "entry int, kind string, item int, old int, new int"), d(snaps, "entry int, opp_id int, before string")
    verdicts = undo.judged(*tables, d([(a,) for a in asked], "entry int"), F.lit(NOW))
    assert {r["entry"]: r["refusal"] for r in verdicts.collect()} == refusal
    home, kept, marked = undo.undone(d(children, "kind string, item int, owner int"), d(records, "opp_id int, record string"), *tables, verdicts)
    assert {(r["kind"], r["item"]): r["owner"] for r in home.collect()} == owner
    assert {r["opp_id"]: r["record"] for r in kept.collect()} == record
    assert {r["entry"] for r in marked.collect() if not r["undone"]} == live and set(refusal.values()) >= {None, "moved_since", "missing"}


def test_moves(spark):
    children = spark.createDataFrame([("s", 1, 10), ("s", 2, 10), ("s", 3, 11)], "kind string, item int, owner int")
    m = undo.merge_moves(children, spark.createDataFrame([(1, 10, 11)], "entry int, victim int, survivor int"))
    after = undo.apply_moves(children, m)
    assert sorted(map(tuple, m.collect())) == [(1, "s", 1, 10, 11), (1, "s", 2, 10, 11)] and {r["owner"] for r in after.collect()} == {11}
    s = undo.split_moves(after, spark.createDataFrame([(2, "s", 3, 12)], "entry int, kind string, item int, new int"))
    assert [tuple(r) for r in s.collect()] == [(2, "s", 3, 11, 12)]
