"""Keyed upserts: several tables in one version, repeated epochs, stopped and competing writes, untouched buckets."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.sources import upsert
from sluice.sources.upsert import Rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, n long")


def held(spark, path, name="m", version=None):
    return {r["id"]: (r["v"], r["n"]) for r in upsert.read(spark, path, name, version).collect()}


def test_random_upserts_by_a_dict(spark, tmp_path):
    path, rnd, want, states = str(tmp_path / "s"), random.Random(9), {}, []
    for step in range(4):
        insert = step == 2
        rows = [(rnd.choice([None, *range(40)]), rnd.choice("abc"), k) for k in range(25)]
        for i, v, n in rows:
            if not (insert and states and i in states[-1]):
                want[i] = (v, n)
        assert upsert.upsert(spark, path, {"m": Rows(frame(spark, rows), ["id"], order="n", insert=insert)}, buckets=8) == step + 1
        states.append(dict(want))
        assert held(spark, path) == want
    assert [held(spark, path, version=v + 1) for v in range(4)] == states and upsert.unused(spark, path) == []


def test_a_message_with_its_children_once(spark, tmp_path):
    path = str(tmp_path / "s")
    split = lambda b: {"m": Rows(b, ["id"], insert=True), "files": Rows(b.select("id", F.explode(F.sequence(F.lit(1), "n")).alias("k")), ["id", "k"], insert=True)}
    write = upsert.sink(path, split, "mail")
    write(frame(spark, [(1, "a", 2), (2, "b", 1)]), 0)
    write(frame(spark, [(1, "again", 2)]), 0)  # the same micro-batch once more
    assert upsert.versions(spark, path) == [1] and held(spark, path)[1] == ("a", 2)
    write(frame(spark, [(2, "late", 3), (3, "c", 1)]), 1)
    assert held(spark, path) == {1: ("a", 2), 2: ("b", 1), 3: ("c", 1)} and upsert.read(spark, path, "files").count() == 6
    assert upsert.manifest(spark, path)["epochs"] == {"mail": 1}


def test_a_stopped_write_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    upsert.upsert(spark, path, {"m": Rows(frame(spark, [(1, "a", 1)]), ["id"])})
    commit = upsert._commit

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(upsert, "_commit", stop)
    with pytest.raises(KeyboardInterrupt):
        upsert.upsert(spark, path, {"m": Rows(frame(spark, [(1, "b", 2)]), ["id"])})
    assert held(spark, path) == {1: ("a", 1)} and len(upsert.unused(spark, path)) == 1

    def beaten(s, p, m):
        commit(s, p, {**m, "tables": {}})
        commit(s, p, m)

    monkeypatch.setattr(upsert, "_commit", beaten)
    with pytest.raises(upsert.Conflict):
        upsert.upsert(spark, path, {"m": Rows(frame(spark, [(1, "b", 2)]), ["id"])})


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "s")
    upsert.upsert(spark, path, {"m": Rows(frame(spark, [(i, "a", i) for i in range(200)]), ["id"])}, buckets=16)
    upsert.upsert(spark, path, {"m": Rows(frame(spark, [(7, "b", 0)]), ["id"])})
    a, b = (upsert.manifest(spark, path, v)["tables"]["m"]["folders"] for v in (1, 2))
    assert sum(a[k] != b[k] for k in a) == 1 and len(held(spark, path)) == 200
    with pytest.raises(ValueError, match="another key"):
        upsert.upsert(spark, path, {"m": Rows(frame(spark, []), ["v"])})


def test_sends_are_claimed_once(spark, tmp_path):
    path = str(tmp_path / "s")
    sends = lambda *ids: spark.createDataFrame([(i, "mon") for i in ids], "who long, day string")
    claim = lambda d: sorted(r["who"] for r in upsert.claim(spark, path, d, ["who", "day"]).collect())
    assert [claim(sends(1, 2, 2)), claim(sends(2, 3)), claim(sends(1, 2, 3))] == [[1, 2], [3], []]
