"""The registered corpus queries over the smallest tables, against plain Python versions of their contracts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from sluice.llm import decontaminate, merkle, packing, pii, quality, queries, toxicity, warc
from sluice.llm.common import WordHash, new_dir
from tests.llm.test_llm import SF, plain_spans, prose, table

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in zip(DOCS["doc_id"], DOCS["text"])}


# ---- 1


def plain_overlaps(texts, items):
    """Documents and items with a reported run on any diagonal, by comparing every place with every place."""
    hashes, out = WordHash(decontaminate.bare), set()
    w = {i: decontaminate.word_array(t, hashes) for i, t in texts.items()}
    for item, text in items.items():
        v = decontaminate.word_array(text, hashes)
        for doc, x in w.items():
            for d in range(-len(v) + 1, len(x)):
                lo, hi = max(0, -d), min(len(v), len(x) - d)
                if hi > lo and (v[lo:hi] == x[lo + d : hi + d]).sum() >= 4 and decontaminate.runs(v[lo:hi], x[lo + d : hi + d], len(v)):
                    out.add((doc, item))
                    break
    return out


def test_op1_by_brute_force(spark, texts):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op1_decontamination(spark, SF).select("doc_id", "item_id").distinct().collect()}
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    rnd = random.Random(1)
    some = dict(rnd.sample(sorted(texts.items()), 60)) | {d: texts[d] for d, _ in got}
    want = plain_overlaps(some, dict(zip(bench["item_id"], bench["text"])))
    assert got and {p for p in got if p[0] in some} <= want
    assert len(want - got) <= 0.02 * len(want)


def test_all_runs_short_and_changed_items(spark):
    a, b = prose(20, 1, 10**6), prose(20, 2, 10**6)
    two = spark.createDataFrame([(1, f"{a} {prose(40, 3, 10**6)} {b}"), (2, "just four plain words"), (3, prose(9, 5, 10**6)), (4, prose(15, 6, 10**6))], "item_id long, text string")
    nine, fifteen = prose(9, 5, 10**6).split(), prose(15, 6, 10**6).split()
    nine[0], fifteen[2::3] = "changed", ["changed"] * 5
    docs = table(spark, [
        (1, f"{a} {prose(40, 4, 10**6)} {b}"), (2, "so Just four, plain words."), (3, "just four plain things"), (4, " ".join(["x", *nine, "y"])), (5, " ".join(["x", *fifteen, "y"])), (6, f"{a} {a}"), (6, f"{a} {a}"),
        (7, "z " * 60_000 + a),
    ])
    got = sorted((r["doc_id"], r["item_id"], r["doc_start"], r["n_words"]) for r in decontaminate.overlaps(docs, two).collect())
    assert [g for g in got if g[0] == 1] == [(1, 1, 0, 20), (1, 1, 60, 20)]
    assert [g for g in got if g[0] == 2] == [(2, 2, 1, 4)] and not [g for g in got if g[0] == 3]
    assert [g[:2] for g in got if g[0] in (4, 5)] == [(4, 3), (5, 4)] and {g[2] for g in got if g[0] == 6} == {0, 20} and [g[2] for g in got if g[0] == 7] == [60_000]


# ---- 2 and 4: their SQL


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op4_warc"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    clean = lambda d: sorted(tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert clean(queries.QUERIES[name](spark, SF).toPandas()) == clean(con.execute(queries.ORACLES[name]).df())


# ---- 3 and 5: held-out accuracy, long words and clauses


@pytest.mark.parametrize("query, label, recall", [(quality.op3_quality, "quality", 0.9), (toxicity.op5_toxicity, "toxic", 0.6)])
def test_held_out_accuracy(spark, query, label, recall):
    d = query(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    h = d[d["held_out"]]
    assert len(h) > 50 and (h["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in h["doc_id"]]).all()
    assert h[h[label] == 1]["predicted"].mean() >= recall and h[h[label] == 0]["predicted"].mean() <= 0.1


def test_scans_are_linear():
    word = ("a" + "!" * 200_000 + "a" + "!" * 200_000).encode()
    units = quality.Units()
    assert units[word] == units[word] and toxicity._norm(word) == "a" + "!" * 200_000 + "a"
    g = toxicity.Grammar({"idiot": 1.0}, {})
    assert g.matches("word " * 200_000 + "you idiot. " + "x " * 200_000)[1] == [[(toxicity.INSULT, 1.0, toxicity.TARGETED, b"idiot.")]]


def test_pooling_by_plain_means():
    rnd, vectors, units = random.Random(3), np.random.default_rng(4).normal(size=(quality.UNITS, 2 * quality.DIM)).astype(np.float32), quality.Units()
    docs = [None, "", "  ", "one", "one one", "a b\nc d\nc d"] + [" ".join(rnd.choice(["Ab", "c,", "(d)", "é", "12", "x_y!"]) for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    got = quality.pool(docs, units, vectors)
    for t, row in zip(docs, got):
        w, s = quality.units_of(t, units)
        if not len(w):
            assert not row.any()
            continue
        grams = {(a, b) for a, b in zip(w[:-1], w[1:])}
        lines = [x for x in t.split("\n") if x]
        want = [np.log1p(len(w)) / 10, len(set(w)) / len(w), len(grams) / (len(w) - 1) if len(w) > 1 else 1.0, (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0,
                len(set(lines)) / max(1, len(lines)), np.log1p(len(w) / max(1, len(lines))) / 10, np.bincount(s).max() / len(w), len(t) / len(w) / 20]
        assert row[-8:] == pytest.approx(want, abs=1e-5) and row[:-8] == pytest.approx(np.concatenate([vectors[w].mean(0), vectors[s].mean(0)]), abs=1e-4)


def test_composed_transducers():
    g = toxicity.Grammar({"idiot": 1.0, "trash": 0.8}, {})
    found = lambda t: [(m[0], round(m[1], 3), m[2]) for c in g.matches(t)[1] for m in c]
    assert found("he is a piece of trash") == [(toxicity.INSULT, 1.2, toxicity.TARGETED)] or found("a piece of trash") == [(toxicity.INSULT, 1.2, 0)]
    assert found("idiot idiot") == [(toxicity.INSULT, 1.0, 0), (toxicity.INSULT, 1.25, 0)]
    assert found("i will kill you") == [(toxicity.THREAT, 1.0, toxicity.TARGETED)] and found("kill time") == [(toxicity.THREAT, 0.5, 0)]
    assert found("said never idiot") == [(toxicity.INSULT, 1.0, toxicity.NEGATED | toxicity.REPORTED)]


# ---- 4


def test_stale_archives_are_not_read(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1", "x" * 300), (1, "http://a.com/1", "x" * 300), (2, None, "é" * 500_000), (None, "http://b.com", "y")], "page_id long, url string, html string")
    uri = new_dir(spark, "warc-test")
    first = warc.write_warcs(pages, uri)
    second = warc.write_warcs(pages, uri)
    for manifest in (first, second):
        got = warc.merge_runs(warc.index_runs(spark, uri, manifest)).toPandas()
        assert sorted(got["payload_bytes"]) == [1, 300, 300, 1_000_000] and (got["record_type"] == "response").all()


# ---- 6


def test_op6_by_plain_patterns(spark, texts):
    got = {r["doc_id"]: r for r in pii.op6_pii(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = plain_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_reliabilities_by_a_plain_loop():
    rnd = random.Random(6)
    counts = {tuple(rnd.choice([-1, 0, 1]) for _ in range(4)): rnd.randint(1, 50) for _ in range(40)}
    prior, yes, no = pii.reliabilities(counts, 4, rounds=20)
    p = {v: min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v in counts}
    for _ in range(20):
        total = sum(counts.values())
        q = min(0.98, max(0.02, sum(n * p[v] for v, n in counts.items()) / total))
        t = [[(sum(n * p[v] for v, n in counts.items() if v[j] == s) + 1) / (sum(n * p[v] for v, n in counts.items()) + 3) for s in (-1, 0, 1)] for j in range(4)]
        f = [[(sum(n * (1 - p[v]) for v, n in counts.items() if v[j] == s) + 1) / (sum(n * (1 - p[v]) for v, n in counts.items()) + 3) for s in (-1, 0, 1)] for j in range(4)]
        for v in counts:
            a, b = q, 1 - q
            for j in range(4):
                a, b = a * t[j][v[j] + 1], b * f[j][v[j] + 1]
            p[v] = a / (a + b)
    assert prior == pytest.approx(q) and yes == pytest.approx(np.array(t)) and no == pytest.approx(np.array(f))


# ---- 7


def test_op7_by_plain_python(spark, texts):
    got = {r["doc_id"]: r for r in merkle.op7_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    for i, doc in enumerate(ids):
        t, after = texts[doc], texts[ids[(i + 1) % len(ids)]]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        r = got[doc]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (edited == t) and (r["fingerprint"] == r["edited_fingerprint"]) == (edited == t)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.4 > 0.2 > np.mean([r["near_next"] for r in got.values()])


def test_edits_name_the_leaves_that_differ(spark):
    lines = [f"line {i} " + "x" * 100 for i in range(20)]
    other = [*lines]
    other[9] = other[9][:40] + "Y" + other[9][41:]
    other[19] += "tail"
    fp = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(table(spark, [(1, "\n".join(lines)), (2, "\n".join(other)), (3, "")])).collect()}
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(fp[1], fp[2], fp[3])], "a string, b string, c string")
    r = d.select(merkle.edits(F.col("a"), F.col("b")).alias("e"), merkle.edits(F.col("a"), F.col("a")).alias("none"), merkle.likeness(F.col("a"), F.col("b")).alias("n"), merkle.likeness(F.col("a"), F.col("c")).alias("z")).first()
    assert [tuple(e) for e in r["e"]] == [(1, 1, 1), (2, 3, 3)] and r["none"] == [] and 0.9 < r["n"] < 1 and r["z"] == 0


@pytest.mark.parametrize("step", [1, 10**15])
def test_successors_whatever_the_ids(spark, monkeypatch, step):
    monkeypatch.setattr(merkle, "BLOCK", 7)
    rows = [(i * step - 50 * step, f"t{i}") for i in range(100)]
    random.Random(1).shuffle(rows)
    got = {r["text"]: r["next_text"] for r in merkle.with_next(table(spark, rows)).collect()}
    assert got == {f"t{i}": f"t{(i + 1) % 100}" for i in range(100)}


# ---- 8


def test_op8_law(spark, texts):
    d = queries.QUERIES["op8_sharding"](spark, SF).toPandas()
    assert sorted(d["doc_id"]) == sorted(texts) and d["shard"].between(0, 39).all() and (d["law"] == "bytes").all() and d["grown_shard"].isna().all()
    assert (d["size"] == [len(texts[i].encode()) + 16 for i in d["doc_id"]]).all() and (d["text_crc32"] == [zlib.crc32(texts[i].encode()) for i in d["doc_id"]]).all()
    assert all(sorted(g) == list(range(len(g))) for _, g in d.groupby("shard")["slot"])
    assert d.groupby("shard")["size"].sum().max() <= d["size"].sum() / 40 + d["size"].max()


# ---- 9 and 10


def ids_of(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}


crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op9_by_the_library(spark, texts):
    got, start = {r["doc_id"]: r for r in queries.QUERIES["op9_token_files"](spark, SF).collect()}, 0
    want = ids_of("word_bpe_49k.json", texts)
    for i in sorted(texts):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want[i]), crc(want[i]))
        start += len(want[i])


def test_op10_by_the_library(spark, texts):
    d = queries.QUERIES["op10_packing"](spark, SF).toPandas()
    want = ids_of("byte_bpe_50k.json", texts)
    for i, g in d.sort_values("piece").groupby("doc_id"):
        assert g["piece"].tolist() == list(range(len(g))) and g["length"].sum() == len(want[i]) and len(g) == -(-len(want[i]) // 1024)
        assert all(crc(want[i][s : s + n]) == c for s, n, c in zip(g["start"], g["length"], g["ids_crc32"]))
    for _, g in d.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= packing.CAPACITY
    assert set(d["doc_id"]) == set(texts) and d["sequence_id"].nunique() <= 1.03 * d["length"].sum() / 1024 + 2


# ---- the pipeline


def test_pipeline_by_plain_python(spark, texts):
    """Of the documents that toxicity keeps, one of each group stays, none with an overlap, masked at all plain spans, and every token is packed."""
    stages = dict(corpus_pipeline.STAGES)
    docs = corpus_pipeline.load(spark, SF, "documents")
    kept = stages["toxicity"](spark, docs, SF).cache()
    left = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
    scores = {r["doc_id"]: r["score"] for r in toxicity.op5_toxicity(spark, SF).collect()}
    assert set(left) == {i for i, s in scores.items() if s < 0.7}
    from tests.llm.test_llm import brute_components

    groups = brute_components(list(left.items()))
    one = stages["jaccard join"](spark, kept, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c in groups.values()})
    found = {r["doc_id"] for r in decontaminate.overlaps(one, corpus_pipeline.load(spark, SF, "benchmark")).collect()}
    clean = stages["decontamination"](spark, one, SF).cache()
    ids = {r["doc_id"] for r in clean.collect()}
    assert ids == {c for _, c in groups.values()} - found
    masked = {r["doc_id"]: r["text"] for r in stages["pii"](spark, clean, SF).collect()}
    assert set(masked) == ids and all(not plain_spans(re.sub(r"\[[a-z_]+\]", "¤", t or "")) for t in masked.values())
    packed = corpus_pipeline.run(spark, SF).toPandas()
    want = ids_of("byte_bpe_50k.json", {i: t or "" for i, t in masked.items()})
    assert {i: n for i, n in packed.groupby("doc_id")["length"].sum().items()} == {i: len(x) for i, x in want.items()}
