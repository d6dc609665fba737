"""The corpus operators on small tables: against brute force, and with nulls, empty texts, copies, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import decontaminate, jaccard, merkle, packing, pii, quality, sharding, token_files, tokens, toxicity, warc
from sluice.llm.common import components, new_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, hash string, bucket int, component_id long"


def table(spark, rows):
    """Documents of (doc_id, text), with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "x", 1, 7) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    return table(spark, [(1, None), (2, ""), (3, "   "), (4, "one two"), (5, "One two"), (6, long), (7, long + " tail"), (8, "a\n\n\nb"), (8, "a\n\n\nb"), (None, "nobody's text"), (9, "é 日本 \U0001f600")])


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def prose(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return " ".join(f"v{rnd.randint(0, vocabulary)}" for _ in range(n))


def test_components_by_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got.get(v, v) == find(v) for v in parent)


# ---- 2


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return {i: (len(sets[i]), label[i]) for i in ids}


def mutate(text, share, rnd):
    return " ".join(f"m{rnd.randint(0, 10**6)}" if rnd.random() < share else w for w in text.split())


@pytest.mark.parametrize("hot", [2, 20])
def test_jaccard_by_brute_force(spark, monkeypatch, hot):
    """Families of near copies around the threshold, a passage that all share, short texts; hot values at 2 force every path."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    rnd = random.Random(hot)
    passage, rows = prose(60, 1), []
    for f in range(8):
        base = passage + " " + prose(rnd.choice([6, 20, 60, 150, 400]), 100 + f, 10**6)
        rows += [(len(rows) + k, mutate(base, rnd.choice([0, 0.01, 0.02, 0.03, 0.04, 0.06]), rnd)) for k in range(rnd.randint(2, 12))]
    rows += [(1000 + i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7)))) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd(spark, odd, empty):
    got = sorted(map(tuple, jaccard.jaccard_components(odd).collect()), key=str)
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29996, 6), (7, 29997, 6), (None, 1, None)} <= set(got) and len(got) == 11
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "9", "None"]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 700):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n).astype(np.uint64)]))
        assert jaccard.hamming(jaccard.bit_sketch(a), jaccard.bit_sketch(b)) <= len(np.setxor1d(a, b))


# ---- 1


def test_decontamination(spark, odd, empty):
    item = prose(30, 5, 10**6)
    words = item.split()
    changed = " ".join("zz" if i % 5 == 4 else w for i, w in enumerate(words))
    docs = table(spark, [(1, prose(50, 6) + " " + item.upper() + ". " + prose(9, 7)), (2, prose(40, 8) + " " + changed), (3, prose(80, 9)), (4, " ".join(words[:6])), (5, None), (None, item)])
    bench = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "", "x"), (None, item, "x"), (13, "too short", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10)}
    assert (got[1, 10]["doc_start"], got[1, 10]["n_words"], got[1, 10]["n_equal"]) == (50, 30, 30) and got[2, 10]["n_equal"] >= 20
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "5"]
    assert decontaminate.overlaps(empty, bench).count() == 0 and decontaminate.overlaps(odd, bench.limit(0)).count() == 0


# ---- 3 and 5


def test_quality(spark, odd, empty):
    got = quality.op3_quality(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    x = got.merge(labels, on="doc_id")
    assert (x["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in x["doc_id"]]).all()
    assert (x[x["held_out"]]["predicted"] == x[x["held_out"]]["quality"]).mean() > 0.9 and got["score"].between(0, 1).all()
    one = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd, 11), (empty, 0)):
        vectors = spark.sparkContext.broadcast(quality.word_vectors(quality.context_sums(docs)))
        scored = docs.select("doc_id", quality.scorer(quality.fit(docs, one, vectors), vectors)("text").alias("s")).toPandas()
        assert len(scored) == n and scored["s"].notna().all()


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 1.0}, {"badpre": 0.5})
    marks = lambda t: [(m[2], m[1]) for clause in g.matches(t)[1] for m in clause]
    assert marks("you idiot.") == [(toxicity.TARGETED, 1.0)]
    assert marks("He is not an idiot.") == [(toxicity.NEGATED, 1.0)]
    assert marks("Bob said that idiot won. idiot") == [(toxicity.REPORTED, 1.0), (0, 1.0)]
    assert marks("idiot you") == [(toxicity.TARGETED, 1.0)]
    assert marks("badprefix") == [(0, 0.5)] and marks("a fine day") == [] and marks(None) == []


def test_toxicity(spark, odd, empty):
    got = toxicity.op5_toxicity(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    assert not got[(got["toxic"] == 0)]["predicted"].any() and got["score"].between(0, 1).all()
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    kept = toxicity.remove_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == 11 and toxicity.remove_toxic(empty, labels).count() == 0


# ---- 4


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(1, "http://a.com/1", big, 1), (2, "http://b.com/é?q=1", None, 2), (3, None, big, 3), (4, "http://a.com/1", "small", 4), (5, "http://a.com:8080/z", "small", 5), (6, "bad url [", "é\r\n\r\nü", 6), (None, "http://n.com", big, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    uri = new_dir(spark, "warc-test")
    warc.write_warcs(pages, uri, file_bytes=300)
    got = {r["page_id"]: r for r in warc.merge_runs(warc.index_runs(spark, uri)).collect()}
    assert len(got) == 7 and got[3]["refers_to"] == 1 and got[3]["record_type"] == "revisit" and got[4]["record_type"] == got[5]["record_type"] == "response"
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    order = [(r["url_key"], r["ts"]) for r in sorted(got.values(), key=lambda r: (r["part"], r["seq"]))]
    assert order == sorted(order)
    none = new_dir(spark, "warc-test")
    warc.write_warcs(pages.limit(0), none)
    assert warc.index_runs(spark, none).count() == 0


def test_loser_tree():
    rnd = random.Random(4)
    for _ in range(200):
        runs = [sorted((rnd.randint(0, 20),) for _ in range(rnd.randint(0, 8))) for _ in range(rnd.randint(0, 9))]
        assert list(warc.LoserTree(runs, lambda r: r)) == sorted(sum(runs, []))


# ---- 6


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_spans_by_plain_patterns():
    rnd = random.Random(5)
    for _ in range(20_000):
        t = "".join(rnd.choice("ab1234567890..@@+- ()-25é") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("4111 1111 1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("9" * 200_000 + "@" + "a" * 200_000) == []


def test_pii(spark, odd, empty):
    docs = table(spark, [(1, 'mail a@b.co token = "' + "0123456789abcdef" * 2 + '" end'), (2, None)])
    r = {x["doc_id"]: x["spans"] for x in pii.find_pii(docs).collect()}
    assert r[1].split(",")[0] == "email:5:11" and r[2] == ""
    masked = {x["doc_id"]: x for x in pii.redact(docs).collect()}
    assert masked[1]["text"].startswith("mail [email] ") and masked[1]["n_chars"] == len(masked[1]["text"]) and masked[2]["text"] is None
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == 11 and pii.find_pii(empty).count() == 0


# ---- 7 and 8


def test_fingerprints(spark, odd, empty):
    rows = [(1, "p1 " * 200 + "\nsecond\nthird"), (2, "p1 " * 200 + "\nsecond\nother"), (3, None), (4, "")]
    fp = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(table(spark, rows)).collect()}
    assert fp[3] == fp[4] and fp[1] != fp[2]
    near = spark.createDataFrame([(fp[1], fp[2], fp[3])], "a string, b string, c string").select(merkle.likeness(F.col("a"), F.col("b")), merkle.likeness(F.col("a"), F.col("c")), merkle.likeness(F.col("c"), F.col("c"))).first()
    assert 0.8 < near[0] < 1 and near[1] == 0 and near[2] == 1
    following = {r["doc_id"]: r["next_text"] for r in merkle.with_next(table(spark, [(5000, "c"), (1, "a"), (2, "b"), (99_999, "d")])).collect()}
    assert following == {1: "b", 2: "c", 5000: "d", 99_999: "a"}
    assert merkle.with_next(odd).count() == 11 and merkle.fingerprints(empty).count() == 0


def test_sharding(spark, odd, empty):
    rnd = random.Random(6)
    rows = [(i, "hot " * 50 if i % 3 == 0 else prose(rnd.randint(1, 60), i)) for i in range(3000)]
    got = sharding.shard(table(spark, rows), 8).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 8 and size.max() - size.min() < 0.02 * size.mean()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"]) and sorted(got["doc_id"]) == list(range(3000))
    cut = got[got["text_crc32"] != zlib.crc32(b"hot " * 50)].groupby("text_crc32")["shard"].nunique()
    assert (cut == 1).all()
    o = sharding.shard(odd, 3).toPandas()
    assert len(o) == 11 and o["size"].min() == 16 and sharding.shard(empty, 3).count() == 0


def test_native_plans(spark, odd):
    for df in (sharding.shard(odd, 3), merkle.fingerprints(odd), merkle.with_next(odd)):
        assert "Python" not in df._jdf.queryExecution().toString()


# ---- 9 and 10


TEXTS = ["", " ", "a  b", " lead", "trail ", "a\n\nb c", "x\t y\r\nz", "don't I'll it's", "é́ é ΑΣ ΑΣ. Σ", "\x1c a\x1cb", "1234 5", "İstanbul ŞŞ", "a \nb", "<|endoftext|> x<|endoftext|>", "日本語 テスト\n中文", "a\x00b \x85 c", "ﬁ ﷺ 가 ᄀ ᅡ", "\nab", "ab\n", "Word, word. Word!\nNext"]


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_give_the_ids_of_whole_texts(name, kind):
    enc = tokens.PieceEncoder(public_tokenizers.path(name), kind, most=5)
    rnd = random.Random(7)
    texts = TEXTS + ["".join(rnd.choice("ab ,.\n'sÉß1 \t") for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [b for _, b in tokens.encode_slices(texts, enc, 200)] == want


def test_simple8b_round_trip():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(0, 400))
        ids = (rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)) >> rng.integers(0, 64, n).astype(np.uint64)
        assert (token_files.unpack_words(token_files.pack_words(ids), n) == ids).all()
    data = token_files.file_bytes(np.arange(40_000), [5, None], np.array([30_000, 10_000]))
    ids, docs, counts = token_files.read_file(data)
    assert (ids == np.arange(40_000)).all() and docs == [5, None] and counts.tolist() == [30_000, 10_000]
    with pytest.raises(ValueError):
        token_files.read_file(data[:-1])


def test_token_files(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    for docs, n in ((odd, 11), (empty, 0)):
        uri = new_dir(spark, "tokens-test")
        rows = token_files.token_starts(token_files.write_token_files(docs, path, uri, file_ids=100), token_files.read_token_files(spark, uri)).toPandas()
        rows = rows.sort_values("start")
        assert len(rows) == n and (rows["start"].tolist() == [0, *rows["n_tokens"].cumsum().tolist()[:-1]] or not n)
    assert rows.empty


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(odd, path, capacity=64).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    for _, g in got[got["doc_id"].isin([6, 7])].sort_values("piece").groupby("doc_id"):
        assert (g["length"].iloc[1:] == 64).all() and g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
    assert packing.pack_documents(empty, path).count() == 0


def test_plans_use_the_histogram_up():
    rng = np.random.default_rng(9)
    for hist in ({700: 50}, {1: 5}, {1024: 3, 512: 7}, {int(k): int(v) for k, v in zip(rng.integers(1, 1025, 60), rng.integers(1, 500, 60))}):
        made = {}
        for p, n in packing.plan(hist):
            assert sum(p) <= 1024
            for length in p:
                made[length] = made.get(length, 0) + n
        assert made == hist


# ---- the pipeline


def test_pipeline(spark):
    docs, kept = corpus_pipeline.load(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and 150 < kept[-1] < 200
    assert "@" not in "".join(m[0] for t in docs.toPandas()["text"] for m in re.finditer(r"[\w.]+@[\w-]+\.\w+", t))
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out["doc_id"].nunique() == kept[-1] and (out.groupby("sequence_id")["length"].sum() <= 1024).all()
