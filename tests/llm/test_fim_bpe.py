"""Fill-in-middle and byte-pair encoding over the smallest tables and odd ones, against plain versions and the tokenizers library."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from sluice.llm import bpe, fim, queries
from sluice.llm.tokens import PieceEncoder
from tests.llm.test_llm import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string"
sha = lambda b: hashlib.sha256(b).hexdigest()
ODD = [(None, None), (None, "a b c d e f"), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "x"), (3, "x"), (4, " é 日本  🙂 \x00 z "), (5, "a <P> b"), (6, "<S"), (7, "<M>"), (8, "w " * 300_000), (9, "q" * 400_000), (10, "<P <S <M >")]


def plain_fim(doc_id, text):
    text = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fim_of_odd_tables(spark):
    rows = ODD + [(i, f" some  words of {i}\n and more" * (i % 7)) for i in range(20, 400)]
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{DOCS}, n long, form string").withColumnRenamed("form", "output")
    got = fim.fill_in_middle(d)
    back = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restore(got["output"], got["form"]).alias("text")).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:6] for r in back), key=key) == sorted(((i, *plain_fim(i, t)) for i, t in rows), key=key)
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in rows) and {r["form"] for r in back} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_op11_by_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    clean = lambda d: sorted(tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    got = queries.QUERIES["op11_fill_in_middle"](spark, SF).toPandas()
    assert clean(got) == clean(con.execute(queries.ORACLES["op11_fill_in_middle"]).df())
    texts = dict(pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    assert all(r == sha((texts[i] or "").encode()) for i, r in zip(got["doc_id"], got["restored_sha256"]))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def coder():
    return bpe.Halves(PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "byte", 5000))


def test_halves_of_random_texts(library, coder):
    rnd = random.Random(12)
    units = ["a", "b", "'", "'s", "'ll", " ", "  ", "\n", "é", "日本", "1", "23", "!", "--", "the ", "ing", "\t", " ", "\x1c", " ", "x" * 7, "ab" * 5, "l", "'re", "🙂", "\r\n", "aaaa", "�"]
    for _ in range(4000):
        some = rnd.sample(units, rnd.choice([2, 4, 8, len(units)]))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(0, rnd.choice([6, 20, 80]))))
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text, rnd.choice([1, 2, 3, 5, 9, 17])).tolist() == want, repr(text)
        assert coder.text(np.array(want, "<u4")) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 100_003, "ab" * 60_001 + "c", " " * 50_001 + "a", "日本" * 30_001, "a1" * 50_001, "'" * 30_001 + "ll", "\n" * 40_000, "!?" * 40_000 + "s"])
def test_long_unsplit_texts(library, coder, text):
    assert coder.encode(text, 1000).tolist() == library.encode(text, add_special_tokens=False).ids


def test_windows_grow_until_both_sides_agree(library, coder):
    """A word of one letter moves every token behind the seam where its left half doesn't end with a whole token."""
    left, right = coder.part("a" * 1001), coder.part("a" * 4096)
    ids = lambda s: library.encode(s, add_special_tokens=False).ids
    assert coder.join(left, right).ids.tolist() == ids("a" * 5097) != ids("a" * 1001) + ids("a" * 4096)


def test_bpe_of_odd_tables(spark, library):
    rnd = random.Random(13)
    rows = ODD + [(11, "a <|endoftext|> b" * 40), (12, "x" * 50 + "<|endoftext|>" * 3 + "y " * 70), (13, "<|endoftext|>" * 20), (14, "same " * 50), (14, "same " * 50), (None, "none " * 60)]
    rows += [(i, "".join(rnd.choice(["a", " ", "b'", "s", "\n", "é ", "12"]) for _ in range(rnd.randint(0, 300)))) for i in range(30, 130)]
    d = spark.createDataFrame([(*r, b"", "?") for r in rows], f"{DOCS}, ids binary, digest string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = bpe.decode(bpe.encode(d, path, leaf=40), path).collect()
    want = {t or "": library.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert all(np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want[r["text"]] for r in got)
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOCS), path), path).count() == 0


def test_op12_by_the_library(spark, library):
    texts = {i: t or "" for i, t in pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)}
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_bpe"](spark, SF).collect()}
    assert set(got) == set(texts) and any(len(t) > bpe.LEAF for t in texts.values())
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
