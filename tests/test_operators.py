import io
import random
import zipfile
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.operators import curation, decisions, digest, ingest, merge, resolve, score
from sluice.sources import attachments, mail
from sluice.streaming import streams
from tests import plain_resolution

NOW = datetime(2026, 9, 30, 6, 30)


def snapshot(spark, **over):
    base = {"project_type": "healthcare", "stated_electrical_value": 500_000.0, "tier": "A", "distance_miles": 10.0, "bid_due": NOW + timedelta(days=10), "bid_type": "negotiated"} | over
    return score.score(spark.createDataFrame(pd.DataFrame([base])), F.lit(NOW)).first()


def test_scores(spark):
    r = snapshot(spark)
    assert (r["score"], r["band"], r["caps"]) == (99, "bid", [])
    assert snapshot(spark, tier="blocked")["caps"] == ["gc_blocked"]
    assert snapshot(spark, bid_due=NOW - timedelta(days=1))["score"] == 5
    assert snapshot(spark, stated_electrical_value=16_000_000.0)["caps"] == ["above_hard_max"]
    assert snapshot(spark, project_type="unheard_of")["f_project_type"] == 0.4
    assert snapshot(spark, trade_relevance="none")["score"] == 5


@pytest.mark.parametrize("value, want", [(74_999.0, 0.0), (75_000.0, 0.0), (162_500.0, 0.5), (250_000.0, 1.0), (4e6, 1.0), (6e6, 0.6), (8e6, 0.2), (15e6, 0.0), (15.1e6, 0.0)])
def test_size_curve(spark, value, want):
    assert snapshot(spark, stated_electrical_value=value)["f_size"] == pytest.approx(want)


def test_profile_problems():
    assert score.Profile().problems() == []
    assert score.Profile(thresholds=(10, 20, 30)).problems()


def test_date_rules():
    a, b, sent = datetime(2026, 10, 1, 14), datetime(2026, 10, 8, 14), datetime(2026, 9, 1)
    assert merge.merge_date(None, a, "itb", sent, None) == (a, "set")
    assert merge.merge_date(a, b, "addendum", sent, sent) == (b, "moved")
    assert merge.merge_date(a, b, "reminder", sent, sent) == (a, "conflict")
    assert merge.merge_date(a, a.replace(hour=9), "reminder", sent, sent) == (a, "same")
    assert merge.merge_date(a, b, "date_change", sent - timedelta(days=1), sent) == (a, "stale")
    assert merge.merge_date(a, b, "itb", sent, sent, locked=True) == (a, "conflict")
    assert merge.merge_date(a, b, "award", sent, sent) == (a, "kept")
    assert merge.merge_text("x", 0.5, "y", 0.6) == ("x", 0.5, False)
    assert merge.merge_text("x", 0.5, "y", 0.7) == ("y", 0.7, True)


def messages(n, seed=0):
    rnd = random.Random(seed)
    words = ["harbor", "museum", "clinic", "depot", "stadium", "arcade", "foundry", "granary"]
    out = []
    for i in range(n):
        name = f"{rnd.choice(words)} {rnd.choice(words)}"
        out.append({
            "id": i, "sent_at": NOW + timedelta(hours=rnd.randint(0, 400)), "kind": rnd.choice(["itb", "itb", "addendum", "date_change", "reminder"]), "name": name, "gc_id": rnd.choice([1, 2, None]), "gc_domain": None,
            "platform_ids": [f"p{rnd.randint(0, 20)}"] if rnd.random() < 0.3 else [], "thread_ids": [f"t{rnd.randint(0, 20)}"] if rnd.random() < 0.3 else [], "project_number": None, "lat": None, "lon": None,
            "city": rnd.choice(["Erie", "York", None]), "bid_due": NOW + timedelta(days=rnd.randint(1, 60)), "owner_name": None,
        })
    return out


def test_messages_resolved_as_one_sequence_does(spark):
    """Rounds over all messages give what a plain pass over them gives."""
    rows = messages(60)
    want = {r[0]: (r[1], r[2]) for r in plain_resolution.fold_messages([dict(r, gc_id=float("nan") if r["gc_id"] is None else float(r["gc_id"])) for r in rows])}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], resolve.MESSAGE)
    got = {r["message_id"]: (r["opp_id"], r["role"]) for r in resolve.resolve(df).collect()}
    assert {k: v[0] for k, v in got.items() if v[1] == "merge"} == {k: v[0] for k, v in want.items() if v[1] == "merge"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    got = dict(resolve.components(edges, spark.range(40)).collect())
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and got[25] == 25


def test_anchor_duplicates_by_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), NOW + timedelta(hours=rnd.randint(0, 900))) for i in range(80)]
    got = {r["id"]: r["duplicate_of"] for r in ingest.anchor_duplicates(spark.createDataFrame(rows, "id long, k string, t timestamp"), "k", "t", "id").collect()}
    anchor = {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k in anchor and t - anchor[k][1] <= timedelta(days=7):
            assert got[i] == anchor[k][0]
        else:
            assert got[i] is None
            anchor[k] = (i, t)


def test_status_fold_and_tokens(spark):
    events = spark.createDataFrame([(1, 1, "bidding"), (1, 2, "won"), (1, 3, "submitted"), (1, 4, "won")], "id long, n int, to string")
    r = decisions.status_fold(events, "id", ["n"], "to").first()
    assert (r["status"], r["applied"], r["refused"]) == ("won", 3, 1)
    d = spark.createDataFrame([("a|1",)], "p string").select(decisions.signed(b"k")("p").alias("t"))
    assert d.select(decisions.verified(b"k")("t").alias("x")).first()["x"] and not d.select(decisions.verified(b"z")("t").alias("x")).first()["x"]


def test_merge_then_undo_is_identity(spark):
    rows = spark.createDataFrame([(i, i % 4) for i in range(12)], "message long, opp long")
    opps = spark.createDataFrame([(i,) for i in range(4)], "id long")
    alias = curation.aliases(spark.createDataFrame([(1, 2), (2, 3)], "victim long, survivor long"), opps)
    assert {r["id"]: r["survivor"] for r in alias.collect()} == {0: 0, 1: 3, 2: 3, 3: 3}
    after = curation.apply_aliases(rows, alias, "opp")
    moves = rows.withColumnRenamed("opp", "old")
    assert sorted(curation.undo(after, moves, "opp", "message").select("message", "opp").collect()) == sorted(rows.collect())
    bad = curation.refusals(spark.createDataFrame([(1, 1), (1, 9)], "victim long, survivor long"), opps.withColumn("status", F.lit("new")))
    assert sorted(r["refusal"] for r in bad.collect()) == ["missing", "same"]


def test_digest_sections(spark):
    items = spark.createDataFrame([(1, "undecided", NOW + timedelta(days=2), None, NOW, None, True, False, False), (2, "bidding", NOW + timedelta(days=30), None, NOW, NOW - timedelta(days=1), False, True, False)], "id long, status string, bid_due timestamp, prebid_at timestamp, first_seen timestamp, watermark timestamp, mine boolean, changed boolean, material boolean")
    got = {(r["id"], r["section"]) for r in digest.sections(items, F.lit(NOW)).collect()}
    assert got == {(1, "needs_decision"), (1, "due_this_week"), (2, "new"), (2, "changed")}


EML = b"""Message-ID: <1@x>\r\nFrom: Bob <Bob@Acme.com>\r\nTo: us@home.com\r\nSubject: =?utf-8?q?Fwd=3A_Bid?=\r\nDate: Wed, 30 Sep 2026 06:30:00 -0400\r\nReferences: <0@x>\r\nContent-Type: text/plain\r\n\r\nplease see\r\n---------- Forwarded message ----------\r\nFrom: Ann <ann@gc.com>\r\nDate: Tue, 29 Sep 2026 08:00:00 -0400\r\nSubject: Bid\r\n\r\nDue Friday\r\n"""


def test_messages_parse(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(EML)
    (tmp_path / "b.txt").write_bytes(b"no")
    r = mail.read_folder(spark, str(tmp_path)).first()
    assert (r["from_addr"], r["forwarded_by"], r["forward_note"], r["body_text"].strip(), r["references"]) == ("ann@gc.com", "bob@acme.com", "please see", "Due Friday", ["<0@x>"])
    assert r["sent_at"] == datetime(2026, 9, 29, 12) and r["sent_at_confidence"] == "low"
    assert mail.read(spark, "manual").count() == 0


def test_attachments(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
        f.writestr("b.pdf", "x")
    rows = attachments.extract("x.zip", z.getvalue())
    assert [(m, t, e) for m, t, _, e in rows] == [(None, "a.txt\nb.pdf", None), ("a.txt", "hello", None), ("b.pdf", None, "unsupported")]
    assert attachments.extract("bad.zip", b"zzz")[0][3]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, NOW, "a", False), (2, NOW, "a", False), (3, NOW, "b", True)], "id long, t timestamp, k string, ok boolean").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, t timestamp, k string, ok boolean").parquet(src)
    for name, df, mode in (("u", streams.recent_unique(stream, "k", "t"), "append"), ("b", streams.bucket_counts(stream, "t", ["k"]), "complete"), ("p", streams.poison_counts(stream, "k", "ok", 2), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("u").count() == 2
    assert {r["k"]: r["n"] for r in spark.table("b").collect()} == {"a": 2, "b": 1}
    assert {r["k"]: (r["attempts"], r["given_up"]) for r in spark.table("p").collect()} == {"a": (2, True), "b": (0, False)}
