"""The update driver by cases, and similar names and prefix joins by brute force."""

import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.functions.similarity import indel_ratio
from sluice.operators import directory, extract, merge, prefix, update
from sluice.sources import attachments

DAY = lambda n, h=0: datetime(2026, 10, n, h)


def run(spark, messages, status="bidding", locked=(), snooze=None):
    rows = [{"opp_id": 1, "position": i, "message_id": i, "status": status, "locked": list(locked), "snooze_until": snooze, **m} for i, m in enumerate(messages)]
    schema = "opp_id long, position long, " + ", ".join(f"{c} {t}" for c, t in {**update.MESSAGE, **update.START}.items())
    names = [c.split()[0] for c in schema.split(", ")]
    applied = update.apply_updates(spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema))
    return update.final_states(applied).first(), [(h["message_id"], h["field"], h["applied"]) for h in update.history(applied).orderBy("position").collect()]


def test_dates(spark):
    m = [
        {"kind": "itb", "sent_at": DAY(1), "bid_due": DAY(10)}, {"kind": "reminder", "sent_at": DAY(2), "bid_due": DAY(12)}, {"kind": "date_change", "sent_at": DAY(3), "bid_due": DAY(20)},
        {"kind": "addendum", "sent_at": DAY(2), "bid_due": DAY(11)}, {"kind": "rfi_response", "sent_at": DAY(4), "bid_due": DAY(30)}, {"kind": "addendum", "sent_at": DAY(5), "bid_due": DAY(21), "addendum_label": "Addendum 2"},
    ]
    s, log = run(spark, m)
    assert s["bid_due"] == DAY(21) and s["due_moves"] == 3 and s["material"] and s["flags"] == ["date_conflict"]
    assert s["summary"] == "Due date: Oct 20 to Oct 21 [Addendum 2], change 3; addendum: Addendum 2"
    assert [x for x in log if x[1] == "bid_due"] == [(0, "bid_due", True), (1, "bid_due", False), (2, "bid_due", True), (3, "bid_due", False), (5, "bid_due", True)]
    assert [x for x in log if x[1] != "bid_due"] == [(3, "addenda", True), (5, "addenda", True)]


def test_an_old_message_on_a_locked_date_is_stale_not_a_conflict():
    assert merge.merge_date(DAY(9), DAY(8), "itb", DAY(1), DAY(2), locked=True) == (DAY(9), "stale")
    assert merge.merge_date(DAY(9), DAY(8), "itb", DAY(3), DAY(2), locked=True) == (DAY(9), "conflict")


def test_locked_fields_stay(spark):
    m = [{"kind": "itb", "bid_due": DAY(10), "bid_type": "gmp", "prebid": DAY(3), "square_feet": 10.0, "project_name": "A", "project_name_confidence": 0.5}]
    s, log = run(spark, m, locked=["bid_due", "bid_type", "prebid", "size_signals", "project_name"])
    assert s["bid_due"] is s["bid_type"] is s["prebid"] is s["square_feet"] is s["project_name"] is None and s["flags"] == ["locked_conflict"]
    assert [x[1:] for x in log] == [("prebid", False), ("bid_type", False), ("size_signals", False), ("project_name", False)]


def test_scope_sizes_names_and_awards(spark):
    m = [
        {"kind": "itb", "scope_items": ["lighting", "site_lighting"], "channel": "mail", "square_feet": 100.0, "project_name": "Tower", "project_name_confidence": 0.5},
        {"kind": "addendum", "scope_items": ["generator"], "changes_described": "Site lighting is removed.", "channel": "portal", "square_feet": 200.0, "project_name": "Tower B", "project_name_confidence": 0.6},
        {"kind": "itb", "changes_described": "lighting is removed", "project_name": "Tower C", "project_name_confidence": 0.7}, {"kind": "award", "award_text": "we regret to inform you"}, {"kind": "award", "award_text": "congratulations, the award is yours"},
    ]
    s, log = run(spark, m, status="submitted")
    assert s["scope_items"] == ["generator", "lighting"] and s["channels"] == ["mail", "portal"] and s["square_feet"] == 200 and s["project_name"] == "Tower C"
    assert s["status"] == "won" and s["material"] and s["flags"] == ["removed_by_addendum"] and s["summary"] == "status: lost to won, as the sender says"
    assert (3, "status", True) in log and (4, "status", True) in log
    s, log = run(spark, m[3:4], status="undecided")
    assert s["status"] == "lost"
    s, log = run(spark, [{"kind": "award", "award_text": "you have been awarded"}], status="bidding")
    assert s["status"] == "bidding" and s["flags"] == ["outcome_conflict"] and log == [(0, "status", False)]


def test_a_sooner_date_ends_a_snooze(spark):
    s, _ = run(spark, [{"kind": "itb", "bid_due": DAY(9)}], status="snoozed", snooze=DAY(9))
    assert s["status"] == "undecided" and s["snooze_until"] is None and s["flags"] == ["snooze_overridden"]
    s, _ = run(spark, [{"kind": "itb", "bid_due": DAY(10)}], status="snoozed", snooze=DAY(9))
    assert s["status"] == "snoozed"


def test_addenda_gaps_and_outcomes(spark):
    m = [
        {"kind": "addendum", "addendum_number": 1}, {"kind": "addendum", "addendum_label": "Addendum 3"}, {"kind": "date_change", "addendum_label": "Addendum 3"}, {"kind": "addendum", "subject": "Revised drawings"},
        {"kind": "award", "award_text": "we regret to inform you"}, {"kind": "award", "award_text": "it is cancelled", "subject": "end"},
    ]
    flags = [run(spark, m[:n], status="submitted")[0]["flags"] for n in (1, 2, 4)]
    assert flags == [[], ["addendum_gap"], []]  # a label without a number ends the check
    rows = [{"opp_id": 1, "position": i, "message_id": i, "status": "submitted", **x} for i, x in enumerate(m)]
    d = spark.createDataFrame([tuple(r.get(c) for c in ("opp_id", "position", *update.MESSAGE, *update.START)) for r in rows], "opp_id long, position long, " + ", ".join(f"{c} {t}" for c, t in {**update.MESSAGE, **update.START}.items()))
    got = {r["label"]: (r["number"], r["message_id"], r["copies"]) for r in update.addenda(d).collect()}
    assert got == {"Addendum 1": (1, 0, 1), "Addendum 3": (3, 1, 2), "Addendum (Revised drawings)": (None, 3, 1)}
    ended = [(r["position"], r["result"], r["notes"]) for r in update.outcomes(update.apply_updates(d), d).orderBy("position").collect()]
    assert ended == [(4, "lost", "we regret to inform you"), (5, "cancelled", "it is cancelled")]


def several(n, seed):
    rnd = random.Random(seed)
    pick = lambda *xs: rnd.choice(xs)
    return [
        {
            "opp_id": pick(1, 2, 3, 4), "position": i, "message_id": i, "kind": pick("itb", "addendum", "reminder", "date_change", "award"), "sent_at": DAY(pick(*range(1, 28))), "bid_due": pick(None, DAY(pick(*range(1, 28)))),
            "prebid": pick(None, DAY(3), DAY(4)), "scope_items": pick(None, ["lighting"], ["site_lighting", "generator"]), "channel": pick(None, "mail", "portal"), "flags": pick(None, ["bid_bond"]), "bid_type": pick("gmp", "unknown", None, "budget"),
            "square_feet": pick(None, 10.0, 90.0), "gc_name": pick("A", "B", None), "gc_name_confidence": pick(0.1, 0.5, 0.9), "changes_described": pick(None, "Site lighting is removed."), "award_text": pick(None, "it is cancelled", "you have been awarded"),
            "addendum_number": pick(None, None, 1, 2, 4), "provisional": pick(None, False, True), "status": "submitted", "snooze_until": None, "locked": pick([], []),
        }
        for i in range(n)
    ]


ALL = {"opp_id": "long", "position": "long", **update.MESSAGE, **update.START}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in ALL) for r in rows], ", ".join(f"{c} {t}" for c, t in ALL.items()))


def applied_rows(d):
    return sorted((r.asDict(True) for r in d.drop("record").collect()), key=lambda r: r["position"])


def test_a_run_in_parts_equals_one(spark):
    rows = several(120, 3)
    whole = update.apply_updates(frame(spark, rows))
    first = update.apply_updates(frame(spark, rows[:50]), keep=True)
    second = update.apply_updates(frame(spark, rows[50:]), start=update.records(first))
    assert applied_rows(first) + applied_rows(second) == applied_rows(whole)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def streamed(spark, source, at, name, **how):
    out = f"{at}/{name}"
    d = update.update_stream(spark.readStream.schema(frame(spark, []).schema).parquet(source), **how)
    d.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def test_a_stream_stopped_and_started_again(rocks, tmp_path):
    rows, source = several(120, 4), str(tmp_path / "source")
    whole = applied_rows(update.apply_updates(frame(rocks, rows)))
    frame(rocks, rows[:50]).coalesce(1).write.parquet(source)
    assert applied_rows(streamed(rocks, source, tmp_path, "all")) == [r for r in whole if r["position"] < 50]
    frame(rocks, rows[50:]).coalesce(1).write.mode("append").parquet(source)
    assert applied_rows(streamed(rocks, source, tmp_path, "all")) == whole
    before = update.records(update.apply_updates(frame(rocks, rows[:50]), keep=True))
    later = str(tmp_path / "later")
    frame(rocks, rows[50:]).coalesce(1).write.parquet(later)
    assert applied_rows(streamed(rocks, later, tmp_path, "snapshot", start=before)) == [r for r in whole if r["position"] >= 50]


def test_event_time_ends_a_snooze(rocks, tmp_path):
    at = lambda i, day, **m: {"opp_id": i, "position": day, "message_id": day, "sent_at": DAY(day), "kind": "reminder", "status": "snoozed" if i == 1 else "bidding", "snooze_until": DAY(5) if i == 1 else None, **m}
    source = str(tmp_path / "source")
    for day in (1, 9, 12):
        frame(rocks, [at(1 if day == 1 else 2, day)]).coalesce(1).write.mode("append").parquet(source)
        got = streamed(rocks, source, tmp_path, "out", arrived="sent_at", late="1 day").collect()
    over = [r for r in got if r["position"] is None]
    assert [(r["opp_id"], r["status"], r["changes"][0]["why"]) for r in over] == [(1, "undecided", "rested")]


def words(rnd):
    return " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(1, 3)))


def test_similar_names_by_brute_force(spark):
    rnd = random.Random(2)
    names = [words(rnd) for _ in range(150)]
    names += ["".join(c for c in n if rnd.random() > 0.05) + rnd.choice(["", " Inc", " Builders, LLC"]) for n in names]
    other = [n + rnd.choice(["", "a", " Co."]) for n in names[::2]]
    side = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, name string")
    got = {(r["left_id"], r["right_id"]): r["ratio"] for r in directory.similar_names(side(names), side(other)).collect()}
    forms = lambda xs: side(xs).select("id", directory.organisation(F.col("name")).alias("n"), directory.organisation_core(F.col("name")).alias("c")).orderBy("id").collect()
    ratio = lambda x, y: indel_ratio(x, y) if x and y else 0.0
    want = {(a["id"], b["id"]): v for a in forms(names) for b in forms(other) if (v := max(ratio(a["n"], b["n"]), ratio(a["c"], b["c"]))) >= 0.9}
    assert got == pytest.approx(want) and len(want) > 200


@pytest.mark.parametrize("least", [0.25, 0.5, 0.8])
def test_prefix_join_loses_no_pair(spark, least):
    rnd = random.Random(5)
    sets = [sorted({f"g{min(rnd.randint(0, 40), rnd.randint(0, 40))}" for _ in range(rnd.randint(0, 14))}) for _ in range(160)]
    side = lambda x: spark.createDataFrame(list(enumerate(sets)), f"{x} long, grams array<string>")
    got = {(r["a"], r["b"]) for r in prefix.candidates(side("a"), side("b"), *prefix.jaccard_sql(least)).collect()}
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and x and y and len({*x} & {*y}) >= least * len({*x} | {*y})}
    assert want <= got and want


def test_extractor_errors_become_rows(spark):
    def extractor(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["body"] == "bad").any():
            raise ValueError("can't read it")
        return pd.DataFrame({"message_id": batch["message_id"], "kind": "itb"})

    d = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good")], "message_id long, body string")
    got = {r["message_id"]: (r["kind"], r["error"]) for r in extract.extract(d, extractor, "message_id long, kind string, error string").collect()}
    assert got == {1: ("itb", None), 2: (None, "ValueError: can't read it"), 3: ("itb", None)}


def test_attachments_never_raise():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("b.exe", "x")
        z.writestr("xl/workbook.xml", "<w/>")
    data = bytearray(out.getvalue())
    plain = attachments.extract("all.zip", bytes(data))
    assert ("a.txt", "hello", [], None) in plain and "a.txt" in (plain[0][1] or "")
    at = data.find(b"PK\x01\x02")
    data[at + 8] |= 1  # the first member claims to be encrypted
    data[6] |= 1
    assert attachments.extract("all.zip", bytes(data))[0][3] is not None or any(r[3] for r in attachments.extract("all.zip", bytes(data)))


FOLDED = {"bid_due": ["bid_due", "due_moves"], "prebid": ["prebid"], "scope_items": ["scope_items"], "channels": ["channels"], "bid_type": ["bid_type"], "size_signals": ["square_feet"], "gc_name": ["gc_name"], "status": ["status", "snooze_until"]}


@pytest.mark.parametrize("fields", [[f] for f in FOLDED] + [["scope_items", "bid_type", "channels", "size_signals"]])
def test_fields_folded_alone(spark, fields):
    rows = [r | {"status": "snoozed" if r["opp_id"] == 2 else "submitted", "snooze_until": DAY(9) if r["opp_id"] == 2 else None, "locked": ["bid_due", "bid_type", "gc_name"] if r["opp_id"] == 3 else []} for r in several(150, 6)]
    d, columns = frame(spark, rows), [c for f in fields for c in FOLDED[f]]
    whole = update.apply_updates(d)
    cells = lambda x, keys: sorted((tuple(map(str, r)) for r in x.select(*keys).collect()))
    assert cells(update.fold_fields(d, fields), ["opp_id", "position", "message_id", *columns]) == cells(whole, ["opp_id", "position", "message_id", *columns])
    logged = update.history(whole).filter(F.col("field").isin(fields))
    keys = ["opp_id", "position", "message_id", "field", "old", "new", "applied", "why"]
    assert cells(update.fold_fields(d, fields, "changes"), keys) == cells(logged, keys)
    last = update.fold_fields(d, fields, "last")
    assert cells(last, ["opp_id", *columns]) == cells(update.final_states(whole), ["opp_id", *columns])
    for c, of in (("applied", "applied"), ("refused", "not applied")):
        assert sum(r[c] for r in last.collect()) == logged.filter(of).count()
    first = update.fold_fields(frame(spark, rows[:70]), fields, "last", keep=True)
    assert cells(update.fold_fields(frame(spark, rows[70:]), fields, start=first), ["position", *columns]) == cells(whole.filter("position >= 70"), ["position", *columns])


def test_flags_and_outcomes_of_one_pass(spark):
    d = frame(spark, several(150, 7))
    whole = update.apply_updates(d)
    conflicts = {r["opp_id"] for r in update.history(whole).filter("field = 'bid_due' and why = 'conflict'").collect()}
    assert conflicts == {r["opp_id"] for r in update.fold_fields(d, ["bid_due"], "last").collect() if "date_conflict" in r["flags"]}
    key = lambda x: sorted(tuple(r[c] for c in ("opp_id", "position", "result", "message_id", "notes")) for r in x.collect())
    assert key(update.outcomes_of(d)) == key(update.outcomes(whole, d)) != []


def test_odd_cells_and_records_of_other_fields(spark):
    rows = [{"opp_id": 1, "position": 1, "message_id": 1, "kind": "itb", "square_feet": float("nan"), "bid_type": "", "gc_name": None}, {"opp_id": None, "position": 2, "bid_type": "gmp"}]
    d = frame(spark, rows)
    got = update.fold_fields(d, ["size_signals", "bid_type", "gc_name"]).collect()
    assert [(r["opp_id"], r["square_feet"], r["bid_type"], r["gc_name"]) for r in got] == [(1, None, None, None)]
    assert update.fold_fields(frame(spark, []), ["status"], "last").count() == 0
    kept = update.fold_fields(d, ["bid_type"], "last", keep=True)
    for run in (lambda: update.fold_fields(d, ["status"], start=kept), lambda: update.apply_updates(d, start=kept)):
        with pytest.raises(Exception, match="a record "):
            run().collect()
    with pytest.raises(ValueError, match="not folded alone"):
        update.fold_fields(d, ["flags"])


@pytest.mark.parametrize("name", ["awards_folded", "due_dates_folded", "outcomes_recorded", "fields_folded", "names_folded"])
def test_messages_are_shuffled_and_folded_once(spark, name):
    from sluice.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1 and plan.count("Exchange") == 1


def test_copies_of_names_are_compared_once(spark, monkeypatch):
    """40,000 pairs of ids from two distinct names on either side: the join on grams sees the names, not the ids."""
    seen, joined = [], directory.candidates
    monkeypatch.setattr(directory, "candidates", lambda a, b, *how: seen.append((a.count(), b.count())) or joined(a, b, *how))
    side = lambda n, *names: spark.range(n).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 2 + 1).cast("int")).alias("name"))
    got = directory.similar_names(side(200, "Hot Bolt, Inc.", "Ring Works"), side(400, "hot bolt", "ring works LLC")).cache()
    assert got.count() == got.distinct().count() == 40_000 and seen == [(2, 2), (2, 2)]
    assert got.filter("left_id % 2 <> right_id % 2 or ratio <> 1").isEmpty()
    odd = spark.createDataFrame([(None, "hot bolt"), (1, None), (2, "")], "id long, name string")
    assert directory.similar_names(odd, odd).count() == 0
