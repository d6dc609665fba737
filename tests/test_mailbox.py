"""The mailbox data source: each message once, whatever stops the stream; failures are rows and tried again; older files come behind."""

import time
from datetime import UTC, datetime

import pytest

from sluice.sources import mail, mailbox


def put(folder, *numbers):
    for n in numbers:
        (folder / f"m{n:03d}.eml").write_text(f"Message-ID: <{n}@x>\nFrom: A <a@b.com>\nSubject: s {n}\nDate: Mon, 02 Mar 2026 10:00:00 +0000\n\nbody {n}\n")


@pytest.fixture
def box(spark, tmp_path):
    mailbox.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    return folder


def run(spark, box, at, **options):
    """A stream that takes what there is and stops; all rows that it has written so far."""
    d = spark.readStream.format("mailbox").options(path=str(box), state=str(at / "state"), **{k: str(v) for k, v in options.items()}).load()
    d.writeStream.format("parquet").option("path", str(at / "out")).option("checkpointLocation", str(at / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["path"], r["attempt"], r["error"] is None) for r in spark.read.parquet(str(at / "out")).collect())


def test_a_batch_reads_all(spark, box):
    put(box, *range(7))
    got = {r["internet_message_id"]: r for r in spark.read.format("mailbox").option("path", str(box)).option("slice", 2).load().collect()}
    plain = {r["internet_message_id"]: r for r in mail.read_folder(spark, str(box)).collect()}
    assert set(got) == set(plain) == {f"<{n}@x>" for n in range(7)}
    assert all(got[k][c] == plain[k][c] for k in got for c in plain[k].asDict() if c != "path")
    assert spark.read.format("mailbox").option("path", str(box / "none")).load().count() == 0


def test_each_message_once_over_restarts(spark, box, tmp_path):
    put(box, *range(5))
    got = run(spark, box, tmp_path, batch=2)
    assert got == [(f"m{n:03d}.eml", 1, True) for n in range(len(got))] and 2 <= len(got) < 7
    put(box, 5, 6)
    for _ in range(4):
        got = run(spark, box, tmp_path, batch=2)
    assert got == [(f"m{n:03d}.eml", 1, True) for n in range(7)]


def test_offsets_name_their_files(box, tmp_path):
    """A plan that Spark never logged is part of the next batch."""
    put(box, *range(6))
    options = {"path": str(box), "state": str(tmp_path / "s"), "batch": "2"}
    start = mailbox.MailboxStream(options).initialOffset()
    mailbox.MailboxStream(options).latestOffset()  # planned, then the driver is lost
    end = mailbox.MailboxStream(options).latestOffset()
    names = [n for p in mailbox.MailboxStream(options).partitions(start, end) for n, _ in p.value]
    assert sorted(names) == [f"m{n:03d}.eml" for n in range(4)]
    last = mailbox.MailboxStream(options).latestOffset()
    assert sorted(n for p in mailbox.MailboxStream(options).partitions(end, last) for n, _ in p.value) == ["m004.eml", "m005.eml"]
    with pytest.raises(ValueError, match="state"):
        mailbox.MailboxStream({"path": str(box)})


def test_failures_are_rows_and_tried_again(spark, box, tmp_path):
    put(box, 1)
    (box / "bad.eml").mkdir()  # can't be read as a file
    for _ in range(6):
        got = run(spark, box, tmp_path, tries=3)
    assert got == [("bad.eml", 1, False), ("bad.eml", 2, False), ("bad.eml", 3, False), ("m001.eml", 1, True)]


def test_older_files_come_behind(spark, box, tmp_path):
    put(box, *range(5))
    time.sleep(0.05)
    since = datetime.now(UTC).replace(tzinfo=None).isoformat()
    time.sleep(0.05)
    put(box, 10, 11)
    options = {"path": str(box), "state": str(tmp_path / "s"), "since": since, "backfill": "2"}
    stream = mailbox.MailboxStream(options)
    at, taken = stream.initialOffset(), []
    for _ in range(4):
        end = stream.latestOffset()
        taken.append([n for p in stream.partitions(at, end) for n, _ in p.value])
        at = end
    assert [sorted(t) for t in taken] == [["m003.eml", "m004.eml", "m010.eml", "m011.eml"], ["m001.eml", "m002.eml"], ["m000.eml"], []]
