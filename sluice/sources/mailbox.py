"""A folder of message files as a data source: spark.read.format("mailbox") and spark.readStream.format("mailbox").

Files are taken in order of arrival (when they got their name in the folder), each once; a batch reads a slice of files in each
task. The stream has three offsets: how far it is with new files, how far with the older ones behind `since` (the newest first),
and which failed files it tries again, the how manieth time. A file that can't be read gives a row with its error; tries are
noted in the state folder, and after `tries` of them it is left.

What a batch will take is noted in the state folder before Spark logs it, so that a restart goes on from there at least; which
files belong to a batch follows from its two offsets alone. So each file comes once, whenever the driver stops.

Options: path (a folder that driver and executors mount), state (a shared folder, streams only), pattern (*.eml), since (ISO time,
UTC; files that arrived before it are backfill), batch (new files a batch, 200), backfill (older files a batch, 100), tries (5),
slice (files a task, 50).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sluice.sources import mail

SCHEMA = mail.MESSAGE + ", attempt int"
_NAMES = [n.split()[0] for n in mail.MESSAGE.replace("attachments array<struct<filename: string, mime: string, size: long, sha256: string, data: binary>>", "attachments x").split(", ")]
_FILE = ("filename", "mime", "size", "sha256", "data")


class Files(InputPartition):
    """(name, attempt) of a task's files."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


class _Reading:
    """What batches and streams share."""

    def __init__(self, options: dict):
        self.folder = Path(options["path"].removeprefix("file://"))
        self.pattern, self.tries = options.get("pattern", "*.eml"), int(options.get("tries", 5))
        self.most, self.older, self.size = int(options.get("batch", 200)), int(options.get("backfill", 100)), int(options.get("slice", 50))
        since = options.get("since")
        self.since = int(datetime.fromisoformat(since).replace(tzinfo=UTC).timestamp() * 1e9) if since else 0
        self.state = Path(options["state"].removeprefix("file://")) if options.get("state") else None

    def files(self) -> list[list]:
        """[arrival, name] in order."""
        found = []
        for p in self.folder.glob(self.pattern):
            try:
                found.append([p.stat().st_ctime_ns, p.name])
            except FileNotFoundError:  # gone since it was listed
                continue
        return sorted(found)

    def slices(self, files: list[tuple[str, int]]) -> list[Files]:
        return [Files(files[k : k + self.size]) for k in range(0, len(files), self.size)]

    def rows(self, part: Files | None) -> Iterator[tuple]:
        """Parsed files; Spark asks for None where there are no partitions."""
        for name, attempt in part.value if part else []:
            try:
                m = {"path": name, **mail.parse((self.folder / name).read_bytes())}
                m["attachments"] = [tuple(f[c] for c in _FILE) for f in m["attachments"]]
            except Exception as e:  # noqa: BLE001  one bad file must not stop a batch; it is a row, and noted
                m = {"path": name, "error": f"{type(e).__name__}: {e}"[:400]}
                if self.state:
                    (self.state / "failed").mkdir(parents=True, exist_ok=True)
                    (self.state / "failed" / f"{name}.{attempt}").touch()
            yield (*[m.get(c) for c in _NAMES], attempt)


class MailboxReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.slices([(name, 1) for _, name in self.files()])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class MailboxStream(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        if self.state is None:
            raise ValueError("a stream needs the option state: a folder of its own that driver and executors share")

    def initialOffset(self) -> dict:
        return {"new": [self.since, "\uffff"], "old": [self.since, "\uffff"], "again": {}}

    def _noted(self) -> dict | None:
        at = self.state / "planned.json"
        return json.loads(at.read_text()) if at.exists() else None

    def latestOffset(self) -> dict:
        at = self._noted() or self.initialOffset()
        files = self.files()
        new = [f for f in files if f > at["new"]][: self.most]
        old = [f for f in reversed(files) if f <= [self.since, "\uffff"] and f < at["old"]][: self.older]
        failed: dict[str, int] = {}
        for p in sorted((self.state / "failed").glob("*.*")) if (self.state / "failed").exists() else []:
            name, _, attempt = p.name.rpartition(".")
            failed[name] = max(failed.get(name, 0), int(attempt))
        again = at["again"] | {n: k + 1 for n, k in failed.items() if k < self.tries and k >= at["again"].get(n, 1)}
        end = {"new": new[-1] if new else at["new"], "old": old[-1] if old else at["old"], "again": again}
        if end != at:
            self.state.mkdir(parents=True, exist_ok=True)
            part = self.state / f"planned.{uuid.uuid4().hex}.tmp"
            part.write_text(json.dumps(end))
            part.replace(self.state / "planned.json")
        return end

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [(f[1], 1) for f in self.files() if start["new"] < f <= end["new"] or end["old"] <= f < start["old"]]
        again = [(n, k) for n, last in end["again"].items() for k in range(start["again"].get(n, 1) + 1, last + 1)]
        return self.slices(new + again)

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(dict(self.options))

    def streamReader(self, schema) -> MailboxStream:
        return MailboxStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mailbox)
