"""WARC archives of pages, and one ordered index over them by external merge.

Writing: each task writes its pages as one gzip member per record into files of bounded size, behind a warcinfo record. Of
records with equal payloads the one with the smallest page_id is a response and the others are revisits that name it. File
names hold the task's attempt, and readers open only the files that the manifest names, so what a lost task left is never read.
Indexing: each file, read back as a stream, gives a run of captures sorted by (URL key, timestamp, record id). Runs are dealt by
ranges of that order, as many as keep RANGE_ROWS captures in one, and in each range a loser tree merges the segments of its k
runs, so the ranges one after the other are the whole capture history in order. The pages have no capture time: the date of a
record is EPOCH plus its page_id in seconds.

Edge cases: a null html is an empty payload; payloads under 100 bytes are always responses; a null url gives the empty key;
a null page_id is archived as a response with an id of its own and sorts last; a page_id that occurs twice is archived twice, and
equal payloads of one page_id are responses both; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import load, materialize, named_files, new_dir, open_bytes, write_bytes

LEAST_REVISIT = 100  # bytes of payload from which equal payloads are stored once
FILE_BYTES = 32 << 20
RANGE_ROWS = 100_000  # captures that a range of the merge has, about
SAME_ROWS = 500_000  # repeated payloads up to which their digests are broadcast; beyond it the join shuffles the pages
PIECE = 1 << 16  # bytes read at once
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
INDEX = "url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long, size long"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: com,example,www)/path?query. Scheme, fragment and port 80 or 443 are dropped."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _member(head: list[str], block: bytes) -> bytes:
    return gzip.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", 3, mtime=0)


def info_record(file: str) -> bytes:
    """The warcinfo record at the head of a file."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, file)}>", f"WARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"]
    return _member(head, b"format: WARC File Format 1.1\r\n")


def record(url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, stamp: int, own: str = "") -> bytes:
    """One WARC 1.1 record as a gzip member. Digests are base32 of SHA-256. The block is an HTTP head with the payload behind
    it; a revisit has the head alone, and its payload's length is a header. `own` names a record without page_id."""
    label = base64.b32encode(bytes.fromhex(digest)).decode()
    kind = "response" if refers_to is None else "revisit"
    name = f"uuid:{uuid.uuid5(uuid.NAMESPACE_URL, own)}" if page_id is None else f"page:{page_id}"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{name}>", f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Date: {(EPOCH + dt.timedelta(seconds=stamp)).strftime('%Y-%m-%dT%H:%M:%SZ')}", f"WARC-Payload-Digest: sha256:{label}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        block += payload
    return _member([*head, "Content-Type: application/http;msgtype=response"], block)


def read_records(data) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, payload, offset, size) of each gzip member but warcinfo; data: bytes or an open file, which is read in pieces."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    at, left = 0, b""
    while True:
        left = left or stream.read(PIECE)
        if not left:
            return
        z, raw, size = zlib.decompressobj(31), [], 0
        while not z.eof:
            left = left or stream.read(PIECE)
            if not left:
                raise ValueError(f"archive cut off in the record at {at}")
            raw.append(z.decompress(left))
            size += len(left) - len(z.unused_data)
            left = z.unused_data
        head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        if fields["WARC-Type"] != "warcinfo":
            yield fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2], at, size
        at += size


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html with digest and refers_to. Digests alone are shuffled to find repeated payloads, first reduced in
    each task; the pages are too if more than SAME_ROWS payloads are repeated."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    marked = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")
    )
    same = marked.filter((F.col("bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    same = materialize(same.filter("n > 1").select("digest", "first"), "warc-same")
    if same.limit(SAME_ROWS + 1).count() <= SAME_ROWS:
        same = F.broadcast(same)
    return marked.join(same, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_warcs(pages: DataFrame, uri: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive pages under uri; returns the manifest (file, records), written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, attempt, seq, held, size = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, [], 0

        def file_name() -> str:
            return f"part-{part:07d}-{attempt}-{seq:05d}.warc.gz"

        def flush() -> pd.DataFrame:
            write_bytes(f"{uri}/{file_name()}", info_record(file_name()) + b"".join(held))
            return pd.DataFrame({"file": [file_name()], "records": [len(held)]})

        for batch in batches:
            for page_id, url, html, digest, refers_to in batch[["page_id", "url", "html", "digest", "refers_to"]].itertuples(index=False):
                page_id = None if pd.isna(page_id) else int(page_id)
                refers_to = None if pd.isna(refers_to) else int(refers_to)
                held.append(record(url or "", page_id, (html or "").encode("utf-8", "surrogatepass"), digest, refers_to, (page_id or 0) % 250_000_000, f"{file_name()}#{len(held)}"))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    held.clear()
                    size, seq = 0, seq + 1
        if held:
            yield flush()

    return materialize(classify(pages).mapInPandas(write, "file string, records long"), "warc-files")


def index_runs(spark: SparkSession, uri: str, manifest: DataFrame | None = None) -> DataFrame:
    """A sorted run of captures for each archive file, read back; digests of responses are taken from their payloads. Of the
    files under uri those that the manifest names, or all without one."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open_bytes(path) as stream:
                    yield _run(path, stream)

    return named_files(spark, uri, "*.warc.gz", manifest).mapInPandas(read, INDEX)


def _run(path: str, stream) -> pd.DataFrame:
    """The sorted captures of one archive."""
    rows = []
    for fields, body, at, size in read_records(stream):
        kind = fields["WARC-Type"]
        page = fields["WARC-Record-ID"].strip("<>")
        named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha256:")).hex()
        digest = hashlib.sha256(body).hexdigest() if kind == "response" else named
        if digest != named:
            raise ValueError(f"payload and digest differ in {path} at {at}")
        stamp = int((dt.datetime.fromisoformat(fields["WARC-Date"]) - EPOCH).total_seconds())
        refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
        rows.append((
            url_key(fields["WARC-Target-URI"]), stamp, int(page.removeprefix("urn:page:")) if page.startswith("urn:page:") else None,
            len(body) if kind == "response" else int(fields["X-Payload-Length"]), digest, kind, int(refers) if refers else None, path.rsplit("/", 1)[-1], at, size,
        ))
    rows.sort(key=_order)
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([None if pd.isna(v) else int(v) for v in out[c]], dtype="Int64")
    return out


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[8]


class LoserTree:
    """k-way merge of sorted lists: each inner node keeps the loser of its match, so an output costs one path to the root."""

    def __init__(self, runs: list[list[tuple]], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * len(runs)
        self.heads = [key(r[0]) if r else None for r in runs]
        self.loser = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        """Whether run i's head comes before run j's; -1 stands for a run still to enter, which wins all."""
        if i < 0 or j < 0:
            return i < 0
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a, i) < (b, j)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._beats(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.runs:
            i = self.loser[0]
            if i < 0 or self.heads[i] is None:
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None
            self._play(i)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in global order: ranges of (URL key, ts, page_id) in partition order, each merged; adds part and seq."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        by_file: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in batch[names].astype(object).where(batch[names].notna(), None).itertuples(index=False, name=None):
                by_file.setdefault(row[7], []).append(row)
        segments = [by_file[f] for f in sorted(by_file)]
        for s in segments:
            if any(_order(a) > _order(b) for a, b in zip(s, s[1:])):  # a fetch may bring a run's blocks out of turn
                s.sort(key=_order)
        out, seq, part = [], 0, TaskContext.get().partitionId()
        for row in LoserTree(segments, _order):
            out.append((*row, part, seq))
            seq += 1
            if len(out) == 10_000:
                yield _frame(out, names)
                out = []
        if out:
            yield _frame(out, names)

    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(n, "url_key", "ts", "page_id", "file", "at").mapInPandas(merge, f"{INDEX}, part long, seq long")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*names, "part", "seq"])
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([None if pd.isna(v) else int(v) for v in out[c]], dtype="Int64")
    return out


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_dir(spark, "warc")
    manifest = write_warcs(load(spark, sf_dir, "pages"), uri)
    runs = materialize(index_runs(spark, uri, manifest), "warc-runs")
    return merge_runs(runs).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
