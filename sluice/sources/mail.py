"""Message files: a folder is read as binary files, each RFC-822 message is parsed in its task."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sluice.functions import constants as K

MESSAGE = (
    "path string, error string, internet_message_id string, from_addr string, from_name string, to array<string>, cc array<string>, subject string, sent_at timestamp, "
    "sent_at_confidence string, body_text string, body_html string, body_trimmed string, in_reply_to string, references array<string>, forwarded_by string, "
    "forward_note string, forward_chain array<string>, attachments array<struct<filename: string, mime: string, size: long, sha256: string, data: binary>>"
)
_QUOTES = re.compile("|".join(K.QUOTE_MARKS), re.I)
_FORWARD = re.compile(r"(?m)^-{3,}\s*Forwarded message\s*-{3,}\s*$|^Begin forwarded message:\s*$", re.I)
_FIELD = re.compile(r"(?m)^\s*(From|Date|Sent|Subject|To|Cc):\s*(.*)$", re.I)
DEPTH = 4


def _text(part) -> str:
    """A part's text in its charset, or as near as possible; never raises."""
    data = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset(), "utf-8", "cp1252"):
        try:
            return data.decode(charset or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("utf-8", "replace")


def _plain(html: str) -> str:
    html = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html)
    html = re.sub(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"\2 (\1)", html)
    html = re.sub(r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6])>", "\n", html)
    html = unescape(re.sub(r"(?s)<[^>]+>", "", re.sub(r"(?i)</t[dh]>", "\t", html)))
    return re.sub(r"[ \r\f\v]*\n[ \n\r\f\v]*", "\n", re.sub(r"[ \r\f\v]+", " ", html)).strip()


def _date(value: str | None) -> datetime | None:
    try:
        d = email.utils.parsedate_to_datetime(value) if value else None
    except (TypeError, ValueError):
        return None
    return None if d is None else (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)


def _has_zone(value: str | None) -> bool:
    try:
        return bool(value) and email.utils.parsedate_to_datetime(value).tzinfo is not None
    except (TypeError, ValueError):
        return False


def _addresses(message, name: str) -> list[str]:
    return [a.lower() for _, a in email.utils.getaddresses([str(v) for v in message.get_all(name, [])]) if a]


def _inner(body: str, sender: str, subject: str, sent, depth: int = 0):
    """(body, sender, subject, sent, chain, note) of the innermost forwarded message."""
    m = _FORWARD.search(body)
    if not m or depth >= DEPTH:
        return body, sender, subject, sent, [], None
    note, rest = body[: m.start()].strip(), body[m.end() :].lstrip("\n")
    head, _, text = rest.partition("\n\n")
    fields = {k.lower(): v.strip() for k, v in _FIELD.findall(head)}
    who = email.utils.parseaddr(fields.get("from", ""))[1].lower() or sender
    got = _inner(text, who, fields.get("subject", subject), _date(fields.get("date") or fields.get("sent")) or sent, depth + 1)
    return (*got[:4], [sender, *got[4]], note or None)


def parse(data: bytes) -> dict:
    """One message; the first text/plain and text/html parts win, and html alone is turned into text."""
    import hashlib

    message = email.message_from_bytes(data, policy=email.policy.compat32)
    text = html = inner = None
    files = []
    for part in message.walk():
        if part.get_content_type() == "message/rfc822" and inner is None and part.get_payload():
            inner = part.get_payload(0)
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            if not (part.get_content_maintype() == "image" and part.get("Content-ID") and part.get_content_disposition() != "attachment"):
                payload = part.get_payload(decode=True) or b""
                files.append({"filename": name or "unnamed", "mime": part.get_content_type(), "size": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "data": payload})
        elif part.get_content_type() == "text/plain" and text is None:
            text = _text(part)
        elif part.get_content_type() == "text/html" and html is None:
            html = _text(part)
    header = lambda n: str(email.header.make_header(email.header.decode_header(message[n]))) if message[n] else None
    body = (text if text is not None else _plain(html or "")).replace("\r\n", "\n")
    name, sender = email.utils.parseaddr(header("From") or "")
    sent, zoned = _date(message["Date"]), _has_zone(message["Date"])
    body, who, subject, when, chain, note = _inner(body, sender.lower(), header("Subject") or "", sent)
    if inner is not None and not chain:
        deep = parse(inner.as_bytes())
        who, subject, when, chain, note, body = deep["from_addr"], deep["subject"], deep["sent_at"], [sender.lower(), *deep["forward_chain"]], body.strip() or None, deep["body_text"]
    cut = _QUOTES.search(body)
    return {
        "error": None, "internet_message_id": (message["Message-ID"] or "").strip() or None, "from_addr": who, "from_name": name or None, "to": _addresses(message, "To"), "cc": _addresses(message, "Cc"),
        "subject": subject, "sent_at": when, "sent_at_confidence": "high" if when and not chain and zoned else "low", "body_text": body, "body_html": html,
        "body_trimmed": (body[: cut.start()] if cut else body).strip(), "in_reply_to": (message["In-Reply-To"] or "").strip() or None, "references": (message["References"] or "").split(),
        "forwarded_by": chain[0] if chain else None, "forward_note": note, "forward_chain": chain, "attachments": files,
    }


def parse_messages(files: DataFrame) -> DataFrame:
    """path, content -> parsed messages; what can't be parsed keeps its path and the error."""
    names = [n.split()[0] for n in re.split(r", (?=\w+ (?:string|array|timestamp))", MESSAGE)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append({"path": path, **parse(bytes(content))})
                except Exception as e:  # noqa: BLE001  one bad message must not stop a batch; it is recorded
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:400]})
            out = pd.DataFrame(rows).reindex(columns=names)
            out["sent_at"] = pd.to_datetime(out["sent_at"])
            yield out.astype({c: object for c in names if c != "sent_at"}).where(out.notna(), None).assign(sent_at=out["sent_at"])

    return files.select("path", "content").mapInPandas(run, MESSAGE)


def read_folder(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """The *.eml files of a folder but for the seen ones (column path), parsed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    if seen is not None:
        files = files.join(seen.select("path"), "path", "left_anti")
    return parse_messages(files)


def stream_folder(spark: SparkSession, path: str, files_per_batch: int = 200) -> DataFrame:
    """The same as a stream: the checkpoint keeps which files are done."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", files_per_batch).load(path)
    return parse_messages(files)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGE)


READERS = {"file": read_folder, "manual": lambda spark, path=None: empty(spark)}


def read(spark: SparkSession, kind: str, path: str | None = None) -> DataFrame:
    """By kind; mailbox protocols need a network and aren't offered here."""
    if kind not in READERS:
        raise ValueError(f"unknown source kind: {kind}")
    return READERS[kind](spark, path)
