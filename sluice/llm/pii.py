"""Personal data: exact base patterns, and further spans by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Further candidates are weaker forms of the same and
secrets. For each, labelers of three sorts vote for, against or abstain: regex (its form), gazetteer (mail hosts, area codes by
their numbering rule, key prefixes, account lengths by country) and context (words before it, words behind it, its place). The
votes are counted by pattern and by the span's shape (length and share of digits, three steps each) over all documents: a
bounded table, from which expectation-maximisation (Dawid and Skene) estimates each labeler's reliability and the probability of
each pattern. Those probabilities train the final classifier of spans, a logistic regression on the kind, the votes and the
shape. Base spans always stay; candidates at or above the threshold join them.

Edge cases: a null text counts as empty and has no spans; spans are in code points, ends exclusive; equal rows give equal
results; with no candidate or one class only, the prior decides; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import lean, load

KINDS = ["email", "ip", "card", "phone"]  # in this order among spans that start together
MORE = ["phone_local", "email_spelled", "secret", "iban"]
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # starts inside a run of digits fail as its start does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ so that long runs cost their length once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_CANDIDATES = {
    "phone_local": re.compile(r"(?<![0-9+.(-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])"),
    "email_spelled": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[\[(](?:at|AT)[\])][\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?[\[(](?:dot|DOT)[\])][\x20]?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+"),
    "secret": re.compile(r"(?<![A-Za-z0-9_-])(?:[0-9a-f]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,100})(?![A-Za-z0-9_-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[0-9A-Z]{4}){3,7}(?:[\x20]?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"),
}
_CAN_START = re.compile(r"[0-9]|[\[(](?:at|AT)[\])]|gh[pousr]_|sk-|A[KS]IA|[a-f]{32}")  # every candidate holds one of these
_HINT = {
    "phone_local": re.compile(r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|whatsapp|reach)\b"),
    "email_spelled": re.compile(r"(?i)\b(?:mail|e-mail|email|contact|write|reach)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key|credential|bearer)\W{0,6}\Z"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
}
_AGAINST = re.compile(r"(?i)\b(?:version|isbn|order|invoice|sha1|sha256|md5|commit|checksum|digest|part|serial)\b\W{0,6}\Z")
MAIL_HOSTS = frozenset(["gmail", "yahoo", "outlook", "hotmail", "icloud", "example", "mail", "proton", "gmx", "web"])
IBAN_LENGTHS = {  # fixed values
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
_BEHIND = {
    "phone_local": re.compile(r"(?i)\A\W{0,3}(?:ext|extension|x[0-9]|mobile|cell|home|office|fax)\b"),
    "email_spelled": re.compile(r"(?i)\A\W{0,3}(?:for|with|or|if|to)\b"),
    "secret": re.compile(r"\A[\"']"),
    "iban": re.compile(r"(?i)\A\W{0,3}(?:bic|swift)\b"),
}
_UNIT = re.compile(r"(?i)\A\x20?(?:px|mm|cm|kg|pcs|usd|eur|bytes|items|pages)\b")
LABELERS = 5


def _area_code(code: str) -> bool:
    """Whether a number may be an area code: 2 to 9, then not 9, not x11, and none of the groups 37x and 96x that are kept free."""
    return code[0] in "23456789" and code[1] != "9" and code[1:] != "11" and code[:2] not in ("37", "96") and code != "555"


def _mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Of each labeler 1 for, -1 against, 0 abstains: form, gazetteer, words before, words behind, place."""
    span = text[start:end]
    before, behind = text[max(0, start - 40) : start], text[end : end + 20]
    if kind == "phone_local":
        digits = _NOT_DIGIT.sub("", span)
        form = -1 if digits[3] in "01" or len(set(digits)) <= 2 else 1
        gazetteer = 1 if _area_code(digits[:3]) else -1
    elif kind == "email_spelled":
        form = 1 if len(span) >= 9 else 0
        gazetteer = 1 if MAIL_HOSTS & set(re.split(r"[^a-z]+", span.lower())) else 0
    elif kind == "secret":
        form = 1 if len(set(span)) >= 8 else -1
        gazetteer = 1 if span.startswith(KEY_PREFIXES) else 0
    else:
        bare = span.replace(" ", "")
        form = 1 if _mod97(bare) else -1
        gazetteer = 1 if IBAN_LENGTHS.get(bare[:2]) == len(bare) else -1
    words = 1 if _HINT[kind].search(before) else -1 if _AGAINST.search(before) else 0
    after = 1 if _BEHIND[kind].search(behind) else -1 if _UNIT.search(behind) else 0
    place = 1 if not before or before[-1] in " (\n\t\"'=:" else -1
    return form, gazetteer, words, after, place


def shape(span: str) -> tuple[int, int]:
    """(step of the length, step of the share of digits), 0 to 2 each."""
    share = sum("0" <= c <= "9" for c in span) / len(span)
    return (0 if len(span) < 16 else 1 if len(span) < 33 else 2), (0 if share < 0.3 else 1 if share < 0.75 else 2)


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weaker forms outside the base spans, leftmost and non-overlapping per kind."""
    if not _CAN_START.search(text):
        return []
    out = []
    for kind, pattern in _CANDIDATES.items():
        if kind == "email_spelled" and "(at)" not in (low := text.lower()) and "[at]" not in low:
            continue
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for _, a, b in taken):
                out.append((kind, m.start(), m.end()))
    return out


def reliabilities(counts: dict[tuple, int], labelers: int, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Dawid-Skene on vote patterns: (prior, P(vote | true), P(vote | false)), votes in the order -1, 0, 1."""
    pats = np.array(list(counts), np.int64).reshape(-1, labelers) + 1
    n = np.array(list(counts.values()), float)
    p = np.clip(0.5 + 0.2 * (pats - 1).sum(1), 0.05, 0.95)  # start: the majority
    prior, yes, no = 0.5, np.full((labelers, 3), 1 / 3), np.full((labelers, 3), 1 / 3)
    for _ in range(rounds):
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
        for j in range(labelers):
            for v in range(3):
                at = pats[:, j] == v
                yes[j, v] = ((n * p)[at].sum() + 1) / ((n * p).sum() + 3)
                no[j, v] = ((n * (1 - p))[at].sum() + 1) / ((n * (1 - p)).sum() + 3)
        a = np.log(prior) + sum(np.log(yes[j, pats[:, j]]) for j in range(labelers))
        b = np.log(1 - prior) + sum(np.log(no[j, pats[:, j]]) for j in range(labelers))
        p = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
    return prior, yes, no


def _features(kind: str, pattern: tuple[int, ...], form: tuple[int, int]) -> list[float]:
    return [1.0, *(float(kind == k) for k in MORE), *(float(v == s) for v in pattern for s in (-1, 1)), *(float(f == s) for f in form for s in (1, 2))]


def span_classifier(counts: dict[tuple[str, tuple[int, ...], tuple[int, int]], int], rounds: int = 300) -> np.ndarray:
    """Weights of the logistic regression that the estimated labels of all vote patterns train."""
    rows, target, weight = [], [], []
    for kind in MORE:
        own: Counter = Counter()
        for (k, p, _), n in counts.items():
            if k == kind:
                own[p] += n
        if not own:
            continue
        prior, yes, no = reliabilities(own, LABELERS)
        for (k, p, form), n in counts.items():
            if k != kind:
                continue
            v = np.array(p) + 1
            a = np.log(prior) + np.log(yes[np.arange(LABELERS), v]).sum()
            b = np.log(1 - prior) + np.log(no[np.arange(LABELERS), v]).sum()
            rows.append(_features(kind, p, form))
            target.append(1 / (1 + np.exp(np.clip(b - a, -50, 50))))
            weight.append(n)
    w = np.zeros(1 + len(MORE) + 2 * LABELERS + 4)
    if not rows:
        return w
    x, y, n = np.array(rows), np.array(target), np.log1p(np.array(weight, float))
    for _ in range(rounds):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + 0.1 * w
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def vote_counts(docs: DataFrame) -> dict[tuple[str, tuple[int, ...], tuple[int, int]], int]:
    """How often each vote pattern and shape occurs, over all documents; at most kinds x 3^LABELERS x 9 rows reach the driver."""
    keys = [*(f"v{i}" for i in range(LABELERS)), "s0", "s1"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for kind, a, b in candidates(text, base_spans(text)):
                    seen[(kind, *votes(kind, text, a, b), *shape(text[a:b]))] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", *keys, "n"])

    # only texts in which a candidate can occur need Python
    some = docs.select("text").filter(F.col("text").rlike(r"[0-9]{3}[ .)-][ .-]?[0-9]{3}|[0-9a-f]{32}|AKIA|ASIA|gh[pousr]_|sk-|[A-Z]{2}[0-9]{2}|[\[(](at|AT)[\])]"))
    rows = some.mapInPandas(lean(count), f"kind string, {', '.join(f'{k} int' for k in keys)}, n long").groupBy("kind", *keys).agg(F.sum("n").alias("n")).collect()
    return {(r["kind"], tuple(r[k] for k in keys[:LABELERS]), (r["s0"], r["s1"])): r["n"] for r in rows}


def all_spans(text: str, weights: np.ndarray, threshold: float) -> tuple[list, list]:
    """(base spans, all spans)."""
    base = base_spans(text)
    more = []
    for kind, a, b in candidates(text, base):
        z = float(np.dot(weights, _features(kind, votes(kind, text, a, b), shape(text[a:b]))))
        if 1 / (1 + np.exp(-z)) >= threshold:
            more.append((kind, a, b))
    order = KINDS + MORE
    return base, sorted(base + more, key=lambda s: (s[1], order.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The input's doc_id and text with base_spans and spans (both joined as kind:start:end)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    weights = span_classifier(vote_counts(texts))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [all_spans(t, weights, threshold) for t in batch["text"]]
            yield batch.assign(base_spans=[joined(b) for b, _ in both], spans=[joined(s) for _, s in both])

    return texts.mapInPandas(lean(find), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, base_spans string, spans string")


def mask(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for part in spans.split(","):
        kind, a, b = part.split(":")
        a, b = int(a), int(b)
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same rows and columns, their texts masked and n_chars counted anew; a null text stays null."""
    weights = span_classifier(vote_counts(docs.select(F.coalesce("text", F.lit("")).alias("text"))))

    @F.pandas_udf("string")
    @lean
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else mask(t, joined(all_spans(t, weights, threshold)[1])) for t in texts], dtype=object)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base_spans", "spans")
    kinds = F.transform(F.filter(F.split("base_spans", ","), lambda s: s != ""), lambda s: F.substring_index(s, ":", 1))
    count = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
