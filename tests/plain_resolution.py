"""Resolution by one sequential pass in plain Python, which the set-wise operator is held against."""

from __future__ import annotations

import heapq
import math
import re
from itertools import islice

import pandas as pd

from sluice.functions import constants as K
from sluice.functions.similarity import indel_ratio, token_set_ratio
from sluice.operators.merge import merge_date
from sluice.operators.resolve import WEIGHTS


def _words(s: str | None) -> list[str]:
    words = (K.NUMBER_WORDS.get(w, w) for w in re.sub(r"[^a-z0-9\s]", " ", (s or "").lower()).split())
    return [w for w in words if w not in K.NAME_STOPWORDS]


def _known(x) -> bool:
    return x is not None and not (isinstance(x, float) and math.isnan(x)) and x is not pd.NaT and x != ""


def _domain(s: str | None) -> str:
    return s.rsplit("@", 1)[-1].strip(" ").lower().removeprefix("www.") if _known(s) else ""


def _prepared(m: dict) -> dict:
    """A message with what each of its pairs needs: words of its names, and the number as it is compared."""
    x = _words(m["name"])
    return {**m, "x": x, "set": set(x), "joined": " ".join(x), "owner": _words(m["owner_name"]) if _known(m["owner_name"]) else None, "domain": _domain(m["gc_domain"]), "number": m["project_number"].strip().lower() if _known(m["project_number"]) else None}


def _likeness(x: list[str], y: list[str]) -> float:
    if not x or not y:
        return 0.0
    a, b = " ".join(x), " ".join(y)
    plain = indel_ratio(a, b)
    return plain if len(x) == len(y) == 1 else max(token_set_ratio(a, b), plain)


def pair_evidence(c: dict, i: dict, least: float = -1.0) -> tuple[float, str | None, bool, bool, float] | None:
    """(score, hard key, organisations differ, rebid, name likeness) of one candidate and one message: evidence() for the fold.

    None if the score stays under `least` however alike the names are. Both sides are _prepared().
    """
    match = None
    if _known(c["gc_id"]) and _known(i["gc_id"]):
        match = c["gc_id"] == i["gc_id"]
    elif c["domain"] and i["domain"]:
        match = c["domain"] == i["domain"]
    if not set(i["platform_ids"]).isdisjoint(c["platform_ids"]):
        return 1.0, "platform_id", match is False, False, 1.0
    if not set(i["thread_ids"]).isdisjoint(c["thread_ids"]):
        return 1.0, "thread", match is False, False, 1.0
    if match and c["number"] is not None and c["number"] == i["number"]:
        return 1.0, "project_number", False, False, 1.0
    weak = min(len(c["x"]), len(i["x"])) < 2
    parts = {"name": 0.7 if weak else 1.0}
    if match is not None:
        parts["gc"] = float(match)
    if all(_known(s[k]) for s in (c, i) for k in ("lat", "lon")):
        p1, p2, dl = math.radians(c["lat"]), math.radians(i["lat"]), math.radians(i["lon"] - c["lon"])
        km = 2 * 6371.0 * math.asin(math.sqrt(math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(dl / 2) ** 2))
        parts["geo"] = 1.0 if km <= 1 else 0.5 if km <= 10 else 0.0
    elif _known(c["city"]) and _known(i["city"]):
        parts["geo"] = float(c["city"].strip().lower() == i["city"].strip().lower())
    apart = None
    if _known(c["bid_due"]) and _known(i["bid_due"]):
        apart = abs((c["bid_due"] - i["bid_due"]).total_seconds()) / 86_400
        near = 1.0 if apart <= 3 else 0.5 if apart <= 14 else 0.0
        parts["due"] = near if i["kind"] in K.SOLICITATIONS else max(near, 0.5)
    if c["owner"] is not None and i["owner"] is not None:
        parts["owner"] = float(_likeness(c["owner"], i["owner"]) >= K.RELATED)
    bottom = sum(WEIGHTS[k] for k in parts)
    most = sum(WEIGHTS[k] * v for k, v in parts.items()) / bottom
    if min(most, K.REVIEW - 0.01) + 1e-4 < least if parts.get("geo") == 0.0 else most + 1e-4 < least:
        return None
    raw = _likeness(c["x"], i["x"])
    parts["name"] = min(raw, 0.7) if weak else raw
    total = sum(WEIGHTS[k] * v for k, v in parts.items()) / bottom
    rebid = apart is not None and apart > K.REBID_DAYS and bool(match) and raw >= K.RELATED and i["kind"] in K.SOLICITATIONS
    if parts.get("geo") == 0.0 or rebid or (c["x"] and i["x"] and raw < K.NAME_FLOOR):
        total = min(total, K.REVIEW - 0.01)
    return round(total, 4), None, match is False, rebid, raw


def _cell(v: float, low: float, span: float, bits: int) -> int:
    return max(0, min(math.ceil((v - low) / span * (1 << bits)) - 1, (1 << bits) - 1))


def _hard_keys(m: dict) -> list[tuple]:
    return [("platform", p) for p in m["platform_ids"]] + [("thread", t) for t in m["thread_ids"]]


def _soft_keys(m: dict) -> list[tuple]:
    """Organisation, five letters of geohash (13 and 12 bits), fingerprint and project number; the name apart."""
    keys = []
    if _known(m["gc_id"]):
        keys.append(("gc", m["gc_id"]))
    if _known(m["lat"]) and _known(m["lon"]):
        keys.append(("cell", _cell(m["lon"], -180.0, 360.0, 13), _cell(m["lat"], -90.0, 180.0, 12)))
    if any(_known(m[k]) for k in ("name", "gc_domain", "city", "bid_due")):
        city = m["city"].strip(" ").lower() if _known(m["city"]) else ""
        keys.append(("fingerprint", m["joined"], m["domain"], city, tuple(m["bid_due"].isocalendar())[:2] if _known(m["bid_due"]) else None))
    if _known(m["project_number"]):
        keys.append(("number", m["project_number"].strip(" ").lower()))
    return keys


def similar_names(names: set[str]) -> dict[str, list[str]]:
    """Each normal name with those whose trigrams overlap by K.TRIGRAM, itself among them."""
    grams = {n: {("  " + w + " ")[k : k + 3] for w in n.split() for k in range(len(w) + 1)} for n in names}
    return {a: [b for b in names if len(grams[a] & grams[b]) >= K.TRIGRAM * len(grams[a] | grams[b])] for a in names}


def fold_messages(rows: list[dict], near: dict[str, list[str]] | None = None) -> list[tuple]:
    """Messages in order of sending: each sees what the earlier ones left. (message, opportunity, role, ...)

    Candidates of a message are all opportunities that hold one of its platform or thread ids, and the K.CANDIDATES most recently
    active ones that share its organisation, geohash-5, fingerprint or project number or whose name is `near`: normal name -> similar ones.
    """
    rows = [_prepared(r) for r in rows]
    if near is None:
        near = similar_names({r["joined"] for r in rows} - {""})
    opps: list[dict] = []
    hard_index: dict[tuple, set[int]] = {}
    soft_index: dict[tuple, dict[int, None]] = {}  # of each key its opportunities, the last active one last
    out = []

    def seen(k: int, n: int) -> None:
        opps[k]["activity"] = n
        for key in opps[k]["soft"]:
            held = soft_index.setdefault(key, {})
            held.pop(k, None)
            held[k] = None
        for key in _hard_keys(opps[k]):
            hard_index.setdefault(key, set()).add(k)

    for n, m in enumerate(sorted(rows, key=lambda r: (r["sent_at"] if _known(r["sent_at"]) else pd.Timestamp.max, r["id"]))):
        best, found = None, (0.0, None, False, False, 0.0)
        keys = _soft_keys(m)
        hard_ones = {k for key in _hard_keys(m) for k in hard_index.get(key, ())}
        reached = {k for key in [*keys, *(("name", x) for x in near.get(m["joined"], ()))] if key in soft_index for k in islice(reversed(soft_index[key]), K.CANDIDATES)}
        for k in [*hard_ones, *heapq.nlargest(K.CANDIDATES, reached, key=lambda k: opps[k]["activity"])]:
            o = opps[k]
            ev = pair_evidence(o, m, -1.0 if best is None else -best[0][0])
            if ev is None:
                continue
            gap = abs((o["bid_due"] - m["bid_due"]).total_seconds()) if _known(o["bid_due"]) and _known(m["bid_due"]) else math.inf
            rank = (-ev[0], gap, -o["activity"])
            if best is None or rank < best[0]:
                best, found = (rank, k), ev
        score, hard, clash, rebid, raw = found
        related = best and (m["kind"] in K.SOLICITATIONS and clash and raw >= K.RELATED or rebid)
        if best and not related and (hard or score >= K.REVIEW):
            k, role = best[1], "merge" if hard or score >= K.AUTO_MERGE else "review"
            o = opps[k]
            o["bid_due"], outcome = merge_date(o["bid_due"] if _known(o["bid_due"]) else None, m["bid_due"] if _known(m["bid_due"]) else None, m["kind"], m["sent_at"], o["as_of"])
            if outcome in ("set", "moved"):
                o["as_of"] = m["sent_at"]
            o["platform_ids"] = sorted({*o["platform_ids"], *m["platform_ids"]})
            o["thread_ids"] = sorted({*o["thread_ids"], *m["thread_ids"]})
        else:
            role, outcome = ("related" if related else "new" if m["kind"] in K.SOLICITATIONS else "orphan_update"), "set" if _known(m["bid_due"]) else "none"
            k, o = len(opps), {**m, "as_of": m["sent_at"], "opp_id": m["id"], "soft": [*keys, *([("name", m["joined"])] if m["joined"] else [])]}
            opps.append(o)
        seen(k, n)
        due = o["bid_due"] if _known(o["bid_due"]) else None
        out.append((m["id"], o["opp_id"], role, float(score), hard, due, outcome, n))
    return out
