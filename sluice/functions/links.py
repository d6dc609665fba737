"""Links in messages: harvest, unwrapping, host classes, platform ids, thread ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import constants as K

URL = r"(https?://[^\s<>\"')\]]+)"


def harvest(c: Column) -> Column:
    """Addresses in their order, each once, without marks that end a sentence."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def host(url: Column) -> Column:
    """In lower case, without user, port and www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def unwrap(url: Column) -> Column:
    """The address inside a wrapper's url, u or target parameter; others stay."""
    inner = F.regexp_extract(url, r"[?&](?:url|u|target)=([^&#]+)", 1)
    wrapped = F.lit(False)
    for w in K.LINK_WRAPPERS:
        wrapped = wrapped | host(url).contains(w)
    return F.when(wrapped & (inner != ""), F.try_url_decode(inner)).otherwise(url)


def host_class(h: Column) -> Column:
    """By host or parent domain; other for the rest."""
    c = F
    for domain, name in K.HOST_CLASSES.items():
        c = c.when((h == domain) | h.endswith(f".{domain}"), name)
    return c.otherwise("other")


def platform_id(url: Column) -> Column:
    """One id a link, the most specific first, with its name space; null when there is none."""
    out = []
    for space, pattern in K.PLATFORM_IDS:
        found = F.lower(F.regexp_extract(url, f"(?i){pattern}", 1))
        out.append(F.when(found != "", F.concat(F.lit(f"{space}:"), found)))
    return F.coalesce(*out)


def platform_ids(urls: Column) -> Column:
    """Sorted distinct ids of an array of links."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(urls, platform_id), lambda x: x.isNotNull())))


def thread_ids(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """References, the answered message and the message itself, without blanks, in order of the alphabet."""
    every = F.concat(F.coalesce(references, F.array().cast("array<string>")), F.array(in_reply_to, message_id))
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
