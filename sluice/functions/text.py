"""Text in column expressions: names, organisations, domains, messages, addenda."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import constants as K


def _words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")), r"\s+"), lambda w: w != "")


def normalize_name(c: Column) -> Column:
    """Lower-cased words without marks; number words become digits and stop words go."""
    numbers = F.create_map(*[F.lit(x) for kv in K.NUMBER_WORDS.items() for x in kv])
    words = F.transform(_words(c), lambda w: F.coalesce(F.try_element_at(numbers, w), w))
    return F.array_join(F.filter(words, lambda w: ~w.isin(K.NAME_STOPWORDS)), " ")


def name_tokens(c: Column, least: int = 4) -> Column:
    """Distinct words of the normal name with `least` letters or more, longest first, then by the alphabet."""
    kept = F.filter(F.array_distinct(F.split(normalize_name(c), " ")), lambda w: F.length(w) >= least)
    ranked = F.array_sort(F.transform(kept, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(ranked, lambda s: s["w"])


def normalize_domain(c: Column) -> Column:
    """What follows the last @, without www., trimmed and in lower case."""
    return F.regexp_replace(F.lower(F.trim(F.substring_index(c, "@", -1))), r"^www\.", "")


def organisation(c: Column) -> Column:
    """An organisation's name: marks to spaces, single spaces, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def organisation_squashed(c: Column) -> Column:
    """The same with marks dropped, so that initials join: P.J. Dick is pj dick."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s]+", ""), r"\s+", " "))


def organisation_core(c: Column) -> Column:
    """organisation() without corporate endings, however many there are."""
    return F.trim(F.regexp_replace(organisation(c), f"( ({'|'.join(K.GC_SUFFIXES)}))+$", ""))


def fingerprint(name: Column, domain: Column, city: Column, due: Column) -> Column:
    """First 20 hex digits of the SHA-1 of name, domain, city and ISO week."""
    week = F.when(due.isNull(), F.lit("")).otherwise(F.concat(F.extract(F.lit("YEAROFWEEK"), due).cast("string"), F.lit("-"), F.lpad(F.weekofyear(due).cast("string"), 2, "0")))
    parts = [normalize_name(name), F.coalesce(normalize_domain(domain), F.lit("")), F.lower(F.trim(F.coalesce(city, F.lit("")))), week]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 20)


def content_hash(subject: Column, body: Column, attachments: Column | None = None) -> Column:
    """SHA-256 of the subject without forward marks, the body in lower case with single spaces, and the attachments' hashes."""
    subject = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^\s*((fwd?|fw)\s*:\s*)+", ""))
    body = F.trim(F.regexp_replace(F.lower(F.coalesce(body, F.lit(""))), r"\s+", " "))
    files = F.array_join(F.array_sort(attachments), ",") if attachments is not None else F.lit("")
    return F.sha2(F.concat_ws("\n", F.lower(subject), body, files), 256)


_ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def unescape(c: Column) -> Column:
    """Named entities of _ENTITIES and numeric ones in one pass, so that what an entity gives isn't read again; others stay."""
    parts = F.split(c, "&")

    def resolved(p: Column) -> Column:
        name = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[a-z]{2,4});", 1)
        code = F.when(name.rlike("^#[0-9]"), F.substring(name, 2, 7).try_cast("long")).when(name.rlike("^#"), F.conv(F.substring(name, 3, 6), 16, 10).try_cast("long"))
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for k, v in _ENTITIES.items():
            char = F.when(name == k, v).otherwise(char)
        return F.coalesce(F.concat(char, p.substr(F.length(name) + 2, F.length(p))), F.concat(F.lit("&"), p))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), resolved), ""))


def html_to_text(c: Column) -> Column:
    """Scripts and styles go, anchors keep their address, blocks become lines, cells tabs; entities are resolved."""
    for pattern, to in (
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "),
        (r"(?is)<!--.*?-->", " "),
        (r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', "$2 ($1)"),
        (r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])[^>]*>", "\n"),
        (r"(?i)</t[dh]>", "\t"),
        (r"(?s)<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    c = unescape(c)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \x0B\f\r]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def trim_quoted(c: Column) -> Column:
    """The text before the first mark of a quoted or forwarded message, trimmed."""
    marks = "(?id)(" + "|".join(K.QUOTE_MARKS) + ")"
    return F.regexp_replace(F.element_at(F.split(c, marks, 2), 1), r"^\s+|\s+$", "")


def excerpt(c: Column, most: int = 200) -> Column:
    """White space collapsed, cut to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def first_words(c: Column, most: int = 60) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, most), " ")


def location_label(c: Column) -> Column:
    """subject, body or attachment:name[:pN], white space collapsed; anything else is null, as it isn't a location."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    name = F.trim(F.regexp_extract(flat, r"(?i)^attachment:(.*?)(?::p(\d+))?$", 1))
    page = F.regexp_extract(flat, r"(?i)^attachment:(.*?)(?::p(\d+))?$", 2).try_cast("int")
    return F.when(F.lower(flat).isin("subject", "body"), F.lower(flat)).when(name != "", F.concat(F.lit("attachment:"), name, F.coalesce(F.concat(F.lit(":p"), page.cast("string")), F.lit(""))))


def stated_range(c: Column) -> Column:
    """A money range as it is written, such as $1.2 - 1.5 million, white space collapsed; null when there is none."""
    number = r"\$?\s*\d[\d,.]*\s*(?:million|billion|thousand|[mkb])?"
    found = F.regexp_extract(c, f"(?i)({number}\\s*(?:-|–|—|to)\\s*{number})", 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit(""))


def humanize(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def short_location(city: Column, state: Column) -> Column:
    return F.nullif(F.concat_ws(", ", F.nullif(F.trim(city), F.lit("")), F.nullif(F.trim(state), F.lit(""))), F.lit(""))


def safe_filename(c: Column) -> Column:
    """Without folders and control characters; attachment where nothing is left."""
    name = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f/\\]", "_"))
    return F.when(name == "", "attachment").otherwise(name)


def sniff_mime(content: Column, declared: Column) -> Column:
    """The kind that the first bytes show; the declared one where they show none. Portals send pages that are named as PDF."""
    head = F.hex(F.substring(content, 1, 8))
    page = F.lower(F.ltrim(F.decode(F.substring(content, 1, 64), "ISO-8859-1")))
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(page.startswith("<!doctype html") | page.startswith("<html"), "text/html").otherwise(declared)


def _is(c: Column, pattern: str) -> Column:
    return c.rlike(f"(?id){pattern}")


def states_removal(c: Column) -> Column:
    return _is(F.coalesce(c, F.lit("")), K.REMOVAL)


def removal_clauses(c: Column) -> Column:
    """The clauses that state a removal, as lower-cased words between single spaces."""
    clauses = F.filter(F.split(F.coalesce(c, F.lit("")), r"[.;\n]"), states_removal)
    return F.transform(clauses, lambda s: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), F.lit(" ")))


def removed_items(changes: Column, items: Column) -> Column:
    """Items named as whole words in a clause that states a removal; of those in one clause, none that another one's name holds."""
    spoken = lambda i: F.replace(i, F.lit("_"), F.lit(" "))

    def of(clause: Column) -> Column:
        named = F.filter(items, lambda i: clause.contains(F.concat(F.lit(" "), spoken(i), F.lit(" "))))
        return F.filter(named, lambda i: ~F.exists(named, lambda j: (j != i) & spoken(j).contains(spoken(i))))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(removal_clauses(changes), of))))


def merged_scope(old: Column, new: Column, changes: Column) -> Column:
    """struct(value, added, removed) of a scope: the union of both, without what `changes` (null: nothing) says is removed."""
    none = F.array().cast("array<string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    removed = removed_items(changes, F.array_union(old, new))
    return F.struct(
        F.array_sort(F.array_except(F.array_union(old, new), removed)).alias("value"),
        F.array_sort(F.array_except(F.array_except(new, old), removed)).alias("added"), F.array_sort(F.array_intersect(removed, old)).alias("removed"),
    )


def award_outcome(*texts: Column) -> Column:
    """cancelled before won or lost; both won and lost say nothing."""
    c = F.concat_ws(" ", *texts)
    won, lost = _is(c, K.WON), _is(c, K.LOST)
    return F.when(_is(c, K.CANCELLED), "cancelled").when(won & ~lost, "won").when(lost & ~won, "lost")


def addendum_number(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(\d{1,3})\b", 1).try_cast("int")


def addendum_scheme(c: Column) -> Column:
    """The label's words but for no and num, such as addendum or bulletin."""
    words = F.filter(F.split(F.lower(F.regexp_replace(c, r"[^A-Za-z]+", " ")), " "), lambda w: (w != "") & ~w.isin("no", "num"))
    return F.array_join(words, " ")


def with_change_count(text: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(text, F.lit(" ("), n.cast("string"), F.lit(" changes)"))).otherwise(text)


def ics_escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ics_fold(c: Column, most: int = 75) -> Column:
    """A line folded so that none has more than `most` octets, the space that starts a further line included; letters stay whole."""
    start = F.struct(c.substr(1, 0).alias("out"), F.lit(0).alias("used"))

    def step(s: Column, ch: Column) -> Column:
        size = F.octet_length(ch)
        over = s["used"] + size > most
        return F.struct(F.concat(s["out"], F.when(over, "\r\n ").otherwise(""), ch).alias("out"), F.when(over, size + 1).otherwise(s["used"] + size).alias("used"))

    return F.when(F.octet_length(c) <= most, c).otherwise(F.aggregate(F.split(c, ""), start, step, lambda s: s["out"]))


def bid_noise(subject: Column, body: Column, attachments: Column, links: Column, sender: Column | None = None, files: Column | None = None) -> Column:
    """Whether a message can be left unread: no hint of a bid, and a noisy subject or next to nothing in it.

    attachments and links: how many there are. Hints are sought in the subject, the sender, the head of the body, and names and
    heads of the files (array of struct filename, text).
    """
    subject, body = F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))
    parts = [subject, *([sender] if sender is not None else []), F.substring(body, 1, K.BODY_SCAN)]
    if files is not None:
        parts.append(F.array_join(F.transform(files, lambda f: F.concat_ws("\n", f["filename"], F.substring(f["text"], 1, K.FILE_SCAN))), "\n"))
    bare = (attachments == 0) & (F.length(F.trim(body)) < 40) & (links == 0)
    return ~_is(F.concat_ws("\n", *parts), K.BID_HINT) & (_is(subject, K.NOISE_SUBJECT) | bare)
