"""Queries of the rules on texts and dates. Where a rule reads phrases, rows of a table take turns through cases, and the SQL has
what each case must give; the patterns themselves aren't repeated there."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import dates, links, text
from sluice.functions.similarity import name_ratio
from sluice.plans.registry import query
from sluice.plans.views import NOW_SQL, OPPORTUNITIES, now, opportunities
from sluice.sources.tables import load


def turn(key: str, values: list):
    """The value whose turn it is at a row's key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def turn_sql(key: str, values: list, kind: str = "VARCHAR") -> str:
    def one(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"([{', '.join(map(one, values))}]::{kind}[])[CAST({key} % {len(values)} AS INTEGER) + 1]"


def _customers(spark, sf_dir):
    (c,) = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("who"))


AWARDS = [
    ("We are pleased to award you the contract", "won"), ("You have been awarded the work", "won"), ("Congratulations, here is the award", "won"), ("Letter of intent to award to you", "won"),
    ("We regret to inform you", "lost"), ("It was awarded to another firm", "lost"), ("Thank you for bidding", "lost"), ("You were not the low bidder", "lost"),
    ("The project is on hold", "cancelled"), ("Cancelled, so nobody was awarded", "cancelled"), ("We are not moving forward", "cancelled"), ("The bid is withdrawn", "cancelled"),
    ("Pleased to inform you, but another contractor won", None), ("You have been selected", None), ("See attached", None),
]


@query(f"SELECT c_custkey AS id, {turn_sql('c_custkey', [w for _, w in AWARDS])} AS outcome FROM customer")
def award_outcomes(spark, sf_dir):
    return _customers(spark, sf_dir).select("id", text.award_outcome(F.concat(F.col("who"), F.lit(": "), turn("id", [t for t, _ in AWARDS]), F.lit("."))).alias("outcome"))


ITEMS = ["fire_alarm", "lighting", "site_lighting", "switchgear"]
REMOVALS = [
    ("Site lighting is deleted. Fire alarm stays", "site_lighting"), ("Remove lighting and switchgear", "lighting,switchgear"), ("Switchgear was descoped; site lighting and lighting too", "switchgear"),
    ("Fire alarm no longer included", "fire_alarm"), ("Lighting added. Strike the switchgear", "switchgear"), ("No longer a concern: lighting", ""), ("Firealarm omitted", ""),
    ("Lighting excluded from this bid\nall else stays", "lighting"), ("", ""),
]


@query(f"SELECT c_custkey AS id, {turn_sql('c_custkey', [w for _, w in REMOVALS])} AS removed, {turn_sql('c_custkey', [','.join(sorted(({*ITEMS, 'generator'} if i % 2 else {*ITEMS}) - set(w.split(',')))) for i, (_, w) in enumerate(REMOVALS * 2)])} AS value FROM customer")
def scope_removals(spark, sf_dir):
    new = F.when(F.col("id") % (2 * len(REMOVALS)) % 2 == 1, F.array(F.lit("generator"))).otherwise(F.array().cast("array<string>"))
    s = text.merged_scope(F.array(*map(F.lit, ITEMS)), new, turn("id", [t for t, _ in REMOVALS]))
    return _customers(spark, sf_dir).select("id", s.alias("s")).select("id", F.array_join("s.removed", ",").alias("removed"), F.array_join("s.value", ",").alias("value"))


QUOTES = ["\n-- Original Message --\nold", "\nOn Monday, Bob wrote:\n> old", "\nFrom: Bob\nSent: Monday\nold", "\n_____\nold", "\nOn it\nwrote: no", "\nFrom: Bob\nTo: me"]


@query(f"SELECT c_custkey AS id, 'Dear ' || c_name || CASE WHEN c_custkey % {len(QUOTES)} < 4 THEN '' ELSE {turn_sql('c_custkey', QUOTES)} END AS body FROM customer")
def quoted_trimmed(spark, sf_dir):
    return _customers(spark, sf_dir).select("id", text.trim_quoted(F.concat(F.lit("  Dear "), F.col("who"), turn("id", QUOTES), F.lit("\n"))).alias("body"))


NOISE = [  # subject, body, attachments, links, sender, whether to skip
    ("Member newsletter", "Membership fees are due on Friday; see the plans and pricing.", 0, 0, "news@x.org", True), ("Your weekly digest", "Nothing here", 3, 2, "a@x.org", True),
    ("Your weekly digest", "You are invited to bid on a tower", 0, 0, "a@x.org", False), ("Newsletter", "none", 0, 0, "rfp@x.org", False), ("hello", "short", 0, 0, "a@x.org", True),
    ("hello", "short", 1, 0, "a@x.org", False), ("hello", "short", 0, 1, "a@x.org", False), ("hello", "a body of forty letters or more is looked at", 0, 0, "a@x.org", False),
    ("Invoice #12", "for last month", 0, 0, "a@x.org", True), ("Automatic reply: Pre-bid", "away", 0, 0, "a@x.org", False),
]


@query(f"SELECT c_custkey AS id, {turn_sql('c_custkey', [n[5] for n in NOISE], 'BOOLEAN')} AS skip FROM customer")
def noise_messages(spark, sf_dir):
    col = lambda i: turn("id", [n[i] for n in NOISE])
    none = F.array().cast("array<struct<filename:string,text:string>>")
    return _customers(spark, sf_dir).select("id", text.bid_noise(col(0), col(1), col(2), col(3), col(4), none).alias("skip"))


@query("SELECT doc_id, doc_id % 2 = 0 AND length(trim(text)) < 40 AS skip FROM documents")
def noise_by_attachments(spark, sf_dir):
    """A hint in the text of an attachment, or a long body, keeps a message."""
    (d,) = load(spark, sf_dir, "documents")
    files = F.array(F.struct(F.lit("scan.pdf").alias("filename"), turn("doc_id", ["none", "see the Invitation to Bid"]).alias("text")))
    body = F.translate("text", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "x" * 52)
    return d.select("doc_id", text.bid_noise(F.lit("re"), body, F.lit(0), F.lit(0), None, files).alias("skip"))


LABELS = [(" Subject ", "subject"), ("BODY", "body"), ("attachment:Specs.pdf:p3", "attachment:Specs.pdf:p3"), ("Attachment: a:b.pdf", "attachment:a:b.pdf"), ("body of the mail", None), ("attachment:", None), ("page 3", None)]
RANGES = [("cost $1.2  - 1.5 million now", "$1.2 - 1.5 million"), ("between 400k to 600k", "400k to 600k"), ("about $3 million", None), ("", None)]


@query(f"SELECT c_custkey AS id, {turn_sql('c_custkey', [w for _, w in LABELS])} AS place, {turn_sql('c_custkey', [w for _, w in RANGES])} AS money FROM customer")
def places_and_ranges(spark, sf_dir):
    return _customers(spark, sf_dir).select("id", text.location_label(turn("id", [t for t, _ in LABELS])).alias("place"), text.stated_range(turn("id", [t for t, _ in RANGES])).alias("money"))


@query(r"""SELECT doc_id, CASE WHEN length(s) > 80 THEN rtrim(substr(s, 1, 79)) || '…' ELSE s END AS short, array_to_string(list_slice(string_split_regex(trim(text, E' \t\n\r\f\v'), '\s+'), 1, 60), ' ') AS summary,
 'fixed_' || lang AS kind, CASE WHEN trim(lang) = '' THEN source ELSE source || ', ' || lang END AS place FROM (SELECT *, regexp_replace(text, '\s+', ' ', 'g') AS s FROM documents)""")
def display_texts(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    flat = F.regexp_replace("text", r"\s+", " ")
    return d.select(
        "doc_id", text.truncate(flat, 80).alias("short"), text.first_words(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("summary"),
        F.replace(text.humanize(F.concat(F.lit("fixed_"), F.col("lang"))), F.lit(" "), F.lit("_")).alias("kind"), text.short_location(F.col("source"), F.col("lang")).alias("place"),
    )


@query("SELECT p_partkey AS id, 'a_b_' || replace(p_name, ' ', '_') AS file, CASE p_partkey % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/zip' WHEN 2 THEN 'text/html' WHEN 3 THEN 'text/html' ELSE 'text/plain' END AS mime FROM part")
def files_sniffed(spark, sf_dir):
    (p,) = load(spark, sf_dir, "part")
    heads = turn("p_partkey", ["%PDF-1.7 ", "PK\x03\x04rest", "  <!DOCTYPE html>", "<HTML lang='en'>", "plain words"])
    name = F.concat(F.lit("a/b\\"), F.replace("p_name", F.lit(" "), F.lit("\x07")))
    return p.select(F.col("p_partkey").alias("id"), text.safe_filename(name).alias("file"), text.sniff_mime(heads.cast("binary"), F.lit("text/plain")).alias("mime"))


ADDENDA = [("Addendum No. 3", "addendum", 3), ("ADDENDUM 12", "addendum", 12), ("Bulletin #2", "bulletin", 2), ("Addendum A", "addendum a", None), ("Addendum Number 4", "addendum number", 4)]


@query(f"SELECT c_custkey AS id, {turn_sql('c_custkey', [s for _, s, _ in ADDENDA])} AS scheme, {turn_sql('c_custkey', [n for *_, n in ADDENDA], 'INTEGER')} AS number, c_name || CASE WHEN c_custkey % 4 > 1 THEN ' (' || c_custkey % 4 || ' changes)' ELSE '' END AS note FROM customer")
def addendum_labels(spark, sf_dir):
    label = turn("id", [t for t, *_ in ADDENDA])
    return _customers(spark, sf_dir).select("id", text.addendum_scheme(label).alias("scheme"), text.addendum_number(label).alias("number"), text.with_change_count(F.col("who"), F.col("id") % 4).alias("note"))


@query(r"SELECT page_id, replace(replace(replace(replace(replace(html, '\', '\\'), ';', '\;'), ',', '\,'), E'\r\n', '\n'), E'\n', '\n') AS escaped FROM pages")
def ics_escaped(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    return p.select("page_id", text.ics_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, url || substr(html, 1, 500) AS line, true AS fits FROM pages")
def ics_folded(spark, sf_dir):
    """Lines of 500 letters of HTML, folded and put together again; no folded line has more than 75 octets."""
    (p,) = load(spark, sf_dir, "pages")
    line = F.concat("url", F.substring("html", 1, 500))
    folded = text.ics_fold(line)
    return p.select("page_id", F.replace(folded, F.lit("\r\n "), F.lit("")).alias("line"), F.forall(F.split(folded, "\r\n"), lambda x: F.octet_length(x) <= 75).alias("fits"))


NAMES = [("tower north", "north tower annex", 1.0), ("Tower Two", "tower 2", 1.0), ("alpha", "", 0.0), ("north wing", "north wing", 1.0), ("abcd", "abce", 0.75)]


@query(f"SELECT c_custkey AS id, {turn_sql('c_custkey', [r for *_, r in NAMES], 'DOUBLE')} AS likeness FROM customer")
def name_likeness(spark, sf_dir):
    x, y = turn("id", [a for a, *_ in NAMES]), turn("id", [b for _, b, _ in NAMES])
    return _customers(spark, sf_dir).select("id", name_ratio(text.normalize_name(x), text.normalize_name(y)).alias("likeness"))


FORMS = [("P.J. Dick, Inc.", "p j dick inc", "pj dick inc", "p j dick"), ("Acme Builders Group LLC", "acme builders group llc", "acme builders group llc", "acme"), ("Müller & Co", "müller co", "müller co", "müller")]


@query(f"SELECT c_custkey AS id, {', '.join(turn_sql('c_custkey', [f[i] for f in FORMS]) + f' AS {n}' for i, n in ((1, 'norm'), (2, 'squashed'), (3, 'core')))} FROM customer")
def organisation_forms(spark, sf_dir):
    c = turn("id", [f[0] for f in FORMS])
    return _customers(spark, sf_dir).select("id", text.organisation(c).alias("norm"), text.organisation_squashed(c).alias("squashed"), text.organisation_core(c).alias("core"))


@query("SELECT conv_id, turn, array_to_string(list_sort(list_distinct(['m' || conv_id || '-' || turn] || CASE WHEN turn > 0 THEN ['m' || conv_id || '-' || (turn - 1)] ELSE [] END || ['root'])), ',') AS ids FROM conversations")
def thread_id_sets(spark, sf_dir):
    (c,) = load(spark, sf_dir, "conversations")
    m = lambda t: F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    refs = F.array(F.lit("root"), F.lit(" "), F.lit("root"))
    return c.select("conv_id", "turn", F.array_join(links.thread_ids(refs, F.when(F.col("turn") > 0, m(F.col("turn") - 1)), m(F.col("turn"))), ",").alias("ids"))


# ---------------------------------------------------------------- dates


@query("SELECT event_id, strftime(CAST(ts AS DATE) + CAST((event_id % 7 - (isodow(ts) - 1) + 7) % 7 AS INTEGER), '%Y-%m-%d') AS day FROM events")
def weekdays_resolved(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    names = turn("event_id", ["Monday", "tue", "WEDNESDAY", "thursday", "fri", "Saturday", "sun"])
    return e.select("event_id", dates.resolve_weekday(names, F.to_date("ts")).cast("string").alias("day"))


ZONES = [("America/New_York", 5), ("Europe/London", 0), ("Asia/Tokyo", -9), ("Mars/Base", 5), (None, 5), ("America/Phoenix", 7)]


@query(f"WITH {OPPORTUNITIES} SELECT id, TIMESTAMP '2026-01-05 09:00:00' + to_days(CAST(id % 20 AS INTEGER)) + to_hours({turn_sql('id', [h for _, h in ZONES], 'INTEGER')}) AS at FROM opp")
def zoned_dates(spark, sf_dir):
    value = F.concat(F.date_format(F.date_add(F.lit("2026-01-05").cast("date"), (F.col("id") % 20).cast("int")), "yyyy-MM-dd"), F.lit("T09:00"))
    p = dates.parse_local(value, turn("id", [z for z, _ in ZONES]), now().cast("timestamp"))
    return opportunities(spark, sf_dir).select("id", F.from_utc_timestamp(F.to_utc_timestamp(p["ts"], F.current_timezone()), "UTC").cast("timestamp_ntz").alias("at"))


@query(f"""WITH {OPPORTUNITIES}, d AS (SELECT id, CASE WHEN id % 9 <> 0 THEN bid_due + to_hours(CASE WHEN id % 4 = 0 THEN 8 WHEN id % 4 = 1 THEN -6 ELSE 0 END) END AS due, id % 3 <> 0 AS parsed, id % 5 = 0 AS claimed FROM opp),
 k AS (SELECT *, coalesce(due IS NOT NULL AND parsed AND (claimed OR NOT (hour(due) = 0 AND minute(due) = 0)), false) AS known, date_diff('day', CAST({NOW_SQL} AS DATE), CAST(due AS DATE)) AS n FROM d)
 SELECT id, known, CASE WHEN due IS NULL THEN 'Due date unknown' ELSE CASE WHEN n = 0 THEN 'TODAY' WHEN n = 1 THEN 'tomorrow' ELSE strftime(due, '%a %b %-d') END || CASE WHEN known THEN strftime(due, ', %-I:%M %p') ELSE '' END END AS shown,
 CASE WHEN due IS NULL THEN '' WHEN n < 0 THEN 'passed' WHEN n = 0 THEN 'today' WHEN n = 1 THEN '1 day' ELSE n || ' days' END AS days_left FROM k""")
def due_displayed(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    hours = F.when(F.col("id") % 4 == 0, 8).when(F.col("id") % 4 == 1, -6).otherwise(0)
    d = o.select("id", F.when(F.col("id") % 9 != 0, F.col("bid_due") + F.make_dt_interval(hours=hours)).alias("due"))
    d = d.withColumn("known", dates.time_known(F.col("due"), F.col("id") % 3 != 0, F.col("id") % 5 == 0))
    return d.select("id", "known", dates.display(F.col("due"), now(), F.col("known")).alias("shown"), dates.days_left(F.col("due"), now()).alias("days_left"))


@query(f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(ts, TIMESTAMP '2024-01-20') WHEN 1 THEN least(greatest(ts, TIMESTAMP '2024-01-10'), TIMESTAMP '2024-01-20') ELSE TIMESTAMP '2024-01-20' END AS received FROM events")
def received_times(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    r = dates.received_at(F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_id") % 3 == 1, F.col("ts")), at("2024-01-20"), at("2024-01-10"))
    return e.select("event_id", r.alias("received"))


@query("SELECT event_id, date_trunc('second', ts) AS at, '-P' || CASE WHEN user_id % 50 >= 24 THEN (user_id % 50) // 24 || 'D' ELSE '' END || CASE WHEN user_id % 50 % 24 > 0 OR user_id % 50 < 24 THEN 'T' || user_id % 50 % 24 || 'H' ELSE '' END AS trigger FROM events")
def filetimes(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    ticks = F.unix_timestamp(F.col("ts").cast("timestamp")) * 10_000_000 + 116_444_736_000_000_000
    return e.select("event_id", dates.filetime(ticks).cast("timestamp_ntz").alias("at"), dates.trigger_text(F.col("user_id") % 50).alias("trigger"))
