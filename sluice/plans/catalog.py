"""Queries over the driver's tables with their SQL: scores, messages, polls, resolution, merging, digests. The other modules of
this folder register more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import constants as K
from sluice.functions import dates, geo, links, similarity, text
from sluice.operators import curation, decisions, digest, directory, evaluation, extract, ingest, merge, resolve
from sluice.operators import score as scoring
from sluice.plans.registry import ORACLES, QUERIES, query
from sluice.plans.views import EVENTS_NOW_TEXT, NOW_SQL, OPPORTUNITIES, SCORED, events_now, now, opportunities
from sluice.sources.tables import load

def _scored(spark: SparkSession, sf_dir: str, p: scoring.Profile = scoring.Profile()) -> DataFrame:
    return scoring.score(scoring.others_due_same_week(opportunities(spark, sf_dir), ["gc_id"]), now(), p)


_TRANSITIONS = "moves(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in K.TRANSITIONS.items() for b in bs) + ")"
_VERBS = ["bid", "snooze", "assign", "submit", "won", "lock_field", "reopen", "needs_info"]

# ---------------------------------------------------------------- scoring


@query(f"WITH {SCORED} SELECT id, score, band, round_even(raw, 3) AS raw_weighted, round(electrical_value, 2) AS electrical_value FROM banded")
def fit_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "score", "band", "raw_weighted", F.round("electrical_value", 2).alias("electrical_value"))


@query(f"WITH {SCORED} SELECT band, count(*) AS n, min(score) AS low, max(score) AS high FROM banded GROUP BY band")
def score_bands(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"""WITH {SCORED} SELECT id, concat_ws(',', CASE WHEN tier = 'blocked' THEN 'gc_blocked' END, CASE WHEN t1 < t0 THEN 'open_shop' END, CASE WHEN t2 < t1 THEN 'due_passed' END, CASE WHEN t3 < t2 THEN 'above_hard_max' END) AS caps,
 concat_ws(',', CASE WHEN solar THEN 'renewables' END, CASE WHEN key_account THEN 'key_account' END, CASE WHEN bim THEN 'design_build_or_bim' END, CASE WHEN sustainability THEN 'sustainability' END) AS boosts,
 round(f_size, 6) AS f_size, round(f_distance, 6) AS f_distance, round(f_timing, 6) AS f_timing FROM banded""")
def score_explain(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", F.array_join("caps", ",").alias("caps"), F.array_join("boosts", ",").alias("boosts"), *[F.round(c, 6).alias(c) for c in ("f_size", "f_distance", "f_timing")])


@query(f"""WITH {SCORED}, f AS (SELECT id, [{{'l': -(f_project_type - 0.5) * 0.25 * 100, 'i': 0, 'n': 'project_type'}}, {{'l': -(f_size - 0.5) * 0.25 * 100, 'i': 1, 'n': 'size'}}, {{'l': -(f_gc - 0.5) * 0.25 * 100, 'i': 2, 'n': 'gc'}},
 {{'l': -(f_distance - 0.6) * 0.10 * 100, 'i': 3, 'n': 'distance'}}, {{'l': -(f_timing - 0.5) * 0.10 * 100, 'i': 4, 'n': 'timing'}}, {{'l': -(f_bid_type - 0.7) * 0.05 * 100, 'i': 5, 'n': 'bid_type'}}] AS r FROM banded)
 SELECT id, array_to_string(list_transform(list_slice(list_sort(list_filter(r, lambda x: x.l < -1e-9)), 1, 3), lambda x: x.n), ',') AS helps,
 array_to_string(list_transform(list_slice(list_sort(list_transform(list_filter(r, lambda x: x.l > 1e-9), lambda x: {{'l': -x.l, 'i': x.i, 'n': x.n}})), 1, 1), lambda x: x.n), ',') AS hurts FROM f""")
def score_factors(spark, sf_dir):
    up, down = scoring.ranked_factors()
    return _scored(spark, sf_dir).select("id", F.array_join(up, ",").alias("helps"), F.array_join(down, ",").alias("hurts"))


@query(f"WITH {OPPORTUNITIES}, w AS (SELECT gc_id, date_trunc('week', bid_due) AS week, count(*) AS n FROM opp WHERE status = 'bidding' GROUP BY ALL) SELECT opp.id, coalesce(w.n, 0) - CASE WHEN status = 'bidding' THEN 1 ELSE 0 END AS others FROM opp LEFT JOIN w ON w.gc_id = opp.gc_id AND w.week = date_trunc('week', bid_due)")
def congestion_by_week(spark, sf_dir):
    return scoring.others_due_same_week(opportunities(spark, sf_dir), ["gc_id"]).select("id", F.col("others_due_same_week").alias("others"))


@query(f"WITH {SCORED} SELECT count(*) AS scored, count(*) FILTER (WHERE band <> CASE WHEN score >= 60 THEN 'bid' WHEN score >= 45 THEN 'consider' WHEN score >= 20 THEN 'likely_pass' ELSE 'pass' END) AS changed FROM banded")
def profile_preview(spark, sf_dir):
    draft = scoring.Profile(version=2, thresholds=(60, 45, 20))
    return _scored(spark, sf_dir).agg(F.count("*").alias("scored"), F.count_if(F.col("band") != scoring.band(F.col("score"), draft)).alias("changed"))


@query(f"WITH {SCORED} SELECT id, score FROM banded WHERE id % 3 <> 0 OR score <> 50")
def rescore_changed(spark, sf_dir):
    d = _scored(spark, sf_dir).select("id", "score", F.col("score").cast("string").alias("stable"))
    stored = d.filter(F.col("id") % 3 == 0).select("id", F.when(F.col("score") == 50, "50").otherwise("stale").alias("stable"))
    return scoring.changed_scores(stored, d, ["id"], "stable").select("id", "score")


# ---------------------------------------------------------------- calibration and extraction accuracy

_LABELLED = f"WITH {SCORED}, l AS (SELECT banded.*, score >= 45 AS p, CAST(o_totalprice > 150000 AND id % 4 <> 0 AS BOOLEAN) AS a FROM banded JOIN orders ON o_orderkey = id)"
_COUNTS = "count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn"


def _labelled(spark, sf_dir):
    return _scored(spark, sf_dir).withColumns({"p": F.col("score") >= 45, "a": (F.col("stated_project_value") > 3_000_000) & (F.col("id") % 4 != 0)})


@query(f"{_LABELLED.replace('o_totalprice > 150000', 'stated_project_value > 3000000')}, c AS (SELECT {_COUNTS} FROM l) SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c")
def calibration(spark, sf_dir):
    out = evaluation.confusion(_labelled(spark, sf_dir), "p", "a", [])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"{_LABELLED.replace('o_totalprice > 150000', 'stated_project_value > 3000000')} SELECT project_type, tier, {_COUNTS} FROM l GROUP BY GROUPING SETS ((project_type), (tier), ())")
def calibration_by_group(spark, sf_dir):
    return evaluation.confusion_sets(_labelled(spark, sf_dir), "p", "a", "project_type", "tier")


@query(f"{_LABELLED.replace('o_totalprice > 150000', 'stated_project_value > 3000000')}, b(position, band) AS (VALUES (0, 'bid'), (1, 'consider'), (2, 'likely_pass'), (3, 'pass')), c AS (SELECT band, count(*) AS n, count(*) FILTER (WHERE a) AS positive FROM l GROUP BY band) SELECT position, b.band, coalesce(n, 0) AS n, coalesce(positive, 0) AS positive FROM b LEFT JOIN c USING (band)")
def band_breakdown(spark, sf_dir):
    return evaluation.by_band(_labelled(spark, sf_dir), "a")


@query(f"WITH {OPPORTUNITIES}, f AS (SELECT 'bid_due' AS field, id % 50 <> 0 AS ok FROM opp UNION ALL SELECT 'project_type', id % 8 <> 0 FROM opp) SELECT field, count(*) AS total, count(*) FILTER (WHERE ok) AS correct, round(count(*) FILTER (WHERE ok) / count(*), 6) AS accuracy, count(*) FILTER (WHERE ok) / count(*) >= CASE field WHEN 'bid_due' THEN 0.97 ELSE 0.9 END AS passed FROM f GROUP BY field")
def extraction_accuracy(spark, sf_dir):
    d = opportunities(spark, sf_dir).select("bid_due", "project_type", F.when(F.col("id") % 50 != 0, F.col("bid_due")).alias("expected_bid_due"), F.when(F.col("id") % 8 != 0, F.col("project_type")).alias("expected_project_type"))
    return evaluation.field_accuracy(d, ["bid_due", "project_type"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {OPPORTUNITIES} SELECT band, count(*) AS n FROM (SELECT CASE WHEN stated_project_value * 0.1 <= 250000 THEN '<=250K' WHEN stated_project_value * 0.1 <= 1000000 THEN '<=1M' WHEN stated_project_value * 0.1 <= 4000000 THEN '<=4M' WHEN stated_project_value * 0.1 <= 15000000 THEN '<=15M' ELSE '>15M' END AS band FROM opp) GROUP BY band")
def size_bands(spark, sf_dir):
    return opportunities(spark, sf_dir).groupBy(evaluation.size_band(F.col("stated_project_value") * 0.1).alias("band")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- directory


@query(f"""WITH {OPPORTUNITIES}, s AS (SELECT gc_id, count(*) AS invites, count(*) FILTER (WHERE status IN ('bidding','submitted','won','lost')) AS bids, count(*) FILTER (WHERE status IN ('submitted','won','lost')) AS submitted,
 count(*) FILTER (WHERE status = 'won') AS won, round(avg(date_diff('day', first_seen, bid_due)), 4) AS avg_days_notice FROM opp WHERE first_seen >= {NOW_SQL} - INTERVAL 365 DAY GROUP BY gc_id)
 SELECT *, CASE WHEN submitted >= 5 THEN round(won / submitted, 6) END AS hit_rate FROM s""")
def gc_stats(spark, sf_dir):
    return directory.gc_stats(opportunities(spark, sf_dir), now()).withColumns({"avg_days_notice": F.round("avg_days_notice", 4), "hit_rate": F.round("hit_rate", 6)})


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '')"


@query(f"WITH p AS (SELECT page_id, {_HOST} AS host FROM pages), d AS (SELECT host, min(page_id) AS gc_id FROM p GROUP BY host) SELECT p.page_id AS message_id, d.gc_id FROM p JOIN d USING (host) WHERE host NOT IN ({', '.join(repr(x) for x in K.PLATFORM_DOMAINS + K.GENERIC_DOMAINS)})")
def directory_by_domain(spark, sf_dir):
    (pages,) = load(spark, sf_dir, "pages")
    p = pages.select(F.col("page_id").alias("message_id"), F.concat(F.lit("bids@"), links.host(F.col("url"))).alias("sender"))
    domains = p.groupBy(F.substring_index("sender", "@", -1).alias("domain")).agg(F.min("message_id").alias("gc_id"))
    return directory.by_domain(p, domains)


@query()
def directory_fuzzy(spark, sf_dir):
    part, supplier = load(spark, sf_dir, "part", "supplier")
    names = part.select(F.col("p_partkey").alias("id"), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " Construction, Inc.").otherwise(" LLC")).alias("name"))
    known = supplier.select(F.col("s_suppkey").alias("k")).join(part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name")), "k").select(F.col("k").alias("id"), "name")
    return directory.similar_names(names, known).select("left_id", "right_id", F.round("ratio", 4).alias("ratio"))


@query("SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'A' END AS tier FROM nation")
def directory_seed(spark, sf_dir):
    (nation,) = load(spark, sf_dir, "nation")
    have = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("A").alias("tier"))
    return directory.seed(have, nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "name")


# ---------------------------------------------------------------- messages


@query(r"SELECT doc_id, sha256(concat_ws(chr(10), lower(source), trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '')) AS content_hash FROM documents")
def message_content_hash(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    return d.select("doc_id", text.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query(r"WITH h AS (SELECT doc_id, source, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS h FROM documents), f AS (SELECT h, min(doc_id) AS message_id FROM h GROUP BY h) SELECT message_id, count(DISTINCT source) AS copies FROM h JOIN f USING (h) GROUP BY message_id")
def message_copies(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    h = d.select("doc_id", "source", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("message_id"))
    return ingest.copies(h.join(first, "h"), "message_id", "source")


@query(f"""WITH RECURSIVE m AS (SELECT doc_id, sha256(text) AS h, TIMESTAMP '{EVENTS_NOW_TEXT}' + to_hours(CAST(doc_id % 2000 AS INTEGER)) AS came FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY came, doc_id) AS k FROM m),
 r AS (SELECT h, k, doc_id, doc_id AS anchor, came AS since, NULL::BIGINT AS duplicate_of FROM o WHERE k = 1
 UNION ALL SELECT o.h, o.k, o.doc_id, CASE WHEN o.came - r.since <= INTERVAL 7 DAY THEN r.anchor ELSE o.doc_id END, CASE WHEN o.came - r.since <= INTERVAL 7 DAY THEN r.since ELSE o.came END, CASE WHEN o.came - r.since <= INTERVAL 7 DAY THEN r.anchor END FROM r JOIN o ON o.h = r.h AND o.k = r.k + 1)
 SELECT doc_id, duplicate_of FROM r""")
def message_anchor_duplicates(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    m = d.select("doc_id", F.sha2("text", 256).alias("h"), (F.lit(EVENTS_NOW_TEXT).cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 2_000).cast("int"))).alias("received_at"))
    return ingest.anchor_duplicates(m, "h", "received_at", "doc_id").select("doc_id", "duplicate_of")


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT event_id, user_id, event_type FROM f WHERE n = 1")
def first_per_message_id(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    return ingest.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query(f"SELECT doc_id, NOT regexp_matches(source || chr(10) || substr(text, 1, 2000), '(?i){K.BID_HINT}') AND (regexp_matches(source, '(?i){K.NOISE_SUBJECT}') OR length(trim(text)) < 40 AND len(regexp_extract_all(text, 'https?://')) = 0) AS skip FROM documents")
def prefilter(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    n = F.size(F.regexp_extract_all("text", F.lit("https?://"), F.lit(0)))
    return d.select("doc_id", text.bid_noise(F.col("source"), F.col("text"), F.lit(0), n).alias("skip"))


_LINKS = r"""SELECT page_id, pos, regexp_replace(u, '[.,;:!?]+$', '') AS link FROM (SELECT page_id, unnest(l) AS u, generate_subscripts(l, 1) - 1 AS pos
 FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '(https?://[^\s<>"'')\]]+)', 1) AS l FROM pages))"""


@query(f"WITH l AS ({_LINKS}) SELECT page_id, link, min(pos) AS first_pos FROM l GROUP BY ALL")
def link_harvest(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    found = F.transform(F.regexp_extract_all("html", F.lit(links.URL), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return p.select("page_id", F.concat_ws(" ", "url", "html").alias("html")).select("page_id", F.posexplode(found).alias("pos", "link")).groupBy("page_id", "link").agg(F.min("pos").alias("first_pos"))


_HOSTS = [h for d in K.HOST_CLASSES for h in (d, f"files.{d}", f"not{d}")]
_CLASS = "CASE " + " ".join(f"WHEN h = '{d}' OR h LIKE '%.{d}' THEN '{c}'" for d, c in K.HOST_CLASSES.items()) + " ELSE 'other' END"


@query(f"WITH p AS (SELECT page_id, {_HOST} AS own, {_HOSTS!r}[CAST(page_id % {len(_HOSTS)} AS INTEGER) + 1] AS h0 FROM pages), q AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN own ELSE h0 END AS h FROM p) SELECT page_id, h AS host, {_CLASS} AS host_class FROM q")
def host_classes(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    known = F.concat(F.lit("https://me@www."), F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % len(_HOSTS) + 1).cast("int")), F.lit(":443/a?b"))
    h = links.host(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(known))
    return p.select("page_id", h.alias("host"), links.host_class(h).alias("host_class"))


@query(r"SELECT page_id, url AS unwrapped FROM pages")
def url_unwrap(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    escape = lambda c: F.url_encode(c)
    wrapped = F.concat(F.lit("https://nam02.safelinks.protection.outlook.com/?url="), escape(F.col("url")), F.lit("&data=1"))
    return p.select("page_id", links.unwrap(F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))).alias("unwrapped"))


# Links with their ids, as the fixed values say: a company's number in a link isn't an id, and a package comes before its project.
_ID_LINKS = [
    ("https://app.buildingconnected.com/projects/5f0c1ab2c3d4e5", "bc:5f0c1ab2c3d4e5"), ("https://app.buildingconnected.com/RFP/ABCDEF012345/files", "bc:abcdef012345"), ("https://app.buildingconnected.com/bids/1234", None),
    ("https://app.procore.com/2318842/project/bid_packages/77?x=1", "procore:77"), ("https://app.procore.com/2318842/projects/991", "procore:991"), ("https://app.procore.com/2318842/home", None),
    ("https://x.example.com/?bidPackageId=Ab-9&projectId=4", "pkg:ab-9"), ("https://x.example.com/?a=1&project_id=4", "proj:4"), ("https://x.example.com/project/4", None),
]


@query(f"SELECT page_id, ([{', '.join('NULL' if i is None else repr(i) for _, i in _ID_LINKS)}])[CAST(page_id % {len(_ID_LINKS)} AS INTEGER) + 1] AS platform_id FROM pages")
def platform_ids(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    return p.select("page_id", links.platform_id(F.element_at(F.array(*[F.lit(u) for u, _ in _ID_LINKS]), (F.col("page_id") % len(_ID_LINKS) + 1).cast("int"))).alias("platform_id"))


_STOP = ", ".join(f"'{w}'" for w in K.NAME_STOPWORDS)
_NUMBERS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.NUMBER_WORDS.items())
_NORM = rf"array_to_string(list_filter(list_transform(string_split_regex(trim(regexp_replace(lower(%s), '[^a-z0-9\s]', ' ', 'g')), '\s+'), lambda w: CASE w {_NUMBERS} ELSE w END), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')"


@query(f"SELECT p_partkey AS id, {_NORM % chr(39).join(['p_name || ', ' Renovation - Phase Two of the ', ' || p_brand'])} AS name FROM part")
def normalize_names(spark, sf_dir):
    (p,) = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), text.normalize_name(F.concat(F.col("p_name"), F.lit(" Renovation - Phase Two of the "), F.col("p_brand"))).alias("name"))


@query(f"WITH n AS (SELECT item_id AS id, list_distinct(list_filter(string_split({_NORM % 'text'}, ' '), lambda w: length(w) >= 4)) AS w FROM benchmark) SELECT id, array_to_string(list_transform(list_slice(list_sort(list_transform(w, lambda x: {{'n': -length(x), 'w': x}})), 1, 3), lambda s: s.w), ',') AS tokens FROM n")
def name_tokens(spark, sf_dir):
    (b,) = load(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.array_join(F.slice(text.name_tokens(F.col("text")), 1, 3), ",").alias("tokens"))


@query(f"WITH {OPPORTUNITIES} SELECT id, substr(sha1(concat_ws('|', id::VARCHAR, 'gc' || gc_id || '.com', '', strftime(bid_due, '%G-%V'))), 1, 20) AS fingerprint FROM opp")
def fingerprints(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    domain = F.concat(F.lit("bids@www.gc"), F.col("gc_id").cast("string"), F.lit(".com"))
    return o.select("id", text.fingerprint(F.col("name"), domain, F.lit(None).cast("string"), F.col("bid_due")).alias("fingerprint"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', '', 'g')) AS n FROM pages")
def html_stripped_length(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", "")
    return p.select("page_id", F.length(bare).alias("n"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?is)<!--.*?-->', ' ', 'g'), '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', '\2 (\1)', 'g'),
 '(?i)<(br|/p|/div|/tr|/li|/h[1-6])[^>]*>', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '(?s)<[^>]+>', '', 'g') AS t FROM pages),
 e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)
 SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \x0B\f\r]+', ' ', 'g'), '[\s\x0B]*\n[\s\x0B]*', chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text FROM e""")
def html_text(spark, sf_dir):
    (p,) = load(spark, sf_dir, "pages")
    return p.select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 200 THEN rtrim(substr(t, 1, 199)) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def excerpts(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    return d.select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT conv_id, turn AS last_turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1")
def thread_latest(spark, sf_dir):
    (c,) = load(spark, sf_dir, "conversations")
    return ingest.latest_per_key(c, ["conv_id"], ["turn", "role"]).select("conv_id", F.col("turn").alias("last_turn"), "role")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS superseded_by FROM conversations")
def extraction_versions(spark, sf_dir):
    (c,) = load(spark, sf_dir, "conversations")
    return ingest.version_chain(c, "conv_id", ["turn"], "turn").select("conv_id", "turn", "version", "superseded_by")


@query("WITH n AS (SELECT o_custkey % 100 AS parent, count(*) AS n FROM orders GROUP BY 1) SELECT parent, greatest(0, n - 50) AS overflow, least(n, 50) AS kept FROM n")
def attachment_cap(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    kept, over = ingest.capped_children(o.select((F.col("o_custkey") % 100).alias("parent"), F.col("o_orderkey").alias("child")), "parent", ["child"])
    return over.join(kept.groupBy("parent").agg(F.count("*").alias("kept")), "parent")


# ---------------------------------------------------------------- polls, jobs, health


def _polls(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 20).alias("source_id"), "ts", (F.col("event_type") != "error").alias("ok"), (F.col("value") - 20).alias("lag_s"), F.col("user_id"))


@query("SELECT user_id % 20 AS source_id, count(*) AS polls, count(*) FILTER (WHERE event_type = 'error') AS failed, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate, round(quantile_cont(value - 20, 0.5), 6) AS lag_p50, round(quantile_cont(value - 20, 0.95), 6) AS lag_p95, count(*) FILTER (WHERE value - 20 < 0) AS clock_skew FROM events GROUP BY 1")
def ingest_metrics(spark, sf_dir):
    return ingest.poll_metrics(_polls(spark, sf_dir), ["source_id"]).withColumns({c: F.round(c, 6) for c in ("success_rate", "lag_p50", "lag_p95")})


@query("WITH r AS (SELECT user_id % 20 AS source_id, value, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id % 20) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id % 20 ORDER BY value)) SELECT source_id, round(value, 6) AS nearest FROM r WHERE k = round_even(0.95 * (n - 1), 0)")
def lag_nearest_rank(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    return ingest.nearest_rank(e.select((F.col("user_id") % 20).alias("source_id"), "value"), "value", 0.95, ["source_id"]).withColumn("nearest", F.round("nearest", 6))


@query(f"WITH l AS (SELECT user_id % 20 AS source_id, max(ts) AS last FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'paused' WHEN date_diff('second', last, TIMESTAMP '{EVENTS_NOW_TEXT}') / 60 > 60 THEN 'down' WHEN date_diff('second', last, TIMESTAMP '{EVENTS_NOW_TEXT}') / 60 > 30 THEN 'degraded' ELSE 'ok' END AS health FROM l")
def source_health(spark, sf_dir):
    last = _polls(spark, sf_dir).filter("ok").groupBy("source_id").agg(F.max("ts").alias("last"))
    minutes = (F.unix_timestamp(events_now().cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 60
    return last.select("source_id", ingest.health(minutes, F.col("source_id") % 7 == 0).alias("health"))


@query("WITH o AS (SELECT event_id, user_id % 20 AS source_id, event_type = 'error' AS bad, lag(event_type = 'error') OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS before FROM events) SELECT event_id, source_id FROM o WHERE bad AND (before IS NULL OR NOT before)")
def outage_alerts(spark, sf_dir):
    log = _polls(spark, sf_dir).select("event_id", "source_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("ok"), "ok").otherwise("down").alias("status"))
    return ingest.status_changes(log, "source_id", "at", "status", "down").select("event_id", "source_id")


@query("SELECT user_id % 20 AS source_id, coalesce(min(CASE WHEN event_type = 'error' THEN event_id END) - 1, max(event_id)) AS cursor, count(*) FILTER (WHERE event_type = 'error') AS unsettled FROM events GROUP BY 1")
def safe_cursor(spark, sf_dir):
    return ingest.safe_cursor(_polls(spark, sf_dir), "source_id", "event_id", "ok")


@query("WITH b AS (SELECT o_custkey, o_orderkey, sum(CAST(o_totalprice AS BIGINT)) OVER w AS s, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) SELECT o_custkey, o_orderkey FROM b WHERE (s <= 500000 OR n = 1) AND n <= 4")
def batch_budget(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    size = F.round("o_totalprice").cast("long")
    return ingest.within_budget(o.select("o_custkey", "o_orderkey", size.alias("size")), "o_custkey", "o_orderkey", "size", 500_000, 4).select("o_custkey", "o_orderkey")


@query("WITH l AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN ts END) AS last FROM events GROUP BY 1) SELECT events.user_id, count(*) AS attempts, count(*) >= 5 AS given_up FROM events JOIN l USING (user_id) WHERE event_type = 'error' AND (last IS NULL OR ts > last) GROUP BY 1")
def poison_messages(spark, sf_dir):
    return ingest.poison(_polls(spark, sf_dir), "user_id", "ts", "ok")


@query("SELECT event_id, ts + to_seconds(30 * CAST(pow(2, event_id % 6) AS BIGINT)) AS run_at FROM events WHERE event_type = 'error'")
def retry_backoff(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    return e.filter("event_type = 'error'").select("event_id", ingest.next_run(F.col("event_id") % 6 + 1, F.col("ts")).alias("run_at"))


@query(f"SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '{EVENTS_NOW_TEXT}' AND (event_id % 3 <> 0 OR ts < TIMESTAMP '{EVENTS_NOW_TEXT}' - INTERVAL 1 DAY)")
def claimable_jobs(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    jobs = e.select("event_id", F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("done").alias("status"), F.col("ts").alias("run_at"), (F.col("event_id") % 4).alias("priority"), F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.make_dt_interval(days=F.lit(1))).alias("lease_until"))
    return ingest.claimable(jobs, events_now()).select("event_id")


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


# ---------------------------------------------------------------- resolution

_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(%s), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""WITH d AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), g AS (SELECT id, {_GRAMS % 'name'} AS g FROM d), u AS (SELECT id, len(g) AS n, unnest(g) AS t FROM g),
 m AS (SELECT x.id AS a, y.id AS b, count(*) AS c, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.t = y.t AND x.id < y.id GROUP BY 1, 2)
 SELECT 'member' AS kind, d.id AS a, p_partkey AS b, 1.0 AS similarity FROM part JOIN d ON name = p_name WHERE p_partkey <> d.id UNION ALL SELECT 'alike', a, b, round(c / (nx + ny - c), 6) FROM m WHERE c / (nx + ny - c) >= 0.25""")
def name_candidates_trigram(spark, sf_dir):
    (p,) = load(spark, sf_dir, "part")
    return resolve.name_candidates(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).withColumn("similarity", F.round("similarity", 6))


def _pairs(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    keys = {"board": F.concat_ws("|", F.col("gc_id"), F.date_trunc("week", "bid_due").cast("string"))}
    pairs = resolve.block_pairs(o, o, keys).filter("a < b")
    cols = lambda x: o.select(F.col("id").alias(f"{x}_id"), F.concat(F.lit("Tower "), F.col("project_type"), F.lit(" "), (F.col("id") % 3).cast("string")).alias(f"{x}_name"), F.when(F.col("id") % 5 != 0, F.col("gc_id")).alias(f"{x}_gc_id"), F.lit(None).cast("string").alias(f"{x}_gc_domain"), F.array().cast("array<string>").alias(f"{x}_platform_ids"), F.array().cast("array<string>").alias(f"{x}_thread_ids"), F.lit(None).cast("string").alias(f"{x}_project_number"), F.when(F.col("id") % 2 == 0, F.col("lat")).alias(f"{x}_lat"), F.col("lon").alias(f"{x}_lon"), F.lit(None).cast("string").alias(f"{x}_city"), F.col("bid_due").alias(f"{x}_bid_due"), F.lit(None).cast("string").alias(f"{x}_owner_name"), F.col("first_seen").alias(f"{x}_last_activity"))
    d = pairs.join(cols("c"), F.col("a") == F.col("c_id")).join(cols("i"), F.col("b") == F.col("i_id")).withColumn("i_kind", F.when(F.col("b") % 4 == 0, "addendum").otherwise("itb"))
    sim = similarity.trigram_similarity(similarity.trigrams(F.col("c_name")), similarity.trigrams(F.col("i_name")))
    return resolve.evidence(d, sim, F.lit(0.0))


_PAIRS = f"""WITH {OPPORTUNITIES}, o AS (SELECT *, 'Tower ' || project_type || ' ' || (id % 3) AS nm, CASE WHEN id % 5 <> 0 THEN gc_id END AS g, CASE WHEN id % 2 = 0 THEN lat END AS la, date_trunc('week', bid_due) AS week FROM opp),
 p AS (SELECT c.id AS c_id, i.id AS i_id, {_GRAMS % 'c.nm'} AS cg, {_GRAMS % 'i.nm'} AS ig, c.g = i.g AS gm, CASE WHEN c.la IS NOT NULL AND i.la IS NOT NULL THEN CASE WHEN c.lat = i.lat AND c.lon = i.lon THEN 1.0 ELSE 0.0 END END AS geo, abs(c.due_days - i.due_days) AS apart,
  CASE WHEN i.id % 4 = 0 THEN 'addendum' ELSE 'itb' END AS kind FROM o c JOIN o i ON c.gc_id = i.gc_id AND c.week = i.week AND c.id < i.id),
 q AS (SELECT *, len(list_intersect(cg, ig)) / len(list_distinct(list_concat(cg, ig))) AS sim, CASE WHEN kind = 'itb' THEN 0.0 ELSE 0.5 END AS least, CASE WHEN apart <= 3 THEN 1.0 WHEN apart <= 14 THEN 0.5 ELSE 0.0 END AS d0 FROM p),
 r AS (SELECT *, (0.45 * sim + CASE WHEN gm IS NULL THEN 0 WHEN gm THEN 0.25 ELSE 0 END + coalesce(0.12 * geo, 0) + 0.12 * greatest(d0, least)) / (0.45 + CASE WHEN gm IS NULL THEN 0 ELSE 0.25 END + CASE WHEN geo IS NULL THEN 0 ELSE 0.12 END + 0.12) AS s FROM q),
 e AS (SELECT c_id, i_id, kind, round_even(CASE WHEN geo = 0 OR sim < 0.5 THEN least(s, 0.59) ELSE s END, 4) AS score, coalesce(NOT gm, false) AS clash, sim FROM r)"""


@query(f"{_PAIRS} SELECT c_id, i_id, score, round_even(sim, 4) AS name_similarity FROM e")
def evidence_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("c_id", "i_id", "score", "name_similarity")


@query(f"{_PAIRS} SELECT c_id, i_id, CASE WHEN score >= 0.9 THEN 'merge' WHEN score >= 0.6 THEN 'review' ELSE 'new' END AS decision FROM e")
def resolve_decisions(spark, sf_dir):
    return _pairs(spark, sf_dir).select("c_id", "i_id", resolve.decision(F.col("i_kind")).alias("decision"))


@query()
def resolve_messages(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    none = F.array().cast("array<string>")
    m = o.select("id", F.col("first_seen").cast("timestamp").alias("sent_at"), F.when(F.col("id") % 3 == 0, "date_change").otherwise("itb").alias("kind"), F.substring(F.sha1(F.floor(F.col("id") / 5).cast("string")), 1, 10).alias("name"), "gc_id", F.lit(None).cast("string").alias("gc_domain"), none.alias("platform_ids"), F.array(F.concat(F.lit("t"), F.floor(F.col("id") / 4).cast("string"))).alias("thread_ids"), F.lit(None).cast("string").alias("project_number"), "lat", "lon", F.lit(None).cast("string").alias("city"), F.col("bid_due").cast("timestamp").alias("bid_due"), F.lit(None).cast("string").alias("owner_name"))
    return resolve.resolve(m).select("message_id", "opp_id", "role", "score", "hard_key", "outcome")


@query("WITH p AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey) SELECT x AS id, array_to_string(list_sort(list_distinct(list(y))), ',') AS related FROM p GROUP BY x")
def related_links(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    side = lambda x: li.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias(x)).distinct()
    pairs = side("a").join(side("b"), ["l_partkey", "l_suppkey"]).filter("a < b").select("a", "b").distinct()
    return resolve.related_links(pairs).select("id", F.array_join(F.transform("related", lambda x: x.cast("string")), ",").alias("related"))


# ---------------------------------------------------------------- merging and curation


@query("WITH u AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, l_linenumber, l_shipdate, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS old FROM u), c AS (SELECT * FROM m WHERE old IS NOT NULL AND old <> l_shipdate) SELECT l_orderkey AS id, l_linenumber AS line, old, l_shipdate AS new, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS change FROM c")
def date_moves(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    d = li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).agg(F.min("l_shipdate").alias("l_shipdate"))
    return merge.date_moves(d, "id", "line", "l_shipdate")


@query("WITH s AS (SELECT l_orderkey AS id, max(l_linenumber) AS top, list_distinct(list(l_linenumber)) AS seen FROM lineitem WHERE l_linenumber % 3 <> 2 GROUP BY 1), g AS (SELECT id, list_filter(range(1, top + 1), lambda n: NOT list_contains(seen, n)) AS m FROM s) SELECT id, array_to_string(m, ',') AS missing FROM g WHERE len(m) > 0")
def addendum_gaps(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    d = li.filter("l_linenumber % 3 <> 2").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("number"))
    return merge.addendum_gaps(d, "id", "number").select("id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query("WITH u AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL), p AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS x, lag(l_quantity) OVER w AS q0, lag(l_extendedprice) OVER w AS x0 FROM u WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey AS id, l_linenumber AS line, round(greatest(abs(q - q0) / nullif(q0, 0), abs(x - x0) / nullif(x0, 0)), 6) AS ratio FROM p WHERE q0 IS NOT NULL")
def size_changes(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    u = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_extendedprice").alias("l_extendedprice"))
    d = u.withColumns({"q0": F.lag("l_quantity").over(w), "x0": F.lag("l_extendedprice").over(w)}).filter("q0 is not null")
    ratio = merge.worst_change([(F.col("q0"), F.col("l_quantity")), (F.col("x0"), F.col("l_extendedprice"))])
    return d.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(ratio, 6).alias("ratio"))


@query(f"WITH {OPPORTUNITIES}, a AS (SELECT *, status = 'undecided' AND first_seen < {NOW_SQL} - INTERVAL 180 DAY AS archived FROM opp) SELECT id, archived, CASE WHEN archived THEN 'archived' ELSE status END AS status FROM a")
def archive_stale(spark, sf_dir):
    return merge.archive_stale(opportunities(spark, sf_dir).withColumn("last_activity", F.col("first_seen")), now()).select("id", "archived", "status")


@query("SELECT o_orderkey - o_orderkey % 5 AS id, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_activity, count(*) AS absorbed FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 5 = 0) > 0 UNION ALL SELECT o_orderkey, o_orderdate, o_orderdate, 1 FROM orders o WHERE o_orderkey % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey = o.o_orderkey - o.o_orderkey % 5)")
def merge_alias(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    opps = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("first_seen"), F.col("o_orderdate").alias("last_activity"))
    pairs = opps.filter("id % 5 <> 0").select(F.col("id").alias("victim"), (F.col("id") - F.col("id") % 5).alias("survivor")).join(opps.select(F.col("id").alias("survivor")), "survivor")
    return curation.merged(opps, curation.aliases(pairs.select("victim", "survivor"), opps))


@query("WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN l_linenumber = 2 AND n > 1 THEN -l_orderkey ELSE l_orderkey END AS opp_id, count(*) AS sources FROM lineitem JOIN n USING (l_orderkey) GROUP BY 1")
def split_sources(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("opp_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("message"))
    moved = li.filter("l_linenumber = 2").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("message"), (-F.col("l_orderkey")).alias("new_id")).distinct()
    return curation.split(s, "message", moved).groupBy("opp_id").agg(F.count("*").alias("sources"))


# ---------------------------------------------------------------- digest, decisions, calendar

_ITEMS = f"""WITH {SCORED}, i AS (SELECT *, id % 2 = 0 AS mine, id % 3 = 0 AS changed, CASE WHEN id % 5 = 0 THEN {NOW_SQL} - INTERVAL 400 DAY END AS watermark FROM banded),
 n AS (SELECT *, status = 'undecided' AND mine AND (bid_due <= {NOW_SQL} + INTERVAL 10 DAY OR first_seen <= {NOW_SQL} - INTERVAL 3 DAY) AS needs FROM i),
 s AS (SELECT id, score, band, bid_due, 'needs_decision' AS section FROM n WHERE needs UNION ALL SELECT id, score, band, bid_due, 'new' FROM n WHERE (watermark IS NULL OR first_seen > watermark) AND NOT needs
  UNION ALL SELECT id, score, band, bid_due, 'due_this_week' FROM n WHERE status IN ('bidding', 'undecided') AND bid_due >= {NOW_SQL} AND bid_due <= {NOW_SQL} + INTERVAL 7 DAY UNION ALL SELECT id, score, band, bid_due, 'changed' FROM n WHERE changed)"""


def _sections(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumns({
        "mine": F.col("id") % 2 == 0, "changed": F.col("id") % 3 == 0, "material": F.lit(False), "prebid_at": F.lit(None).cast("timestamp_ntz"),
        "watermark": F.when(F.col("id") % 5 == 0, now() - F.make_dt_interval(days=F.lit(400))),
    })
    return digest.sections(d, now())


@query(f"{_ITEMS} SELECT id, section FROM s")
def due_sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("id", "section")


@query(f"{_ITEMS} SELECT count(*) FILTER (WHERE section = 'new') AS new, count(*) FILTER (WHERE section = 'new' AND band = 'bid') AS new_bid, count(*) FILTER (WHERE section = 'due_this_week') AS due_this_week, count(*) FILTER (WHERE section = 'changed') AS changed, count(*) FILTER (WHERE section = 'needs_decision') AS needs_decision, min(CASE WHEN bid_due >= {NOW_SQL} THEN bid_due END) AS next_due, count(*) = 0 AS quiet FROM s")
def digest_counts(spark, sf_dir):
    return digest.header(_sections(spark, sf_dir), now())


@query(f"WITH {SCORED} SELECT band, id, row_number AS position FROM (SELECT band, id, row_number() OVER (PARTITION BY band ORDER BY score DESC, bid_due NULLS LAST, id) AS row_number FROM banded) WHERE row_number <= 10")
def consider_topk(spark, sf_dir):
    best, _ = digest.top_by_band(_scored(spark, sf_dir))
    return best.select("band", "id", "position")


@query(f"WITH {SCORED} SELECT band, greatest(0, count(*) - 10) AS overflow FROM banded GROUP BY band")
def band_overflow(spark, sf_dir):
    return digest.top_by_band(_scored(spark, sf_dir))[1]


@query(f"""WITH RECURSIVE {_TRANSITIONS}, o AS (SELECT user_id, ({K.STATUSES!r})[CAST(event_id % 10 AS INTEGER) + 1] AS goal, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 r AS (SELECT user_id, 0::BIGINT AS k, 'new' AS status, 0 AS applied, 0 AS refused FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT o.user_id, o.k, CASE WHEN t.a IS NOT NULL THEN o.goal ELSE r.status END, r.applied + CASE WHEN t.a IS NOT NULL THEN 1 ELSE 0 END, r.refused + CASE WHEN t.a IS NULL AND o.goal <> r.status THEN 1 ELSE 0 END
 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1 LEFT JOIN moves t ON t.a = r.status AND t.b = o.goal)
 SELECT user_id, arg_max(status, k) AS status, max(applied) AS applied, max(refused) AS refused FROM r GROUP BY user_id""")
def status_fold(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    to = F.element_at(F.array(*map(F.lit, K.STATUSES)), (F.col("event_id") % 10 + 1).cast("int"))
    return decisions.status_fold(e.select("user_id", "ts", "event_id", to.alias("to")), "user_id", ["ts", "event_id"], "to")


@query(f"WITH {OPPORTUNITIES} SELECT id, greatest({NOW_SQL}, least({NOW_SQL} + INTERVAL 3 DAY, bid_due - INTERVAL 2 DAY)) AS until FROM opp")
def snooze_clamp(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", decisions.snooze_until(F.lit(None).cast("timestamp_ntz"), now(), F.col("bid_due")).alias("until"))


@query(f"WITH {OPPORTUNITIES}, e AS (SELECT id, status, 'due' AS kind, bid_due AS event_at FROM opp UNION ALL SELECT id, status, 'prebid', CASE WHEN id % 4 = 0 THEN bid_due - INTERVAL 5 DAY END FROM opp) SELECT id, kind, event_at, 'CONFIRMED' AS state FROM e WHERE event_at IS NOT NULL")
def calendar_events(spark, sf_dir):
    o = opportunities(spark, sf_dir).withColumns({"prebid_at": F.when(F.col("id") % 4 == 0, F.col("bid_due") - F.make_dt_interval(days=F.lit(5))), "rfi_deadline": F.lit(None).cast("timestamp_ntz")})
    return decisions.calendar_events(o).select("id", "kind", F.col("at").alias("event_at"), "state")


# ---------------------------------------------------------------- geography


@query(f"WITH {OPPORTUNITIES} SELECT id, round(distance_miles, 6) AS miles FROM opp")
def road_distance(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", F.round("distance_miles", 6).alias("miles"))


@query(f"""WITH {OPPORTUNITIES}, c AS (SELECT id, CAST(greatest(0, least(ceil((lon + 180) / 360 * 32768) - 1, 32767)) AS BIGINT) AS x, CAST(greatest(0, least(ceil((lat + 90) / 180 * 32768) - 1, 32767)) AS BIGINT) AS y FROM opp)
 SELECT id, array_to_string(list_transform(range(0, 6), lambda i: substr('{geo._BASE32}', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: ((CASE WHEN (5 * i + j) % 2 = 0 THEN x ELSE y END >> CAST(14 - (5 * i + j) // 2 AS INTEGER)) & 1) << CAST(4 - j AS INTEGER))) AS BIGINT), 1)), '') AS cell FROM c""")
def geohash_cells(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", geo.geohash(F.col("lat"), F.col("lon")).alias("cell"))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN due_days < 0 THEN 'due date has passed' WHEN due_days = 0 THEN 'due today' WHEN due_days = 1 THEN 'due in 1 day' ELSE 'due in ' || due_days || ' days' END AS phrase FROM opp")
def due_phrases(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", dates.due_phrase(dates.days_between(F.col("bid_due"), now())).alias("phrase"))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN id % 2 = 0 THEN CAST(strftime(bid_due, '%Y-%m-%d 14:30:00') AS TIMESTAMP) ELSE date_trunc('day', bid_due) END AS at, id % 2 = 0 AS time_known FROM opp")
def parsed_dates(spark, sf_dir):
    value = F.date_format("bid_due", "yyyy-MM-dd")
    d = opportunities(spark, sf_dir).select("id", dates.parse_local(F.when(F.col("id") % 2 == 0, F.concat(value, F.lit("T14:30"))).otherwise(value), F.lit("UTC"), now().cast("timestamp")).alias("p"))
    return d.select("id", F.from_utc_timestamp(F.to_utc_timestamp("p.ts", F.current_timezone()), "UTC").cast("timestamp_ntz").alias("at"), "p.time_known")


# ---------------------------------------------------------------- extraction


@query("WITH a AS (SELECT conv_id AS message_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn, text) AS k FROM conversations) SELECT message_id, count(*) AS attachments, sum(CASE WHEN length(text) <= 12000 THEN length(text) ELSE 12007 END)::BIGINT AS chars FROM a WHERE k <= 4 GROUP BY 1")
def extraction_inputs(spark, sf_dir):
    (c,) = load(spark, sf_dir, "conversations")
    files = c.select(F.col("conv_id").alias("message_id"), F.when(F.col("role") == "user", "scope.txt").otherwise("other.txt").alias("filename"), F.struct("turn", "text").alias("position"), "text")
    d = extract.assemble(c.select(F.col("conv_id").alias("message_id")).distinct(), files)
    return d.select("message_id", F.size("attachments").cast("long").alias("attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + F.length(a["text"])).alias("chars"))


@query(f"WITH {OPPORTUNITIES} SELECT id, id % 3 = 1 AS late, CASE WHEN id % 3 = 1 THEN 0.3 ELSE 0.9 END AS confidence, CASE WHEN id % 2 = 0 THEN NULL ELSE name END AS gc_name FROM opp")
def extraction_postprocess(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    d = o.select("id", (F.col("bid_due") + F.make_dt_interval(days=F.when(F.col("id") % 3 == 1, 3).otherwise(-3))).alias("sent_at"), "bid_due", F.lit(0.9).alias("bid_due_confidence"), F.lit(None).cast("boolean").alias("prebid_mandatory"), F.when(F.col("id") % 4 == 0, "Procore").otherwise(F.col("name")).alias("gc_name"), F.when(F.col("id") % 4 == 2, "mail.planhub.com").alias("gc_domain"), "flags", F.lit("").alias("summary"), F.lit("scope").alias("scope_text"))
    return extract.postprocess(d).select("id", F.array_contains("flags", "past_due_at_receipt").alias("late"), F.col("bid_due_confidence").alias("confidence"), "gc_name")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'exact' WHEN c_custkey % 3 = 1 THEN 'city' END AS precision FROM customer")
def geocode_cascade(spark, sf_dir):
    (c,) = load(spark, sf_dir, "customer")
    d = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("street"), F.when(F.col("c_custkey") % 3 < 2, "City").alias("city"), F.lit("PA").alias("state"), F.lit("nowhere").alias("raw"))
    streets = d.filter("street is not null").select(F.lower(F.concat_ws(", ", "street", "city", "state")).alias("query"))
    cache = streets.union(d.select(F.lit("city, pa").alias("query")).distinct()).withColumns({"lat": F.lit(40.0), "lon": F.lit(-80.0)})
    return extract.geocode(d, cache).select("id", "precision")


@query("WITH l AS (SELECT user_id AS message_id, arg_max(event_type, event_id) AS t, count(*) AS attempts FROM events GROUP BY 1) SELECT message_id, attempts, CASE WHEN t = 'view' THEN 'done' WHEN t = 'signup' THEN 'failed' WHEN attempts >= 24 THEN 'failed' ELSE 'retrying' END AS status FROM l")
def extraction_status(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    outcome = F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "signup", "refusal").otherwise("error")
    d = e.select(F.col("user_id").alias("message_id"), F.row_number().over(w).cast("long").alias("attempt"), outcome.alias("outcome"))
    return extract.status(d).select("message_id", "attempts", "status")


@query(f"WITH x AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY 1) SELECT user_id AS message_id FROM events JOIN x USING (user_id) WHERE event_id = e AND event_type <> 'view' AND ts >= TIMESTAMP '{EVENTS_NOW_TEXT}' - INTERVAL 30 DAY ORDER BY ts DESC, user_id LIMIT 200")
def stale_extractions(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("message_id"), F.col("event_id").alias("version"), F.col("ts").alias("created_at"), F.col("event_type").alias("prompt"))
    return extract.stale(d, "view", events_now()).select("message_id")


@query(f"WITH {OPPORTUNITIES} SELECT 'kind' AS measure, bid_type AS key, count(*) AS n FROM opp GROUP BY 2 UNION ALL SELECT 'flag', 'open_shop_indicated', count(*) FROM opp WHERE open_shop UNION ALL SELECT 'flag', 'union_required', count(*) FROM opp WHERE union_required UNION ALL SELECT 'flag', 'sustainability', count(*) FROM opp WHERE sustainability UNION ALL SELECT 'due', 'known', count(*) FROM opp")
def corpus_report(spark, sf_dir):
    return extract.corpus_report(opportunities(spark, sf_dir).withColumn("kind", F.col("bid_type")))


@query(f"""WITH RECURSIVE {OPPORTUNITIES}, {_TRANSITIONS}, goals(action, goal) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in K.ACTION_STATUS.items())}),
 a AS (SELECT l_orderkey AS id, ({_VERBS!r})[CAST((l_partkey + l_linenumber) % 8 AS INTEGER) + 1] AS action, l_linenumber AS came FROM lineitem),
 o AS (SELECT a.id, action, goal, row_number() OVER (PARTITION BY a.id ORDER BY came, action) AS k FROM a LEFT JOIN goals USING (action)),
 r AS (SELECT id, 0::BIGINT AS k, status, 0 AS applied FROM opp WHERE id IN (SELECT id FROM a)
 UNION ALL SELECT o.id, o.k, CASE WHEN t.a IS NOT NULL THEN o.goal ELSE r.status END, r.applied + CASE WHEN o.goal IS NULL OR o.goal = r.status OR t.a IS NOT NULL THEN 1 ELSE 0 END
 FROM r JOIN o ON o.id = r.id AND o.k = r.k + 1 LEFT JOIN moves t ON t.a = r.status AND t.b = o.goal),
 f AS (SELECT id, arg_max(status, k) AS status, max(k) AS actions, max(applied)::BIGINT AS applied FROM r GROUP BY id), n AS (SELECT id, max(CASE WHEN action = 'assign' THEN 'bid_due' END) AS assignee, max(CASE WHEN action = 'lock_field' THEN 1 ELSE 0 END) AS locked FROM a GROUP BY id)
 SELECT opp.id, coalesce(f.status, opp.status) AS status, assignee, coalesce(locked, 0) AS locked, actions, applied FROM opp LEFT JOIN f ON f.id = opp.id LEFT JOIN n ON n.id = opp.id""")
def apply_actions(spark, sf_dir):
    o = opportunities(spark, sf_dir).select("id", "status", "bid_due", "flags", F.lit(None).cast("string").alias("assignee"), F.array().cast("array<string>").alias("locked"), F.lit(None).cast("timestamp").alias("snooze_until"))
    (li,) = load(spark, sf_dir, "lineitem")
    acts = li.select(F.col("l_orderkey").alias("id"), (now().cast("timestamp") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("at"), F.element_at(F.array(*map(F.lit, _VERBS)), ((F.col("l_partkey") + F.col("l_linenumber")) % 8 + 1).cast("int")).alias("action"), F.lit("bid_due").alias("value"))
    after, log = decisions.apply_actions(o, acts, now())
    done = log.groupBy("id").agg(F.count("*").alias("actions"), F.count_if("applied").alias("applied"))
    return after.join(done, "id", "left").select("id", "status", "assignee", F.size("locked").alias("locked"), "actions", "applied")


from sluice.plans import digests, lookups, rules, spans, stores, updates  # noqa: E402, F401  they register their queries
