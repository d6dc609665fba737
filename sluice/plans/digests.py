"""Queries of the digest: items, the review queue, health, visibility, subjects, watermarks and calendars, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import decisions, digest
from sluice.plans.catalog import _ITEMS, _scored, _sections
from sluice.plans.lookups import _STORE, _store
from sluice.plans.registry import query
from sluice.plans.rules import turn, turn_sql
from sluice.plans.views import NOW_SQL, OPPORTUNITIES, SCORED, now, opportunities
from sluice.sources.tables import load

_HOSTS = ["other", "procore", "box"]


@query(f"""WITH {OPPORTUNITIES}, {_STORE}, a AS (SELECT l_orderkey AS opp_id, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
 SELECT opp.id, opp.name AS project_name, coalesce(opp.tier, 'unknown') AS gc_tier, coalesce(l.score, 0) AS score, coalesce(l.band, 'pass') AS band, coalesce(a.n, 0) AS addenda, coalesce(a.top > a.n, false) AS gap,
 'user' || opp.id % 3 AS assignee_name, CASE opp.id % 3 WHEN 0 THEN 'procore' WHEN 1 THEN 'procore' ELSE 'box' END AS docs_host, CASE WHEN open_shop THEN 'open_shop_indicated' ELSE '' END AS flags
 FROM opp LEFT JOIN l ON l.opp_id = opp.id LEFT JOIN a ON a.opp_id = opp.id WHERE status <> 'submitted'""")
def digest_items(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    links = F.array(*[F.struct(F.lit(None).cast("string").alias("url"), turn("id", _HOSTS[i:] + _HOSTS[:i]).alias("host_class")) for i in range(2)])
    o = opportunities(spark, sf_dir).withColumns({"archived": F.col("status") == "submitted", "project_name": F.col("name"), "assignee": F.col("id") % 3, "document_links": links})
    users = spark.range(3).select(F.col("id").alias("user_id"), F.concat(F.lit("user"), F.col("id").cast("string")).alias("user_name"))
    addenda = li.select(F.col("l_orderkey").alias("opp_id"), F.concat(F.lit("Addendum "), F.col("l_linenumber").cast("string")).alias("label"), F.col("l_linenumber").alias("number")).distinct()
    d = digest.items(o, _store(spark, sf_dir), addenda, users)
    return d.select("id", "project_name", "gc_tier", "score", "band", F.col("addenda_count").alias("addenda"), (F.size("missing_addenda") > 0).alias("gap"), "assignee_name", "docs_host", F.array_join("flags", ",").alias("flags"))


@query(f"""WITH {OPPORTUNITIES}, s AS (SELECT event_id, {turn_sql('event_id', ['failed', 'done', 'done', 'retrying'])} AS status, event_id % 10 / 10.0 AS c FROM events),
 u AS (SELECT 'extraction_failed' AS kind FROM s WHERE status = 'failed' UNION ALL SELECT 'low_confidence_kind' FROM s WHERE status = 'done' AND c < 0.6 UNION ALL SELECT 'ingest_skipped' FROM (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5)
 UNION ALL SELECT 'possible_duplicate' FROM opp WHERE status <> 'submitted' AND id % 11 = 0 UNION ALL SELECT 'orphan_update' FROM opp WHERE status <> 'submitted' AND id % 13 = 0) SELECT kind, count(*) AS n FROM u GROUP BY kind""")
def review_items(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    m = e.select(F.col("event_id").alias("message_id"), F.col("event_type").alias("subject"), turn("event_id", ["failed", "done", "done", "retrying"]).alias("status"), (F.col("event_id") % 10 / 10).alias("kind_confidence"))
    skips = e.filter("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("attempts")).withColumn("given_up", F.col("attempts") >= 5)
    flags = F.array_compact(F.array(F.when(F.col("id") % 11 == 0, "possible_duplicate"), F.when(F.col("id") % 13 == 0, "orphan_update")))
    o = opportunities(spark, sf_dir).withColumns({"archived": F.col("status") == "submitted", "flags": flags, "project_name": F.col("name")})
    return digest.review_items(m, skips, o).groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id % 20 AS source_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY 1), h AS (SELECT source_id, CASE WHEN source_id % 7 = 0 THEN 'paused' WHEN last IS NULL OR date_diff('second', last, TIMESTAMP '2024-01-30') > 3600 THEN 'down' WHEN date_diff('second', last, TIMESTAMP '2024-01-30') > 1800 THEN 'degraded' ELSE 'ok' END AS s0 FROM s)
 SELECT source_id, CASE WHEN s0 = 'ok' AND source_id % 3 = 0 THEN 'degraded' ELSE s0 END AS status, source_id % 3 = 0 AS stuck FROM h""")
def health_lines(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    s = e.groupBy((F.col("user_id") % 20).alias("source_id")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_success"))
    s = s.withColumns({"paused": F.col("source_id") % 7 == 0, "backfill_stuck": F.col("source_id") % 3 == 0, "backfill_error": F.lit("full")})
    d = digest.health_lines(s, F.lit("2024-01-30").cast("timestamp_ntz"))
    return d.select("source_id", "status", F.col("detail").contains("backfill stuck: full").alias("stuck"))


@query(f"{_ITEMS}, h AS (SELECT *, band IN ('likely_pass', 'pass') AS hidden FROM s WHERE section = 'new') SELECT band, count(*) AS n, count(*) FILTER (WHERE hidden) AS hidden FROM h GROUP BY band")
def bands_hidden(spark, sf_dir):
    d = digest.hide_below(_sections(spark, sf_dir).filter("section = 'new'"), "consider")
    return d.groupBy("band").agg(F.count("*").alias("n"), F.count_if("hidden").alias("hidden"))


@query(f"WITH {SCORED} SELECT id, id % 3 = 0 AND id % 2 <> 0 AS changed FROM banded")
def changes_cleared(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("changed", F.col("id") % 3 == 0)
    return digest.clear_changes(d, d.filter("id % 2 = 0").select("id")).select("id", "changed")


_SUBJECT = "CASE WHEN n = 0 AND d = 0 AND u = 0 THEN 'Bids · Sat Sep 1 · quiet morning' ELSE CASE WHEN k % 4 = 0 THEN '⚠︎ ' ELSE '' END || 'Bids · Sat Sep 1 · ' || n || ' new' || CASE WHEN b > 0 THEN ' (' || b || ' to bid)' ELSE '' END || ' · ' || d || ' due this week' || CASE WHEN u > 0 THEN ' · ' || u || ' need decision' ELSE '' END END"


@query(f"WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS n, c_custkey % 2 AS b, c_custkey % 5 AS d, c_custkey % 7 AS u FROM customer) SELECT k AS id, {_SUBJECT} AS subject FROM c")
def subject_lines(spark, sf_dir):
    (c,) = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    quiet = (k % 3 == 0) & (k % 5 == 0) & (k % 7 == 0)
    return c.select(k.alias("id"), digest.subject_line(now(), k % 3, k % 2, k % 5, k % 7, quiet, k % 4 == 0).alias("subject"))


@query(f"WITH {SCORED}, w AS (SELECT DISTINCT gc_id AS user_id, CASE WHEN gc_id % 2 = 0 THEN {NOW_SQL} - INTERVAL 1 DAY ELSE {NOW_SQL} END AS moved FROM banded) SELECT user_id, moved AS \"at\" FROM w")
def watermarks_moved(spark, sf_dir):
    users = opportunities(spark, sf_dir).select(F.col("gc_id").alias("user_id")).distinct()
    old = users.select("user_id", (now() - F.make_dt_interval(days=F.lit(1))).alias("at"))
    sent = users.filter("user_id % 2 <> 0").select("user_id", now().alias("sent_at"))
    return digest.move_watermarks(old, sent)


@query(f"""WITH {OPPORTUNITIES}, e AS (SELECT gc_id, id FROM opp) SELECT gc_id, count(*) AS events, true AS framed, true AS folded FROM e GROUP BY gc_id""")
def calendar_files(spark, sf_dir):
    none = F.lit(None).cast("timestamp_ntz")
    o = opportunities(spark, sf_dir).withColumns({"prebid_at": none, "rfi_deadline": none, "name": F.rpad(F.concat(F.col("name"), F.lit(", phase; two: ")), 120, "é")})
    e = decisions.calendar_events(o).join(o.select("id", "gc_id"), "id")
    ics = decisions.ics_calendars(e, "gc_id")
    lines = F.split("ics", "\r\n")
    return ics.select(
        "gc_id", F.size(F.filter(lines, lambda x: x == "BEGIN:VEVENT")).cast("long").alias("events"),
        (F.col("ics").startswith("BEGIN:VCALENDAR\r\n") & F.col("ics").endswith("\r\nEND:VCALENDAR\r\n")).alias("framed"), F.forall(lines, lambda x: F.octet_length(x) <= 75).alias("folded"),
    )
