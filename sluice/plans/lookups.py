"""Queries of lookups, candidates, the score store, the directory and plain filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import curation, decisions, digest, directory, extract, ingest, merge, resolve, store
from sluice.operators import evaluation as ev
from sluice.plans.catalog import _PAIRS, _pairs, _scored
from sluice.plans.registry import query
from sluice.plans.rules import turn, turn_sql
from sluice.plans.views import NOW_SQL, OPPORTUNITIES, SCORED, now, opportunities
from sluice.sources.tables import load, new_path, read_snapshot, write_blobs, write_snapshot

# ---------------------------------------------------------------- filters


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def tuple_in(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    asked = li.filter("l_returnflag = 'R' and l_quantity > 45").select("l_partkey", "l_suppkey").distinct()
    return li.join(asked, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey AS id FROM part WHERE p_name LIKE '%bolt%' OR p_name LIKE 'blue%'")
def names_like(spark, sf_dir):
    (p,) = load(spark, sf_dir, "part")
    return p.filter(F.col("p_name").contains("bolt") | F.col("p_name").startswith("blue")).select(F.col("p_partkey").alias("id"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3 GROUP BY ALL")
def json_paths(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.filter(k >= 3).groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


_USERS = "users AS (SELECT 'U' || s_suppkey || '@home.example' AS email FROM supplier)"
_MAIL = "m AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'u' || c_custkey || '@HOME.example' WHEN 1 THEN 'x@www.own.example' ELSE 'y@' || c_custkey || '.example' END AS sender FROM customer)"


@query(f"WITH {_USERS}, {_MAIL} SELECT id FROM m WHERE sender LIKE '%@www.own.example' OR lower(sender) IN (SELECT lower(email) FROM users)")
def internal_senders(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer", "supplier")
    k = F.col("c_custkey").cast("string")
    sender = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("u"), k, F.lit("@HOME.example"))).when(F.col("c_custkey") % 3 == 1, "x@www.own.example").otherwise(F.concat(F.lit("y@"), k, F.lit(".example")))
    users = s.select(F.concat(F.lit("U"), F.col("s_suppkey").cast("string"), F.lit("@home.example")).alias("email"))
    return directory.internal_senders(c.select(F.col("c_custkey").alias("message_id"), sender.alias("sender")), ["own.example"], users).select(F.col("message_id").alias("id"))


_STATES = ["failed", "retrying", "done", "done", "skipped"]


@query(f"WITH s AS (SELECT event_id, {turn_sql('event_id', _STATES)} AS status, event_id % 10 / 10.0 AS confidence, ts FROM events), q AS (SELECT event_id FROM s WHERE status IN ('failed', 'retrying') OR status = 'done' AND confidence < 0.6 ORDER BY ts DESC, event_id LIMIT 100) SELECT event_id FROM q")
def review_queue(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    d = e.select(F.col("event_id").alias("message_id"), turn("event_id", _STATES).alias("status"), (F.col("event_id") % 10 / 10).alias("kind_confidence"), F.col("ts").alias("received_at"))
    return extract.review_queue(d).select(F.col("message_id").alias("event_id"))


@query(f"WITH s AS (SELECT user_id AS message_id, {turn_sql('max(event_id)', _STATES)} AS status, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS attempts FROM events GROUP BY user_id) SELECT message_id, 'retry:' || message_id || ':' || strftime({NOW_SQL}, '%Y%m%d%H') AS key FROM s WHERE status = 'retrying' AND attempts < 24")
def retry_sweep(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    d = e.groupBy(F.col("user_id").alias("message_id")).agg(F.max("event_id").alias("last"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 50)).alias("attempts")).withColumn("status", turn("last", _STATES))
    return extract.retry_sweep(d, now()).select("message_id", "key")


# ---------------------------------------------------------------- lookups


@query("SELECT count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS extracted, count(*) FILTER (WHERE l_linenumber % 3 = 0 AND (l_returnflag = 'R' OR l_quantity > 40)) AS failed FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def attachment_counts(spark, sf_dir):
    o, li = load(spark, sf_dir, "orders", "lineitem")
    m = o.select(F.col("o_orderkey").alias("message_id"), F.col("o_orderdate").alias("created_at"))
    a = li.select(F.col("l_orderkey").alias("message_id"), F.when(F.col("l_linenumber") % 3 != 0, "text").alias("text"), F.when(F.col("l_returnflag") == "R", "broken").alias("error"), (F.col("l_quantity") > 40).alias("large"), F.lit(False).alias("oversize"))
    return store.attachment_counts(m, a, F.lit("1998-01-01").cast("timestamp_ntz"))


_STATS = f"s AS (SELECT gc_id, count(*) FILTER (WHERE status IN ('submitted', 'won', 'lost')) AS submitted, count(*) FILTER (WHERE status = 'won') AS won FROM opp WHERE first_seen >= {NOW_SQL} - INTERVAL 365 DAY GROUP BY gc_id)"


@query(f"""WITH {OPPORTUNITIES}, {_STATS}, g AS (SELECT c_custkey AS id, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'C' END AS tier FROM customer WHERE c_nationkey < 20)
 SELECT opp.id, coalesce(g.tier, 'unknown') AS tier, coalesce(s.submitted, 0) AS submitted_12m, round(CASE WHEN s.submitted >= 5 THEN s.won / s.submitted END, 6) AS hit_rate_12m,
 CASE WHEN g.id IS NOT NULL THEN g.c_mktsegment = 'BUILDING' ELSE opp.id % 4 = 0 END AS owner_direct FROM opp LEFT JOIN g ON g.id = opp.gc_id LEFT JOIN s ON s.gc_id = opp.gc_id""")
def organisation_lookup(spark, sf_dir):
    (c,) = load(spark, sf_dir, "customer")
    o = opportunities(spark, sf_dir)
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "owner").otherwise("gc")
    g = c.filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("C").alias("tier"), kind.alias("kind"))
    named = o.select("id", "gc_id", F.when(F.col("id") % 2 == 0, "Owner").alias("owner_name"), F.when(F.col("id") % 4 != 0, "Builder").alias("gc_name"))
    d = store.with_organisation(named, g, directory.gc_stats(o, now()))
    return d.select("id", "tier", F.col("submitted_12m").cast("long").alias("submitted_12m"), F.round("hit_rate_12m", 6).alias("hit_rate_12m"), "owner_direct")


_STORE = f"st AS (SELECT event_id AS id, user_id AS opp_id, CAST(round(value) AS INTEGER) % 101 AS score, ts AS computed_at, event_type FROM events WHERE value IS NOT NULL AND value >= 0), sb AS (SELECT *, CASE WHEN score >= 70 THEN 'bid' WHEN score >= 45 THEN 'consider' WHEN score >= 20 THEN 'likely_pass' ELSE 'pass' END AS band FROM st), l AS (SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY opp_id ORDER BY computed_at DESC, id DESC) = 1)"


def _store(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    score = (F.round("value").cast("int") % 101).alias("score")
    d = e.filter("value is not null and value >= 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("opp_id"), score, F.col("ts").alias("computed_at"), F.col("event_type").alias("profile"))
    return d.withColumn("band", F.when(F.col("score") >= 70, "bid").when(F.col("score") >= 45, "consider").when(F.col("score") >= 20, "likely_pass").otherwise("pass"))


@query(f"WITH {_STORE} SELECT opp_id, id, score, band FROM l")
def latest_scores(spark, sf_dir):
    return store.latest_scores(_store(spark, sf_dir)).select("opp_id", "id", "score", "band")


@query(f"WITH {OPPORTUNITIES}, {_STORE} SELECT opp.id, coalesce(l.score, 0) AS score, coalesce(l.band, 'pass') AS band FROM opp LEFT JOIN l ON l.opp_id = opp.id")
def items_with_scores(spark, sf_dir):
    return store.with_latest_score(opportunities(spark, sf_dir).select("id"), _store(spark, sf_dir)).select("id", "score", "band")


@query(f"WITH {OPPORTUNITIES}, {_STORE}, p AS (SELECT id FROM opp ORDER BY first_seen DESC, id LIMIT 200) SELECT p.id, coalesce(l.score, 0) AS score FROM p LEFT JOIN l ON l.opp_id = p.id WHERE coalesce(l.band, 'pass') = 'pass'")
def listed_by_band(spark, sf_dir):
    o = opportunities(spark, sf_dir).select("id", F.col("first_seen").alias("last_activity"))
    return store.listed(o, _store(spark, sf_dir), "pass", 200).select("id", "score")


@query(f"""WITH {SCORED} SELECT id, sha256('{{"bid_type":"' || bid_type || '","id":' || id || ',"project_type":"' || project_type || '","score":' || score || ',"tier":"' || tier || '"}}') AS inputs_hash, sha256('{{"band":"' || band || '","score":' || score || '}}') AS stable FROM banded""")
def score_hashes(spark, sf_dir):
    d = _scored(spark, sf_dir).select("id", "bid_type", "project_type", "tier", "score", "band").withColumn("inputs_hash", store.inputs_hash("id", "bid_type", "project_type", "tier", "score"))
    return d.select("id", "inputs_hash", store.stable_hash(["band", "score", "inputs_hash"]).alias("stable"))


@query(f"WITH {_STORE}, n AS (SELECT user_id AS opp_id, CAST(max(event_id) % 101 AS INTEGER) AS score FROM events GROUP BY 1), b AS (SELECT *, CASE WHEN score >= 70 THEN 'bid' WHEN score >= 45 THEN 'consider' WHEN score >= 20 THEN 'likely_pass' ELSE 'pass' END AS band FROM n) SELECT b.opp_id, b.score, CASE WHEN l.band <> b.band THEN 'profile 2' END AS note FROM b LEFT JOIN l USING (opp_id) WHERE l.score IS NULL OR l.score <> b.score OR l.event_type <> 'view'")
def scores_written(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    new = e.groupBy(F.col("user_id").alias("opp_id")).agg((F.max("event_id") % 101).cast("int").alias("score"))
    new = new.withColumns({"band": F.when(F.col("score") >= 70, "bid").when(F.col("score") >= 45, "consider").when(F.col("score") >= 20, "likely_pass").otherwise("pass"), "profile": F.lit("view")})
    hashed = lambda d: d.withColumn("stable", store.stable_hash(["score", "band"]))
    return store.rescored(hashed(_store(spark, sf_dir)), hashed(new), "profile 2").select("opp_id", "score", "note")


@query(f"WITH {_STORE}, lab AS (SELECT doc_id AS id, quality = 1 AS actual FROM labels), m AS (SELECT lab.id, actual, score >= 45 AS p FROM lab JOIN (SELECT DISTINCT o_orderkey FROM orders) o ON o_orderkey = lab.id JOIN l ON l.opp_id = lab.id) SELECT (SELECT count(*) FROM m WHERE p AND actual) AS tp, (SELECT count(*) FROM m WHERE p AND NOT actual) AS fp, (SELECT count(*) FROM m WHERE NOT p AND actual) AS fn, (SELECT count(*) FROM lab WHERE id NOT IN (SELECT opp_id FROM l)) AS unmatched")
def labels_matched(spark, sf_dir):
    (lab,) = load(spark, sf_dir, "labels")
    labels = lab.select(F.col("doc_id").alias("opportunity_id"), F.when(F.col("quality") == 1, " Yes").otherwise("no").alias("label"))
    got, unmatched = store.labelled(labels, opportunities(spark, sf_dir).select("id"), _store(spark, sf_dir))
    c = ev.confusion(got.withColumn("p", F.col("score") >= 45), "p", "actual", [])
    return c.select("tp", "fp", "fn").withColumn("unmatched", unmatched.agg(F.count("*").alias("n")).scalar())


@query(f"WITH {OPPORTUNITIES}, g AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'C' END AS tier FROM customer) SELECT opp.id FROM opp JOIN g ON g.id = opp.gc_id WHERE g.id % 5 = 0 AND g.tier <> 'A' AND opp.status <> 'submitted'")
def tier_rescored(spark, sf_dir):
    (c,) = load(spark, sf_dir, "customer")
    g = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("C").alias("tier"))
    changes = g.filter("id % 5 = 0").select("id", F.lit("A").alias("tier"))
    _, again = store.set_tier(g, changes, opportunities(spark, sf_dir).withColumn("archived", F.col("status") == "submitted"))
    return again.select("id")


# ---------------------------------------------------------------- the directory

@query("""WITH m AS (SELECT c_custkey, c_custkey % 5 AS t, c_custkey % 25 AS k FROM customer)
 SELECT c_custkey AS message_id, CASE WHEN t < 3 THEN k END AS gc_id, CASE t WHEN 0 THEN 0.98 WHEN 1 THEN 0.95 WHEN 2 THEN 1.0 END AS confidence, CASE t WHEN 0 THEN 'domain' WHEN 1 THEN 'alias' WHEN 2 THEN 'fuzzy' ELSE 'none' END AS method FROM m""")
def directory_resolved(spark, sf_dir):
    """Domain before alias before likeness: names with other endings are alike in their core; platforms and free mail say nothing."""
    c, n = load(spark, sf_dir, "customer", "nation")
    k, t = F.col("c_custkey") % 25, F.col("c_custkey") % 5
    d = c.join(n, k == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("message_id"),
        F.when(t == 0, F.concat(F.lit("bids@www.gc"), k.cast("string"), F.lit(".com"))).when(t == 4, "x@gmail.com").when(t == 3, "x@mail.procore.com").otherwise("x@other.org").alias("sender"),
        F.when(t == 1, F.concat(F.lit("the  "), F.col("n_name"), F.lit(", works!"))).when(t == 2, F.concat(F.col("n_name"), F.lit(" Builders, Inc."))).when(t == 3, F.lit("zqxj kwvp")).alias("gc_name"),
    )
    records = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    domains = records.select(F.concat(F.lit("gc"), F.col("id").cast("string"), F.lit(".com")).alias("domain"), F.col("id").alias("gc_id"))
    aliases = records.select(F.concat(F.lit("THE "), F.col("name"), F.lit(" WORKS")).alias("alias"), F.col("id").alias("gc_id"))
    return directory.resolve(d, records, domains, aliases).select("message_id", "gc_id", "confidence", "method")


# ---------------------------------------------------------------- candidates

_CANDIDATES = f"""WITH {OPPORTUNITIES}, h AS (SELECT DISTINCT a.id AS message_id, b.id AS opp_id FROM opp a JOIN opp b ON a.id // 4 = b.id // 4),
 n AS (SELECT DISTINCT a.id AS message_id, b.id AS opp_id, b.first_seen FROM opp a JOIN opp b ON (a.gc_id = b.gc_id) AND b.status <> 'submitted' UNION SELECT a.id, b.id, b.first_seen FROM opp a JOIN opp b ON a.id // 6 = b.id // 6 AND b.status <> 'submitted'),
 r AS (SELECT message_id, opp_id, row_number() OVER (PARTITION BY message_id ORDER BY first_seen DESC, opp_id) AS k FROM n QUALIFY k <= 5),
 u AS (SELECT message_id, opp_id, true AS hard, 0 AS k FROM h UNION ALL SELECT message_id, opp_id, false, k FROM r),
 c AS (SELECT message_id, opp_id, bool_or(hard) AS hard, min(k) AS k FROM u GROUP BY 1, 2)"""


def _candidates(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    key = F.struct(F.lit("thread").alias("kind"), F.floor(F.col("id") / 4).cast("string").alias("value"))
    number = F.floor(F.col("id") / 6).alias("project_number")
    incoming = o.select(F.col("id").alias("message_id"), F.array(key).alias("keys"), "gc_id", number)
    opps = o.select("id", (F.col("status") == "submitted").alias("archived"), F.col("first_seen").alias("last_activity"), "gc_id", number)
    keys = o.select(F.col("id").alias("opp_id"), key.alias("k")).select("opp_id", "k.*")
    return resolve.candidate_ids(incoming, opps, keys, ["gc_id", "project_number"], 5), opps, keys


@query(f"{_CANDIDATES} SELECT message_id, opp_id, hard, row_number() OVER (PARTITION BY message_id ORDER BY k, opp_id) AS position FROM c")
def message_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[0]


@query(f"{_CANDIDATES} SELECT message_id, opp_id, opp.gc_id, CAST(opp_id // 4 AS VARCHAR) AS threads, 0 AS platforms FROM c JOIN opp ON opp.id = opp_id")
def candidates_hydrated(spark, sf_dir):
    found, opps, keys = _candidates(spark, sf_dir)
    d = resolve.hydrate(found, opps, keys)
    return d.select("message_id", "opp_id", "gc_id", F.array_join("thread_ids", ",").alias("threads"), F.size("platform_ids").alias("platforms"))


@query(f"{_PAIRS}, b AS (SELECT c_id AS id, i_id AS other, score FROM e WHERE score >= 0.6 UNION ALL SELECT i_id, c_id, score FROM e WHERE score >= 0.6) SELECT id, other, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS position FROM b QUALIFY position <= 10")
def possible_duplicates(spark, sf_dir):
    return resolve.possible_duplicates(_pairs(spark, sf_dir))


@query(f"{_PAIRS} SELECT i_id, arg_min(c_id, (-score, apart, -epoch_us(first_seen), c_id)) AS c_id FROM (SELECT e.*, r.apart, c.first_seen FROM e JOIN r USING (c_id, i_id) JOIN opp c ON c.id = e.c_id) GROUP BY i_id")
def best_candidates(spark, sf_dir):
    return resolve.best_candidate(_pairs(spark, sf_dir)).select("i_id", "c_id")


@query("SELECT o_orderkey AS opp_id, o_custkey AS value FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def keys_pruned(spark, sf_dir):
    o, c = load(spark, sf_dir, "orders", "customer")
    wanted = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("opp_id"), F.col("o_custkey").alias("value"))
    return wanted.join(c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("value")), "value", "left_anti").select("opp_id", "value")


@query("WITH s AS (SELECT l_orderkey AS opp_id, l_linenumber AS message_id, min(l_quantity) AS score FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), a AS (SELECT l_orderkey AS opp_id, l_linenumber AS message_id, -1.0 AS score FROM lineitem GROUP BY ALL) SELECT opp_id, message_id, coalesce(s.score, a.score) AS score FROM a LEFT JOIN s USING (opp_id, message_id)")
def sources_attached(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    d = li.select(F.col("l_orderkey").alias("opp_id"), F.col("l_linenumber").alias("message_id"), F.col("l_quantity").alias("score"))
    have = d.filter("message_id <= 2").groupBy("opp_id", "message_id").agg(F.min("score").alias("score"))
    return resolve.attach_sources(have, d.withColumn("score", F.lit(-1.0)))


@query("SELECT l_orderkey AS opp_id, count(DISTINCT l_partkey) + 1 AS keys FROM lineitem GROUP BY 1")
def keys_remembered(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    have = li.select(F.col("l_orderkey").alias("opp_id"), F.lit("platform").alias("kind"), F.lit("p").alias("value")).distinct()
    keys = F.array(F.struct(F.lit("thread").alias("kind"), F.col("l_partkey").cast("string").alias("value")), F.struct(F.lit("thread").alias("kind"), F.lit("").alias("value")))
    return resolve.remember_keys(have, li.select(F.col("l_orderkey").alias("opp_id"), keys.alias("keys"))).groupBy("opp_id").agg(F.count("*").alias("keys"))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN status = 'submitted' THEN CASE WHEN id % 3 = 0 THEN 'undecided' ELSE 'archived' END ELSE status END AS status, status = 'submitted' AND id % 3 <> 0 AS archived, status = 'submitted' AND id % 3 = 0 AS reactivated FROM opp")
def opportunities_reactivated(spark, sf_dir):
    o = opportunities(spark, sf_dir).withColumn("archived", F.col("status") == "submitted").withColumn("status", F.when(F.col("archived"), "archived").otherwise(F.col("status")))
    d = resolve.reactivated(o, o.filter("id % 3 = 0").select(F.col("id").alias("opp_id")))
    return d.select("id", "status", "archived", F.array_contains("flags", "reactivated").alias("reactivated"))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN id % 2 = 0 THEN first_seen END AS due_as_of, 'gc' || gc_id || '.com' AS gc_domain, 'mail' AS channels FROM opp")
def canonical_records(spark, sf_dir):
    none = F.lit(None).cast("timestamp_ntz")
    o = opportunities(spark, sf_dir).withColumns({"bid_due": F.when(F.col("id") % 2 == 0, F.col("bid_due")), "rfi_deadline": none, "intent_due": none, "delivery_channel": F.lit("mail"), "gc_domain": F.concat(F.lit("x@WWW.gc"), F.col("gc_id").cast("string"), F.lit(".com"))})
    return resolve.canonical(o, "first_seen").select("id", F.col("bid_due_as_of").alias("due_as_of"), "gc_domain", F.array_join("delivery_channels", ",").alias("channels"))


# ---------------------------------------------------------------- small aggregates


@query("SELECT l_orderkey AS id, 'Addendum ' || l_linenumber AS label, count(DISTINCT l_partkey) AS copies FROM lineitem GROUP BY ALL")
def addendum_copies(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    d = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Addendum "), F.col("l_linenumber").cast("string")).alias("label"), "l_partkey")
    return merge.addenda(d, "id", "label", "l_partkey")


@query("SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list(l_returnflag) || list(l_linestatus))), ',') AS scope FROM lineitem GROUP BY 1")
def scope_unions(spark, sf_dir):
    (li,) = load(spark, sf_dir, "lineitem")
    return merge.union_arrays(li.select(F.col("l_orderkey").alias("id"), F.array("l_returnflag", "l_linestatus").alias("scope")), "id", "scope").select("id", F.array_join("scope", ",").alias("scope"))


@query("SELECT role, round(sum(length(text)) / 1e6 * 3.0 + count(*) / 1e6 * 15.0, 9) AS cost FROM conversations GROUP BY role")
def model_costs(spark, sf_dir):
    (c,) = load(spark, sf_dir, "conversations")
    n = c.groupBy("role").agg(F.sum(F.length("text")).alias("i"), F.count("*").alias("o"))
    return n.select("role", F.round(ev.llm_cost(F.col("i"), F.col("o"), 3.0, 15.0), 9).alias("cost"))


@query(f"WITH {OPPORTUNITIES} SELECT id, id % 2 = 0 AND 3 + id % 9 > 7 OR id % 3 = 0 AND id % 10 / 10.0 > 0.5 AS material, CASE WHEN id % 7 = 0 THEN true ELSE false END AS breaks FROM opp")
def material_changes(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    moved = F.col("bid_due") - F.make_dt_interval(days=F.when(F.col("id") % 2 == 0, 3 + F.col("id") % 9).otherwise(0).cast("int"))
    until = F.col("bid_due") + F.make_dt_interval(hours=F.when(F.col("id") % 7 == 0, 0).otherwise(-1))
    return o.select("id", merge.material(F.col("bid_due"), moved, F.when(F.col("id") % 3 == 0, F.col("id") % 10 / 10)).alias("material"), merge.breaks_snooze(F.col("bid_due"), F.when(F.col("id") % 5 != 6, until)).alias("breaks"))


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN status = 'bidding' AND bid_due <= {NOW_SQL} THEN 'undecided' WHEN status = 'bidding' THEN 'snoozed' ELSE status END AS status, CASE WHEN status = 'bidding' AND bid_due <= {NOW_SQL} THEN 'snooze ended' END AS note FROM opp")
def snoozes_ended(spark, sf_dir):
    o = opportunities(spark, sf_dir).withColumns({"status": F.when(F.col("status") == "bidding", "snoozed").otherwise(F.col("status")), "snooze_until": F.col("bid_due")})
    return merge.unsnooze(o, now()).select("id", "status", "note")


@query("SELECT event_id, CASE WHEN event_type = 'error' AND ts < TIMESTAMP '2024-01-30 00:00:00' THEN 'abandoned' ELSE event_type END AS state FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 20 DAY")
def polls_closed(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    at = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    d = ingest.close_abandoned(e.select("event_id", "ts", F.col("event_type").alias("state")), "state", "error", "ts", at, minutes=720)
    return ingest.prune(d, "ts", at, 20).select("event_id", "state")


@query("WITH b AS (SELECT user_id % 20 AS source_id, event_id // 50 AS batch, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1, 2), o AS (SELECT source_id, count(*) AS batches, sum(errors)::BIGINT AS errors, arg_max(n < 3 AND errors = 0, batch) AS done, max(batch) AS last FROM b GROUP BY 1) SELECT source_id, batches, CASE WHEN done THEN 'done' WHEN errors >= 20 THEN 'stuck' ELSE 'running' END AS state FROM o")
def backfill_states(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    d = e.groupBy((F.col("user_id") % 20).alias("source_id"), F.floor(F.col("event_id") / 50).alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return ingest.backfill(d, "source_id", "batch", "n", "errors", full=3).select("source_id", "batches", "state")


# ---------------------------------------------------------------- decisions


@query(f"WITH {OPPORTUNITIES}, f AS (SELECT id, gc_id, CASE WHEN id % 5 = 0 THEN 'passed' ELSE status END AS status, first_seen FROM opp) SELECT id FROM f WHERE status IN ('bidding', 'undecided', 'submitted', 'passed', 'lost', 'cancelled') AND (status IN ('bidding', 'undecided', 'submitted') OR first_seen >= {NOW_SQL} - INTERVAL 40 DAY) AND (gc_id % 3 = 0 OR gc_id % 3 = 1 AND status = 'undecided')")
def feed_items(spark, sf_dir):
    o = opportunities(spark, sf_dir).withColumns({"status": F.when(F.col("id") % 5 == 0, "passed").otherwise(F.col("status")), "last_activity": F.col("first_seen"), "assignee": F.when(F.col("gc_id") % 3 == 0, "me").when(F.col("gc_id") % 3 == 2, "you")})
    return decisions.feed(o, now(), user="me", days=40).select("id")


@query("SELECT event_id, event_type <> 'error' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND event_id % 4 <> 0 AS usable FROM events")
def action_tokens(spark, sf_dir):
    """Tokens signed and checked; those of errors are tampered with, old ones and spent ones can't be used."""
    (e,) = load(spark, sf_dir, "events")
    secret = b"secret of the tests"
    token = decisions.signed(secret)(F.concat_ws("|", F.col("event_id").cast("string"), F.lit("bid")))
    d = e.select("event_id", F.col("ts").alias("issued_at"), F.col("event_id").alias("nonce"), F.when(F.col("event_type") == "error", F.concat(token, F.lit("x"))).otherwise(token).alias("token"))
    good = decisions.usable(d.filter(decisions.verified(secret)("token")), d.filter("event_id % 4 = 0").select("nonce"), F.lit("2024-01-31").cast("timestamp_ntz"))
    return d.select("event_id").join(good.select("event_id", F.lit(True).alias("ok")), "event_id", "left").select("event_id", F.coalesce("ok", F.lit(False)).alias("usable"))


_DUE = f"WITH {SCORED}"


@query(f"{_DUE} SELECT status, id, row_number() OVER (PARTITION BY status ORDER BY d NULLS LAST, score DESC, id) AS position FROM (SELECT *, CASE WHEN id % 7 <> 0 THEN bid_due END AS d FROM banded)")
def due_sorted(spark, sf_dir):
    d = _scored(spark, sf_dir).withColumn("bid_due", F.when(F.col("id") % 7 != 0, F.col("bid_due")))
    return digest.ordered(d, ["status"]).select("status", "id", "position")


@query(f"WITH {OPPORTUNITIES} SELECT id, CASE WHEN v = u THEN 'same' WHEN sid IS NULL THEN 'missing' WHEN s.status <> o.status AND s.status IN ('bidding', 'submitted') AND o.status IN ('bidding', 'submitted') THEN 'decided' END AS refusal FROM (SELECT id, id AS v, CASE WHEN id % 5 = 0 THEN id ELSE id + 1 END AS u, status FROM opp) o LEFT JOIN (SELECT id AS sid, status FROM opp) s ON sid = u")
def merge_refusals(spark, sf_dir):
    o = opportunities(spark, sf_dir).select("id", "status")
    pairs = o.select(F.col("id").alias("victim"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.col("id") + 1).alias("survivor"))
    return curation.refusals(pairs, o).select(F.col("victim").alias("id"), "refusal")


@query("SELECT l_orderkey AS id, count(*) AS rows FROM (SELECT CASE WHEN l_orderkey % 4 = 1 AND l_orderkey - 1 IN (SELECT o_orderkey FROM orders) AND l_linenumber > 1 THEN l_orderkey - 1 ELSE l_orderkey END AS l_orderkey FROM lineitem) GROUP BY 1")
def merges_undone(spark, sf_dir):
    """Rows of every fourth opportunity go to the one before it; then the moves of first lines are undone."""
    li, o = load(spark, sf_dir, "lineitem", "orders")
    rows = li.select(F.col("l_orderkey").alias("opp_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("row"), "l_linenumber")
    alias = rows.filter("opp_id % 4 = 1").select(F.col("opp_id").alias("id"), (F.col("opp_id") - 1).alias("survivor")).distinct().join(o.select(F.col("o_orderkey").alias("survivor")), "survivor")
    moved = curation.apply_aliases(rows, alias, "opp_id")
    log = rows.filter("opp_id % 4 = 1 and l_linenumber = 1").select("row", F.col("opp_id").alias("old")).distinct()
    return curation.undo(moved, log, "opp_id", "row").groupBy(F.col("opp_id").alias("id")).agg(F.count("*").alias("rows"))


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 AND ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY")
def merges_undoable(spark, sf_dir):
    (e,) = load(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("id"), (F.col("event_id") % 3 == 0).alias("undone"), F.col("ts").alias("created_at"))
    return curation.undoable(log, F.lit("2024-02-15").cast("timestamp_ntz")).select("id")



# ---------------------------------------------------------------- files that Spark writes from the tables and reads again


@query("SELECT c_name AS canonical_name, 'gc' AS kind, 'gc' || c_custkey || '.com,www.gc' || c_custkey || '.org' AS domains, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE '' END AS aliases FROM customer")
def seed_files(spark, sf_dir):
    (c,) = load(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    d = c.select(F.col("c_name").alias("canonical_name"), F.lit("gc").alias("kind"), F.concat(F.lit("gc"), k, F.lit(".com; www.gc"), k, F.lit(".org;")).alias("domains"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("aliases"))
    path = new_path(spark, "seed")
    d.write.csv(path, header=True)
    return directory.read_seed(spark, path).select("canonical_name", "kind", F.array_join("domains", ",").alias("domains"), F.array_join("aliases", ",").alias("aliases"))


@query("SELECT quality = 1 AS positive, count(*) AS n FROM labels GROUP BY 1")
def label_files(spark, sf_dir):
    (lab,) = load(spark, sf_dir, "labels")
    path = new_path(spark, "labels")
    lab.select(F.col("doc_id").cast("string").alias("opportunity_id"), F.when(F.col("quality") == 1, "TRUE").otherwise("no").alias("label")).write.csv(path, header=True)
    return ev.read_labels(spark, path).groupBy(ev.truth(F.col("label")).alias("positive")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS blobs, sum(octet_length(encode(text)))::BIGINT AS bytes FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)")
def blobs_written_once(spark, sf_dir):
    """All documents are written as blobs, and every second one again: each content is there once."""
    (d,) = load(spark, sf_dir, "documents")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    blobs = d.select("doc_id", F.sha2(data, 256).alias("sha256"), data.alias("data"))
    path = new_path(spark, "blobs")
    write_blobs(blobs.select("sha256", "data"), path)
    write_blobs(blobs.filter("doc_id % 2 = 0").select("sha256", "data"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("blobs"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))


@query("SELECT version, count(*) AS n, sum(o_totalprice > 100000)::BIGINT AS large FROM (SELECT 1 AS version, * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 2, * FROM orders) GROUP BY 1")
def snapshot_versions(spark, sf_dir):
    (o,) = load(spark, sf_dir, "orders")
    path = new_path(spark, "orders")
    write_snapshot(o.filter("o_orderkey % 2 = 0"), path, 1)
    write_snapshot(o, path, 2)
    of = lambda d, v: d.agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100_000).alias("large"))
    return of(read_snapshot(spark, path, 1), 1).unionByName(of(read_snapshot(spark, path), 2))


@query("""WITH d AS (SELECT doc_id AS message_id, CASE WHEN length(text) <= 20000 THEN text ELSE substr(text, 1, 10000) || chr(10) || '[...]' || chr(10) || right(text, 10000) END AS body, source FROM documents)
 SELECT message_id, '<message>' || chr(10) || '<from>a@b.c</from>' || chr(10) || '<subject>' || source || '</subject>' || chr(10) || '<body>' || chr(10) || body || chr(10) || '</body>' || chr(10)
 || CASE WHEN message_id % 2 = 0 THEN '<links>' || chr(10) || array_to_string(list_transform(range(1, 51), lambda i: 'http://x/' || i), chr(10)) || chr(10) || '</links>' || chr(10) ELSE '' END
 || CASE WHEN message_id % 3 = 0 THEN '<attachment name="scope &lt;1&gt; &amp; &quot;2&quot;.txt">' || chr(10) || source || chr(10) || '</attachment>' || chr(10) ELSE '' END || '</message>' AS prompt FROM d""")
def prompts_built(spark, sf_dir):
    (d,) = load(spark, sf_dir, "documents")
    links = F.when(F.col("doc_id") % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("http://x/"), i.cast("string"))))
    m = d.select(F.col("doc_id").alias("message_id"), F.lit("a@b.c").alias("sender"), F.col("source").alias("subject"), F.col("text").alias("body"), links.alias("links"))
    files = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("message_id"), F.lit('scope <1> & "2".txt').alias("filename"), F.lit(1).alias("position"), F.col("source").alias("text"))
    empty = files.withColumns({"text": F.lit(""), "filename": F.lit("itb.txt")})
    return extract.prompt(extract.assemble(m, files.unionByName(empty)))
