"""Queries of the keyed store (what several commits, one of them repeated, leave) and of versions in force."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import undo
from sluice.operators.accounts import accounts_in_names
from sluice.operators.asof import as_of
from sluice.plans.registry import query
from sluice.sources import upsert
from sluice.sources.tables import load, new_path, written
from sluice.sources.upsert import Rows


def _commits(spark, sf_dir) -> str:
    """Even orders with their lines, then every third one anew, then the same epoch with other rows; returns the store's path."""
    orders, lines = load(spark, sf_dir, "orders", "lineitem")
    path = new_path(spark, "store")
    m = orders.select(F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_orderdate").alias("sent"))
    parts = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_quantity", "l_shipdate")

    def commit(number: int, of: str, label: str, add: float) -> None:
        upsert.upsert(spark, path, {
            "messages": Rows(m.filter(of).select("id", F.lit(label).alias("label"), (F.col("o_totalprice") + add).alias("total"), "sent"), ["id"], order="sent"),
            "parts": Rows(parts.filter(of).select("id", "line", (F.col("l_quantity") + add).alias("quantity"), "l_shipdate"), ["id", "line"], order="l_shipdate", insert=True),
        }, epoch=("orders", number), buckets=16)

    commit(0, "id % 2 = 0", "first", 0.0)
    commit(1, "id % 3 = 0", "second", 1.0)
    commit(1, "id % 5 = 0", "repeated", 2.0)
    return path


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'second' ELSE 'first' END AS label, round(max(o_totalprice) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, 2) AS total
 FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 GROUP BY o_orderkey""")
def messages_upserted(spark, sf_dir):
    return upsert.read(spark, _commits(spark, sf_dir), "messages").select("id", "label", F.round("total", 2).alias("total"))


@query("""SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS parts FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 = 0 GROUP BY 1""")
def children_upserted(spark, sf_dir):
    return upsert.read(spark, _commits(spark, sf_dir), "parts").groupBy("id").agg(F.count("*").alias("parts"))


@query("""SELECT DISTINCT user_id, date_trunc('day', ts) AS day, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS claimed_by FROM (
 SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END) AS k FROM events) WHERE k = 1""")
def sends_claimed(spark, sf_dir):
    """Two senders claim each user's digest of a day: the one that sees views and clicks first, then the one of all other events."""
    (events,) = load(spark, sf_dir, "events")
    path, day = new_path(spark, "ledger"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    seen = F.col("event_type").isin("view", "click")
    claims = [upsert.claim(spark, path, events.filter(of).select("user_id", day), ["user_id", "day"]).withColumn("claimed_by", F.lit(k)) for k, of in ((1, seen), (2, ~seen))]
    return claims[0].unionByName(claims[1])


@query("""WITH v AS (SELECT user_id, ts, max(event_id) AS profile FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2)
 SELECT e.event_id, v.profile FROM events e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def profiles_in_force(spark, sf_dir):
    """The profile that a user's last signup or purchase had activated when each event came."""
    (events,) = load(spark, sf_dir, "events")
    active = events.filter(F.col("event_type").isin("signup", "purchase")).select("user_id", "ts", F.col("event_id").alias("profile"))
    return as_of(events.select("event_id", "user_id", "ts"), active, ["user_id"], "ts", ["profile"]).select("event_id", "profile")


@query("""WITH s AS (SELECT event_type, ts, ts AS sent, max(event_id) AS digest FROM events WHERE event_id % 50 = 0 GROUP BY ALL)
 SELECT e.event_id, s.sent, s.digest FROM events e ASOF LEFT JOIN s ON e.event_type = s.event_type AND e.ts >= s.ts""")
def watermarks_in_force(spark, sf_dir):
    """The digest of its list that had gone out last when each event came; a list holds a fifth of all events."""
    (events,) = load(spark, sf_dir, "events")
    sends = events.filter("event_id % 50 = 0").select("event_type", "ts", F.col("ts").alias("sent"), F.col("event_id").alias("digest"))
    return as_of(events.select("event_id", "event_type", "ts"), sends, ["event_type"], "ts", ["sent", "digest"]).select("event_id", "sent", "digest")


_LINES = "SELECT DISTINCT l_orderkey AS o, l_linenumber AS line FROM lineitem"


@query(f"""WITH l AS ({_LINES}), b AS (SELECT o FROM l WHERE line = 1 AND o % 8 = 0)
 SELECT o * 10 + line AS item, CASE WHEN o % 8 = 0 AND o % 16 <> 0 AND o IN (SELECT o FROM b) THEN CASE WHEN line = 1 THEN o + 2 ELSE o + 1 END ELSE o END AS owner FROM l""")
def moves_undone(spark, sf_dir):
    """Every fourth order's lines are merged into the next order, of every eighth the first line is then split off; all merges and
    every second split are to be undone, and a merge whose line was split off since stays where the split does."""
    (lines,) = load(spark, sf_dir, "lineitem")
    o = F.col("l_orderkey")
    children = lines.select(F.lit("line").alias("kind"), (o * 10 + F.col("l_linenumber")).alias("item"), o.alias("owner")).distinct()
    orders = children.select(F.col("owner").alias("o")).distinct()
    merges = orders.filter("o % 4 = 0").select((F.col("o") * 2).alias("entry"), F.col("o").alias("victim"), (F.col("o") + 1).alias("survivor"))
    splits = orders.filter("o % 8 = 0").select((F.col("o") * 2 + 1).alias("entry"), F.lit("line").alias("kind"), (F.col("o") * 10 + 1).alias("item"), (F.col("o") + 2).alias("new"))
    first = undo.merge_moves(children, merges)
    merged = undo.apply_moves(children, first)
    moves = written(first.unionByName(undo.split_moves(merged, splits)), "moves")
    now = F.lit("2026-09-30").cast("timestamp")
    log = merges.select("entry").unionByName(splits.select("entry")).select("entry", F.col("entry").alias("seq"), now.alias("created_at"), F.lit(False).alias("undone"))
    snapshots = spark.createDataFrame([], "entry long, opp_id long, before string")
    asked = merges.select("entry").unionByName(splits.filter("floor(entry / 2) % 16 = 0").select("entry"))
    verdicts = undo.judged(log, moves, snapshots, asked, now)
    records = spark.createDataFrame([], "opp_id long, record string")
    home, _, _ = undo.undone(undo.apply_moves(merged, moves.filter("entry % 2 = 1")), records, log, moves, snapshots, verdicts)
    return home.select("item", "owner")


@query("SELECT c_custkey AS id, p_partkey AS account FROM customer JOIN part ON contains(lower(c_name), '00' || p_partkey)")
def accounts_in_owner_names(spark, sf_dir):
    """Every part's number behind two zeros, as a phrase, in the names of all customers."""
    customer, part = load(spark, sf_dir, "customer", "part")
    return accounts_in_names(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), part.select(F.col("p_partkey").alias("account"), F.concat(F.lit("00"), F.col("p_partkey").cast("string")).alias("phrase")))
