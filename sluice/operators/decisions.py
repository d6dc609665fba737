"""Decisions: the state machine, actions, snoozing, signed tokens, calendar events."""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from sluice.functions import constants as K
from sluice.functions.text import ics_escape, ics_fold


def allowed(now: Column, to: Column) -> Column:
    """Whether one status may follow another; staying is always allowed."""
    c = now == to
    for a, bs in K.TRANSITIONS.items():
        c = c | ((now == a) & to.isin(bs))
    return c


SLICE = 4096  # events of a key that one row holds


def status_fold(events: DataFrame, key: str, order: list[str], to: str, start: str = "new", slice_rows: int = SLICE) -> DataFrame:
    """The status of each key after its events in order: what isn't allowed leaves it as it is. Refusals are counted.

    A key's events are cut into slices in order. Each slice is folded from every status it may start with, and a key combines
    its slices' outcomes, so a key with very many events is never one row.
    """
    def step(s: Column, e: Column) -> Column:
        ok, same = allowed(s["status"], e), s["status"] == e
        return F.struct(F.when(ok, e).otherwise(s["status"]).alias("status"), (s["applied"] + F.when(ok & ~same, 1).otherwise(0)).alias("applied"), (s["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    zero = lambda status: F.struct(status.alias("status"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, to)) - 1
    cut = events.select(key, *order, F.col(to).alias("__to"), F.floor(place / slice_rows).alias("__slice"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, "__to"))), lambda r: r["__to"])
    starts = F.array(*map(F.lit, dict.fromkeys([start, *K.STATUSES])))
    slices = cut.groupBy(key, "__slice").agg(rows.alias("__rows")).withColumn("__ends", F.map_from_arrays(starts, F.transform(starts, lambda q: F.aggregate("__rows", zero(q), step))))

    def combine(s: Column, part: Column) -> Column:
        end = F.element_at(part["__ends"], s["status"])
        return F.struct(end["status"].alias("status"), (s["applied"] + end["applied"]).alias("applied"), (s["refused"] + end["refused"]).alias("refused"))

    parts = F.transform(F.array_sort(F.collect_list(F.struct("__slice", F.map_entries("__ends").alias("__e")))), lambda p: F.struct(F.map_from_entries(p["__e"]).alias("__ends")))
    return slices.groupBy(key).agg(F.aggregate(parts, zero(F.lit(start)), combine).alias("s")).select(key, "s.*")


def snooze_until(asked: Column, now: Column, due: Column, days: int = 3) -> Column:
    """Three days by default, not beyond two days before the due date, never before now."""
    until = F.coalesce(asked, now + F.make_dt_interval(days=F.lit(days)))
    return F.greatest(now, F.least(until, F.coalesce(due - F.make_dt_interval(days=F.lit(2)), until)))


def apply_actions(opps: DataFrame, actions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(opportunities after their actions, log of every action with before, after and whether it was applied).

    Actions (id, at, action, value): status actions obey the state machine, snooze is clamped, assign and lock_field set their
    columns, needs_info raises a flag. The actions of one opportunity are folded in order in one expression.
    """
    to_status = F.create_map(*[F.lit(x) for kv in K.ACTION_STATUS.items() for x in kv])
    rows = F.array_sort(F.collect_list(F.struct("at", "action", "value")))
    d = opps.join(actions.groupBy("id").agg(rows.alias("__acts")), "id", "left")
    entry = "struct<at:timestamp,action:string,before:string,after:string,applied:boolean>"
    start = F.struct(F.col("status").alias("status"), F.col("assignee").alias("assignee"), F.col("locked").alias("locked"), F.col("flags").alias("flags"), F.col("snooze_until").alias("snooze_until"), F.array().cast(f"array<{entry}>").alias("log"))

    def step(s: Column, a: Column) -> Column:
        to = F.try_element_at(to_status, a["action"])
        ok = F.when(to.isNotNull(), allowed(s["status"], to)).otherwise(a["action"].isin("assign", "lock_field", "needs_info"))
        after = F.when(ok & to.isNotNull(), to).otherwise(s["status"])
        until = F.when(ok & (a["action"] == "snooze"), snooze_until(a["value"].try_cast("timestamp"), now.cast("timestamp"), F.col("bid_due").cast("timestamp"))).otherwise(s["snooze_until"])
        log = F.struct(a["at"].cast("timestamp").alias("at"), a["action"].alias("action"), s["status"].alias("before"), after.alias("after"), F.coalesce(ok, F.lit(False)).alias("applied"))
        return F.struct(
            after.alias("status"), F.when(a["action"] == "assign", a["value"]).otherwise(s["assignee"]).alias("assignee"),
            F.when(a["action"] == "lock_field", F.array_union(s["locked"], F.array(a["value"]))).otherwise(s["locked"]).alias("locked"),
            F.when(a["action"] == "needs_info", F.array_union(s["flags"], F.array(F.lit("needs_info")))).otherwise(s["flags"]).alias("flags"),
            until.alias("snooze_until"), F.concat(s["log"], F.array(log)).alias("log"),
        )

    none = F.array().cast("array<struct<at:timestamp,action:string,value:string>>")
    d = d.withColumn("__s", F.aggregate(F.coalesce("__acts", none), start, step))
    changed = ("status", "assignee", "locked", "flags", "snooze_until")
    after = d.select(*[F.col(f"__s.{c}").alias(c) if c in changed else F.col(c) for c in opps.columns])
    return after, d.select("id", F.explode("__s.log").alias("e")).select("id", "e.*")


def signed(secret: bytes):
    """A column function: v1.payload.signature of a text."""

    @F.pandas_udf(StringType())
    def sign(payloads: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            body = base64.urlsafe_b64encode(p.encode()).decode().rstrip("=")
            mac = hmac.new(secret, f"v1.{body}".encode(), hashlib.sha256).digest()
            return f"v1.{body}.{base64.urlsafe_b64encode(mac).decode().rstrip('=')}"

        return payloads.map(one)

    return sign


def verified(secret: bytes):
    """A column function: whether a token's signature is right."""

    @F.pandas_udf(BooleanType())
    def check(tokens: pd.Series) -> pd.Series:
        def one(t: str) -> bool:
            parts = (t or "").split(".")
            if len(parts) != 3 or parts[0] != "v1":
                return False
            mac = base64.urlsafe_b64encode(hmac.new(secret, f"v1.{parts[1]}".encode(), hashlib.sha256).digest()).decode().rstrip("=")
            return hmac.compare_digest(mac, parts[2])

        return tokens.map(one)

    return check


def usable(tokens: DataFrame, used: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Tokens that aren't spent, over `days` old or more than five minutes ahead."""
    fresh = (F.col("issued_at") >= now - F.make_dt_interval(days=F.lit(days))) & (F.col("issued_at") <= now + F.make_dt_interval(mins=F.lit(5)))
    return tokens.filter(fresh).join(used.select("nonce"), "nonce", "left_anti")


def calendar_events(opps: DataFrame) -> DataFrame:
    """Up to three events an opportunity: due, prebid, rfi; cancelled where it is passed, lost, cancelled or archived."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("at")) for k, c in (("due", "bid_due"), ("prebid", "prebid_at"), ("rfi", "rfi_deadline"))])
    events = opps.withColumn("e", F.explode(kinds)).filter("e.at is not null")
    off = F.col("status").isin("passed", "lost", "cancelled", "archived")
    return events.select("id", "name", F.col("e.kind").alias("kind"), F.col("e.at").alias("at"), F.when(off, "CANCELLED").otherwise("CONFIRMED").alias("state"))


def feed(opps: DataFrame, now: Column, user: str | None = None, statuses: list[str] | None = None, days: int = 7) -> DataFrame:
    """What a calendar shows: the asked statuses, closed ones only while active within `days`; a person's feed has what is theirs
    and what is undecided and nobody's."""
    open_ = F.col("status").isin("bidding", "undecided", "submitted")
    shown = F.col("status").isin(statuses or K.FEED_STATUSES) & (open_ | (F.col("last_activity") >= now - F.make_dt_interval(days=F.lit(days))))
    if user is not None:
        shown = shown & ((F.col("assignee") == user) | (F.col("assignee").isNull() & (F.col("status") == "undecided")))
    return opps.filter(shown)


def ics_events(events: DataFrame) -> DataFrame:
    """A VEVENT text a row."""
    stamp = F.date_format("at", "yyyyMMdd'T'HHmmss'Z'")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("kind"), F.lit("-"), F.col("id").cast("string")), F.concat(F.lit("DTSTART:"), stamp), F.concat(F.lit("SUMMARY:"), ics_escape(F.col("name"))), F.concat(F.lit("STATUS:"), F.col("state")), F.lit("END:VEVENT")]
    return events.select("id", "kind", F.concat_ws("\r\n", *map(ics_fold, lines)).alias("vevent"))


def ics_calendars(events: DataFrame, key: str) -> DataFrame:
    """A whole calendar as text for each key: its events in order, inside the frame. A calendar is one feed's, some hundred events."""
    rows = ics_events(events).join(events.select("id", "kind", key), ["id", "kind"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "kind", "vevent"))), lambda e: e["vevent"]), "\r\n")
    frame = lambda x: F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//sluice//EN\r\nCALSCALE:GREGORIAN\r\nMETHOD:PUBLISH\r\n"), x, F.lit("\r\nEND:VCALENDAR\r\n"))
    return rows.groupBy(key).agg(frame(body).alias("ics"))
