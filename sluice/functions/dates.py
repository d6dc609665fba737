"""Dates and times: the four grammars of extracted dates, weeks, spans of days, display."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_ZONE = "America/New_York"
ZONES = sorted(zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"})
WEEKDAYS = {d: i for i, d in enumerate(["mon", "tue", "wed", "thu", "fri", "sat", "sun"])}
MICROS_PER_DAY = 86_400_000_000


def zone_or_home(zone: Column) -> Column:
    """The zone if there is one of that name, else the home zone."""
    return F.when(zone.isin(ZONES), zone).otherwise(HOME_ZONE)


def resolve_weekday(name: Column, anchor: Column) -> Column:
    """The first such weekday on the anchor's date or after it."""
    target = F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])
    return F.date_add(anchor, F.pmod(F.try_element_at(target, F.substring(F.lower(name), 1, 3)) - F.weekday(anchor), F.lit(7)).cast("int"))


def parse_local(value: Column, zone: Column, anchor: Column) -> Column:
    """struct(ts, time_known) of weekday:fri@12:00, M-D[THH:MM] or M/D, an ISO date, or an ISO datetime.

    A date without a year takes the anchor's, or the next where it would lie more than two days back. Impossible dates are null.
    """
    zone = zone_or_home(zone)
    clock = F.regexp_extract(value, r"[T@ ]([0-9]{1,2}:[0-9]{2})", 1)
    hour, minute = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("int")
    local = F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(anchor, "UTC"), HOME_ZONE))
    at = lambda y, m, d: F.try_make_timestamp(y, m, d, F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)), F.lit(0), zone)
    weekday = resolve_weekday(F.regexp_extract(value, r"^weekday:([A-Za-z]+)", 1), local)
    month, day = F.regexp_extract(value, r"^(\d{1,2})[-/](\d{1,2})(?:\D|$)", 1).try_cast("int"), F.regexp_extract(value, r"^(\d{1,2})[-/](\d{1,2})(?:\D|$)", 2).try_cast("int")
    this_year = at(F.year(local), month, day)
    rolled = F.when(this_year < F.date_sub(local, 2), at(F.year(local) + 1, month, day)).otherwise(this_year)
    iso = [F.regexp_extract(value, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int") for i in (1, 2, 3)]
    offset = value.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")
    ts = (
        F.when(value.startswith("weekday:"), at(F.year(weekday), F.month(weekday), F.dayofmonth(weekday)))
        .when(month.isNotNull(), rolled).when(offset, value.try_cast("timestamp")).when(iso[0].isNotNull(), at(*iso))
    )
    return F.struct(ts.alias("ts"), (clock != "").alias("time_known"))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / float(MICROS_PER_DAY)


def time_known(ts: Column, parsed: Column, claimed: Column) -> Column:
    """Whether a time of day is known: it was given, and midnight only if it was claimed as a time."""
    midnight = (F.hour(ts) == 0) & (F.minute(ts) == 0)
    return F.coalesce(ts.isNotNull() & parsed & (~midnight | F.coalesce(claimed, F.lit(False))), F.lit(False))


def display(ts: Column, now: Column, known: Column) -> Column:
    """TODAY, tomorrow or Mon Oct 5, with the time of day where it is known; both in the home zone's local time."""
    days = F.datediff(ts, now)
    day = F.when(days == 0, "TODAY").when(days == 1, "tomorrow").otherwise(F.date_format(ts, "EEE MMM d"))
    return F.when(ts.isNull(), "Due date unknown").when(known, F.concat(day, F.lit(", "), F.date_format(ts, "h:mm a"))).otherwise(day)


def days_left(ts: Column, now: Column) -> Column:
    """passed, today, 1 day, 2 days; empty without a date."""
    d = F.datediff(ts, now)
    return F.when(ts.isNull(), "").when(d < 0, "passed").when(d == 0, "today").otherwise(F.concat(d.cast("string"), F.when(d == 1, " day").otherwise(" days")))


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts)


def received_at(transport: Column, trace: Column, now: Column, floor: Column) -> Column:
    """The transport's time, no later than now; else the trace's between floor and now; else now."""
    return F.when(transport.isNotNull(), F.least(transport, now)).when(trace.isNotNull(), F.least(F.greatest(trace, floor), now)).otherwise(now)


def due_phrase(days: Column) -> Column:
    whole = F.floor(days).cast("int")
    return F.when(days.isNull(), "due date unknown").when(days < 0, "due date has passed").when(whole == 0, "due today").when(whole == 1, "due in 1 day").otherwise(F.concat(F.lit("due in "), whole.cast("string"), F.lit(" days")))


def filetime(ticks: Column) -> Column:
    """Ticks of 100 ns since 1601."""
    return F.timestamp_micros((ticks / 10).cast("long") - 11_644_473_600_000_000)


def trigger_text(hours: Column) -> Column:
    """-P1DT2H for 26 hours before."""
    d, h = F.floor(hours / 24), hours % 24
    return F.concat(F.lit("-P"), F.when(d > 0, F.concat(d.cast("string"), F.lit("D"))).otherwise(""), F.when((h > 0) | (d == 0), F.concat(F.lit("T"), h.cast("int").cast("string"), F.lit("H"))).otherwise(""))
