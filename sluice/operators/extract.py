"""Extraction: inputs, the extractor's place, post-processing, geocoding by cache, attempts and re-extraction, corpus reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from sluice.functions import constants as K
from sluice.functions.text import excerpt, first_words, normalize_domain, organisation
from sluice.operators.directory import is_platform

BODY, ATTACHMENT, ATTACHMENTS, LINKS = 20_000, 12_000, 4, 50
PRIORITY = ["itb", "invitation", "scope", "bid form", "bid-form", "addend", "bulletin"]  # words that put an attachment first
MAX_ATTEMPTS = 24


def head_and_tail(c: Column, most: int, head: float) -> Column:
    """A text cut in its middle to `most` characters, `head` of them from its start."""
    first = int(most * head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, first), F.lit("\n[...]\n"), F.substring(c, F.length(c) - (most - first) + 1, F.lit(most - first))))


def assemble(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """One row a message: its columns, and its first attachments with a text (those with a priority word in the name before others) as an array."""
    named = F.lit(False)
    for w in PRIORITY:
        named = named | F.lower("filename").contains(w)
    order = Window.partitionBy("message_id").orderBy(F.when(named, 0).otherwise(1), "position")
    best = attachments.filter(F.col("text") != "").withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= ATTACHMENTS)
    lists = best.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(F.col("__k").alias("k"), "filename", head_and_tail(F.col("text"), ATTACHMENT, 2 / 3).alias("text")))).alias("attachments"))
    return messages.join(lists, "message_id", "left")


def _escaped(c: Column) -> Column:
    """A value that becomes part of the prompt's own marks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def prompt(inputs: DataFrame) -> DataFrame:
    """message_id, prompt: sender, subject, body, links and attachments of assembled inputs between marks, each within its limit.

    Names of files are escaped, as a name could forge a mark otherwise.
    """
    block = lambda tag, c: F.concat(F.lit(f"<{tag}>\n"), c, F.lit(f"\n</{tag}>"))
    line = lambda tag, c: F.concat(F.lit(f"<{tag}>"), F.coalesce(c, F.lit("")), F.lit(f"</{tag}>"))
    files = F.transform(F.coalesce("attachments", F.array().cast("array<struct<k:int,filename:string,text:string>>")), lambda a: F.concat(F.lit('<attachment name="'), _escaped(a["filename"]), F.lit('">\n'), a["text"], F.lit("\n</attachment>")))
    links = F.slice(F.coalesce("links", F.array().cast("array<string>")), 1, LINKS)
    parts = F.concat(
        F.array(F.lit("<message>"), line("from", F.col("sender")), line("subject", F.col("subject")), block("body", head_and_tail(F.coalesce("body", F.lit("")), BODY, 0.5))),
        F.when(F.size(links) > 0, F.array(block("links", F.array_join(links, "\n")))).otherwise(F.array().cast("array<string>")), files, F.array(F.lit("</message>")),
    )
    return inputs.select("message_id", F.array_join(parts, "\n").alias("prompt"))


def _filled(d: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The named columns; those that are missing are null."""
    return d.assign(**{c: pd.Series([None] * len(d), index=d.index, dtype=object) for c in names if c not in d.columns})[names]


def extract(inputs: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs an extractor over assembled inputs, batch by batch. A batch that fails is tried row by row, and a row that fails
    gives its message_id with the error in the schema's column error, all else null."""
    names = [f.name for f in _parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield _filled(extractor(batch), names)
            except Exception:  # noqa: BLE001  one bad input must not stop the others
                for i in range(len(batch)):
                    row = batch.iloc[i : i + 1]
                    try:
                        yield _filled(extractor(row), names)
                    except Exception as e:  # noqa: BLE001  recorded
                        yield pd.DataFrame({c: row["message_id"].tolist() if c == "message_id" else [f"{type(e).__name__}: {e}"[:400] if c == "error" else None] for c in names})

    return inputs.mapInPandas(run, schema)


def fixtures(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Model output kept as <stem>.expected.json, with its stem: the offline extractor is a join with it."""
    d = spark.read.schema(schema).option("multiLine", True).json(f"{path}/*.expected.json")
    return d.withColumn("stem", F.regexp_extract(F.input_file_name(), r"([^/]+)\.expected\.json$", 1))


def postprocess(d: DataFrame, sent: str = "sent_at") -> DataFrame:
    """Columns bid_due, bid_due_confidence, prebid_mandatory, gc_name, gc_domain, flags, summary, scope_text are put in order:

    a due date over two days before sending is doubtful; a mandatory pre-bid gives its flag; a bidding platform isn't an
    organisation; the summary has sixty words at most and is made from the scope where it is blank.
    """
    late = F.coalesce(F.col("bid_due") < F.col(sent) - F.make_dt_interval(days=F.lit(2)), F.lit(False))
    platform = organisation(F.col("gc_name")).isin(K.PLATFORM_NAMES) | is_platform(normalize_domain(F.col("gc_domain")))
    blank = F.trim(F.coalesce("summary", F.lit(""))) == ""
    flags = F.array_union(F.coalesce("flags", F.array().cast("array<string>")), F.array_compact(F.array(F.when(late, "past_due_at_receipt"), F.when(F.col("prebid_mandatory"), "mandatory_prebid"), F.when(blank, "summary_synthesized"))))
    return d.withColumns({
        "bid_due_confidence": F.when(late, F.least("bid_due_confidence", F.lit(0.3))).otherwise(F.col("bid_due_confidence")),
        "gc_name": F.when(~F.coalesce(platform, F.lit(False)), F.col("gc_name")), "flags": F.array_sort(F.array_distinct(flags)),
        "summary": F.when(blank, excerpt(F.coalesce("scope_text", F.lit("No summary")))).otherwise(first_words(F.col("summary"))),
    })


def geocode_queries(d: DataFrame) -> DataFrame:
    """(id, rank, precision, query): the street, then the city, then the raw text, as far as they are known."""
    known = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    city = F.concat_ws(", ", F.col("city"), F.col("state"))
    plans = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("rank"), F.lit(p).alias("precision"), F.lower(F.trim(q)).alias("query"))) for i, (c, p, q) in enumerate((
        (known(F.col("street")) & known(F.col("city")), "exact", F.concat_ws(", ", F.col("street"), city)), (known(F.col("city")), "city", city), (known(F.col("raw")), "raw", F.col("raw")),
    ))]))
    return d.select("id", F.explode(plans).alias("p")).select("id", "p.*")


def geocode(d: DataFrame, cache: DataFrame) -> DataFrame:
    """id, lat, lon, precision of the first query that the cache (query, lat, lon) knows."""
    hits = geocode_queries(d).join(cache, "query").groupBy("id").agg(F.min_by(F.struct("lat", "lon", "precision"), "rank").alias("g"))
    return d.select("id").join(hits, "id", "left").select("id", "g.*")


def status(attempts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Of each message (columns message_id, attempt, outcome): done, skipped, failed (refused or out of attempts), retrying."""
    last = attempts.groupBy("message_id").agg(F.max_by("outcome", "attempt").alias("outcome"), F.max("attempt").alias("attempts"))
    return last.withColumn("status", F.when(F.col("outcome").isin("done", "skipped"), F.col("outcome")).when((F.col("outcome") == "refusal") | (F.col("attempts") >= most), "failed").otherwise("retrying"))


def retry_sweep(states: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Messages to try again, with the key of the hour, which makes a repeated sweep harmless."""
    again = states.filter((F.col("status") == "retrying") & (F.col("attempts") < most))
    return again.withColumn("key", F.concat(F.lit("retry:"), F.col("message_id").cast("string"), F.lit(":"), F.date_format(now, "yyyyMMddHH")))


def stale(extractions: DataFrame, prompt_version: str, now: Column, days: int = 30, most: int = 200) -> DataFrame:
    """Messages whose latest extraction is recent but by another prompt, newest first."""
    w = Window.partitionBy("message_id").orderBy(F.desc("version"), F.desc("created_at"))
    last = extractions.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    return last.filter((F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days))) & (F.col("prompt") != prompt_version)).orderBy(F.desc("created_at"), "message_id").limit(most)


def review_queue(states: DataFrame, least: float = 0.6, most: int = 100) -> DataFrame:
    """What a person should look at: failed, retrying, or done without confidence; newest first."""
    odd = F.col("status").isin("failed", "retrying") | ((F.col("status") == "done") & (F.col("kind_confidence") < least))
    return states.filter(odd).orderBy(F.desc("received_at"), "message_id").limit(most)


def corpus_report(d: DataFrame) -> DataFrame:
    """(measure, key, n): counts by kind, by flag, and of rows with a due date."""
    kinds = d.groupBy(F.lit("kind").alias("measure"), F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    flags = d.select(F.explode("flags").alias("key")).groupBy(F.lit("flag").alias("measure"), "key").agg(F.count("*").alias("n"))
    due = d.filter("bid_due is not null").groupBy(F.lit("due").alias("measure"), F.lit("known").alias("key")).agg(F.count("*").alias("n"))
    return kinds.unionByName(flags).unionByName(due)
