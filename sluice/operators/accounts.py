"""Key accounts named within longer names: which phrases, of thousands, stand in which texts.

A list of phrases of at most BYTES is broadcast, and each task looks for all of them at once with an Aho-Corasick automaton. A
longer one meets the names in a join: a phrase goes by the rarest of its trigrams, and what shares it is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTES = 8 << 20
GRAM = 3


def accounts_in_names(names: DataFrame, accounts: DataFrame, most: int = BYTES) -> DataFrame:
    """Distinct (id, account): names (id long, name) that hold the phrase of an account (account long, phrase), case aside.

    Blank phrases and null names match nothing; repeated rows count once.
    """
    n = names.select(F.col("id").cast("long").alias("id"), F.lower("name").alias("name")).filter("id is not null and name <> ''").distinct()
    a = accounts.select(F.col("account").cast("long").alias("account"), F.lower(F.trim("phrase")).alias("phrase")).filter("account is not null and phrase <> ''").distinct()
    size = a.agg(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0))).first()[0]
    return (by_automaton if size <= most else by_rarest_gram)(n, a)


def by_automaton(n: DataFrame, a: DataFrame) -> DataFrame:
    phrases: dict[str, list[int]] = {}
    for r in a.collect():  # at most `most` bytes
        phrases.setdefault(r["phrase"], []).append(r["account"])
    shared = n.sparkSession.sparkContext.broadcast(phrases)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in shared.value:
            machine.add_word(phrase, phrase)
        machine.make_automaton()
        for b in batches:
            ids, found = [], []
            for i, name in zip(b.column("id").to_pylist(), b.column("name").to_pylist()):
                for phrase in {p for _, p in machine.iter(name)}:
                    ids += [i] * len(shared.value[phrase])
                    found += shared.value[phrase]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["id", "account"])

    if not phrases:
        return n.sparkSession.createDataFrame([], "id long, account long")
    return n.mapInArrow(search, "id long, account long").distinct()


def by_rarest_gram(n: DataFrame, a: DataFrame) -> DataFrame:
    short = [r[0] for r in a.filter(F.length("phrase") < GRAM).select(F.length("phrase")).distinct().collect()]  # GRAM - 1 rows at most

    def grams(c, lengths):
        of = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.substring(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.explode(F.array_distinct(F.concat(*[of(k) for k in lengths])))

    of_names = n.select("id", "name", grams(F.col("name"), [*short, GRAM]).alias("gram"))
    df = of_names.groupBy("gram").agg(F.count("*").alias("df"))
    own = F.when(F.length("phrase") < GRAM, F.array("phrase")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length("phrase") - (GRAM - 1), F.lit(1))), lambda i: F.substring("phrase", i, F.lit(GRAM))))
    rarest = a.select("account", "phrase", F.explode(F.array_distinct(own)).alias("gram")).join(df, "gram", "left").fillna(0, ["df"])
    rarest = rarest.groupBy("account", "phrase").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    return rarest.join(of_names, "gram").filter(F.col("name").contains(F.col("phrase"))).select("id", "account").distinct()
