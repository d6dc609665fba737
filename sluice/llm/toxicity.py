"""Toxicity by a weighted finite-state pattern grammar.

Words become classes: slur, violence, target, negation, report, intent, noun of scorn ("piece"), its link ("of"), other, each with
a mark when it ends a clause. Five transducers are composed, each reading what the one before it writes. The insult transducer
writes insults, weightier as "piece of <slur>" or slur upon slur; the threat transducer writes threats, weightier soon after an
intent ("I will ..."); target marks what is aimed at somebody, negation what it negates, reported speech what it reports. The
composition is one table over the reachable tuples of states. Only clauses with a slur or violence are run, and what counts is
the clause as matched: asserted, negated or reported, with or without a target. A logistic regression turns the sums over the
matched clauses into a probability.

The insult lexicon (a short fixed seed, whole words and word beginnings, with weights) and the regression are fitted on a bounded sample of
labelled rows, FIT_ROWS at most; near copies in it count once. Labels, lang, source and doc_id are never inputs of a score.

Edge cases: null, empty and wordless texts score as a text without matches; equal texts score alike; with one class only in
the labels or none at all the score is the smoothed share of toxic labels; documents with equal doc_id are scored one by one;
a null doc_id is scored and counts as not held out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import lean, load

FIT_ROWS = 20_000
LEXICON = 4_000  # entries kept, the strongest first
PREFIXES = (4, 5, 6)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, SCORN, LINK = range(9)  # a slur is read as INSULT, violence as THREAT
SYMBOLS = 9
CLAUSE_END = 16
# Fixed word lists of the grammar's closed classes, for the four languages.
TARGETS = "you your yours yourself they them their he him his she her du dich dir ihr euch sie dein deine tu te toi vous votre tes usted ustedes ti vosotros"
NEGATIONS = "not never no nobody neither nor isn't aren't wasn't don't nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás ni tampoco"
REPORTS = "said says say wrote writes called calls quoted quote claims claimed told reported sagte schrieb nannte behauptet dit disait écrit appelle dijo dice escribió llamó"
THREATS = "kill killed hurt destroy burn shoot stab beat punch töten umbringen schlagen verbrennen tuer frapper brûler matar golpear quemar disparar"
INTENTS = "will going gonna i'll we'll shall want werde wird wollen will vais va vont allons voy vamos va quiero"
SCORNS = "piece pieces waste bunch pile load excuse sack stück haufen bande bout morceau tas bande pedazo montón banda"
LINKS = "of a an some von de d un une for"
# Fixed seed of the insult lexicon; what the labelled sample shows is added to it.
INSULTS = (
    "idiot idiots moron morons stupid pathetic worthless loser losers trash scum clown disgusting dumb dumbass imbecile cretin fool jerk bastard asshole "
    "bitch vermin filth scumbag retard idioten dumm trottel schwachkopf arschloch abschaum widerlich wertlos versager dreckskerl crétin imbécile débile "
    "connard salaud ordure minable dégoûtant estúpido imbécil tonto basura escoria patético inútil asqueroso cabrón"
)
_ENDS = (b".", b"!", b"?", b";", b":")


class Transducer:
    """Deterministic and weighted: step(state, symbol) -> (state, symbol written, marks, weight). The start is the first state."""

    def __init__(self, start, step):
        self.start, self.step = start, step


REPORTED, NEGATED, TARGETED, TARGETED_BEFORE = 1, 2, 4, 8


def insult_transducer() -> Transducer:
    """An insult weighs more right after another one, and most behind a noun of scorn and its link."""

    def step(q: str, a: int):
        if a == INSULT:
            return "insult", INSULT, 0, {"link": 1.5, "insult": 1.25}.get(q, 1.0)
        return ("scorn" if a == SCORN else "link" if a == LINK and q in ("scorn", "link") else ""), a, 0, 1.0

    return Transducer("", step)


def threat_transducer(reach: int = 3) -> Transducer:
    """Violence is a threat; within `reach` words of an intent it has its full weight, else half of it."""

    def step(q: int, a: int):
        if a == THREAT:
            return max(0, q - 1), THREAT, 0, 1.0 if q else 0.5
        return (reach if a == INTENT else max(0, q - 1)), a, 0, 1.0

    return Transducer(0, step)


def report_transducer() -> Transducer:
    """From a word of reporting to the clause's end, all is reported."""
    return Transducer(0, lambda q, a: (1 if a == REPORT else q, a, REPORTED if q else 0, 1.0))


def negation_transducer(reach: int = 3) -> Transducer:
    """A negation holds for the next `reach` words; a second one in reach lifts it."""

    def step(q: int, a: int):
        if a == NEGATION:
            return (0 if q else reach), a, 0, 1.0
        return max(0, q - 1), a, NEGATED if q else 0, 1.0

    return Transducer(0, step)


def target_transducer(reach: int = 3) -> Transducer:
    """Marks a match within `reach` words after a target, and a target that follows a match so closely."""

    def step(q: tuple[int, int], a: int):
        since_target, since_match = q
        if a in (INSULT, THREAT):
            mark = TARGETED if since_target else 0
            return (max(0, since_target - 1), 0 if mark else reach), a, mark, 1.0
        if a == TARGET:
            return (reach, 0), a, TARGETED_BEFORE if since_match else 0, 1.0
        return (max(0, since_target - 1), max(0, since_match - 1)), a, 0, 1.0

    return Transducer((0, 0), step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The second reads what the first writes; marks join and weights multiply."""

    def step(q, a: int):
        x, b, marks, weight = first.step(q[0], a)
        y, c, more, times = second.step(q[1], b)
        return (x, y), c, marks | more, weight * times

    return Transducer((first.start, second.start), step)


def grammar_transducer() -> Transducer:
    parts = [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer()]
    return functools.reduce(compose, parts)


def table_of(t: Transducer) -> tuple[list[list[int]], list[list[int]], list[list[int]], list[list[float]]]:
    """(next state, symbol written, marks, weight) by number of the state and symbol read, over the states that can be reached."""
    number, todo = {t.start: 0}, [t.start]
    rows: tuple = ([], [], [], [])
    for q in todo:
        steps = [t.step(q, a) for a in range(SYMBOLS)]
        for to, *_ in steps:
            if to not in number:
                number[to] = len(number)
                todo.append(to)
        for out, values in zip(rows, zip(*[(number[to], *rest) for to, *rest in steps])):
            out.append(list(values))
    return rows


def _norm(word: bytes) -> str:
    """In lower case, without marks on either side; apostrophes stay."""
    if word.isalpha():
        return word.lower().decode()
    s = word.decode("utf-8", "surrogatepass").lower()
    i, j = 0, len(s)
    while i < j and not (s[i].isalnum() or s[i] in "_'"):
        i += 1
    while i < j and not (s[j - 1].isalnum() or s[j - 1] in "_'"):
        j -= 1
    return s[i:j]


class Grammar:
    """The composed table and the lexicon; matches() gives the weighted matches of a text, clause by clause."""

    def __init__(self, words: dict[str, float], prefixes: dict[str, float]):
        self.words, self.prefixes = words, prefixes
        self.next, self.writes, self.marks, self.times = table_of(grammar_transducer())
        classes = ((LINK, LINKS), (INTENT, INTENTS), (SCORN, SCORNS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS))
        self.closed = {w: s for s, ws in classes for w in ws.split()}
        self.symbols: dict[bytes, int] = {}
        self.weights: dict[bytes, float] = {}

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.prefixes.get(word[:k], 0.0) for k in PREFIXES if len(word) > k)])

    def symbol(self, raw: bytes) -> int:
        word = _norm(raw)
        w = self.weight(word)
        s = INSULT if w > 0 else self.closed.get(word, OTHER)
        if w > 0:
            self.weights[raw] = w
        s |= CLAUSE_END * raw.rstrip(b"\"')]*&%$#").endswith(_ENDS)
        if len(self.symbols) > 150_000:
            self.symbols.clear()
            self.weights.clear()
        self.symbols[raw] = s
        return s

    def matches(self, text: str | None) -> tuple[int, list[list[tuple[int, float, int, bytes]]]]:
        """(number of words, per clause with a match its (symbol, weight, marks, word))."""
        raw = (text or "").encode("utf-8", "surrogatepass").split()
        get = self.symbols.get
        syms = list(map(get, raw))
        if None in syms:
            syms = [self.symbol(w) if s is None else s for w, s in zip(raw, syms)]
        line = bytes(syms)
        out, start = [], 0
        while (m := _HIT.search(line, start)) is not None:
            a = max(start, 1 + max(line.rfind(end, start, m.start()) for end in _END_BYTES))
            right = _END.search(line, m.start())
            b = right.end() if right else len(line)
            q, found = 0, []
            for i in range(a, b):
                c = line[i] & (CLAUSE_END - 1)
                s, mark, times = self.writes[q][c], self.marks[q][c], self.times[q][c]
                q = self.next[q][c]
                if s in (INSULT, THREAT):
                    found.append((s, times * (self.weights.get(raw[i]) or self.weight(_norm(raw[i])) if s == INSULT else 1.0), mark, raw[i]))
                elif mark & TARGETED_BEFORE and found:
                    found[-1] = (*found[-1][:2], found[-1][2] | TARGETED, found[-1][3])
            out.append(found)
            start = b
        return len(raw), out


_HIT = re.compile(b"[" + bytes([INSULT, THREAT, INSULT | CLAUSE_END, THREAT | CLAUSE_END]) + b"]")
_END = re.compile(b"[" + bytes(range(CLAUSE_END, CLAUSE_END + SYMBOLS)) + b"]")
_END_BYTES = [bytes([c]) for c in range(CLAUSE_END, CLAUSE_END + SYMBOLS)]
FEATURES = 9


def features(grammar: Grammar, text: str | None) -> list[float]:
    n, clauses = grammar.matches(text)
    said = denied = told = aimed = threat = top = 0.0
    kinds = set()
    for clause in clauses:
        score = 0.0
        for s, w, mark, word in clause:
            if s == THREAT:
                threat += w * bool(mark & TARGETED)
                score += w * bool(mark & TARGETED)
                continue
            kinds.add(_norm(word))
            said += w * (not mark & (NEGATED | REPORTED))
            denied += w * bool(mark & NEGATED)
            told += w * bool(mark & REPORTED)
            aimed += w * bool(mark & TARGETED)
            score += w * (0.5 if mark & (NEGATED | REPORTED) else 1.5 if mark & TARGETED else 1.0)
        top = max(top, score)
    return [1.0, math.log1p(said), math.log1p(denied), math.log1p(told), math.log1p(aimed), math.log1p(threat), top, (said + denied + told) / math.sqrt(n + 1), math.log1p(len(kinds))]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most `rows` labelled documents that aren't held out, the first by a hash of doc_id."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # ids: `rows` rows at most


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that toxic documents have far more often than others, by the likelihood ratio."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                raw = (text or "").encode("utf-8", "surrogatepass").split()
                words = {w for w in map(_norm, set(raw)) if w}
                grams = [b" ".join(raw[i : i + 5]) for i in range(max(1, len(raw) - 4))]
                family = [min(xxhash.xxh3_64_intdigest(g, seed) for g in grams) >> 1 for seed in (1, 2)]
                out.append((*family, int(label), sorted(words | {f"{w[:k]}*" for w in words for k in PREFIXES if len(w) > k})))
            yield pd.DataFrame(out, columns=["f1", "f2", "label", "units"])

    seed = dict.fromkeys(INSULTS.split(), 0.8)
    one = sample.mapInPandas(lean(parts), "f1 long, f2 long, label int, units array<string>").groupBy("f1", "f2").agg(F.max_by("units", F.struct("label", F.size("units"))).alias("units"), F.max("label").alias("label"))
    totals = one.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in totals}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return seed, {}
    counts = one.select(F.explode("units").alias("unit"), "label").groupBy("unit").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    odds = F.log(((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1)))
    share = n1 / (n1 + n0)
    both = F.col("a") + F.col("b")
    g2 = 2 * (F.col("a") * F.log(F.col("a") / (both * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (both * (1 - share)))).otherwise(0.0))
    rows = counts.filter("a >= 4").withColumn("odds", odds).withColumn("g2", g2).filter("odds >= 2.5 and g2 >= 20").orderBy(F.desc("g2"), "unit").limit(LEXICON).collect()
    weight = {r["unit"]: min(1.0, r["odds"] / 6) for r in rows}
    return seed | {u: w for u, w in weight.items() if not u.endswith("*")}, {u[:-1]: w for u, w in weight.items() if u.endswith("*")}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 100) -> np.ndarray:
    """Newton steps with a ridge; the first column is the constant and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[Grammar, np.ndarray]:
    sample = fit_sample(docs, labels, "toxic", rows)
    grammar = Grammar(*learn_lexicon(sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [features(grammar, t) for t in batch["text"]], "label": batch["label"]})

    got = sample.mapInPandas(lean(run), "x array<double>, label int").toPandas()  # `rows` rows at most
    y = got["label"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 2.0)
        return grammar, np.array([math.log(p / (1 - p))] + [0.0] * (FEATURES - 1))
    return grammar, logistic(np.array(got["x"].tolist()), y)


def scorer(grammar: Grammar, weights: np.ndarray):
    """A column function: the probability that a text is toxic."""

    @F.pandas_udf("double")
    @lean
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            z = np.array([features(grammar, t) for t in texts]).reshape(-1, FEATURES) @ weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    return docs.filter(scorer(*fit(docs, labels))("text") < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(*fit(docs, labels))("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
