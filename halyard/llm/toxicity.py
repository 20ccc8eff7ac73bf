"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms, case, homoglyphs from other scripts, and digits or signs
that stand for letters inside a word. The lexicon holds whole words and word beginnings, weighted by the
log-odds with which training documents that contain them are toxic; the heaviest entry of each word
counts. A document's weight per hundred words goes through a logistic curve fitted on the same rows.
Exception phrases, given or learnt from harmless documents, cancel the matches they cover.

Only ``text`` is an input of the score. A null or empty text has no words: it gets the curve's value
for no matches. Texts of any length are read whole. Without training rows of both classes the
lexicon is empty and all scores are equal and below 0.5. Equal texts have equal scores.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.shared import stored

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    "авеёкмнорстухіјѕԁԛαβεηικνορτυχıɡ",
    "abeekmhopctyxijsdqabenikvoptuxig",
)
# Digits and signs that stand for letters.
DIGITS = str.maketrans("01345789@$!", "oieastbgasi")
MIXED = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
HAS_DIGIT, HAS_LETTER = re.compile(r"[0-9@$!]"), re.compile(r"[^\W\d_]")
GAP = re.compile(r"[\W_]+")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "scum line")


def fold(text: str | None) -> str:
    """The folded words of a text, a space before and after each."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    if HAS_DIGIT.search(text):
        text = MIXED.sub(_digits, text)
    return f" {GAP.sub(' ', text).strip()} "


def _digits(found: re.Match) -> str:
    word = found[0]
    return word.translate(DIGITS) if HAS_DIGIT.search(word) and HAS_LETTER.search(word) else word


def terms(folded: str, shortest: int = 3, longest: int = 8) -> set[str]:
    """Entries that would match: every word whole (" word ") and its beginnings (" wor")."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(" " + word[:k] for k in range(shortest, min(longest, len(word)) + 1))
    return out


@dataclass
class Lexicon:
    """Weighted entries, exception phrases and the curve; a few thousand rows at most."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    offset: float = -2.0
    _automaton: object = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            built = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                built.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                entry = fold(phrase)
                built.add_word(entry, (len(entry), None))
            if len(built):
                built.make_automaton()
            self._automaton = built
        return self._automaton

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word and its heaviest entry's weight."""
        automaton = self.automaton()
        if not len(automaton):
            return {}
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for start, end in spared:
            for at in [k for k in best if start <= k < end]:
                del best[at]
        return best

    def density(self, folded: str) -> float:
        """Matched weight per hundred words, on a logarithmic scale."""
        found = self.matches(folded)
        return math.log1p(100 * sum(found.values()) / max(folded.count(" ") - 1, 10)) if found else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, self.slope * self.density(fold(text)) + self.offset))))


def surprise(bad: Column, good: Column, n_bad: int, n_good: int) -> Column:
    """How much likelier the counts are at their own rate than at the common one (twice the log ratio)."""
    rate = n_bad / (n_bad + n_good)
    term = lambda n, q: F.when(n > 0, n * F.log(n / (bad + good) / F.lit(q))).otherwise(0.0)
    return 2 * (term(bad, rate) + term(good, 1 - rate))


def closed(found: list[str], bad: np.ndarray, rows: np.ndarray, most: float = 0.9) -> np.ndarray:
    """The rows of entries of which no longer one covers nearly as many toxic documents: not " los" where " loser " does."""
    count = dict(zip(found, bad.tolist(), strict=True))
    covered = {t[:k] for t, n in count.items() for k in range(2, len(t)) if n >= most * count.get(t[:k], np.inf)}
    return np.array([r for t, r in zip(found, rows.tolist(), strict=True) if t not in covered], np.int64)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest curve, with a weak pull towards zero."""
    a = np.column_stack([x, np.ones(len(x))])
    beta, pull = np.zeros(2), np.diag([0.01, 0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pull, a.T @ (y - p) - pull @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id):
    """Whether a row may not be learnt from: crc32 of the id's text is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = 16_000, entries: int = 4_000, exceptions: tuple[str, ...] = EXCEPTIONS, seed: int = 11) -> Lexicon:
    """Learns from at most ``fit_rows`` labelled rows (the documented bound), those with the smallest keyed
    hashes, none of them held out. The driver gets those terms of these rows that pass the test of significance, of which
    the ``entries`` surest make the lexicon, the phrases that enough of them share, and one pair of numbers a training row. Labels that repeat for a document count once, as toxic if any is."""
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    chosen = chosen.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            rows = [0, 0]
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                seen[int(toxic)].update(terms(fold(text)))
                rows[int(toxic)] += 1
            words = list(seen[0] | seen[1])
            yield pd.DataFrame({"term": ["", *words], "bad": [rows[1], *(seen[1][w] for w in words)], "good": [rows[0], *(seen[0][w] for w in words)]})

    counts = stored(train.mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxicity-terms")
    rows = counts.filter("term = ''").first()
    n_bad, n_good = (rows["bad"], rows["good"]) if rows else (0, 0)
    if not n_bad or not n_good:
        return Lexicon(exceptions=exceptions)
    size = F.least(F.length("term"), F.lit(12)).alias("size")
    kinds = {r["size"]: r["n"] for r in counts.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}
    # rarer by chance than one in all terms of that size that were looked at
    needed = F.element_at(F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, 2 * math.log(4 * n))]), size)
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    tested = counts.filter((F.col("bad") >= 3) & (F.col("term") != "")).withColumn("odds", odds).withColumn("sure", surprise(F.col("bad"), F.col("good"), n_bad, n_good))
    rest = tested.filter((F.col("odds") > 1.5) & (F.col("sure") > needed)).select("term", "bad", "odds", "sure").toPandas()
    rest = rest.sort_values(["term"], ignore_index=True)
    keep = closed(rest["term"].tolist(), rest["bad"].to_numpy(float), np.arange(len(rest)))
    sure, odds = rest["sure"].to_numpy(float), rest["odds"].to_numpy(float)
    keep = keep[np.argsort(-sure[keep], kind="stable")][:entries]
    lexicon = Lexicon({rest["term"][k]: float(min(odds[k], 6.0)) for k in keep}, exceptions)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            folded = [fold(t) for t in batch["text"]]
            phrases = [around(f, lexicon.matches(f)) if not y else [] for f, y in zip(folded, batch["toxic"], strict=True)]
            yield pd.DataFrame({"x": [lexicon.density(f) for f in folded], "toxic": batch["toxic"].astype(int), "phrases": phrases})

    measured = stored(train.mapInPandas(measure, "x double, toxic int, phrases array<string>"), "toxicity-points")
    # phrases around matches that several harmless documents share spare those matches
    common = measured.select(F.explode(F.array_distinct("phrases")).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    spared = common.filter(F.col("n") >= max(5, 0.002 * n_good)).select("phrase").collect()
    lexicon.exceptions = (*exceptions, *sorted(r["phrase"] for r in spared))
    lexicon._automaton = None
    points = measured.select("x", "toxic").toPandas().sort_values(["x", "toxic"])
    lexicon.slope, lexicon.offset = logistic(points["x"].to_numpy(float), points["toxic"].to_numpy(float))
    return lexicon


def around(folded: str, found: dict[int, float]) -> list[str]:
    """Each matched word with the word before it and with the word after it."""
    out = []
    for start in found:
        end = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start) if start else -1
        if before >= 0:
            out.append(folded[before + 1 : end])
        after = folded.find(" ", end + 1)
        if after > 0:
            out.append(folded[start + 1 : after])
    return out


def scorer(spark: SparkSession, lexicon: Lexicon):
    """A column function from texts to scores; the lexicon goes to the tasks, a few thousand entries at most."""
    shipped = spark.sparkContext.broadcast(lexicon)
    return F.pandas_udf(lambda texts: pd.Series([shipped.value.score(t) for t in texts], dtype="float64"), "double")


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, predicted of ``docs(doc_id, text)``; nothing is shuffled."""
    scored = docs.select("doc_id", scorer(docs.sparkSession, lexicon)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, most: float = 0.5) -> DataFrame:
    """The rows whose score is below ``most``, with all their columns."""
    return docs.filter(scorer(docs.sparkSession, lexicon)(F.col("text")) < most)


def judge_toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_toxicity(docs, fit_lexicon(docs, labels, **parameters))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
