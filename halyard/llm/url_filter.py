"""URL filter: rules first, then a character language-model ratio.

Two variable-order Markov models, one of accepted and one of rejected URLs, score what the rules leave
open. The context of a character backs off from the longest seen suffix to shorter ones, each order
weighted by how often it was seen (Witten-Bell), so every URL has a positive probability under both. The
verdict is the sign of ``(log P(url | accepted) - log P(url | rejected)) / characters - threshold``.

The models learn from all URLs that the rules decide, none left out: tasks count what stands in their rows and the counts
are added. Every fifth URL of a class in keyed order is held out while the threshold is calibrated, and learnt from after.
The host and the path without digits are read, so numbers and queries are not learnt. A class of one URL is learnt from
too, at a threshold of zero. Where one class has no rows, everything is allowed.

URLs of any length are scored whole. A null URL, or one without ``://``, has an empty host and path and is allowed. Equal URLs get equal
verdicts. Empty tables give no rows; other columns are untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.scratch import numbered, spooled

#: (verdict, rule); a rule is a host and a path prefix. Fixed values of the task.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"(?s)\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path the URL's starts with."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):  # later, longer rules override
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


class Markov:
    """Counts of characters after every context of up to ``order`` characters, as one hash table a model:
    keys are 64-bit codes of (context, character), so the tables are plain sorted arrays."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self._fill(count_grams(texts, order))

    @classmethod
    def of_counts(cls, grams: list[tuple[np.ndarray, np.ndarray]]) -> Markov:
        """The model of counts made elsewhere: of each order the codes, ascending, and how often each was seen."""
        model = cls.__new__(cls)
        model._fill(grams)
        return model

    def _fill(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.order = len(grams) - 1
        self.grams = [(keys, counts.astype(np.float64)) for keys, counts in grams]
        self.contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for keys, counts in grams:
            ctx, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
            self.contexts.append((ctx, np.bincount(inverse, counts, len(ctx)), np.bincount(inverse, minlength=len(ctx)).astype(np.float64)))

    def log_probabilities(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural logarithm of each character's probability after what stands before it."""
        p = np.full(len(codes), 1.0 / 256)
        for n in range(self.order + 1):
            gram, context, ok = windows(codes, starts, n)
            keys, counts = self.grams[n]
            ctx, totals, kinds = self.contexts[n]
            if not len(keys):
                break
            seen = find(keys, counts, gram)
            total, kind = find(ctx, totals, context), find(ctx, kinds, context)
            use = ok & (total > 0)
            p = np.where(use, (seen + kind * p) / np.maximum(total + kind, 1), p)
        return np.log(p)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with an end mark each, and how many bytes of its text precede each byte."""
    parts = [t.encode("utf-8", "replace") + b"\x00" for t in texts]
    codes = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return codes, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def windows(codes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the n characters before each one with and without it; whether so many stand there.
    Up to seven bytes fit a code without loss."""
    context = np.zeros(len(codes), np.uint64)
    for k in range(n, 0, -1):
        back = np.zeros(len(codes), np.uint64)
        back[k:] = codes[:-k] if k else codes
        context = (context << np.uint64(8)) | back
    return (context << np.uint64(8)) | codes, context, before >= n


def count_grams(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each order the codes of characters with what stands before them, ascending, and how often each was seen."""
    codes, before = encode(texts)
    found = (windows(codes, before, n) for n in range(order + 1))
    return [np.unique(gram[ok], return_counts=True) for gram, _, ok in found]


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def features(host: str, path: str) -> str:
    return re.sub(r"\d+", "0", f"{host}{path}")


class Ratio:
    """The two models and the threshold between them."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        held = lambda rows: [r for k, r in enumerate(rows) if k % 5 == 0]
        kept = lambda rows: [r for k, r in enumerate(rows) if k % 5]
        self.models = None
        self.threshold = 0.0
        if not accepted or not rejected:
            return
        if len(accepted) == 1 or len(rejected) == 1:  # nothing would be left to learn from
            self.models = (Markov(accepted, order), Markov(rejected, order))
            return
        self.models = (Markov(kept(accepted), order), Markov(kept(rejected), order))
        good, bad = np.sort(self.scores(held(accepted))), np.sort(self.scores(held(rejected)))
        cuts = np.unique(np.concatenate([good, bad]))
        mids = np.concatenate([[cuts[0] - 1e-6], (cuts[1:] + cuts[:-1]) / 2])
        # the cut with the smallest mean of the two error rates, ties to the one nearest zero
        wrong = np.searchsorted(good, mids) / len(good) + 1 - np.searchsorted(bad, mids) / len(bad)
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        self.threshold = float(mids[best[np.argmin(np.abs(mids[best]))]])
        self.models = (Markov(accepted, order), Markov(rejected, order))

    @classmethod
    def of_models(cls, models: tuple[Markov, Markov] | None, threshold: float = 0.0) -> Ratio:
        ratio = cls([], [])
        ratio.models, ratio.threshold = models, threshold
        return ratio

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood difference a character; above the threshold means accepted."""
        if self.models is None or not texts:
            return np.zeros(len(texts))
        codes, before = encode(texts)
        each = self.models[0].log_probabilities(codes, before) - self.models[1].log_probabilities(codes, before)
        starts = np.flatnonzero(before == 0)
        return np.add.reduceat(each, starts) / np.diff(np.append(starts, len(codes)))


def learnt(ruled: DataFrame, order: int) -> Ratio:
    """The models of all rows of ``ruled(draw, host, path, accepted)`` and the threshold between them."""
    sizes = {r["accepted"]: r["count"] for r in ruled.groupBy("accepted").count().collect()}
    if len(sizes) < 2:
        return Ratio.of_models(None)
    # rejected rows come first, so the places of accepted ones begin after them
    placed = numbered(ruled, [F.col("accepted"), F.col("draw"), F.col("host"), F.col("path")])
    held = (F.col("position") - F.when(F.col("accepted"), sizes[False]).otherwise(0)) % 5 == 0
    rows = placed.select("accepted", held.alias("held"), "host", "path")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (accepted, held), part in batch.groupby(["accepted", "held"]):
                texts = list(map(features, part["host"], part["path"]))
                for n, (grams, times) in enumerate(count_grams(texts, order)):
                    yield pd.DataFrame({"accepted": accepted, "held": held, "n": n, "gram": grams.view(np.int64), "times": times})

    counts = rows.mapInPandas(count, "accepted boolean, held boolean, n int, gram long, times long")
    counts = counts.groupBy("accepted", "n", "gram").agg(F.sum("times").alias("times"), F.sum(F.when(F.col("held"), 0).otherwise(F.col("times"))).alias("kept")).toPandas()

    def model(accepted: bool, column: str) -> Markov:
        own = counts[(counts["accepted"] == accepted) & (counts[column] > 0)].sort_values("gram")
        return Markov.of_counts([(x["gram"].to_numpy(np.int64).view(np.uint64), x[column].to_numpy(np.int64)) for x in (own[own["n"] == n] for n in range(order + 1))])

    models = (model(True, "times"), model(False, "times"))
    if min(sizes.values()) == 1:  # nothing would be left to learn from
        return Ratio.of_models(models)
    return Ratio.of_models(models, best_cut(scored(rows.filter("held"), Ratio.of_models((model(True, "kept"), model(False, "kept"))))))


def scored(rows: DataFrame, ratio: Ratio) -> DataFrame:
    """(score, accepted) of ``rows(host, path, accepted)``."""
    shipped = rows.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"score": shipped.value.scores(list(map(features, batch["host"], batch["path"]))), "accepted": batch["accepted"]})

    return rows.select("host", "path", "accepted").mapInPandas(score, "score double, accepted boolean")


def best_cut(rows: DataFrame) -> float:
    """The cut between neighbouring scores of ``rows(score, accepted)`` with the smallest mean of the two classes' error rates,
    ties to the one nearest zero. Scores are dealt out by range; a row a range, with its sums and its last score, is chained."""
    each = rows.groupBy("score").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lined = spooled(each.repartitionByRange(parts, "score").sortWithinPartitions("score").withColumn("part", F.spark_partition_id()), "cuts")
    ends = lined.groupBy("part").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"), F.max("score").alias("last"))
    w = Window.orderBy("part")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = [f(c).over(over).alias(f"{c}_{name}") for c in ("goods", "bads") for f, over, name in ((F.sum, earlier, "before"), (F.sum, all_, "all"))]
    chained = ends.select("part", *sums, F.lag("last").over(w).alias("last_before"))
    own = Window.partitionBy("part").orderBy("score")
    below = lambda c: F.coalesce(F.col(f"{c}s_before"), F.lit(0)) + F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = lined.join(F.broadcast(chained), "part")
    before = F.coalesce(F.lag("score").over(own), "last_before")
    cut = F.coalesce((F.col("score") + before) / 2, F.col("score") - 1e-6)
    cuts = spooled(joined.select(cut.alias("cut"), (below("good") / F.col("goods_all") + 1 - below("bad") / F.col("bads_all")).alias("wrong")), "errors")
    least = cuts.agg(F.min("wrong")).first()[0]
    return cuts.filter(F.col("wrong") <= least + 1e-12).agg(F.min_by("cut", F.struct(F.abs("cut"), F.col("cut")))).first()[0]


def judge_urls(pages: DataFrame, rules=RULES, order: int = ORDER, seed: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of ``pages(page_id, url)``.

    The models are counts of up to six neighbouring bytes over all rows that a rule decides. What the driver holds and the
    tasks are sent are the different ones, whose number grows with the words that hosts and paths are made of and not
    with the rows."""
    verdict_of = {rule: verdict for verdict, rule in rules}
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    split = split.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    allowing = [rule for verdict, rule in rules if verdict == "allow"]
    ratio = learnt(split.filter(F.col("rule").isNotNull()).select(F.xxhash64("url", F.lit(seed)).alias("draw"), "host", "path", F.col("rule").isin(allowing).alias("accepted")), order)
    shipped = pages.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shipped.value
        for batch in batches:
            texts = [features(h, p) for h, p in zip(batch["host"], batch["path"], strict=True)]
            batch["score"] = model.scores(texts) - model.threshold
            empty = (batch["host"] == "") & (batch["path"] == "")
            batch.loc[empty, "score"] = 0.0
            by_model = np.where(batch["score"] >= 0, "allow", "block")
            batch["verdict"] = [verdict_of.get(r, v) for r, v in zip(batch["rule"], by_model, strict=True)]
            yield batch[["page_id", "host", "path", "rule", "verdict", "score"]]

    return split.select("page_id", "host", "path", "rule").mapInPandas(score, "page_id long, host string, path string, rule string, verdict string, score double")
