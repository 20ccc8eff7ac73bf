"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target in words. Targets become equal blocks of words by the highest quotients
``target / (2k + 1)``, first among sources, then among each source's shards by their sizes, so quotas are
integers that add up. Within a shard, documents lie on a line in a seeded order; whole passes take
everything and a seeded permutation picks the blocks of the last, partial pass.

A document's size is its number of words, null texts have none. A null source is a source of its own
that comes last. Documents of no words are kept with nothing taken. An empty table gives no rows.
Equal rows are separate documents. Texts of any length are counted whole. Other columns pass through untouched if the
caller keeps them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.scratch import numbered, spooled

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3  # no document and no source is taken more often than this


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = MOST, share: float = 1.0) -> DataFrame:
    """source, place, source_size, source_docs, weight, target of ``sized(source, size)``, one stored row a source.

    The sources, by code point and null last, weigh ``weights`` in turn and share ``share`` of all sizes.
    A target stops at ``most`` times its source's size and the excess is dealt out by weight until none
    is above: with the targets ``min(cap, level * weight)``, the level rises from that at which none stops until
    their sum is reached, each step at the rate of those that have not stopped. A step is one sum over the
    sources; the driver holds the level alone."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "place")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    per = spooled(per.withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        stopped = F.col("cap") <= F.lit(level) * F.col("weight")
        sums = per.agg(F.sum(F.when(stopped, F.col("cap"))).alias("full"), F.sum(F.when(~stopped, F.col("weight"))).alias("free")).first()
        if not sums["free"]:
            break
        risen = (total - (sums["full"] or 0.0)) / sums["free"]
        if risen <= level * (1 + 1e-15):
            break
        level = risen
    return per.select("source", "place", "source_size", "source_docs", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def seats_above(vote: Column, d: float) -> Column:
    """How many quotients vote / (2k + 1) are above the divisor."""
    return F.greatest(F.ceil(vote / F.lit(2 * d) - 0.5), F.lit(0)).cast("long")


def source_quotas(sources: DataFrame, seats: int) -> DataFrame:
    """The sources with ``quota``, their seats by the highest quotients, ties to the earlier source.

    Rounding moves the sum of seats by half a seat a source at most, so the last seat's quotient lies between two
    divisors that three sums give. The seats above the upper one are sure; between the two lie about two quotients a source, the
    highest of which get the seats that are left."""
    votes = sources.filter("target > 0")
    ends = votes.agg(F.max("target").alias("top"), F.sum("target").alias("sum"), F.count(F.lit(1)).alias("n")).first()
    if seats <= 0 or not ends["n"]:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    low = 0.999 * ends["sum"] / (2 * seats + ends["n"] + 1)
    high = 1.001 * (ends["sum"] / (2 * seats - ends["n"] - 1) if 2 * seats > ends["n"] + 1 else 2 * ends["top"])
    sure, most = seats_above(F.col("target"), high), seats_above(F.col("target"), low)
    left = seats - votes.agg(F.sum(sure)).first()[0]
    open_ = votes.filter(most > sure).select("place", "target", F.explode(F.sequence(sure, most - 1)).alias("k"))
    won = open_.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "place").limit(left).groupBy("place").agg(F.count(F.lit(1)).alias("more"))
    quota = F.when(F.col("target") > 0, sure).otherwise(0) + F.coalesce("more", F.lit(0))
    return sources.join(won, "place", "left").withColumn("quota", quota.cast("long")).drop("more")


def sainte_lague(votes: np.ndarray, seats: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Seats of each party by the highest quotients votes / (2k + 1), ties to the earlier party,
    none above its ``limit``. A common divisor is bisected, then the last seats go one quotient at a time."""
    votes = np.asarray(votes, np.float64)
    most = np.full(len(votes), seats, np.int64) if limit is None else np.asarray(limit, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.ceil(votes / (2 * d) - 0.5).clip(0), most).astype(np.int64)  # noqa: E731  quotients above d
    low, high = 0.0, float(votes.max()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
    out = given(high)
    left = seats - int(out.sum())
    while left > 0:
        quotient = np.where(out < most, votes / (2 * out + 1), -1.0)
        out[int(np.argmax(quotient))] += 1
        left -= 1
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, block_words: int = 64, shard_words: int = 1 << 24, shard_docs: int = 1 << 20, most: int = MOST, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, shard, quota of ``docs(doc_id, text, source)``.

    The texts are read once; only ids and sizes are shuffled. A hot source is cut into as many shards as its words and
    documents ask for. Quotas stay rows of tables; the driver sees sums only."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", F.lit(seed)).alias("tie"))
    sized = spooled(sized, "sizes")
    sources = source_targets(sized, weights, most, share)
    sources = source_quotas(sources, round((sources.agg(F.sum("target")).first()[0] or 0.0) / block_words))
    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_docs") / shard_docs), F.lit(1)).cast("long")
    s, d = spooled(sources.withColumn("n_shards", n_shards), "source-quotas").alias("s"), sized.alias("d")
    dealt = d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")), "left").select("d.*", "s.place", "s.source_size", "s.target", "s.n_shards", F.col("s.quota").alias("source_quota"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("n_shards")))
    shards = dealt.groupBy("place", "source_quota", "n_shards", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = shard_quotas(shards, block_words, most)

    on_line = Window.partitionBy("place", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "tie")
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(on_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("row", F.row_number().over(on_line))
    placed = placed.join(quotas, ["place", "shard"])

    # a row for each block that a document touches: the blocks are drawn in a seeded order until the
    # partial pass is used up, the last of them in part
    end = F.col("begin") + F.col("size")
    blocks = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words)))
    pieces = placed.withColumn("block", F.explode_outer(blocks))
    pieces = pieces.withColumn("from", F.greatest("begin", F.col("block") * block_words)).withColumn("words", F.least(end, (F.col("block") + 1) * block_words) - F.col("from"))
    drawn = Window.partitionBy("place", "shard").orderBy(F.xxhash64("place", "shard", "block", F.lit(seed + 2)), "block", "from").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("got", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.coalesce(F.sum("words").over(drawn), F.lit(0)))))
    kept = ("place", "doc_id", "size", "source_size", "target", "source", "shard", "quota")
    per_doc = pieces.groupBy(*kept, "row", "passes").agg(F.coalesce(F.sum("got"), F.lit(0)).alias("got"))
    return per_doc.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes") + F.col("got")).alias("taken"), "source", "shard", "quota")


def shard_quotas(shards: DataFrame, block_words: int, most: int) -> DataFrame:
    """place, shard, quota in blocks, whole passes, words of the partial pass of ``shards(place, source_quota, n_shards,
    shard, shard_size)``. A shard can give ``most`` passes; its last block may be short. Only sources of several shards,
    so of millions of words or documents, are apportioned, a row a shard; one task has all shards of a source."""
    limit = F.ceil(F.col("shard_size") * most / block_words).cast("long")
    single = shards.filter("n_shards = 1").select("place", "shard", "shard_size", F.least(F.col("source_quota"), limit).alias("quota"))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard", ignore_index=True)
        sizes = group["shard_size"].to_numpy(np.int64)
        group["quota"] = sainte_lague(sizes, int(group["source_quota"].iloc[0]), -(-most * sizes // block_words))
        return group[["place", "shard", "shard_size", "quota"]]

    several = shards.filter("n_shards > 1").groupBy("place").applyInPandas(split, "place long, shard long, shard_size long, quota long")
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * most)
    passes = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    out = single.unionByName(several).withColumn("passes", passes)
    return out.select("place", "shard", "quota", "passes", (words - F.col("passes") * F.col("shard_size")).alias("rest"))


def mix_corpus(docs: DataFrame, **parameters) -> DataFrame:
    """The documents as the mix takes them: each as many times as ``taken`` holds its size, the broken
    part of a pass deciding by a keyed hash whether one copy more is taken. Documents of no words, whose
    share of the mix is nothing either way, stay once. Columns are those of ``docs``; equal rows share
    their plan."""
    seed = parameters.get("seed", 17)
    plan = mix(docs, **parameters)
    ratio = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.col("taken") / F.col("size"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed + 3)), F.lit(1 << 20)) / float(1 << 20)
    copies = plan.groupBy("doc_id", F.col("source").alias("from_source")).agg((F.floor(F.avg(ratio)) + F.when(chance < F.avg(ratio) - F.floor(F.avg(ratio)), 1).otherwise(0)).cast("int").alias("copies"))
    d, c = docs.alias("d"), copies.alias("c")
    joined = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.from_source")))
    extra = f"copy_{uuid.uuid4().hex}"
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(1), F.col("c.copies"))).alias(extra)).drop(extra)
