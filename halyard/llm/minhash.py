"""Near-duplicate documents by DartMinHash signatures.

A document is a weighted set of shingles, five folded words each (all its words if there are fewer), a
shingle seen n times weighing ``1 + floor(log2 n)``. Every shingle owns a plane of weight by rank into which
a Poisson process of intensity one, drawn by hash, throws darts. A document keeps the darts below its
weight and below a rank at which it expects ``k ln k + 2k`` of them, hashes each to one of k coordinates
and keeps the earliest a coordinate; documents that miss a coordinate double the rank and throw again.
Two documents share a coordinate's dart with the probability of their weighted Jaccard similarity. Bands
of coordinates propose pairs, whose similarity is then computed from the whole texts.

Work is per distinct text. A band's bucket proposes its members against its smallest. Buckets that still hold
several classes afterwards propose their members again: small ones every pair across classes, the members of
large ones every pair whose rare tokens allow the similarity, an exact join.

Texts of any length are read whole, one at a time in a task. Null and empty texts, and texts without words, are copies of one another and one class. Repeated rows fall
into one class. A null doc_id takes part and never names a class unless all ids in it are null. Empty tables
give no rows; other columns are not touched.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.components import components
from halyard.llm.shared import stored, trim_worker

SHINGLE = 5
U64 = np.uint64
#: Up to so many members left in several classes, a bucket compares all of them across classes.
SMALL_BUCKET = 32
#: A token that more texts share is joined in several parts.
HOT_TOKEN = 1024


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of all texts, and how many words each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    folded = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), r"[^\pL\pN]+", " "), " ")
    lists = pc.split_pattern(folded, " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter((digest(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)), U64, len(coded.dictionary))
    hashes = own[coded.indices.to_numpy(zero_copy_only=False)]
    empty = pc.equal(folded, "").to_numpy(zero_copy_only=False)
    if empty.any():  # splitting gives one empty word
        hashes = np.delete(hashes, (np.cumsum(counts) - counts)[empty])
        counts = np.where(empty, 0, counts)
    return hashes, counts


def weighted_shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of each distinct shingle of each text, sorted by text."""
    words, counts = word_hashes(texts)
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    text = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    end = np.cumsum(counts)[text]
    shingle = np.zeros(len(text), U64)
    padded = np.append(words, U64(0))
    for k in range(width):
        at = first + k
        shingle = mixed(shingle + np.where(at < end, padded[np.minimum(at, len(words))], U64(0)) + U64(k + 1))
    key = mixed(shingle ^ mixed(text.astype(U64) + U64(1)))
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    repeats = np.diff(np.append(starts, len(key)))
    one = order[starts]
    by_text = np.argsort(text[one], kind="stable")
    return text[one][by_text], shingle[one][by_text], 1.0 + np.floor(np.log2(repeats[by_text].astype(np.float64)))


POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def throw_darts(shingle: np.ndarray, weight: np.ndarray, most_rank: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element number, rank, dart) of all darts below each element's weight and rank.

    Weights are cut at 2^n - 1 and each strip's ranks into cells of area one, so a cell holds a Poisson number of
    darts with mean one; a dart's place depends on the shingle and the cell alone."""
    found = []
    level = 0
    while True:
        floor, height = 2.0**level - 1, 2.0**-level
        rows = np.flatnonzero(weight > floor)
        if not len(rows):
            break
        cells = np.ceil(most_rank[rows] / height).astype(np.int64)
        who = np.repeat(rows, cells)
        cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
        spot = mixed(shingle[who] + mixed(cell.astype(U64) * U64(64) + U64(level) + U64(seed) * U64(0x9E3779B97F4A7C15)))
        darts = np.searchsorted(POISSON, (spot >> U64(11)).astype(np.float64) * 2.0**-53)
        hit = np.flatnonzero(darts)
        each = darts[hit]
        who, cell, spot = np.repeat(who[hit], each), np.repeat(cell[hit], each), np.repeat(spot[hit], each)
        number = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
        dart = mixed(spot + (number.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
        across = floor + 2.0**level * ((dart >> U64(40)).astype(np.float64) * 2.0**-24)
        rank = (cell + (mixed(dart) >> U64(11)).astype(np.float64) * 2.0**-53) * height
        ok = (across < weight[who]) & (rank < most_rank[who])
        found.append((who[ok], rank[ok], dart[ok]))
        level += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U64))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, k: int, seed: int = 1) -> np.ndarray:
    """(texts, k) of darts; rows of texts without shingles are zero."""
    out = np.zeros((n_texts, k), U64)
    total = np.bincount(text, weight, n_texts)
    wanted = k * math.log(max(k, 2)) + 2 * k
    ceiling = wanted / np.maximum(total, 1e-9)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[text])
        who, rank, dart = throw_darts(shingle[mine], weight[mine], ceiling[text[mine]], seed)
        slot = text[mine][who] * k + (mixed(dart ^ U64(0xE7037ED1A0B428DB)) % U64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot = slot[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        filled = np.bincount(slot[first] // k, minlength=n_texts) == k
        done = todo & filled
        keep = first[done[slot[first] // k]]
        out.reshape(-1)[slot[keep]] = dart[order][keep]
        todo &= ~filled
        ceiling = np.where(todo, ceiling * 2, ceiling)
    return out


def band_values(signature: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands): a hash of each band's coordinates."""
    parts = signature.reshape(len(signature), bands, -1)
    out = np.zeros(parts.shape[:2], U64)
    for k in range(parts.shape[2]):
        out = mixed(out + parts[:, :, k] + U64(k + 1))
    return out


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about ``most`` characters; a longer text is alone."""
    at = 0
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= most):
            chars += len(texts[upto])
            upto += 1
        yield slice(at, upto)
        at = upto


def banded(texts: DataFrame, k: int, bands: int, seed: int) -> DataFrame:
    """key, bands of ``texts(key, text)``, one row a row."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["text"].tolist()
            for part in chunks(rows):
                own = rows[part]
                signed = signatures(*weighted_shingles(own), len(own), k, seed)
                yield pd.DataFrame({"key": batch["key"].iloc[part].tolist(), "bands": list(band_values(signed, bands).view(np.int64))})
        trim_worker()

    return texts.mapInPandas(sign, "key binary, bands array<long>")


def similarities(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted Jaccard similarity of the texts of each pair (a, b, text_a, text_b)."""
    for batch in pairs:
        a, b = batch["text_a"].tolist(), batch["text_b"].tolist()
        for part in chunks([x + y for x, y in zip(a, b, strict=True)]):
            distinct = list(dict.fromkeys(a[part] + b[part]))
            number = {t: n for n, t in enumerate(distinct)}
            text, shingle, weight = weighted_shingles(distinct)
            edges = np.searchsorted(text, np.arange(len(distinct) + 1))
            sets = {}

            def of(t: str):
                if t not in sets:
                    own = slice(edges[number[t]], edges[number[t] + 1])
                    order = np.argsort(shingle[own])
                    sets[t] = shingle[own][order], weight[own][order]
                return sets[t]

            likeness = []
            for x, y in zip(a[part], b[part], strict=True):
                (hx, wx), (hy, wy) = of(x), of(y)
                _, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
                both = float(np.minimum(wx[ix], wy[iy]).sum())
                total = float(wx.sum() + wy.sum()) - both
                likeness.append(both / total if total else 1.0)
            yield pd.DataFrame({"a": batch["a"].iloc[part].tolist(), "b": batch["b"].iloc[part].tolist(), "similarity": likeness})
    trim_worker()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) of text keys whose texts are at least so similar."""
    pairs = pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    with_a = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(with_b.mapInPandas(similarities, "a binary, b binary, similarity double").filter(F.col("similarity") >= least), "links")


def token_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, tokens of (key, text): a shingle of weight w is w tokens, so that the Jaccard similarity of the token sets is
    the weighted one of the texts."""
    for batch in batches:
        rows = batch["text"].tolist()
        for part in chunks(rows):
            own = rows[part]
            text, shingle, weight = weighted_shingles(own)
            units = weight.astype(np.int64)
            level = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
            token = mixed(np.repeat(shingle, units) + level.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
            edges = np.searchsorted(np.repeat(text, units), np.arange(1, len(own)))
            yield pd.DataFrame({"key": batch["key"].iloc[part].tolist(), "tokens": np.split(token, edges)})
    trim_worker()


def rare_tokens(texts: DataFrame, least: float) -> DataFrame:
    """key, size, token, holders, rest of ``texts(key, text)``: the tokens by which a text can meet texts of at least that
    similarity. ``holders`` texts have the token; ``rest`` of the text's ``size`` tokens are this one or come after it.

    Tokens are ordered by their holders, fewest first. Similar texts agree in so many tokens that the first
    one they share is among the first fifth of the larger text's and the first ninth of the smaller one's at 0.8."""
    sets = stored(texts.select("key", "text").mapInPandas(token_sets, "key binary, tokens array<long>"), "tokens")
    each = sets.select("key", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    held = each.join(shared, "token").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("holders", "token"))).alias("held"))
    held = held.join(sets.select("key", F.size("tokens").alias("size")), "key").withColumn("alone", F.col("size") - F.size("held"))
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-6) + 1 - F.col("alone")
    held = held.select("key", "size", "alone", F.posexplode(F.slice("held", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("at", "of"))
    return stored(held.select("key", "size", "of.token", "of.holders", (F.col("size") - F.col("alone") - F.col("at")).alias("rest")), "rare-tokens")


def led(rare: DataFrame) -> DataFrame:
    """Pairs (a, b): each text and, for each of its rare tokens, the holder with the least before it. So most texts that
    belong together are in one class before all pairs across classes meet."""
    lead = rare.groupBy("token").agg(F.min_by("key", F.struct(F.col("size") - F.col("rest"), "key")).alias("b"))
    return rare.join(lead, "token").select(F.col("key").alias("a"), "b")


def met(rare: DataFrame, component: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different ``component(key, component)``: all that can be similar by what is left after a shared
    rare token."""
    agreed = least / (1 + least)
    # a token of many texts is dealt out: each smaller text to one part, the larger ones to all
    rare = rare.join(component, "key").withColumn("parts", F.ceil(F.col("holders") / HOT_TOKEN).cast("int"))
    small = rare.filter(F.col("rest") >= 2 * agreed * F.col("size") - 1e-6).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    large = rare.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    ordered = F.struct(x("size"), x("key")) < F.struct(y("size"), y("key"))
    enough = F.least(x("rest"), y("rest")) >= agreed * (x("size") + y("size")) - 1e-6
    pairs = small.alias("x").join(large.alias("y"), (x("token") == y("token")) & (x("part") == y("part")) & (x("component") != y("component")) & ordered & enough)
    return pairs.select(x("key").alias("a"), y("key").alias("b")).distinct()


def near_duplicates(docs: DataFrame, least: float = 0.8, k: int = 64, bands: int = 16, seed: int = 1) -> DataFrame:
    """doc_id, text_key, class_id, class_key of ``docs(doc_id, text)``: the class id is the smallest doc_id in it,
    the class key its own even where ids repeat or are null.

    Texts are linked at ``least`` and above and not below it: copies with more edits than that, as with one word in
    fifty replaced throughout, are different texts here. Two texts of similarity 0.8 are proposed with a probability of 0.9998 at the default bands."""
    # texts without a word are one node
    text = F.coalesce("text", F.lit(""))
    text = F.when(text.rlike(r"[\p{L}\p{N}]"), text).otherwise(F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    signed = banded(keyed.select("key", "text").filter(F.col("text") != ""), k, bands, seed)
    nodes = stored(signed.groupBy("key").agg(F.first("bands").alias("bands")), "signatures")
    spread = nodes.select("key", F.posexplode("bands").alias("band", "value"))
    full = spread.groupBy("band", "value").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("members")).filter(F.col("members") > 1)
    members = stored(spread.join(full, ["band", "value"]), "buckets")
    # the texts of all members, fetched once: a shuffle of the texts at any size, so no broadcast here
    wanted = members.select("key").distinct().hint("merge")
    texts = stored(keyed.select("key", "text").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "member-texts")
    links = verified(members.select(F.col("key").alias("a"), F.col("leader").alias("b")), texts, least)
    classes = components(links)

    # what the leaders could not join: members of buckets that still hold several classes
    left = members.filter(F.col("members") > 2).join(classes.select(F.col("node").alias("key"), "component"), "key", "left")
    left = left.withColumn("component", F.coalesce("component", "key")).filter(F.col("key") != F.col("leader"))
    split = left.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rest")).filter(F.col("low") != F.col("high"))
    left = stored(left.join(split.select("band", "value", "rest"), ["band", "value"]), "split-buckets")
    few = left.filter(F.col("rest") <= SMALL_BUCKET)
    across = few.alias("x").join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.component") < F.col("y.component")))
    pairs = across.select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    # the members of larger ones meet at rare tokens, so no bucket makes all its pairs
    many = left.filter(F.col("rest") > SMALL_BUCKET).select("key").distinct()
    rare = None if many.isEmpty() else rare_tokens(texts.join(many, "key"), least)
    links = links.select("a", "b").union(verified(pairs if rare is None else pairs.union(led(rare)), texts, least).select("a", "b"))
    classes = components(links)
    if rare is not None:
        own = rare.select("key").distinct().join(classes.select(F.col("node").alias("key"), "component"), "key", "left")
        links = links.union(verified(met(rare, own.withColumn("component", F.coalesce("component", "key")), least), texts, least).select("a", "b"))
        classes = components(links)

    of_text = keyed.select("doc_id", "key").alias("d").join(classes.alias("c"), F.col("d.key") == F.col("c.node"), "left").select("d.doc_id", "d.key", F.coalesce("c.component", "d.key").alias("component"))
    first = of_text.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return of_text.join(first, "component").select("doc_id", F.hex("key").alias("text_key"), "class_id", F.hex("component").alias("class_key"))


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each class stays, that with the smallest doc_id, with all its columns. Among rows of
    that id, the smallest text key first, one stays."""
    classes = near_duplicates(docs, **parameters)
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.min("text_key").alias("text_key"), F.first("class_id").alias("class_id"))
    text = F.coalesce(F.col("d.text"), F.lit(""))
    text = F.when(text.rlike(r"[\p{L}\p{N}]"), text).otherwise(F.lit(""))
    names, key = docs.columns, f"key_{uuid.uuid4().hex}"
    joined = docs.alias("d").join(kept.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.class_id")) & (F.upper(F.md5(text)) == F.col("k.text_key")), "left_semi")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        joined = joined.withColumn(key, F.md5(text)).dropDuplicates(["doc_id", key])
    return joined.select(*[F.col(f"`{c}`") for c in names])
