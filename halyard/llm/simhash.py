"""Document fingerprints by SimHash, in DataFrame operations alone.

A text's terms are its runs of three folded words (all of them if there are fewer); each occurrence of a term
weighs ``1 + min(3, characters / 8)``, so longer, rarer terms count for more. Every term votes on each of
128 bits with its weight, for or against as its hash has the bit set, and the sign of the sum is the fingerprint's
bit. Votes are summed two to a long: bits j and j + 32 of a hash are added in its two halves.

Fingerprints within a Hamming radius r are found by r + 1 blocks: two such fingerprints agree on one
block at least, so r + 1 tables keyed by one block each meet them all, and the first table that does
reports them.

Null texts are empty texts; texts without a word have the fingerprint 0. Equal texts have equal
fingerprints. Equal rows count once where an order of documents is asked for; a null doc_id is the last.
Texts may have up to 2^29 words. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.shared import partitions, stored

WORDS, HALF = 3, 32
MASK = (1 << HALF) | 1


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, hi, lo (two longs, the fingerprint) of ``texts(*keys, text)``; keys tell rows apart.

    All of a text's votes are added where the text is; what is shuffled is one row of sums a text and task."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = texts.select(*keys, words.alias("w")).withColumn("n", F.size("w"))
    # one row for texts without words too, so that they keep a fingerprint
    at = cut.select(*keys, "w", "n", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - (WORDS - 1), F.lit(1)))).alias("i"))
    parts = [F.try_element_at("w", F.col("i") + k) for k in range(WORDS)]
    size = sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0))
    weight = F.when(F.col("n") > 0, 1 + F.least(F.lit(3), F.floor(size / 8))).otherwise(0).cast("long")
    votes = at.select(*keys, F.xxhash64(*parts).alias("h0"), weight.alias("weight")).withColumn("h1", F.xxhash64(F.col("h0"), F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(f"h{h}", j).bitwiseAND(F.lit(MASK)) * F.col("weight")).alias(f"s{h}_{j}") for h in (0, 1) for j in range(HALF)]
    summed = votes.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)

    def bits(h: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(HALF):
            low, high = F.col(f"s{h}_{j}").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned(f"s{h}_{j}", HALF)
            out = out.bitwiseOR(F.when(low * 2 > F.col("total"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"))
            top = 1 << (j + HALF)
            out = out.bitwiseOR(F.when(high * 2 > F.col("total"), F.lit(top - (1 << 64) if top >= 1 << 63 else top)).otherwise(F.lit(0)).cast("long"))
        return out

    return summed.select(*keys, bits(0).alias("hi"), bits(1).alias("lo"))


def distance(a: str, b: str) -> Column:
    """Differing bits of two fingerprints, given the prefixes of their columns."""
    return F.bit_count(F.col(f"{a}hi").bitwiseXOR(F.col(f"{b}hi"))) + F.bit_count(F.col(f"{a}lo").bitwiseXOR(F.col(f"{b}lo")))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def blocks(hi: Column, lo: Column, radius: int) -> list[Column]:
    """``radius`` + 1 parts of about equal width that make up the 128 bits, as numbers (a hash, if one part is all)."""
    if radius == 0:
        return [F.xxhash64(hi, lo)]
    edges = [128 * k // (radius + 1) for k in range(radius + 2)]
    low = lambda c, width: c if width >= 64 else c.bitwiseAND(F.lit((1 << width) - 1))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b <= 64:
            out.append(low(F.shiftrightunsigned(hi, 64 - b), b - a))
        elif a >= 64:
            out.append(low(F.shiftrightunsigned(lo, 128 - b), b - a))
        else:  # it lies across both longs
            out.append(F.shiftleft(low(hi, 64 - a), b - 64).bitwiseOR(F.shiftrightunsigned(lo, 128 - b)))
    return out


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """q_hi, q_lo, hi, lo, n, bits of each pair of a distinct query fingerprint and a distinct indexed one within
    ``radius`` bits; n rows of the index have it. Equal fingerprints are one on both sides, so groups of
    copies do not multiply."""

    def tabled(df: DataFrame) -> DataFrame:
        parts = [F.struct(F.lit(t).alias("t"), b.alias("block")) for t, b in enumerate(blocks(F.col("hi"), F.col("lo"), radius))]
        return df.withColumn("b", F.explode(F.array(*parts))).select("*", "b.t", "b.block").drop("b")

    q = tabled(queries.select("hi", "lo").distinct()).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "t", "block")
    x = tabled(index.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")))
    met = q.join(x, ["t", "block"]).withColumn("bits", distance("q_", "")).filter(F.col("bits") <= radius)
    # the first table in which two fingerprints meet reports them
    mine, theirs = blocks(F.col("q_hi"), F.col("q_lo"), radius), blocks(F.col("hi"), F.col("lo"), radius)
    first = F.lit(len(mine))
    for t in range(len(mine) - 1, -1, -1):
        first = F.when(mine[t] == theirs[t], F.lit(t)).otherwise(first)
    return met.filter(F.col("t") == first).drop("t", "block")


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, mark, n_chars, next_id, next_mark, with the next row in descending doc_id (then mark), after the
    last the first. Ids alone are dealt out by range and ordered within each range; one row a range is then
    ordered in one place to join the ends."""
    n = partitions(ids.sparkSession)
    order = (F.col("doc_id").desc_nulls_last(), F.col("mark").asc())
    dealt = stored(ids.distinct().repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("part").orderBy(*order)
    me = F.struct("doc_id", "mark").alias("me")
    lined = dealt.withColumn("next", F.lead(me).over(inside)).withColumn("place", F.row_number().over(inside))
    heads = lined.filter(F.col("place") == 1).select("part", me)
    ends = Window.orderBy("part")
    heads = heads.withColumn("follow", F.lead("me").over(ends)).withColumn("first", F.first("me").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("part", F.coalesce("follow", "first").alias("after"))
    out = lined.join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    return out.select("doc_id", "mark", "n_chars", F.col("next.doc_id").alias("next_id"), F.col("next.mark").alias("next_mark"))


def fingerprint_digest(docs: DataFrame, radius: int = 3, query_every: int = 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and near_rows: for ids
    divisible by ``query_every`` the other rows whose fingerprint lies within ``radius`` bits, else null.

    The edited text is the document's with the last half of its code points replaced by the first ones of the next
    document. Texts are shuffled twice, once whole and once
    their beginnings. Rows equal in id and text are one where the next document is meant."""
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    chain = stored(successors(marked.select("doc_id", "mark", F.char_length("text").alias("n_chars"))), "successors")
    on = lambda a, b, i, m: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.{i}")) & (F.col(f"{a}.mark") == F.col(f"{b}.{m}"))
    # a document's beginning goes to the one before it, as much as that needs
    giver = marked.alias("m").join(chain.hint("merge").alias("c"), on("m", "c", "next_id", "next_mark"))
    heads = giver.select(F.col("c.doc_id").alias("doc_id"), F.col("c.mark").alias("mark"), "c.n_chars", "c.next_id", "c.next_mark", F.substring(F.col("m.text"), F.lit(1), F.floor(F.col("c.n_chars") / 2).cast("int")).alias("head"))
    both = marked.alias("m").join(heads.hint("merge").alias("h"), on("m", "h", "doc_id", "mark"))
    edited = F.concat(F.substring(F.col("m.text"), F.lit(1), (F.col("h.n_chars") - F.floor(F.col("h.n_chars") / 2)).cast("int")), F.col("h.head"))
    rows = both.select("m.doc_id", "m.mark", "h.n_chars", "h.next_id", "h.next_mark", "m.text", edited.alias("edited"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("k")
    keys = ["doc_id", "mark", "n_chars", "next_id", "next_mark", "sha"]
    # equal rows meet in one group: their votes and the total grow alike, which leaves the signs
    printed = rows.withColumn("sha", F.sha2(F.encode("edited", "utf-8"), 256)).select(*keys, kinds).select(*keys, "k.kind", "k.text")
    printed = stored(fingerprints(printed, [*keys, "kind"]), "fingerprints")
    own = printed.filter("kind = 0")
    o, e, x = own.alias("o"), printed.filter("kind = 1").select("doc_id", "mark", "hi", "lo").alias("e"), own.select("doc_id", "mark", "hi", "lo").alias("x")
    like = lambda a, b: 1 - distance(a, b) / F.lit(4.0 * HALF)
    out = o.join(e, on("o", "e", "doc_id", "mark")).join(x, F.col("o.next_id").eqNullSafe(F.col("x.doc_id")) & (F.col("o.next_mark") == F.col("x.mark")))
    out = out.select("o.doc_id", "o.mark", "o.n_chars", F.col("o.sha").alias("edited_sha256"), "o.hi", "o.lo", as_text(F.col("o.hi"), F.col("o.lo")).alias("fingerprint"), as_text(F.col("e.hi"), F.col("e.lo")).alias("edited_fingerprint"), like("o.", "e.").alias("near_edited"), like("o.", "x.").alias("near_next"))

    # every row of the table again, each with its fingerprint
    r = marked.select("doc_id", "mark").alias("r")
    rows = r.join(out.alias("o"), on("r", "o", "doc_id", "mark")).select("o.*")
    asked = F.coalesce(F.col("doc_id") % query_every == 0, F.lit(False))
    near = within_radius(rows.filter(asked), rows, radius).groupBy("q_hi", "q_lo").agg((F.sum("n") - 1).alias("near_rows"))
    rows = rows.alias("o").join(near.alias("n"), (F.col("o.hi") == F.col("n.q_hi")) & (F.col("o.lo") == F.col("n.q_lo")), "left")
    return rows.select("o.doc_id", F.col("o.n_chars").cast("long").alias("n_chars"), "o.edited_sha256", "o.fingerprint", "o.edited_fingerprint", "o.near_edited", "o.near_next", F.when(asked, F.col("n.near_rows")).alias("near_rows"))
