"""Sync by digest tree: only ranges of ids whose rows differ are joined.

Ids are dealt by hash into ranges, leaves of a tree. A leaf's digest does not depend on the order of its rows: their number, and
the sum and the exclusive-or of their hashes; a node's digest is made of its leaves'. Both sides are compared from the root, and a
level looks at the children of those nodes only that differ. A table's digests can be stored with its version, so that
a sync reads the source once, and of the table what lies in the leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.operators import catalog_index
from halyard.scratch import spooled

#: Leaves are 2 to so many; what is broadcast is at most one number a leaf.
BITS, MOST_BITS, STEP = 16, 20, 6


def leaf(bits: int = BITS) -> Column:
    """The leaf of a row's id: the upper bits of its hash."""
    return F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)


def digests(rows: DataFrame, like: DataFrame, columns: list[str], bits: int = BITS) -> DataFrame:
    """leaf, n, total, odd of ``rows``: the columns count as the types of ``like``, null apart from any value."""
    if not 0 < bits <= MOST_BITS:
        raise ValueError(f"leaves have 1 to {MOST_BITS} bits")
    kinds = {f.name: f.dataType for f in like.schema.fields}
    cast = [F.col(c).cast(kinds[c]) for c in columns]
    h = F.xxhash64("id", *[x for c in cast for x in (c.isNull(), c)])
    return rows.select(leaf(bits).alias("leaf"), h.alias("h")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("h").alias("odd"))


def differing(mine: DataFrame, theirs: DataFrame, bits: int = BITS) -> DataFrame:
    """leaf of each leaf whose digests differ, or that one side lacks. Both sides' digests are paired by leaf and stored once,
    at most 2 to ``bits`` rows, so each level is one look at the pairs."""
    other = theirs.select("leaf", F.col("n").alias("n_"), F.col("total").alias("total_"), F.col("odd").alias("odd_"))
    pairs = spooled(mine.select("leaf", "n", "total", "odd").join(other, "leaf", "full_outer"), "digests")
    up = F.col("leaf").cast("long")
    parents = None
    for depth in [*range(0, bits, STEP), bits]:
        nodes = pairs.withColumn("node", F.call_function("shiftright", up, F.lit(bits - depth)))
        if parents is not None:
            nodes = nodes.withColumn("parent", F.call_function("shiftright", up, F.lit(bits - last))).join(F.broadcast(parents), "parent", "left_semi")
        told = [F.struct(F.sum(f"n{s}").alias("n"), F.sum(f"total{s}").cast("decimal(38,0)").alias("total"), F.bit_xor(f"odd{s}").alias("odd")).alias(f"digest{s}") for s in ("", "_")]
        parents = nodes.groupBy("node").agg(*told).filter(~F.col("digest").eqNullSafe(F.col("digest_"))).select(F.col("node").alias("parent"))
        last = depth
    return parents.select(F.col("parent").alias("leaf"))


def sides(table: DataFrame, source: DataFrame, bits: int = BITS, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(differing leaves, the table's rows in them, the source's rows in them). ``stored``: the table's digests over the source's
    columns, if they are kept."""
    columns = [c for c in source.columns if c in table.columns and c != "id"]
    mine = digests(table, table, columns, bits) if stored is None else stored
    theirs = digests(source, table, columns, bits)
    apart = spooled(differing(mine, theirs, bits), "leaves")
    within = lambda df: df.join(F.broadcast(apart.withColumnRenamed("leaf", "__leaf")), leaf(bits) == F.col("__leaf"), "left_semi")
    return apart, within(table), within(source)


def sync(table: DataFrame, source: DataFrame, bits: int = BITS, stored: DataFrame | None = None) -> DataFrame:
    """``catalog_index.sync``, joining the rows of differing leaves only."""
    apart, mine, theirs = sides(table, source, bits, stored)
    rest = table.join(F.broadcast(apart.withColumnRenamed("leaf", "__leaf")), leaf(bits) == F.col("__leaf"), "left_anti")
    return rest.unionByName(catalog_index.sync(mine, theirs))


def delta(table: DataFrame, source: DataFrame, bits: int = BITS, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the source's rows that are new or differ, the ids that it lacks): what a change log needs to follow the source."""
    _, mine, theirs = sides(table, source, bits, stored)
    columns = [c for c in source.columns if c in table.columns]
    kinds = {f.name: f.dataType for f in table.schema.fields}
    given = theirs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
    held = mine.select(F.col("id"), F.struct(*columns).alias("__held"))
    fresh = given.join(held, "id", "left").filter(~F.struct(*columns).eqNullSafe(F.col("__held"))).select(*columns)
    return fresh, catalog_index.pruned(mine, theirs)
