"""Selections as bitmaps over the places of a stored view.

The ids are numbered once, by their place in a stored view (``RankIndex``). A selection is then rows of (bucket, bits): bit k
of bucket b stands for place 32768 (b - 1) + k, and empty buckets are left out. Each task sets the bits of its own rows, so
what is shuffled is a bit a row and never an id; union, difference, meeting and counting shuffle buckets of 4 KB alone.
``Facets`` holds such a selection for every kind, size bucket and format, from one pass over the view: what select-all takes
is then the common bits of three of them, and a run over places is a mask.

A selection holds for one version of a table. An empty one has no buckets. Two selections may be combined only if they are
over the same stored view.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.plans.rank_index import RankIndex
from halyard.plans.view import BUCKETS, NEEDLES, TYPES, View, planned, predicate
from halyard.schema import IMAGE, VIDEO
from halyard.scratch import spooled

BITS = 32_768  # a bucket of Spark's bitmap functions
SENT = 8_192  # buckets, 32 MB, up to which a selection is sent to the tasks that look its ids up


def _buckets(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bits) of the rows' ``position``; the functions of Spark count from 1."""
    at = F.col("position") + 1
    return rows.groupBy(*keys, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def _inverted(bits: Column) -> Column:
    return F.unhex(F.translate(F.hex(bits), "0123456789ABCDEF", "FEDCBA9876543210"))


def _byte(bits: Column, k: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, k + 1, F.lit(1))), 16, 10).cast("int")


@dataclass(frozen=True)
class Selection:
    """Chosen places of one stored view: (bucket long, bits binary), a row a bucket."""

    buckets: DataFrame

    @staticmethod
    def of(rows: DataFrame) -> Selection:
        """The places in ``rows(position)``; repeated ones are one, null ones none."""
        return Selection(_buckets(rows.filter(F.col("position").isNotNull()).select("position")))

    @staticmethod
    def between(index: RankIndex, first: int, last: int) -> Selection:
        """All places from ``first`` to ``last`` of the view, without looking at a row."""
        first, last = max(first, 0), min(last, index.count() - 1)
        low, high = first // BITS, last // BITS
        if last < first:
            low, high = 0, -1
        b = F.col("bucket") - 1

        def side(edge: int, keep_from: bool) -> Column:
            byte, bit = divmod(edge % BITS, 8)
            if keep_from:
                return F.concat(F.repeat(F.lit("00"), F.lit(byte)), F.lit(f"{0xFF << bit & 0xFF:02X}"), F.repeat(F.lit("FF"), F.lit(BITS // 8 - 1 - byte)))
            return F.concat(F.repeat(F.lit("FF"), F.lit(byte)), F.lit(f"{(2 << bit) - 1:02X}"), F.repeat(F.lit("00"), F.lit(BITS // 8 - 1 - byte)))

        known = index.spark.range(low + 1, high + 2).withColumnRenamed("id", "bucket")
        begun = known.select("bucket", F.unhex(F.when(b == low, side(first, True)).otherwise(F.repeat(F.lit("FF"), F.lit(BITS // 8)))).alias("bits"))
        ended = known.filter(b == high).select("bucket", F.unhex(side(last, False)).alias("bits"))
        # the last bucket's bits are those of both masks
        return Selection(begun.unionByName(ended).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits")))

    def stored(self) -> Selection:
        """Written once, for a selection that is used several times."""
        return Selection(spooled(self.buckets, "selection"))

    def union(self, *others: Selection) -> Selection:
        every = reduce(DataFrame.unionByName, (s.buckets for s in (self, *others)))
        return Selection(every.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")))

    def meet(self, *others: Selection) -> Selection:
        """What all of them hold."""
        every = reduce(DataFrame.unionByName, (s.buckets for s in (self, *others)))
        common = every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
        return Selection(common.filter((F.col("n") == len(others) + 1) & (F.bitmap_count("bits") > 0)).select("bucket", "bits"))

    def minus(self, other: Selection) -> Selection:
        """What this one holds and the other does not."""
        every = self.buckets.withColumn("own", F.lit(1)).unionByName(other.buckets.select("bucket", _inverted(F.col("bits")).alias("bits"), F.lit(0).alias("own")))
        left = every.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.max("own").alias("own"))
        return Selection(left.filter((F.col("own") == 1) & (F.bitmap_count("bits") > 0)).select("bucket", "bits"))

    def count(self) -> DataFrame:
        """One row: ``n``."""
        return self.buckets.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))

    def first(self) -> DataFrame:
        """One row: the smallest chosen ``position``; null for none."""
        some = F.hex("bits")
        byte = F.floor((F.length(some) - F.length(F.ltrim(some, F.lit("0")))) / 2).cast("int")
        least = self.buckets.filter(F.bitmap_count("bits") > 0).select("bucket", byte.alias("byte"), _byte(F.col("bits"), byte).alias("value"))
        low = F.bit_count((F.col("value").bitwiseAND(-F.col("value"))) - 1)
        return least.agg(F.min((F.col("bucket") - 1) * BITS + F.col("byte") * 8 + low).alias("position"))

    def rows(self, index: RankIndex) -> DataFrame:
        """The chosen rows of the view with their ``position``, unsorted.

        Up to ``SENT`` buckets (268 million places) go to the tasks that read the view, so no id moves; larger selections are
        joined by bucket."""
        held = self.stored().buckets
        n = held.count()
        sent = F.broadcast(held) if n <= SENT else held
        at = F.col("position") + 1
        placed = index.placed().withColumns({"bucket": F.bitmap_bucket_number(at), "__bit": F.bitmap_bit_position(at).cast("int")})
        found = placed.join(sent, "bucket")
        return found.filter(F.bit_get(_byte(F.col("bits"), F.shiftright("__bit", 3)), F.col("__bit").bitwiseAND(7)) == 1).drop("bucket", "bits", "__bit")


@dataclass(frozen=True)
class Facets:
    """A selection for each kind, size bucket and format over a view of the whole table, in one stored table."""

    index: RankIndex
    table: DataFrame

    @staticmethod
    def built(index: RankIndex, formats: Iterable[str] = tuple(NEEDLES)) -> Facets:
        """One pass over ``index``, a view without filters: each row sets a bit in each of its facets."""
        if predicate(index.p) is not None:
            raise ValueError("facets are counted over a view of the whole table")
        choices = {f"kind:{k}": View(kind=k) for k in TYPES if k != "all"} | {f"size:{s}": View(size=s) for s in BUCKETS if s != "any"} | {f"format:{f}": View(format=f) for f in formats}
        names = F.array(F.lit("all"), *(F.when(predicate(planned(v)), F.lit(name)) for name, v in choices.items()))
        rows = index.placed().select("position", F.explode(F.array_compact(names)).alias("facet"))
        return Facets(index, spooled(_buckets(rows, "facet").repartition("facet").sortWithinPartitions("facet", "bucket"), "facets"))

    def facet(self, name: str) -> Selection:
        return Selection(self.table.filter(F.col("facet") == name).select("bucket", "bits"))

    @staticmethod
    def _parts(v: View) -> list[str]:
        return [f"kind:{v.kind}"] * (v.kind != "all") + [f"size:{v.size}"] * (v.size != "any") + [f"format:{v.format}"] * (v.format is not None) or ["all"]

    def matching(self, v: View) -> Selection:
        """What a view shows, whatever its order."""
        first, *rest = map(self.facet, self._parts(v))
        return first.meet(*rest) if rest else first

    def counts(self, views: list[View]) -> DataFrame:
        """(kind, size, format, n): how many rows each view shows, for all of them at once; no format is null."""
        spark = self.index.spark
        asked = [(k, v.kind, v.size, v.format, len(self._parts(v))) for k, v in enumerate(views)]
        wanted = spark.createDataFrame(asked, "view int, kind string, size string, format string, parts int")
        parts = spark.createDataFrame([(k, p) for k, v in enumerate(views) for p in self._parts(v)], "view int, facet string")
        met = self.table.join(F.broadcast(parts), "facet").groupBy("view", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("held"))
        shown = met.join(F.broadcast(wanted), "view").filter(F.col("held") == F.col("parts")).groupBy("view").agg(F.sum(F.bitmap_count("bits")).alias("n"))
        return wanted.join(shown, "view", "left").select("kind", "size", "format", F.coalesce("n", F.lit(0)).alias("n"))

    def select_all(self, v: View, locked: int | None = None) -> Selection:
        """What select-all takes: one type, the lock's if any, else videos or images as the view shows."""
        kind = locked if locked is not None else VIDEO if v.kind == "videos" else IMAGE
        return self.matching(View({IMAGE: "photos", VIDEO: "videos"}[kind], v.sort, v.size, v.format))

    def run(self, base: Selection, anchor: int, to: int) -> Selection:
        """A selection after a drag from place ``anchor`` to ``to``: the base and the run's entries of the anchor's type."""
        at = self.index.run(anchor, anchor).select("type").first()
        name = {IMAGE: "kind:photos", VIDEO: "kind:videos"}.get(at["type"]) if at else None
        if name is None:
            return base if at is None else base.union(Selection.of(self.index.run(min(anchor, to), max(anchor, to)).filter(F.col("type") == at["type"])))
        return base.union(self.facet(name).meet(Selection.between(self.index, min(anchor, to), max(anchor, to))))

    def lock(self, chosen: Selection) -> DataFrame:
        """One row: the type of the first chosen entry in view order; null for none."""
        place = chosen.first().first()["position"]
        if place is None:
            return self.index.spark.createDataFrame([(None,)], "type int")
        return self.index.run(place, place).select("type")
