"""Result sizes before anything is encoded: a model per row, calibrated on samples or on one encoded anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.numbers import bits_per_pixel, clamp, pixels
from halyard.functions.text import extension, family
from halyard.operators.median import exact_median
from halyard.schema import FAMILIES
from halyard.scratch import spooled

# Fixed values of the model: bits per pixel of a target, and of a source family at full detail.
TARGET_BPP = {"jpeg": 1.8, "heic": 1.0, "avif": 0.7, "webp": 1.3, "png": 6.0, "auto": 1.0}
SOURCE_BPP = {"jpeg": 2.2, "heif": 1.4, "avif": 1.0, "webp": 1.6, "png": 8.0, "other": 2.0}
# Fixed values of the older ratio model.
RATIO = {"avif": 0.32, "heic": 0.50, "webp": 0.60, "jpeg": 0.90, "png": 0.95, "auto": 0.40}


def one_of(c: Column, values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[c]


def once(df: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """``keep`` and the columns, as a generator of one row: no filter or use of a column is moved below it, so what a column
    stands for is in the generated code once."""
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def items(assets: DataFrame, alpha: Column | None = None) -> DataFrame:
    """id, pixels, source_bytes, family, has_alpha of assets."""
    return once(assets, ["id"], pixels(F.col("width"), F.col("height")).alias("pixels"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("source_bytes"), family(F.col("mime_type"), F.col("title")).alias("family"), (F.lit(False) if alpha is None else alpha).alias("has_alpha"))


def quality_factor(quality: int) -> float:
    return min(max((min(max(quality, 1), 100) / 80) ** 1.6, 0.15), 3.5)


def predicted(target: str, quality: int) -> Column:
    """Bytes that an item (pixels, source_bytes, family, has_alpha) is expected to take."""
    # every part is named once, or the generated code would repeat what it stands for
    bpp = bits_per_pixel(F.col("source_bytes"), F.col("pixels"))
    detail = F.when(F.col("family") == "png", F.lit(0.35)).otherwise(F.lit(1.0))  # png sizes follow detail less
    complexity = F.pow(bpp / one_of(F.col("family"), SOURCE_BPP), F.lit(0.8)) * detail + (1 - detail)
    rate = F.lit(TARGET_BPP[target] * quality_factor(quality)) * clamp(complexity, 0.3, 3.0)
    if target != "jpeg":
        rate = rate * F.when(F.col("has_alpha"), F.lit(1.12)).otherwise(F.lit(1.0))
    size = F.greatest(F.round(F.col("pixels") * rate / 8).cast("long"), F.lit(512).cast("long"))
    if target != "png":  # least() passes over the null of an unknown source
        size = F.least(size, F.when(F.col("source_bytes") > 0, F.round(F.col("source_bytes") * 1.2).cast("long")))
    return F.when(F.col("pixels") > 0, size).otherwise(F.lit(0)).cast("long")


def tier(bpp: Column) -> Column:
    return F.when(bpp < 1.2, 0).when(bpp < 2.6, 1).when(bpp < 4.0, 2).otherwise(3)


def strata(df: DataFrame) -> DataFrame:
    number = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
    return df.withColumn("tier", tier(bits_per_pixel(F.col("source_bytes"), F.col("pixels")))).withColumn("family_no", number.cast("int"))


def _band(expected: Column, half: Column, confidence: Column) -> list[Column]:
    whole = lambda c: F.coalesce(F.round(c).cast("long"), F.lit(0))
    e = whole(expected)
    return [whole(e * (1 - half)).alias("low"), e.alias("expected"), whole(e * (1 + half)).alias("high"), confidence.alias("confidence")]


def _exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.coalesce(F.sum(c.cast("decimal(30,6)")), F.lit(0).cast("decimal(38,6)")).cast("double")


def prior(df: DataFrame, target: str, quality: int) -> DataFrame:
    """One row: low, expected, high, confidence from the model alone."""
    return df.agg(F.coalesce(F.sum(predicted(target, quality)), F.lit(0)).alias("p")).select(*_band(F.col("p").cast("double"), F.lit(0.45), F.lit(0.25)))


def by_stratum(df: DataFrame, target: str, quality: int) -> DataFrame:
    """family, tier, e: the model's bytes of each stratum. All that calibrates the model depends on a row's stratum alone,
    so one pass with partial sums leaves 24 rows at most, which later steps join."""
    rows = strata(df.select("pixels", "source_bytes", "family", "has_alpha"))
    return rows.groupBy("family", "tier").agg(F.sum(predicted(target, quality)).alias("e"))


def calibrated(df: DataFrame, samples: DataFrame, target: str, quality: int) -> DataFrame:
    """One row: the model times what samples (pixels, source_bytes, family, predicted, actual) show.

    Ratios beyond a third or three times their median are left out. An item takes the factor of its family and tier
    if two samples have both, else its tier's, else the common one; all three come from one pass over grouping
    sets. Without a usable sample it is the prior. The medians are exact, whatever the number of samples
    (``exact_median``); the driver holds them alone. The factors, at most 29 rows, are broadcast."""
    ratio = F.when(F.col("predicted") > 0, F.col("actual") / F.col("predicted").cast("double"))
    usable = once(strata(samples), [], F.col("family"), F.col("tier"), F.col("predicted"), F.col("actual"), ratio.alias("ratio")).filter("ratio is not null")
    usable = spooled(usable, "samples")
    middle = F.lit(exact_median(usable, "ratio")).cast("double")
    kept = usable.filter((middle > 0) & F.col("ratio").between(middle / 3, middle * 3))
    sums = kept.groupingSets([["family", "tier"], ["tier"], []], "family", "tier").agg(F.sum("actual").alias("a"), F.sum("predicted").alias("p"), F.count(F.lit(1)).alias("n"), F.grouping_id("family", "tier").alias("g"))
    factors = sums.filter(F.col("n") > 0).withColumn("alpha", F.col("a") / F.col("p").cast("double"))
    fine = factors.filter("g = 0 and n >= 2").select("family", "tier", F.col("alpha").alias("fine"))
    coarse = factors.filter("g = 2 and n >= 2").select("tier", F.col("alpha").alias("coarse"))
    common = factors.filter("g = 3").select(F.col("alpha").alias("common"), F.col("n").alias("n_kept"))
    apart = kept.crossJoin(F.broadcast(common)).select(F.abs(F.col("ratio") - F.col("common")).alias("apart"))
    mad = F.lit(exact_median(apart, "apart")).cast("double")
    # one row, of nulls if no sample is kept
    spread = common.agg(F.first("common").alias("common"), F.first("n_kept").alias("n_kept"))
    rel = F.when(F.col("common") > 0, clamp(mad / F.col("common"), 0.0, 1.0)).otherwise(0.5)
    half = clamp(rel / F.sqrt(F.col("n_kept").cast("double")), 0.04, 0.5)
    spread = spread.select(F.col("common"), half.alias("half"))
    each = by_stratum(df, target, quality).join(F.broadcast(fine), ["family", "tier"], "left").join(F.broadcast(coarse), "tier", "left").crossJoin(F.broadcast(spread))
    total = each.agg(F.sum("e").alias("p"), F.first("common").alias("common"), F.first("half").alias("half"), _exact_sum(F.col("e") * F.coalesce("fine", "coarse", "common")).alias("x"))
    known = F.col("common").isNotNull()
    plain = F.coalesce(F.col("p"), F.lit(0)).cast("double")
    confidence = F.when(known, clamp(1 - F.col("half"), 0.0, 0.97)).otherwise(0.25)
    return total.select(*_band(F.when(known, F.col("x")).otherwise(plain), F.when(known, F.col("half")).otherwise(0.45), confidence))


def anchored(df: DataFrame, anchor_id: str, actual: Column | int, target: str, quality: int) -> DataFrame:
    """One row: the model corrected by one encoded item, the more the closer an item's family and tier are to its."""
    ratio = F.col("actual") / F.col("e").cast("double")
    ok = (F.col("e") > 0) & (F.col("actual") > 0)
    anchor = strata(df.filter(F.col("id") == anchor_id)).withColumn("e", predicted(target, quality)).withColumn("actual", F.lit(actual).cast("long"))
    anchor = anchor.limit(1).agg(F.first("family").alias("a_family"), F.first("tier").alias("a_tier"), F.first(F.when(ok, clamp(ratio, 0.2, 5.0))).alias("ratio"))
    apart = F.abs(F.col("tier") - F.col("a_tier"))
    same = F.col("family") == F.col("a_family")
    weight = F.when(same & (apart == 0), 0.9).when(same & (apart == 1), 0.6).when(apart == 0, 0.5).when(apart == 1, 0.35).otherwise(0.22)
    sums = by_stratum(df, target, quality).crossJoin(F.broadcast(anchor)).agg(F.first("ratio").alias("ratio"), F.sum("e").alias("p"), _exact_sum(F.col("e") * (1 + (F.col("ratio") - 1) * weight)).alias("x"))
    known = F.col("ratio").isNotNull()
    plain = F.coalesce(F.col("p"), F.lit(0)).cast("double")
    return sums.select(*_band(F.when(known, F.col("x")).otherwise(plain), F.when(known, 0.22).otherwise(0.45), F.when(known, 0.55).otherwise(0.25)))


def batch_savings(df: DataFrame, target: str, quality: int) -> DataFrame:
    """One row of totals: each result is at most its source."""
    size = predicted(target, quality)
    capped = F.when(F.col("source_bytes") > 0, F.least(size, F.col("source_bytes"))).otherwise(size)
    sums = df.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("original"), F.coalesce(F.sum(capped), F.lit(0)).alias("output"))
    saved = clamp(F.col("original") - F.col("output"), F.lit(0), F.col("original"))
    percent = F.when(F.col("original") > 0, F.round(100.0 * saved / F.col("original"))).otherwise(0)
    return sums.select("items", "original", "output", saved.cast("long").alias("saved"), percent.cast("long").alias("percent"), (F.col("items") > 0).alias("is_approximation"))


def compression_ratio(target: str, quality: int) -> float:
    return min(max(RATIO[target] * (0.7 + (quality - 30) / 70 * 0.7), 0.05), 0.95)


def compression_ratios(target: Column, quality: Column) -> Column:
    """The older model's share of the source that is left, for rows of targets and qualities."""
    return clamp(one_of(target, RATIO) * (F.lit(0.7) + (quality - 30) / F.lit(70.0) * 0.7), 0.05, 0.95)


def eta_seconds(df: DataFrame, anchor_id: str, anchor_ms: int) -> DataFrame:
    """One row: seconds for all items at the anchor's milliseconds a megapixel; null without one."""
    anchor = df.filter(F.col("id") == anchor_id).limit(1).agg(F.first("pixels").alias("a_px"))
    total = df.agg(F.coalesce(F.sum("pixels"), F.lit(0)).alias("px"))
    rate = F.when(F.col("a_px") > 0, F.lit(float(anchor_ms)) / (F.col("a_px") / 1e6))
    return total.crossJoin(F.broadcast(anchor)).select((F.col("px") / 1e6 * rate / 1000).alias("seconds"))


def stratified_sample(df: DataFrame, cap: int, index: str = "idx") -> DataFrame:
    """At most ``cap`` items, a turn each from every stratum in the order they first appear, inside one largest, smallest,
    next largest, and so on by pixels. ``place`` is the order taken; where all items are taken, the index's.

    Of a stratum at most ``cap`` items can be taken, half of them from each end of its order, so each task passes on
    that many from each end only."""
    rows = strata(df)
    if cap <= 0:
        return rows.limit(0).withColumn("place", F.lit(0).cast("long"))
    ends, key = cap // 2 + 1, ["family", "tier"]
    largest = Window.partitionBy(*key).orderBy(F.col("pixels").desc(), F.col(index).desc())
    smallest = Window.partitionBy(*key).orderBy("pixels", index)
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first"))
    top = rows.withColumn("at", F.row_number().over(largest)).filter(F.col("at") <= ends).withColumn("turn", 2 * (F.col("at") - 1))
    low = rows.withColumn("at", F.row_number().over(smallest)).filter(F.col("at") <= ends).withColumn("turn", 2 * (F.col("at") - 1) + 1)
    both = top.unionByName(low).join(F.broadcast(counts), key)  # one row a stratum, at most 24
    # an item near both ends has two turns, of which the earlier holds
    reached = F.when(F.col("turn") % 2 == 0, 2 * (F.col("n") - F.col("at")) + 1).otherwise(2 * (F.col("n") - F.col("at")))
    both = both.filter(F.col("turn") < reached)
    total = counts.agg(F.sum("n").alias("total"))
    whole = F.when(F.col("total") <= cap, F.col(index))
    order = [whole.asc(), F.col("turn"), F.col("first")]
    # what is left is at most 24 times cap rows, of which one task takes and numbers cap
    taken = both.crossJoin(F.broadcast(total)).orderBy(*order).limit(cap)
    return taken.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")).select(*rows.columns, "place")


def estimate(assets: DataFrame, selection: DataFrame, choice: str, quality: int, capabilities: dict[str, bool], anchor: tuple[str, int, int] | None = None) -> DataFrame:
    """One row for a selection: band, confidence and seconds left. ``auto`` is resolved first; the anchor (id, bytes, ms)
    counts only if it is selected."""
    from halyard.plans.view import estimate_facts

    target = resolve_auto(choice, **capabilities)
    rows = items(estimate_facts(assets, selection))
    out = anchored(rows, anchor[0], anchor[1], target, quality) if anchor else prior(rows, target, quality)
    seconds = eta_seconds(rows, anchor[0], anchor[2]) if anchor else rows.agg(F.lit(None).cast("double").alias("seconds"))
    return out.crossJoin(F.broadcast(seconds)).withColumn("target", F.lit(target))


def resolve_auto(choice: str, avif_hardware: bool = False, heic: bool = False, heif: bool = False, webp: bool = False) -> str:
    if choice != "auto":
        return choice
    return "avif" if avif_hardware else "heic" if heic or heif else "webp" if webp else "jpeg"


def auto_target(choice: Column) -> Column:
    """The target of rows with the capability columns avif_hardware, heic, heif, webp."""
    best = F.when(F.col("avif_hardware"), "avif").when(F.col("heic") | F.col("heif"), "heic").when(F.col("webp"), "webp").otherwise("jpeg")
    return F.when(choice == "auto", best).otherwise(choice)


def format_policy(choice: Column, has_alpha: Column) -> Column:
    """(target, flatten) of rows with the capability columns avif_hardware, heic, heif, webp."""
    auto = F.when(F.col("avif_hardware"), "avif").when(F.col("heic") | F.col("heif"), "heic").when(F.col("webp"), "webp").when(has_alpha, "png").otherwise("jpeg")
    return F.struct(F.when(choice == "auto", auto).otherwise(choice).alias("target"), (has_alpha & (choice == "jpeg")).alias("flatten"))


def fallback_chain(target: Column, has_alpha: Column) -> Column:
    """Targets to try in turn: alpha images never become jpeg."""
    chain = F.when(has_alpha, F.array(target, F.lit("webp"), F.lit("png"))).otherwise(F.array(target, F.lit("webp"), F.lit("jpeg"), F.lit("png")))
    return F.array_distinct(F.filter(chain, lambda t: (t != "auto") & ~(has_alpha & (t == "jpeg"))))


def capability_defaults(spark) -> DataFrame:
    """What a platform can write, until it is asked."""
    rows = [("ios", True, False, True, False), ("android", False, True, True, False), ("other", False, False, True, False)]
    return spark.createDataFrame(rows, "platform string, heic boolean, heif boolean, webp boolean, avif_hardware boolean")


__all__ = ["anchored", "auto_target", "batch_savings", "calibrated", "capability_defaults", "compression_ratio", "compression_ratios", "estimate", "eta_seconds", "extension", "fallback_chain", "format_policy", "items", "predicted", "prior", "resolve_auto", "strata", "stratified_sample"]
