from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import estimate as E

EXPECTED = [
    (12_000_000, 5_000_000, "jpeg", "avif", 80, 1464044),
    (12_000_000, 5_000_000, "jpeg", "heic", 80, 2091492),
    (12_000_000, 5_000_000, "jpeg", "jpeg", 80, 3764685),
    (12_000_000, 5_000_000, "jpeg", "png", 80, 12548949),
    (12_000_000, 5_000_000, "jpeg", "webp", 50, 1281762),
    (12_000_000, 5_000_000, "jpeg", "heic", 95, 2753404),
    (12_000_000, 3_000_000, "heif", "avif", 80, 1396725),
    (4_000_000, 1_000_000, "jpeg", "heic", 30, 96451),
    (4_000_000, 1_000_000, "jpeg", "heic", 60, 292384),
    (4_000_000, 1_000_000, "jpeg", "heic", 90, 559371),
    (1_000_000, 1_000_000, "png", "heic", 80, 125000),
    (12_000_000, 1000, "jpeg", "jpeg", 100, 1200),
    (100, 100, "other", "webp", 80, 120),
    (0, 5000, "jpeg", "heic", 80, 0),
]
KIND = "id string, pixels long, source_bytes long, family string, has_alpha boolean"


def frame(spark, rows):
    return spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], KIND)


@pytest.mark.parametrize("case", EXPECTED)
def test_prediction(spark, case):
    px, source, family, target, quality, size = case
    assert frame(spark, [(px, source, family, False)]).select(E.predicted(target, quality)).first()[0] == size


def test_alpha_costs_more(spark):
    assert frame(spark, [(1_000_000, 1_000_000, "png", True)]).select(E.predicted("webp", 80)).first()[0] == 182000


BATCH = [(12_000_000, 5_000_000, "jpeg", False), (1_000_000, 1_000_000, "png", False), (4_000_000, 1_000_000, "heif", False)]


def test_prior_and_anchor(spark):
    rows = frame(spark, BATCH)
    assert tuple(E.prior(rows, "heic", 80).first()) == (1584879, 2881599, 4178319, 0.25)
    assert tuple(E.anchored(rows, "0", 3137238, "heic", 80).first()) == (3089610, 3961039, 4832468, 0.55)
    assert tuple(E.anchored(rows, "none", 3137238, "heic", 80).first()) == (1584879, 2881599, 4178319, 0.25)
    assert E.prior(rows.limit(0), "heic", 80).first()["expected"] == 0


def synthetic(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        px, detail = int(r.uniform(0.5e6, 12e6)), r.uniform(0.2, 1.0)
        family = r.choice(["jpeg", "heif", "avif", "webp", "png", "other"])
        out.append((px, int(px * E.SOURCE_BPP[family] * detail * 2 / 8), family, False))
    return out


def test_calibration_comes_near_the_truth(spark):
    rows = frame(spark, synthetic(4, 200)).withColumn("predicted", E.predicted("heic", 80)).withColumn("actual", F.round(F.col("predicted") * (0.7 + F.col("id").cast("int") % 7 * 0.02)).cast("long"))
    truth = rows.agg(F.sum("actual")).first()[0]
    samples = rows.filter(F.col("id").cast("int") % 10 == 0)
    out = E.calibrated(rows.drop("predicted", "actual"), samples, "heic", 80).first()
    assert abs(out.expected - truth) / truth < 0.08
    broken = samples.withColumn("actual", F.when(F.col("id") == "0", F.col("actual") * 50).otherwise(F.col("actual")))
    assert abs(E.calibrated(rows.drop("predicted", "actual"), broken, "heic", 80).first().expected - truth) / truth < 0.15
    everything = E.calibrated(rows.drop("predicted", "actual"), rows, "heic", 80).first()
    assert abs(everything.expected - truth) / truth < 0.03
    plain = E.calibrated(rows.drop("predicted", "actual"), samples.limit(0), "heic", 80).first()
    assert tuple(plain) == tuple(E.prior(rows, "heic", 80).first())


def test_spread_order(spark):
    small = [(1000 * (k + 1), 1, "jpeg", False) for k in range(5)]
    other = [(1000 * (k + 1), 1, "png", False) for k in range(3)]
    rows = frame(spark, small + other).withColumn("idx", F.col("id").cast("long"))
    assert [int(r.id) for r in E.stratified_sample(rows, 6).orderBy("place").collect()] == [4, 7, 0, 5, 3, 6]
    assert [int(r.id) for r in E.stratified_sample(rows, 99).orderBy("place").collect()] == list(range(8))
    assert E.stratified_sample(rows, 0).count() == 0


def test_savings(spark):
    out = E.batch_savings(frame(spark, BATCH), "heic", 80).first()
    assert (out["items"], out.original) == (3, 7_000_000) and 0 < out.saved <= out.original
    empty = E.batch_savings(frame(spark, BATCH).limit(0), "heic", 80).first()
    assert (empty.original, empty.output, empty.percent, empty.is_approximation) == (0, 0, 0, False)


def test_ratio_and_policy(spark):
    assert E.compression_ratio("avif", 80) < E.compression_ratio("heic", 80) < E.compression_ratio("jpeg", 80) <= 0.95
    assert E.resolve_auto("auto", heif=True) == "heic" and E.resolve_auto("auto") == "jpeg" and E.resolve_auto("png", heic=True) == "png"
    chain = lambda t, a: spark.range(1).select(E.fallback_chain(F.lit(t), F.lit(a))).first()[0]
    assert chain("avif", True) == ["avif", "webp", "png"] and chain("jpeg", True) == ["webp", "png"]
    assert chain("auto", False) == ["webp", "jpeg", "png"] and chain("png", False) == ["png", "webp", "jpeg"]


def test_exact_median_of_many(spark):
    """Ten million ratios with ties: narrowed to what fits, equal to the aggregate."""
    from halyard.operators.median import exact_median

    rows = spark.range(10_000_000, numPartitions=8).select(F.round(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0, 2).alias("r"))
    assert exact_median(rows, "r", fits=1000) == rows.agg(F.median("r")).first()[0]


def test_exact_median_of_odd_values(spark):
    import random
    from statistics import median

    from halyard.operators.median import exact_median

    r = random.Random(2)
    sets = [[1.0], [1.0, 2.0], [5.0] * 400, [1.0] * 200 + [9.0] * 200, [1.0] * 200 + [9.0] * 201, [10.0**k for k in range(-150, 150)], [-x / 7 for x in range(333)], [r.choice([0.0, 1e-9, 1e300, r.random()]) for _ in range(501)]]
    for values in sets:
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert exact_median(rows, "v", fits=4) == median(values)
    assert exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
