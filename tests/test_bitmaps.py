"""Selections as bitmaps: the same rows as selections of ids."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import catalog_index as C
from halyard.plans import view as V
from halyard.plans.bitmaps import BITS, Facets, Selection
from halyard.plans.rank_index import RankIndex


@pytest.fixture(scope="module")
def facets(spark):
    n = 70_001  # three buckets
    k = F.col("id")
    rows = spark.range(n).select(
        F.concat(F.lit("a"), k).alias("id"), (1 + F.pmod(F.xxhash64(k), F.lit(2))).cast("int").alias("type"), F.pmod(F.xxhash64(k + 1), F.lit(900)).alias("created_date"),
        F.when(k % 5 != 0, k * 400).alias("size_bytes"), F.concat(F.lit("x"), k, F.when(k % 3 == 0, ".MOV").otherwise(".jpg")).alias("title"),
    )
    return Facets.built(RankIndex.built(C.as_assets(rows), V.planned(V.View()), rows_per_file=9_000))


def places(spark, chosen):
    return spark.createDataFrame([(p,) for p in chosen], "position long")


def held(s, index):
    return sorted(r.position for r in s.rows(index).select("position").collect())


def test_sets_of_random_places(spark, facets):
    r = random.Random(3)
    n = facets.index.count()
    edges = [0, 7, 8, BITS - 1, BITS, 2 * BITS - 1, 2 * BITS, n - 1]
    a, b, c = ({*r.sample(range(n), size), *r.sample(edges, 4)} for size in (3_000, 40, 20_000))
    A, B, C_ = (Selection.of(places(spark, [*s, *list(s)[:50], None])).stored() for s in (a, b, c))
    for got, want in ((A.union(B, C_), a | b | c), (A.meet(C_), a & c), (A.minus(C_), a - c), (B.minus(A), b - a), (A.minus(A), set()), (A.meet(B, C_), a & b & c)):
        assert got.count().first()["n"] == len(want)
        assert got.first().first()["position"] == min(want, default=None)
        assert held(got, facets.index) == sorted(want)
    nothing = Selection.of(places(spark, []))
    assert nothing.count().first()["n"] == 0 and nothing.first().first()["position"] is None
    assert held(A.minus(nothing), facets.index) == sorted(a) and held(nothing.union(B), facets.index) == sorted(b) and held(A.meet(nothing), facets.index) == []


@pytest.mark.parametrize("first, last", [(0, 0), (5, 5), (3, 12), (0, BITS - 1), (BITS - 1, BITS), (10, 2 * BITS + 9), (BITS, 10**9), (-5, 3), (9, 8), (10**9, 10**9 + 1)])
def test_places_between(facets, first, last):
    assert held(Selection.between(facets.index, first, last), facets.index) == list(range(max(first, 0), min(last, facets.index.count() - 1) + 1))


def test_choices_equal_those_of_ids(spark, facets):
    """Run, select-all, filters, removal and lock against the selections of ids."""
    index, rows = facets.index, facets.index.placed()
    for v in (V.View(), V.View("photos", size="small"), V.View("videos", "smallest", "medium", "mov"), V.View(format="jpeg"), V.View(size="large")):
        assert held(facets.matching(v), index) == sorted(r.position for r in V.matching(rows, V.planned(v)).collect())
        for lock in (None, 1, 2):
            assert facets.select_all(v, lock).count().first()["n"] == V.select_all(rows, v, lock).count()
    asked = [V.View(kind, size=size, format=f) for kind in V.TYPES for size in V.BUCKETS for f in (None, "mov")]
    counted = {(r.kind, r.size, r.format): r.n for r in facets.counts(asked).collect()}
    assert len(counted) == len(asked) and all(counted[v.kind, v.size, v.format] == facets.matching(v).count().first()["n"] for v in asked[::5])
    base = Selection.of(places(spark, range(90))).stored()
    for anchor, to in ((60_000, 20), (100, 40_000), (7, 7), (69_999, 80_000), (90_000, 5)):
        want = V.select_run(rows, rows.filter("position < 90"), anchor, to)
        assert sorted(r.id for r in facets.run(base, anchor, to).rows(index).collect()) == sorted(r.id for r in want.collect())
    left = facets.run(base, 60_000, 20).minus(facets.matching(V.View(format="mov")))
    assert held(left, index) == sorted(r.position for r in V.select_run(rows, rows.filter("position < 90"), 60_000, 20).join(rows, "id").filter(~V.has_format(("mov", "quicktime"))).collect())
    far = Selection.of(places(spark, [5_000, 40_000]))
    assert facets.lock(far).first()["type"] == rows.filter("position = 5000").first()["type"]
    assert facets.lock(base.minus(base)).first()["type"] is None


def test_no_id_is_shuffled(spark, facets):
    """The bits of a run without what a filter shows are found and looked up without an exchange that has an id in it."""
    chosen = facets.run(facets.matching(V.View(size="small")), 60_000, 20).minus(facets.matching(V.View(format="mov")))
    looked_up = chosen.rows(facets.index).select("id")
    for df in (chosen.buckets, looked_up):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for k, line in enumerate(lines):
            if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
                assert "bucket" in line or "path" in line, line


def test_unfiltered_views_only(spark, facets):
    with pytest.raises(ValueError):
        Facets.built(RankIndex.built(facets.index.placed().drop("position"), V.planned(V.View("photos"))))


def test_empty_table(spark):
    rows = C.as_assets(spark.createDataFrame([], "id string, type int, created_date long, size_bytes long"))
    facets = Facets.built(RankIndex.built(rows, V.planned(V.View())))
    assert facets.select_all(V.View()).count().first()["n"] == 0 and facets.run(facets.matching(V.View()), 0, 5).rows(facets.index).count() == 0
