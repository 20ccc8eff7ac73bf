"""Stored views: pages, runs and places from the files that hold them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from halyard.operators import catalog_index as C
from halyard.plans import view as V
from halyard.plans.rank_index import RankIndex
from halyard.schema import ASSETS
from halyard.sources.catalog import VersionedTable
from tests.test_catalog import ids


def made(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(f"a{k}", 1 + k % 2, r.randrange(50), r.choice([None, 0, *range(40)])) for k in range(n)]
    return C.as_assets(spark.createDataFrame(rows, "id string, type int, created_date long, size_bytes long"))


@pytest.mark.parametrize("sort", ["newest", "oldest", "largest", "smallest"])
def test_index_of_a_view_with_ties(spark, sort):
    """Many equal keys, unknown and zero sizes: pages, runs and places are those of the sorted view."""
    rows = made(spark, 700)
    p = V.planned(V.View("photos", sort))
    index = RankIndex.built(rows, p, rows_per_file=60)
    want = ids(V.entries(rows, p))
    assert index.count() == len(want) == 350 and [r.id for r in index.placed().orderBy("position").collect()] == want
    for at, n in ((0, 10), (55, 130), (340, 50), (400, 5)):
        assert ids(index.page(at, n)) == want[at : at + n]
    assert sorted(index.run(100, 180).select("id", "position").collect()) == sorted((want[k], k) for k in range(100, 181))
    held = {r.id: r[p.order] for r in rows.collect()}
    assert [index.place(held[want[k]], want[k]) for k in (0, 59, 60, 61, 200, 349)] == [0, 59, 60, 61, 200, 349]
    assert index.place(7, "nobody") is None
    some = spark.createDataFrame([(want[5],), (want[300],), ("nobody",)], "id string")
    assert sorted((r.id, r.position) for r in index.places(some).collect()) == sorted([(want[5], 5), (want[300], 300)])
    assert RankIndex.built(rows.limit(0), p).page(0, 5).count() == 0


def test_a_page_reads_its_files_alone(spark):
    """A page at 100,000 of 150,000 rows opens two files at most."""
    rows = C.as_assets(spark.range(150_000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("type"), (F.xxhash64("id") % 9000).alias("created_date")))
    index = RankIndex.built(rows, V.planned(V.View()), rows_per_file=10_000)
    page = index.page(100_000, 100)
    assert len(page.inputFiles()) <= 2 and len(set(index.placed().inputFiles())) >= 15
    assert [r.position for r in page.collect()] == list(range(100_000, 100_100))
    assert ids(page) == ids(V.page(rows, V.planned(V.View()), 100_000, 100))


def test_index_is_stored_once_a_version(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    table.write(made(spark, 50))
    p = V.planned(V.View())
    first = RankIndex.of(table, p, f"file://{tmp_path}/views")
    assert RankIndex.of(table, p, f"file://{tmp_path}/views").folder == first.folder
    assert RankIndex.of(table, V.planned(V.View(sort="oldest")), f"file://{tmp_path}/views").folder != first.folder
    table.change(lambda now: C.delete_ids(now, now.filter("type = 1").select("id")))
    later = RankIndex.of(table, p, f"file://{tmp_path}/views")
    assert later.folder != first.folder and (first.count(), later.count()) == (50, 25)
