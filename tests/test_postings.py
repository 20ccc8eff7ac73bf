"""Substring search from posting lists against a look at every text."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from halyard.operators import catalog_index as C
from halyard.plans import view as V
from halyard.plans.postings import Term, TextIndex, matching_formats, named

NAMES = [None, "", "a", "ab", "Blue", "blue sky", "SKY BLUE", "Ünïcödé", "日本語の名前", "日本", "a😀b😀c", "😀", "new\nline", "tab\tin", "100%_sure", "...", "aaaa", "aaa", "x" * 50_000 + "needle" + "y" * 50_000, "Blue"]
NEEDLES = ["", " ", "a", "B", "bl", "blue", " BLUE ", "e s", "日", "日本", "日本語", "語の", "ö", "cödé", "😀", "😀b", "b😀c", "\n", "w\nl", "%_", "..", "....", "aaa", "aaaa", "aaaaa", "needle", "xneedley", "zzz", "none of them", "\0", "e\0"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    return rows, TextIndex.built(rows.repartition(3), ["name"], f"file://{tmp_path_factory.mktemp('odd')}/index", rows_per_file=3)


@pytest.mark.parametrize("query", NEEDLES)
def test_odd_needles(odd, query):
    rows, index = odd
    assert sorted(r.id for r in named(index, query).collect()) == sorted(r.id for r in V.named(rows, query).collect())


def asset_rows(spark, keys, seed):
    r = random.Random(seed)
    made = [(f"a{k}", 1 + k % 2, r.randrange(20_000_000), r.choice(["x.MOV", "y.mov.txt", "z.jpg", "quicktime", "jpeg", None, "p.JPEG", ".mov"]), r.choice(["video/quicktime", "image/JPEG", None, "", "image/png"])) for k in keys]
    return C.as_assets(spark.createDataFrame(made, "id string, type int, size_bytes long, title string, mime_type string"))


def test_changes_removals_and_compaction(spark, tmp_path):
    """Changed rows are found by their new texts alone, before and after a compaction; nothing else is written."""
    rows = asset_rows(spark, range(400), 1)
    index = TextIndex.built(rows, ["mime_type", "title"], f"file://{tmp_path}/index")
    views = [V.planned(v) for v in (V.View(format="mov"), V.View(format="jpeg"), V.View("videos", size="large", format="mov"), V.View(format="png"), V.View(format="nothing"), V.View(size="small"))]

    def check(now):
        for p in views:
            assert sorted(r.id for r in matching_formats(index, p).collect()) == sorted(r.id for r in V.matching(now, p).collect())
        assert sorted(r.id for r in index.rows().collect()) == sorted(r.id for r in now.collect())

    check(rows)
    fresh = asset_rows(spark, [3, 9, *range(395, 410)], 2)
    index.changed(fresh)
    now = rows.join(fresh, "id", "left_anti").unionByName(fresh)
    check(now)
    assert index._rows(index.segments()[-1]).count() == 17
    gone = spark.createDataFrame([("a3",), ("a50",), ("nobody",)], "id string")
    index.removed(gone)
    now = now.join(gone, "id", "left_anti")
    check(now)
    back = asset_rows(spark, [50], 3)
    index.changed(back)
    now = now.unionByName(back)
    check(now)
    index.compacted()
    assert len(index.segments()) == 1
    check(now)
    index.changed(asset_rows(spark, [500], 4))
    check(now.unionByName(asset_rows(spark, [500], 4)))


def test_changes_made_during_a_compaction_stay(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, f"name {k}") for k in range(20)], "id long, name string")
    index = TextIndex.built(rows, ["name"], f"file://{tmp_path}/index")
    written = TextIndex._written

    def slow(self, *args):
        data = written(self, *args)
        monkeypatch.setattr(TextIndex, "_written", written)
        index.changed(spark.createDataFrame([(5, "other")], "id long, name string"))
        return data

    monkeypatch.setattr(TextIndex, "_written", slow)
    index.compacted()
    assert len(index.segments()) == 2 and [r.id for r in named(index, "other").collect()] == [5] and named(index, "name 5").count() == 0
    index.compacted()
    assert len(index.segments()) == 1 and named(index, "name").count() == 19


def test_writers_at_the_same_time(spark, tmp_path):
    index = TextIndex.built(spark.createDataFrame([], "id long, name string"), ["name"], f"file://{tmp_path}/index")
    assert named(index, "w").count() == 0
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: index.changed(spark.createDataFrame([(k, f"writer {k}")], "id long, name string")), range(4)))
    assert len(index.segments()) == 5 and sorted(r.id for r in named(index, "writer").collect()) == [0, 1, 2, 3]


def test_a_search_reads_the_files_that_hold_its_rows(spark, tmp_path):
    """Of 20 files and more a rare needle opens two, and one that is nowhere none; strings that all rows have do not matter."""
    rows = spark.range(100_000).select("id", F.concat(F.lit("Picture "), F.when(F.col("id") % 49_999 == 7, "Zebra").otherwise("Horse"), F.lit(" at noon")).alias("name"))
    index = TextIndex.built(rows.repartitionByRange(4, "id").sortWithinPartitions("id"), ["name"], f"file://{tmp_path}/index", rows_per_file=5_000)
    found = named(index, "zebra at")
    assert len(index.rows().inputFiles()) >= 20 and len(found.inputFiles()) == 2
    assert sorted(r.id for r in found.collect()) == [k for k in range(100_000) if k % 49_999 == 7]
    assert named(index, "unicorn").count() == 0 and named(index, "horse").count() == 99_998
    assert index.search([Term("name", "zebra"), Term("name", "oon", ends=True)], F.lower("name").contains("zebra")).count() == 2
