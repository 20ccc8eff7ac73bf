"""Change logs and digest trees against the operators that rewrite whole tables."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators import catalog_index as C
from halyard.operators import digest
from halyard.schema import ASSETS
from halyard.sources.backups import delete_backups, opened, present, read_backups, remove, write_backups
from halyard.sources.change_log import ChangeLog
from tests.test_catalog import assets, ids

NULLABLE = T.StructType([T.StructField(f.name, f.dataType) for f in ASSETS.fields])


def rows_of(df):
    return sorted(map(tuple, df.select(*[f.name for f in ASSETS.fields]).collect()), key=repr)


def test_log_equals_whole_table_changes(spark, tmp_path):
    """Random puts, sets, removals and clearings: the fold is the table after each of them in turn."""
    r = random.Random(3)
    table = assets(spark, *({"id": f"a{k}", "size_bytes": k, "title": "t"} for k in range(12)))
    log = ChangeLog(spark, f"file://{tmp_path}/log", ASSETS)
    log.put(table)
    for step in range(24):
        some = [f"a{r.randrange(16)}" for _ in range(r.randrange(1, 6))]
        kind = r.choice(["put", "put", "titles", "sizes", "gone", "size", "compact", "clear" if step == 11 else "put"])
        if kind == "put":
            new = spark.createDataFrame([(x, r.randrange(3), r.choice([None, "n", "m"])) for x in some], "id string, type int, title string")
            table = C.upsert(table, new)
            log.put(new)
        elif kind == "titles":  # a null that is given is not an absent column
            new = spark.createDataFrame([(x, None) for x in some], "id string, title string")
            table = C.upsert(table, new)
            log.put(new)
        elif kind == "sizes":
            new = spark.createDataFrame([(x, r.choice([None, 1, 2])) for x in some], "id string, size_bytes long")
            table = C.set_sizes(table, new)
            log.set(new)
        elif kind == "size":
            table = C.set_size(table, some[0], step)
            log.set_size(some[0], step)
        elif kind == "gone":
            gone = spark.createDataFrame([(x,) for x in some], "id string")
            table = C.delete_ids(table, gone)
            log.remove(gone)
        elif kind == "clear":
            table = C.clear(table)
            log.clear()
        else:
            log.compact()
            assert log.waiting() == 0
        table = spark.createDataFrame(table.collect(), NULLABLE)
        assert rows_of(log.read()) == rows_of(table), (step, kind)


def test_one_size_writes_one_row(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", ASSETS)
    log.put(C.as_assets(spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("type"))))
    log.compact()
    before = set((tmp_path / "log" / "log").rglob("*.parquet"))
    log.set_size("77", 5)
    fresh = [str(p) for p in set((tmp_path / "log" / "log").rglob("*.parquet")) - before]
    assert spark.read.parquet(*fresh).count() == 1 and log.base.versions() == [1]
    assert log.read().filter("size_bytes is not null").select("id", "size_bytes").collect() == [("77", 5)] and log.read().count() == 20_000


def test_changes_during_a_compaction_stay(spark, tmp_path):
    """A change that is appended after a compaction has listed the log is folded on top of it."""
    log = ChangeLog(spark, f"file://{tmp_path}/log", ASSETS)
    log.put(assets(spark, {"id": "a"}, {"id": "b"}))
    change = log.base.change

    def slow(work):
        log.set_size("a", 9)
        return change(work)

    log.base.change = slow
    log.compact()
    assert log.waiting() == 1 and sorted((r.id, r.size_bytes) for r in log.read().collect()) == [("a", 9), ("b", None)]


def test_writers_append_at_the_same_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = ChangeLog(spark, f"file://{tmp_path}/log", ASSETS)
    with ThreadPoolExecutor(4) as pool:
        places = list(pool.map(lambda k: log.put(assets(spark, {"id": f"w{k}", "width": k})), range(8)))
    assert sorted(places) == list(range(1, 9)) and sorted(ids(log.read())) == [f"w{k}" for k in range(8)]


# digests --------------------------------------------------------------------------------------------


def catalogue(spark, n):
    k = F.col("id")
    return C.as_assets(spark.range(n).select(k.cast("string").alias("id"), F.lit(1).alias("type"), (k % 900).cast("int").alias("width"), F.when(k % 7 != 0, k).alias("size_bytes"), F.when(k % 3 != 0, F.lit("t")).alias("title")))


def test_ten_changes_of_many_rows_join_few(spark):
    """Ten changed rows of 150,000: less than a hundredth of either side meets in a join, and the rows are those of a sync."""
    table = catalogue(spark, 150_000)
    k = F.col("id").cast("long")
    source = table.select("id", "type", F.when(k % 50_000 == 9, 5000).otherwise(F.col("width")).alias("width"), F.when(k % 50_000 == 11, None).otherwise(F.col("title")).alias("title"))
    source = source.filter(k % 75_000 != 13).union(spark.createDataFrame([("x", 1, 2, None), ("y", 1, 2, "t")], "id string, type int, width int, title string"))
    apart, mine, theirs = digest.sides(table, source)
    assert 8 <= apart.count() <= 10 and mine.count() < 1500 and theirs.count() < 1500
    got, want = digest.sync(table, source), C.sync(table, source)
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*[x for f in ASSETS.fields for x in (F.col(f.name).isNull(), F.col(f.name))]).cast("decimal(38,0)"))).first()
    assert total(got) == total(want)
    fresh, gone = digest.delta(table, source)
    assert sorted(ids(fresh)) == sorted(["x", "y", "9", "50009", "100009", "11", "50011"]) and sorted(ids(gone)) == ["13", "75013"]


def test_equal_sides_have_no_leaf(spark):
    table = catalogue(spark, 500)
    source = table.select("id", F.col("width").cast("long").alias("width"), "title")  # other types, equal values
    stored = digest.digests(table, table, ["width", "title"])
    apart, mine, _ = digest.sides(table, source, stored=stored)
    assert apart.count() == 0 and mine.count() == 0 and rows_of(digest.sync(table, source, stored=stored)) == rows_of(table)
    # a value that moves to the next column, a null, a repeated row and an empty side
    moved = table.select("id", F.col("size_bytes").cast("string").alias("title"), "width")
    assert rows_of(digest.sync(table, moved, bits=4)) == rows_of(C.sync(table, moved))
    assert digest.sides(table, source.union(source.limit(1)))[0].count() == 1
    assert digest.sync(table, source.limit(0)).count() == 0 and digest.sync(table.limit(0), source).count() == 500


def test_a_log_follows_its_source(spark, tmp_path):
    """Deltas of a sync put into a log: it is the synced table, and only changed rows are written."""
    log = ChangeLog(spark, f"file://{tmp_path}/log", ASSETS)
    log.put(catalogue(spark, 2000))
    log.compact()
    source = catalogue(spark, 2000).filter("id <> '5'").select("id", "type", F.when(F.col("id") == "8", 1).otherwise(F.col("width")).alias("width"))
    want = rows_of(C.sync(log.read(), source))
    fresh, gone = digest.delta(log.read(), source)
    log.put(fresh)
    log.remove(gone)
    assert rows_of(log.read()) == want and log.waiting() == 2


# backups --------------------------------------------------------------------------------------------


def test_wanted_backups_alone_are_opened(spark, tmp_path):
    """Ten of ten thousand: ten files are opened; gone, empty and repeated paths do no harm."""
    content = spark.range(10_000).select(F.col("id").cast("string").alias("id"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    folder = f"file://{tmp_path}/backups"
    paths = write_backups(content, folder)
    paths.write.parquet(f"{tmp_path}/paths")
    wanted = spark.read.parquet(f"{tmp_path}/paths").filter(F.col("id").cast("long") % 1000 == 7)
    more = wanted.select("backup_path").union(wanted.select("backup_path")).union(spark.createDataFrame([("",), (f"{folder}/gone.bin",), (None,)], "backup_path string"))
    count = spark.sparkContext.accumulator(0)
    got = opened(more, count).collect()
    assert count.value == 10 and sorted(int(r.content) for r in got) == [k * 1000 + 7 for k in range(10)]


def test_many_backups_are_few_files(spark, tmp_path):
    """20,000 backups are packs of 16,384 at most; what is deleted is gone from their bytes, the rest is whole, the last deletion leaves
    no file."""
    folder, text = f"file://{tmp_path}/backups", F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">"))
    content = spark.range(0, 20_000, 1, 1).select(F.col("id").cast("string").alias("id"), F.encode(text, "utf-8").alias("content"))
    paths = spark.createDataFrame(write_backups(content, folder).collect(), "id string, backup_path string")
    assert write_backups(content, folder).count() == 20_000  # a repeated task
    files = lambda: [p for p in (tmp_path / "backups").iterdir() if not p.name.endswith(".crc")]
    assert len(files()) == 2 and present(paths).count() == 20_000
    assert opened(paths).join(paths, "backup_path").filter(F.col("content").cast("string") != F.concat(F.lit("<"), "id", F.lit(">"))).count() == 0
    gone = paths.filter("cast(id as long) % 3 <> 0")
    assert delete_backups(gone.union(gone).select("backup_path")).first()["deleted"] == 13_333 and delete_backups(gone).first()["deleted"] == 0
    left = {r.backup_path: bytes(r.content) for r in read_backups(spark, folder).collect()}
    assert left == {r.backup_path: f"<{r.id}>".encode() for r in paths.collect() if int(r.id) % 3 == 0} and {r.backup_path for r in present(paths).collect()} == set(left)
    assert len(files()) == 2 and not any(b"<10000>" in p.read_bytes() for p in files()) and any(b"<9999>" in p.read_bytes() for p in files())
    assert delete_backups(paths).first()["deleted"] == 6_667 and files() == [] and opened(paths).count() == present(paths).count() == 0


def test_odd_backups_are_kept_whole(spark, tmp_path):
    """Names with marks of paths, empty and large contents, an id twice; files of one backup's own, as older journals name them."""
    folder, large = f"file://{tmp_path}/back#ups", bytes(9 << 20)
    rows = [("a/b#c", b"1"), ("", b""), ("\u00fc\n", b"3"), ("x", b"old"), ("x", b"new"), *((f"large{k}", large) for k in range(4)), (None, b"no"), ("none", None)]
    content = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in rows], "id string, content binary").coalesce(1)
    met = write_backups(content, folder, "heic").collect()
    paths, plain = dict(map(tuple, met)), tmp_path / "own.bin"
    plain.write_bytes(b"own")
    want = {paths[i]: c for i, c in rows if i is not None and c is not None}
    assert len(met) == 9 and len(want) == 8 and len(list((tmp_path / "back#ups").iterdir())) == 2
    assert {r.backup_path: bytes(r.content) for r in read_backups(spark, folder).collect()} == want
    asked = spark.createDataFrame([(p,) for p in (paths["a/b#c"], paths["x"], f"file://{plain}", paths["x"] + "no", f"file://{tmp_path}/gone")], "backup_path string")
    assert {r.backup_path: bytes(r.content) for r in opened(asked).collect()} == {paths["a/b#c"]: b"1", paths["x"]: b"new", f"file://{plain}": b"own"}
    assert delete_backups(asked).first()["deleted"] == 3 and not plain.exists()
    assert {r.backup_path for r in read_backups(spark, folder).collect()} == set(want) - {paths["a/b#c"], paths["x"]}


def test_deletions_that_meet_in_a_pack_are_all_done(spark, tmp_path):
    folder = f"file://{tmp_path}/backups"
    content = spark.range(0, 4_000, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit(bytearray(1000)).alias("content"))
    paths = [r.backup_path for r in write_backups(content, folder).collect()]
    (file,) = {p.split("#")[0] for p in paths}
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda k: remove(file, {p[len(file) + 1 :] for p in paths[k::10]}), range(9)))
    assert done == [400] * 9 and {r.backup_path for r in read_backups(spark, folder).collect()} == set(paths[9::10])
