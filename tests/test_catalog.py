from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from halyard.operators import catalog_index as C
from halyard.operators import journal as J
from halyard.operators import tasks as T
from halyard.plans import view as V
from halyard.schema import ASSETS, TRASH
from halyard.sources.backups import read_backups, write_backups
from halyard.sources.catalog import Conflict, Flags, VersionedTable, append_gallery, fresh_sizes, open_tables, resource_sizes, store_sizes


def assets(spark, *rows):
    keys = [f.name for f in ASSETS.fields]
    base = {"type": 1, "created_date": 0, "modified_date": 0, "width": 0, "height": 0, "duration_ms": 0}
    return spark.createDataFrame([tuple((base | r).get(k) for k in keys) for r in rows], ASSETS)


def ids(df):
    return [r.id for r in df.collect()]


def test_orders_and_pages(spark):
    rows = assets(spark, *({"id": f"a{k}"} for k in range(10)))
    pages = [ids(V.page(rows, V.planned(V.View()), at, 4)) for at in (0, 4, 8)]
    assert [len(p) for p in pages] == [4, 4, 2] and len({i for p in pages for i in p}) == 10
    sized = assets(spark, {"id": "s", "size_bytes": 100}, {"id": "b", "size_bytes": 900}, {"id": "n"}, {"id": "z", "size_bytes": 0})
    assert ids(V.entries(sized, V.planned(V.View(sort="largest")))) == ["b", "s", "z", "n"]
    assert ids(V.entries(sized, V.planned(V.View(sort="smallest")))) == ["n", "z", "s", "b"]
    assert sorted(ids(V.matching(sized, V.planned(V.View(size="small"))))) == ["b", "s", "z"]
    assert [r.position for r in V.positions(rows, V.planned(V.View())).orderBy("position").collect()] == list(range(10))


def test_formats(spark):
    rows = assets(spark, {"id": "j", "title": "IMG.JPG", "mime_type": "image/jpeg"}, {"id": "p", "title": "pic.png", "mime_type": "image/png"}, {"id": "m", "type": 2, "title": "clip.mov", "mime_type": "video/quicktime"}, {"id": "h", "mime_type": "image/heif"})
    find = lambda f: sorted(ids(V.matching(rows, V.planned(V.View(format=f)))))
    assert find("jpeg") == ["j"] and find("mov") == ["m"] and find("heic") == []


def test_client_view_keeps_unknown_sizes(spark):
    rows = assets(spark, {"id": "n"}, {"id": "big", "size_bytes": 50 << 20}).withColumn("position", F.monotonically_increasing_id())
    assert ids(V.client_view(rows, V.View(size="small"))) == ["n"]


def test_upsert_keeps_absent_columns(spark):
    rows = assets(spark, {"id": "a", "size_bytes": 10, "title": "t"}, {"id": "b"})
    new = spark.createDataFrame([("a", 2, None), ("c", 1, "x"), ("c", 1, "x")], "id string, type int, title string")
    out = {r.id: r for r in C.upsert(rows, new).collect()}
    assert out["a"].size_bytes == 10 and out["a"].title is None and out["a"].type == 2
    assert out["c"].created_date == 0 and out["c"].size_bytes is None and len(out) == 3
    assert C.upsert(rows, new.limit(0)).count() == 2
    nulls = spark.createDataFrame([("a", None)], "id string, size_bytes long")
    assert {r.id: r.size_bytes for r in C.upsert(rows, nulls).collect()}["a"] is None


def test_sync_and_sizes(spark):
    rows = assets(spark, {"id": "a", "size_bytes": 10}, {"id": "b"}, {"id": "c"})
    source = spark.createDataFrame([("a", 1), ("c", 1)], "id string, type int")
    synced = C.sync(rows, source)
    assert sorted(ids(synced)) == ["a", "c"] and {r.id: r.size_bytes for r in synced.collect()}["a"] == 10
    assert C.sync(rows, source.limit(0)).count() == 0
    assert C.sync(rows, source.limit(0), keep_if_source_empty=True).count() == 3
    found = spark.createDataFrame([("b", 20)], "id string, size_bytes long")
    assert {r.id: r.size_bytes for r in C.resolve_sizes(rows, found).collect()} == {"a": 10, "b": 20, "c": 0}
    got, table = C.resolve_page(rows, spark.createDataFrame([("b",), ("c",)], "id string"), found)
    assert got.count() == 1 and {r.id: r.size_bytes for r in table.collect()}["c"] is None
    assert {r.id: r.size_bytes for r in C.set_size(rows, "b", 7).collect()} == {"a": 10, "b": 7, "c": None}
    left, picked = C.remove_assets(rows, source.select("id"), spark.createDataFrame([("a",)], "id string"))
    assert sorted(ids(left)) == ["b", "c"] and ids(picked) == ["c"]


def test_size_lookups(spark):
    raw = spark.createDataFrame([("a", "12.0"), ("b", "-1"), ("c", None), ("d", "x")], "id string, size string")
    assert [tuple(r) for r in fresh_sizes(raw).collect()] == [("a", 12)]
    rows = spark.createDataFrame([(1, 5), (2, 0)], "_id long, _size long")
    wanted = spark.createDataFrame([("1",), ("2",), ("x/1",)], "id string")
    assert [tuple(r) for r in store_sizes(rows, wanted).collect()] == [("1", 5)]
    parts = spark.createDataFrame([("a", 0, "other", 9), ("a", 1, "photo", 7), ("b", 0, "other", 0)], "id string, position int, kind string, size long")
    assert [tuple(r) for r in resource_sizes(parts).collect()] == [("a", 7)]
    ties = spark.createDataFrame([("a", 1, "photo", n) for n in (9, 4, None, 6)], parts.schema)
    assert [tuple(r) for r in resource_sizes(ties).collect()] == [("a", 4)]


def test_selection(spark):
    rows = assets(spark, *({"id": f"a{k}", "type": 1 + k % 2, "created_date": 100 - k} for k in range(8)))
    placed = V.positions(rows, V.planned(V.View()))
    base = spark.createDataFrame([("a0",)], "id string")
    assert sorted(ids(V.select_run(placed, base, 5, 2))) == ["a0", "a3", "a5"]
    assert V.type_lock(placed, spark.createDataFrame([("a3",), ("a4",)], "id string")).first()[0] == 2
    assert sorted(ids(V.select_all(rows, V.View()))) == ["a0", "a2", "a4", "a6"]
    items = spark.createDataFrame([(x, k) for k, x in enumerate("abcd")], "id string, position int")
    assert [r.id for r in V.moved(items, 0, 2).orderBy("position").collect()] == list("bcad")


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    assert table.read().count() == 0
    table.write(assets(spark, {"id": "a"}), sort_by="id")
    table.write(C.clear(table.read()))
    assert table.versions() == [1, 2] and table.read().count() == 0 and table.vacuum() == [1]
    assert set(open_tables(spark, str(tmp_path))) == {"assets", "trash"}


def test_writers_that_meet(spark, tmp_path):
    """Four writers of a thousand rows each leave four versions; replacing writes share none either."""
    from concurrent.futures import ThreadPoolExecutor

    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    rows = [C.as_assets(spark.range(1000).select(F.concat(F.lit(f"{k}-"), F.col("id").cast("string")).alias("id"), F.lit(1).alias("type"), F.lit(k).alias("width"))) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda r: table.change(lambda now: now.unionByName(r)), rows))
    assert table.versions() == [1, 2, 3, 4] == sorted(d.version for d in done)
    assert [table.at(n).count() for n in table.versions()] == [1000, 2000, 3000, 4000] and table.read().select("id").distinct().count() == 4000
    assert all(d.after.count() == d.before.count() + 1000 for d in done)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(table.write, rows))
    assert table.versions() == list(range(1, 9))
    assert sorted(table.at(n).agg(F.first("width"), F.count_distinct("width"), F.count("id")).first() for n in range(5, 9)) == [(k, 1, 1000) for k in range(4)]
    folders = [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()]
    assert len(folders) == 8 and not [p for p in (tmp_path / "t").iterdir() if p.name.endswith(".claim")]


def test_writers_of_a_process_write_once_each(spark, tmp_path, monkeypatch):
    """Six changes that meet write six tables: none is written again because another came first."""
    from concurrent.futures import ThreadPoolExecutor

    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    row = lambda k: C.as_assets(spark.createDataFrame([(f"{k}", 1)], "id string, type int"))
    written, stored = [], VersionedTable._stored
    monkeypatch.setattr(VersionedTable, "_stored", lambda self, *rest: written.append(1) or stored(self, *rest))
    with ThreadPoolExecutor(6) as pool:  # each by an object of its own
        list(pool.map(lambda k: VersionedTable(spark, table.folder, ASSETS).change(lambda now: now.unionByName(row(k))), range(6)))
    assert table.versions() == list(range(1, 7)) and table.read().count() == 6 and len(written) == 6


def test_a_stale_write_is_a_conflict(spark, tmp_path):
    """What a sync planned before a size write does not wipe the sizes out."""
    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    table.write(assets(spark, {"id": "a"}, {"id": "b"}), since=0)
    source = spark.createDataFrame([("a", 1, 5)], "id string, type int, width int")
    planned = C.sync(table.read(), source)
    table.change(lambda now: C.set_size(now, "a", 7))
    with pytest.raises(Conflict):
        table.write(planned, since=1)
    met = []

    def sync(now):
        if not met:  # another writer comes between the reading and the writing
            met.append(table.change(lambda t: C.set_size(t, "a", 9)).version)
        return C.sync(now, source)

    assert table.change(sync).version == 4 and met == [3]
    assert [(r.id, r.width, r.size_bytes) for r in table.read().collect()] == [("a", 5, 9)]
    assert table.change(lambda now: None).version == 4 and table.versions() == [1, 2, 3, 4]
    assert table.vacuum(2) == [1, 2] and len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) == 2


def test_empty_trash_takes_the_backups(spark, tmp_path):
    table, backups = VersionedTable(spark, f"file://{tmp_path}/trash", TRASH), f"file://{tmp_path}/backups"
    content = spark.createDataFrame([("e", bytearray(b"one")), ("f", bytearray(b"two"))], "id string, content binary")
    paths = {r.id: r.backup_path for r in write_backups(content, backups).collect()}
    table.write(J.mark_committed(J.insert_pending(table.read(), entry(spark, id="e", backup_path=paths["e"]).union(entry(spark, id="f", backup_path=paths["f"]))), "e", 5))
    assert J.empty_trash(table).first()["deleted"] == 1 and ids(table.read()) == ["f"]
    assert [bytes(r.content) for r in read_backups(spark, backups).collect()] == [b"two"] and J.empty_trash(table).first()["deleted"] == 0


def test_a_killed_write_does_not_block_the_next(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    table.write(assets(spark, {"id": "a"}))
    (tmp_path / "t" / "v00000002").mkdir()
    (tmp_path / "t" / "v00000002" / "part-0.parquet").write_bytes(b"torn")
    assert ids(table.read()) == ["a"]
    table.write(assets(spark, {"id": "b"}))
    assert table.versions() == [1, 3] and ids(table.read()) == ["b"]
    assert table.vacuum() == [1] and table.versions() == [3] and not (tmp_path / "t" / "v00000002").exists()


def test_migration_adds_the_journal(spark, tmp_path):
    old = VersionedTable(spark, f"file://{tmp_path}/assets", ASSETS)
    old.write(assets(spark, {"id": "a", "size_bytes": 5}))
    tables = open_tables(spark, f"file://{tmp_path}")
    assert old.versions() == [1] and ids(tables["assets"].read()) == ["a"] and tables["trash"].versions() == [1]
    tables["trash"].write(J.insert_pending(tables["trash"].read(), entry(spark)))
    again = open_tables(spark, f"file://{tmp_path}")  # a second opening changes nothing
    assert again["trash"].versions() == [1, 2] and again["trash"].read().count() == 1
    assert VersionedTable(spark, f"file://{tmp_path}/schema", again["assets"].schema).versions() == [1]


def test_flags(spark, tmp_path):
    flags = Flags(spark, f"file://{tmp_path}/flags")
    assert flags.get("seen") is False
    flags.put("seen", True)
    flags.put("other", False)
    assert flags.get("seen") is True and flags.get("other") is False
    flags.put("seen", False)
    assert flags.get("seen") is False


def test_positions_of_a_large_view(spark, tmp_path):
    """100,000 rows of several files in 16 parts, all columns kept: places are a permutation in view order."""
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("id"), (1 + F.col("id") % 2).cast("int").alias("type"), (F.xxhash64("id") % 5000).alias("created_date"), F.lit(0).alias("width"))
    rows.repartition(11).write.parquet(f"{tmp_path}/rows")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = V.positions(spark.read.parquet(f"{tmp_path}/rows"), V.planned(V.View())).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.position for r in placed] == list(range(100_000))
    assert [r.id for r in placed] == [r.id for r in sorted(placed, key=lambda r: (-r.created_date, r.id))]


def test_restore_and_sweep(spark, tmp_path):
    backups, gallery = f"file://{tmp_path}/backups", f"file://{tmp_path}/gallery"
    content = spark.createDataFrame([("e", bytearray(b"one")), ("f", bytearray(b"two")), ("n", None)], "id string, content binary")
    paths = {r.id: r.backup_path for r in write_backups(content, backups).collect()}
    assert set(paths) == {"e", "f"} and {bytes(r.content) for r in read_backups(spark, backups).collect()} == {b"one", b"two"}
    table = VersionedTable(spark, f"file://{tmp_path}/trash", TRASH)
    rows = [entry(spark, id=k, backup_path=paths.get(k, f"{backups}/none.bin"), filename="" if k == "e" else k, created_date_ms=0 if k == "e" else 1000, latitude="0" if k == "e" else "1.5", longitude="2.5") for k in ("e", "f", "g")]
    book = J.insert_pending(table.read(), rows[0].union(rows[1]).union(rows[2]))
    table.write(book)
    wanted = spark.createDataFrame([("e",), ("g",), ("unknown",)], "id string")
    assert {r.id: r.ok for r in J.restore(table, wanted, gallery).collect()} == {"e": True, "g": False, "unknown": False}
    assert sorted(ids(table.read())) == ["f", "g"] and [bytes(r.content) for r in read_backups(spark, backups).collect()] == [b"two"]
    saved = spark.read.parquet(gallery).collect()
    assert [(r.title, bytes(r.content), r.created, r.latitude, r.longitude) for r in saved] == [("restored", b"one", None, None, 2.5)]
    append_gallery(spark.read.parquet(gallery).withColumn("content", F.lit(b"new")), gallery)
    assert sorted(bytes(r.content) for r in spark.read.parquet(gallery).collect()) == [b"new", b"one"]  # nothing is overwritten
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    table.write(J.mark_committed(J.mark_committed(table.read(), "f", 1000), "g", 1_706_600_000_000))
    assert J.launch_sweep(table, as_of).first()["purged"] == 1 and ids(table.read()) == ["g"]
    assert read_backups(spark, backups).count() == 0
    assert J.drop_entries(table, spark.createDataFrame([("g",), ("x",)], "id string")).first()["deleted"] == 0 and table.read().count() == 0


def test_last_row_of_a_repeated_id_wins(spark):
    rows = assets(spark, {"id": "a", "title": "old"})
    new = spark.createDataFrame([("a", "z", 1), ("a", "b", 2), ("c", "y", 5), ("c", "q", 4)], "id string, title string, at int")
    out = {r.id: r.title for r in C.upsert(rows, new, order="at").collect()}
    assert out == {"a": "b", "c": "y"} and C.upsert(rows, new, order="at").columns == rows.columns


def test_ingest_and_small_parts(spark):
    rows = assets(spark, {"id": "a"}, {"id": "b"})
    source = spark.createDataFrame([("c", 1, "t"), ("d", 2, "u")], "id string, type int, title string")
    sizes = spark.createDataFrame([("c", 7), ("d", 8), ("a", 9)], "id string, size_bytes long")
    out = {r.id: r.size_bytes for r in C.ingest(rows, source, spark.createDataFrame([("c",), ("x",)], "id string"), sizes).collect()}
    assert out == {"a": None, "b": None, "c": 7}
    assert sorted(ids(V.all_ids(rows.union(rows)))) == ["a", "b"] and C.remaining_total(3, 5) == 0
    assert C.intersects(rows, source.select("id").union(rows.select("id"))) and not C.intersects(rows, source)
    assert V.View(sort="largest").any_active and V.View(size="small").needs_sizes and not V.View().any_active and not V.View(format="jpeg").needs_sizes


def test_newest_results(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1)], "key string, seq int")
    results = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 1, "z"), ("c", 1, "w")], "key string, seq int, out string")
    assert sorted(r.out for r in T.newest_results(requests, results).collect()) == ["y", "z"]


def test_processed_items(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ab")), (2, None), (3, bytearray(b"bad"))], "id long, data binary")

    def work(data):
        if data == b"bad":
            raise ValueError("no")
        return data[::-1]

    out = {r.id: (r.status, r.result and bytes(r.result)) for r in T.processed(rows, work, "long").collect()}
    assert out[1] == ("saved", b"ba") and out[2] == ("skipped", None) and out[3][0] == "failed"


def test_debounce_across_spans(spark):
    import datetime as dt

    r = __import__("random").Random(3)
    at = sorted(r.choice([0, 40, 90, 200]) * 86_400 + r.randrange(20_000) for _ in range(300))
    base = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", base + dt.timedelta(seconds=s)) for s in at] + [("k", None)], "key string, ts timestamp")
    runs = [[at[0]]]
    for s in at[1:]:
        if s - runs[-1][-1] <= 60:
            runs[-1].append(s)
        else:
            runs.append([s])
    want = sorted((base + dt.timedelta(seconds=x[0]), base + dt.timedelta(seconds=x[-1]), len(x)) for x in runs)
    for span in (30_000, 3_600_000, 10**12):
        assert sorted((x.started, x.last, x.changes) for x in T.debounced_batch(rows, 60_000, span).collect()) == want


def entry(spark, **given):
    row = {"id": "e", "original_asset_id": "o", "original_bytes": 5_000_000, "new_bytes": 1_200_000, "user_album_ids": '["alb1","alb2"]', "backup_path": "/b/e"} | given
    row |= {k: float(row[k]) for k in ("latitude", "longitude") if k in row}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))


def test_journal(spark):
    empty = spark.createDataFrame([], TRASH)
    book = J.insert_pending(empty, entry(spark))
    assert J.pending(book).count() == 1 and J.committed(book).count() == 0
    with pytest.raises(J.DuplicateKey):
        J.insert_pending(book, entry(spark))
    done = J.mark_committed(book, "e", 1000)
    row = done.first()
    assert (row.state, row.new_asset_id, row.new_bytes, row.deleted_at_ms) == (1, None, 1_200_000, 1000)
    assert J.mark_committed(book, "none", 1).first().state == 0
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    left, count = J.purge(done, as_of)
    assert left.count() == 0 and count.first()[0] == 1
    assert J.purge(book, as_of)[0].count() == 1 and J.empty_all(done.unionByName(book)).count() == 1
    rest, files = J.drop(done, spark.createDataFrame([("e",), ("x",)], "id string"))
    assert rest.count() == 0 and files.first()[0] == "/b/e"


def test_task_fold(spark):
    assert T.fold(None, ["running", "failed", "completed"]) == "failed"
    assert T.fold(None, ["running", "completed", "cancelled", "failed"]) == "cancelled"
    assert T.fold("completed", ["running"]) == "completed"
    assert T.fold(None, ["pending", "completed"]) == "pending" and T.fold(None, ["completed", "running"]) == "running"
    import datetime as dt

    rows, truth = [], {}
    states = ["pending", "running", "completed", "failed", "cancelled"]
    for task in range(40):
        own = [states[(task * 7 + k * (task % 5 + 1)) % (5 if task % 3 else 4)] for k in range(6)]
        rows += [(task, k, dt.datetime(2024, 1, 1, 0, 0, k), s) for k, s in enumerate(own)]
        truth[task] = T.fold(None, own)
    got = {r.task_id: r.status for r in T.folded(spark.createDataFrame(rows, T.EVENT)).collect()}
    assert got == truth
    states = spark.createDataFrame([(1, "running"), (2, "failed"), (3, "pending")], "task_id long, status string")
    assert T.clear_finished(states).count() == 2 and T.remove(states, 1).count() == 3 and T.remove(states, 3).count() == 2
    assert tuple(T.badge(states.limit(0)).first()) == (0, 0, False)
    assert T.any_finished(states).first()[0] is True
    before = spark.createDataFrame([(1, "running", ["x"])], "task_id long, status string, outputs array<string>")
    after = spark.createDataFrame([(1, "completed", ["x", "y"])], before.schema)
    assert T.newly_completed(before, after).count() == 2


def test_streamed_sync(spark, tmp_path):
    from halyard.streaming.tasks import sizes_from

    table = VersionedTable(spark, f"file://{tmp_path}/t", ASSETS)
    table.write(assets(spark, {"id": "a"}, {"id": "b"}))
    new = spark.createDataFrame([("a", 5), ("b", -1)], "id string, size_bytes long")
    new.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    sizes_from(stream, table, f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.id: r.size_bytes for r in table.read().collect()} == {"a": 5, "b": None}


def test_present_backups_are_found_by_their_names(spark, tmp_path):
    """Files that are gone, empty paths and folders are none; nothing is opened, not even what may not be read."""
    from halyard.sources.backups import present

    (tmp_path / "a.bin").write_bytes(b"x")
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "b.bin").chmod(0)
    (tmp_path / "c.bin").mkdir()
    paths = [f"file://{tmp_path}/{n}.bin" for n in ("a", "b", "c", "gone", "a")] + [""]
    out = present(spark.createDataFrame([(p,) for p in paths], "backup_path string"))
    assert sorted(r.backup_path for r in out.collect()) == paths[:2] and present(out.limit(0)).count() == 0
