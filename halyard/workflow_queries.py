"""Registered queries that run whole workflows and the operators not in the other two modules, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.functions import binary, numbers, text
from halyard.operators import catalog_index, digest, estimate, journal, tasks
from halyard.plans import view
from halyard.queries import AS_OF, ASSETS_SQL, SELECTION_SQL, TASKS_SQL, TRASH_SQL, assets, read, register, selection, streamed, task_events, trash
from halyard.schema import ASSETS, TARGETS, TRASH
from halyard.scratch import scratch_path, spooled
from halyard.sources import catalog
from halyard.sources.backups import opened, present, read_backups, write_backups
from halyard.sources.catalog import Flags, VersionedTable, open_tables
from halyard.sources.change_log import ChangeLog


@register("index_ids", f"WITH {ASSETS_SQL} SELECT id FROM assets")
def index_ids(spark, sf_dir):
    rows = assets(spark, sf_dir)
    return view.all_ids(rows.unionByName(rows))


@register("set_one_size", f"WITH {ASSETS_SQL} SELECT id, CASE WHEN id = '37' THEN 4242 ELSE size_bytes END AS size_bytes FROM assets")
def set_one_size(spark, sf_dir):
    rows = catalog_index.set_size(assets(spark, sf_dir), "37", 4242)
    return catalog_index.set_size(rows, "no such id", 1).select("id", "size_bytes")


@register("cleared_index", "SELECT 0 AS n")
def cleared_index(spark, sf_dir):
    return catalog_index.clear(assets(spark, sf_dir)).agg(F.count(F.lit(1)).cast("int").alias("n"))


@register("resolved_page", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id, CASE WHEN id IN (SELECT id FROM selection) AND cast(id AS bigint) % 2 = 0 THEN 99 ELSE size_bytes END AS size_bytes FROM assets")
def resolved_page(spark, sf_dir):
    """Of the selected ids the lookup knows the even ones; only those are put in."""
    rows = assets(spark, sf_dir)
    known = rows.filter(F.col("id").cast("long") % 2 == 0).select("id", F.lit(99).cast("long").alias("size_bytes"))
    return catalog_index.resolve_page(rows, selection(spark, sf_dir), known)[1].select("id", "size_bytes")


@register("removed_assets", f"WITH {ASSETS_SQL}, {SELECTION_SQL}, gone AS (SELECT id FROM assets WHERE cast(id AS bigint) % 3 = 0) SELECT id, 'view' AS kind FROM assets WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT id, 'selection' FROM selection WHERE id NOT IN (SELECT id FROM gone)")
def removed_assets(spark, sf_dir):
    rows = assets(spark, sf_dir)
    left, picked = catalog_index.remove_assets(rows, selection(spark, sf_dir), rows.filter(F.col("id").cast("long") % 3 == 0).select("id"))
    return left.select("id", F.lit("view").alias("kind")).union(picked.select("id", F.lit("selection").alias("kind")))


@register("ingested_assets", f"WITH {ASSETS_SQL}, fresh AS (SELECT 'n' || id AS id, width, CASE WHEN size_bytes IS NOT NULL THEN size_bytes + 1 END AS size_bytes FROM assets WHERE cast(id AS bigint) % 10 = 4) SELECT id, width, size_bytes FROM assets UNION ALL SELECT * FROM fresh")
def ingested_assets(spark, sf_dir):
    rows = assets(spark, sf_dir)
    source = rows.select(F.concat(F.lit("n"), "id").alias("id"), "type", "width", "created_date")
    wanted = rows.filter(F.col("id").cast("long") % 10 == 4).select(F.concat(F.lit("n"), "id").alias("id"))
    sizes = rows.filter("size_bytes is not null").select(F.concat(F.lit("n"), "id").alias("id"), (F.col("size_bytes") + 1).alias("size_bytes"))
    return catalog_index.ingest(rows, source, wanted, sizes).select("id", "width", "size_bytes")


@register("last_write_wins", f"WITH {TASKS_SQL} SELECT cast(task_id AS varchar) AS id, arg_max(status, (ts, seq)) AS title FROM tasks GROUP BY task_id")
def last_write_wins(spark, sf_dir):
    """Of many rows of an id the last stays, whatever it holds."""
    rows = task_events(spark, sf_dir).select(F.col("task_id").cast("string").alias("id"), F.col("status").alias("title"), F.struct("ts", "seq").alias("at"))
    return catalog_index.upsert(spark.createDataFrame([], ASSETS), rows, order="at").select("id", "title")


@register("ids_meet", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT count(*) > 0 AS meet FROM assets WHERE id IN (SELECT id FROM selection)")
def ids_meet(spark, sf_dir):
    return spark.createDataFrame([(catalog_index.intersects(assets(spark, sf_dir), selection(spark, sf_dir)),)], "meet boolean")


@register("view_flags", f"""WITH {ASSETS_SQL}, c AS (SELECT id, ['newest', 'oldest', 'largest', 'smallest'][1 + width % 4] AS sort, ['any', 'small', 'medium', 'large'][1 + height % 4] AS size, CASE WHEN width % 3 = 0 THEN 'jpeg' END AS format FROM assets)
  SELECT id, sort <> 'newest' OR size <> 'any' OR format IS NOT NULL AS active, size <> 'any' OR sort IN ('largest', 'smallest') AS needs_sizes FROM c""")
def view_flags(spark, sf_dir):
    """A stored choice for each asset, by its width and height."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (1 + F.col(c) % len(values)).cast("int"))
    chosen = view.flags(pick(view.SORTS, "width"), pick(view.BUCKETS, "height"), F.when(F.col("width") % 3 == 0, "jpeg"))
    return assets(spark, sf_dir).select("id", chosen.alias("f")).select("id", "f.active", "f.needs_sizes")


@register("shown_figures", f"""WITH {ASSETS_SQL}, f AS (SELECT id, width, height, size_bytes, duration_ms FROM assets)
  SELECT id, CASE WHEN width % 10 = 0 THEN cast(width // 10 AS varchar) ELSE (width // 10) || '.' || (width % 10) END AS trimmed,
    CASE WHEN width % 2 = 0 THEN 'HEIC' ELSE 'HEIF' END AS format, CASE WHEN duration_ms > 0 THEN duration_ms END AS elapsed,
    CASE WHEN duration_ms > 0 AND size_bytes IS NOT NULL THEN CASE WHEN size_bytes * 8 >= duration_ms * 10000 THEN cast((size_bytes * 16 + duration_ms * 1000) // (duration_ms * 2000) AS varchar)
      ELSE ((size_bytes * 160 + duration_ms * 1000) // (duration_ms * 2000)) // 10 || '.' || ((size_bytes * 160 + duration_ms * 1000) // (duration_ms * 2000)) % 10 END || ' Mbps' END AS bitrate,
    cast(least(width // 80, 100) AS integer) AS percent, width % 3 <> 0 AND height % 3 <> 0 AS placed,
    CASE WHEN width % 4 = 0 THEN 8 ELSE width % 4 END AS bit_depth, height % 2 = 0 AS has_alpha, FALSE AS is_hdr FROM f""")
def shown_figures(spark, sf_dir):
    w, h, ms = F.col("width"), F.col("height"), F.col("duration_ms")
    begun = F.timestamp_millis(F.lit(0))
    facts = numbers.image_facts(F.when(w % 4 != 0, w % 4), F.when(h % 2 == 0, F.lit(True)), F.lit(None).cast("boolean"), F.lit("RGB"))
    return assets(spark, sf_dir).select(
        "id", text.trimmed_decimal(w / 10).alias("trimmed"), text.format_name(F.lit("heic"), w % 2 == 0, F.lit(True)).alias("format"),
        numbers.elapsed_ms(begun, F.when(ms > 0, F.timestamp_millis(ms))).alias("elapsed"), numbers.bitrate_text(F.col("size_bytes"), ms / 1000).alias("bitrate"),
        numbers.progress_percent(F.floor(w / 80) / 100).alias("percent"), numbers.has_place((w % 3).cast("double"), F.when(h % 3 != 0, h.cast("double"))).alias("placed"),
        facts["bit_depth"].alias("bit_depth"), facts["has_alpha"].alias("has_alpha"), facts["is_hdr"].alias("is_hdr"),
    )


CHOICE_SQL = "['auto', 'avif', 'heic', 'webp', 'jpeg', 'png'][1 + width % 6]"


def choice():
    return F.element_at(F.array(*map(F.lit, TARGETS)), (1 + F.col("width") % len(TARGETS)).cast("int"))


@register("ratio_model", f"WITH {ASSETS_SQL} SELECT id, least(greatest(CASE {CHOICE_SQL} WHEN 'avif' THEN 0.32::double WHEN 'heic' THEN 0.5::double WHEN 'webp' THEN 0.6::double WHEN 'jpeg' THEN 0.9::double WHEN 'png' THEN 0.95::double ELSE 0.4::double END * (0.7::double + (1 + height % 100 - 30) / 70.0::double * 0.7::double), 0.05), 0.95) AS ratio FROM assets")
def ratio_model(spark, sf_dir):
    """A target and a quality for each asset, by its width and height."""
    return assets(spark, sf_dir).select("id", estimate.compression_ratios(choice(), 1 + F.col("height") % 100).alias("ratio"))


@register("auto_targets", f"WITH {ASSETS_SQL} SELECT id, CASE WHEN {CHOICE_SQL} <> 'auto' THEN {CHOICE_SQL} WHEN height % 16 >= 8 THEN 'avif' WHEN height % 8 >= 4 OR height % 4 >= 2 THEN 'heic' WHEN height % 2 = 1 THEN 'webp' ELSE 'jpeg' END AS target FROM assets")
def auto_targets(spark, sf_dir):
    """A choice and what a device can write for each asset."""
    bit = lambda k: F.col("height") % (2 * k) >= k
    rows = assets(spark, sf_dir).select("id", choice().alias("choice"), bit(8).alias("avif_hardware"), bit(4).alias("heic"), bit(2).alias("heif"), bit(1).alias("webp"))
    return rows.select("id", estimate.auto_target(F.col("choice")).alias("target"))


@register("gallery_places", f"WITH {ASSETS_SQL} SELECT id, CASE WHEN width % 3 <> 0 THEN cast(width % 3 AS double) END AS latitude, CASE WHEN height % 2 <> 0 THEN cast(height % 2 AS double) END AS longitude, 2 AS copies FROM assets WHERE type = 1")
def gallery_places(spark, sf_dir):
    """A gallery to which the same results are saved twice: nothing is overwritten."""
    folder = scratch_path(spark, "gallery")
    rows = assets(spark, sf_dir).filter("type = 1").select("id", "title", F.encode("title", "utf-8").alias("content"), F.lit(None).cast("timestamp").alias("created"), (F.col("width") % 3).cast("double").alias("latitude"), (F.col("height") % 2).cast("double").alias("longitude"))
    for _ in range(2):
        catalog.append_gallery(rows, folder)
    saved = spark.read.parquet(folder)
    return saved.groupBy("id", "latitude", "longitude").agg(F.count(F.lit(1)).cast("int").alias("copies"))


def journal_of(spark, sf_dir):
    """The trash as whole journal rows, each with a backup path."""
    rows = trash(spark, sf_dir).withColumns({"original_asset_id": F.concat(F.lit("o"), "id"), "backup_path": F.concat(F.lit("/b/"), "id")})
    return journal.insert_pending(spark.createDataFrame([], TRASH), rows.drop("state")).join(rows.select("id", F.col("state").alias("own")), "id").withColumn("state", F.col("own")).select(*[f.name for f in TRASH.fields])


@register("trash_inserted", f"WITH {TRASH_SQL} SELECT 'x' || id AS id, 0 AS state, original_bytes, '[]' AS user_album_ids, '' AS filename FROM trash UNION ALL SELECT id, state, original_bytes, '[]', '' FROM trash")
def trash_inserted(spark, sf_dir):
    book = journal_of(spark, sf_dir)
    fresh = book.select(F.concat(F.lit("x"), "id").alias("id"), F.lit(1).alias("state"), "original_asset_id", "original_bytes")
    return journal.insert_pending(book, fresh).select("id", "state", "original_bytes", "user_album_ids", "filename")


@register("trash_dropped", f"WITH {TRASH_SQL}, {SELECTION_SQL} SELECT id, '' AS backup_path FROM trash WHERE id NOT IN (SELECT id FROM selection) UNION ALL SELECT '', '/b/' || id FROM trash WHERE id IN (SELECT id FROM selection)")
def trash_dropped(spark, sf_dir):
    left, paths = journal.drop(journal_of(spark, sf_dir), selection(spark, sf_dir))
    return left.select("id", F.lit("").alias("backup_path")).union(paths.select(F.lit("").alias("id"), "backup_path"))


@register("backup_files", "SELECT cast(page_id AS varchar) AS id, octet_length(encode(html)) AS n, sha256(encode(html)) AS sha FROM pages WHERE html IS NOT NULL")
def backup_files(spark, sf_dir):
    folder = scratch_path(spark, "backups")
    content = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.encode("html", "utf-8").alias("content"))
    paths = spooled(write_backups(content, folder), "backup-paths")
    return paths.join(read_backups(spark, folder), "backup_path").select("id", F.octet_length("content").alias("n"), F.sha2("content", 256).alias("sha"))


@register("restored_originals", "SELECT cast(page_id AS varchar) AS id, page_id % 2 = 0 AND html IS NOT NULL AS ok, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 'restored' ELSE 'p' || page_id END END AS title, CASE WHEN page_id % 2 = 0 THEN sha256(encode(html)) END AS sha FROM pages")
def restored_originals(spark, sf_dir):
    """A journal of all pages of which the even ones have backups: all are asked for, and those come back."""
    folder = scratch_path(spark, "restore")
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "page_id", F.encode("html", "utf-8").alias("content"))
    paths = spooled(write_backups(pages.filter("page_id % 2 = 0"), f"{folder}/backups"), "backup-paths")
    entries = pages.join(paths, "id", "left").select("id", F.lit("o").alias("original_asset_id"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("p"), "id")).otherwise("").alias("filename"), F.coalesce("backup_path", F.concat(F.lit(f"{folder}/backups/gone-"), "id")).alias("backup_path"), F.lit(0).alias("original_bytes"), F.lit(0).alias("new_bytes"))
    table = open_tables(spark, folder)["trash"]
    table.change(lambda now: journal.insert_pending(now, entries))
    asked = journal.restore(table, pages.select("id"), f"{folder}/gallery")
    saved = spark.read.parquet(f"{folder}/gallery").select("id", "title", F.sha2("content", 256).alias("sha"))
    return asked.join(saved, "id", "left").select("id", "ok", "title", "sha")


@register("swept_journal", f"WITH {TRASH_SQL} SELECT id, state, 3 AS versions FROM trash WHERE NOT (state = 1 AND deleted_at_ms > 0 AND deleted_at_ms < epoch_ms(TIMESTAMP '{AS_OF}') - 14 * 86400000)")
def swept_journal(spark, sf_dir):
    """A journal in a new folder, opened at the current version, filled, swept at a launch, read back."""
    table = open_tables(spark, scratch_path(spark, "tables"))["trash"]
    table.write(journal_of(spark, sf_dir).withColumn("backup_path", F.lit("")))
    journal.launch_sweep(table, F.to_timestamp(F.lit(AS_OF)))
    return table.read().select("id", "state", F.lit(len(table.versions())).alias("versions"))


@register("kept_flags", f"WITH {ASSETS_SQL}, c AS (SELECT mime_type AS name, count(*) AS n FROM assets WHERE mime_type IS NOT NULL GROUP BY mime_type) SELECT name, CASE WHEN name = 'image/png' THEN FALSE ELSE n % 2 = 0 OR name = 'image/webp' END AS is_on FROM c")
def kept_flags(spark, sf_dir):
    """A switch for each kind of asset, on where their number is even; then two are set again."""
    flags = Flags(spark, scratch_path(spark, "flags"))
    kinds = assets(spark, sf_dir).filter("mime_type is not null").groupBy(F.col("mime_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    flags.put_all(kinds.select("name", F.lit(False).alias("on")))
    flags.put_all(kinds.select("name", (F.col("n") % 2 == 0).alias("on")))
    flags.put("image/png", False)
    flags.put("image/webp", True)
    return flags.table.read().select("name", F.col("on").alias("is_on"))


@register("newest_encodes", "SELECT user_id AS key, max(event_id) AS seq FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING max(event_id) = arg_max(event_id, event_id) AND max(event_id) >= (SELECT max(e.event_id) FROM events e WHERE e.user_id = events.user_id)")
def newest_encodes(spark, sf_dir):
    """Results of all requests but views: those of a user's newest request count."""
    requests = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type")
    return tasks.newest_results(requests.select("key", "seq"), requests.filter("event_type <> 'view'").select("key", "seq"))


@register("processed_events", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'skipped' WHEN event_type = 'error' THEN 'failed' ELSE 'saved' END AS status, CASE WHEN event_type NOT IN ('view', 'error') THEN reverse(event_type) END AS result FROM events")
def processed_events(spark, sf_dir):
    def work(data: bytes) -> bytes:
        if data == b"error":
            raise ValueError("no")
        return data[::-1]

    kind = F.when(F.col("event_type") != "view", F.encode("event_type", "utf-8"))
    out = tasks.processed(read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), kind.alias("data")), work, "long")
    return out.select("id", "status", F.when(F.col("status") == "saved", F.decode("result", "utf-8")).alias("result"))


@register("synced_by_bursts", f"WITH {ASSETS_SQL} SELECT id, width + 2 AS width, size_bytes FROM assets WHERE cast(id AS bigint) % 10 <> 3")
def synced_by_bursts(spark, sf_dir):
    """Bursts of changes sync the stored index with its source, one sync at a time."""
    from halyard.streaming.tasks import change_bursts, sync_on_bursts

    rows, folder = assets(spark, sf_dir), scratch_path(spark, "synced")
    table = VersionedTable(spark, f"{folder}/assets", ASSETS)
    table.write(rows)
    source = lambda: rows.filter(F.col("id").cast("long") % 10 != 3).select("id", "type", (F.col("width") + 2).alias("width"))
    changes = streamed(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    sync_on_bursts(change_bursts(changes), table, source, f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("id", "width", "size_bytes")


@register("emptied_trash", f"WITH {TRASH_SQL} SELECT id, state = 0 AS listed, state = 0 AND cast(id AS bigint) % 3 <> 0 AS backed FROM trash WHERE state = 0 OR cast(id AS bigint) % 3 <> 0")
def emptied_trash(spark, sf_dir):
    """A journal two thirds of whose entries have backups, emptied: what is left in the table and in the folder. Entries that
    are gone are listed by the backups they had."""
    folder = scratch_path(spark, "emptied")
    book = journal_of(spark, sf_dir)
    content = book.filter(F.col("id").cast("long") % 3 != 0).select("id", F.encode("original_asset_id", "utf-8").alias("content"))
    paths = spooled(write_backups(content, f"{folder}/backups"), "backup-paths")
    table = open_tables(spark, folder)["trash"]
    table.write(book.drop("backup_path").join(paths, "id", "left").withColumn("backup_path", F.coalesce("backup_path", F.lit(""))))
    journal.empty_trash(table).collect()
    left = present(paths).select("backup_path", F.lit(True).alias("there"))
    backed = paths.join(left, "backup_path", "left").select("id", F.coalesce("there", F.lit(False)).alias("backed"))
    listed = table.read().select("id", F.lit(True).alias("listed"))
    both = listed.join(backed, "id", "full_outer")
    return both.select("id", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("backed", F.lit(False)).alias("backed"))


@register("met_streams", f"""WITH {ASSETS_SQL}, sized AS (SELECT cast(user_id AS varchar) AS id, max(event_id) AS size FROM events GROUP BY user_id)
  SELECT a.id, a.width + 2 AS width, coalesce(s.size, a.size_bytes) AS size_bytes, CASE WHEN cast(a.id AS bigint) % 5 < 4 THEN 't' || cast(a.id AS bigint) % 5 ELSE a.title END AS title
  FROM assets a LEFT JOIN sized s ON s.id = a.id WHERE cast(a.id AS bigint) % 10 <> 3""")
def met_streams(spark, sf_dir):
    """A sync stream, a size stream and four writers change one stored index at the same time: every change is in the end."""
    from concurrent.futures import ThreadPoolExecutor

    from halyard.streaming.tasks import change_bursts, sizes_from, sync_on_bursts

    rows, folder = assets(spark, sf_dir), scratch_path(spark, "met")
    table = VersionedTable(spark, f"{folder}/assets", ASSETS)
    table.write(rows)
    source = lambda: rows.filter(F.col("id").cast("long") % 10 != 3).select("id", "type", (F.col("width") + 2).alias("width"))
    events = streamed(spark, sf_dir)
    changes = events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    sizes = events.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("size_bytes"))
    streams = [sync_on_bursts(change_bursts(changes), table, source, f"{folder}/sync"), sizes_from(sizes, table, f"{folder}/sizes")]
    running = [s.trigger(availableNow=True).start() for s in streams]

    def retitle(k: int) -> int:
        mine = F.col("id").cast("long") % 5 == k
        return table.change(lambda now: now.withColumn("title", F.when(mine, F.lit(f"t{k}")).otherwise(F.col("title")))).version

    with ThreadPoolExecutor(4) as pool:
        assert len(set(pool.map(retitle, range(4)))) == 4
    for query in running:
        query.awaitTermination()
    return table.read().select("id", "width", "size_bytes", "title")


@register("restored_few", "SELECT cast(page_id AS varchar) AS id, sha256(encode(html)) AS sha, (SELECT count(*) FROM pages WHERE page_id % 50 = 7 AND html IS NOT NULL) AS opened FROM pages WHERE page_id % 50 = 7 AND html IS NOT NULL")
def restored_few(spark, sf_dir):
    """All pages have backups; a fiftieth of them is asked for, and as many contents are read."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), "page_id", F.encode("html", "utf-8").alias("content"))
    paths = spooled(write_backups(pages, scratch_path(spark, "few")), "backup-paths")
    count = spark.sparkContext.accumulator(0)
    wanted = paths.filter(F.col("id").cast("long") % 50 == 7)
    found = spooled(wanted.join(opened(wanted, count), "backup_path").select("id", F.sha2("content", 256).alias("sha")), "opened")
    return found.withColumn("opened", F.lit(count.value).cast("long"))


@register("logged_changes", f"""WITH {ASSETS_SQL}, k AS (SELECT *, cast(id AS bigint) AS k FROM assets)
  SELECT id, width + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS width, CASE WHEN k % 14 = 0 THEN NULL WHEN k % 7 = 0 THEN 'new' ELSE title END AS title,
    CASE WHEN k % 5 = 0 THEN k WHEN k % 21 = 0 THEN NULL ELSE size_bytes END AS size_bytes FROM k WHERE k % 10 <> 3 UNION ALL
  SELECT id, 0, 'back', NULL FROM k WHERE k % 30 = 3 UNION ALL SELECT 'n' || id, width, NULL, 9 FROM k WHERE k % 1000 = 1""")
def logged_changes(spark, sf_dir):
    """Upserts, sizes, removals and returns appended to a log, with a compaction between them."""
    rows, k = assets(spark, sf_dir), F.col("id").cast("long")
    log = ChangeLog(spark, scratch_path(spark, "log"), ASSETS)
    log.put(rows)
    log.put(rows.filter(k % 7 == 0).select("id", (F.col("width") + 1).alias("width"), F.when(k % 14 != 0, "new").alias("title")))
    log.put(rows.filter(k % 21 == 0).select("id", F.lit(None).cast("long").alias("size_bytes")))
    log.compact()
    log.set(rows.filter(k % 5 == 0).select("id", k.alias("size_bytes")).union(rows.limit(1).select(F.lit("no such id"), F.lit(1).cast("long"))))
    log.remove(rows.filter(k % 10 == 3).select("id"))
    log.set(rows.filter(k % 10 == 3).select("id", F.lit(77).cast("long").alias("size_bytes")))
    log.put(rows.filter(k % 30 == 3).select("id", F.lit("back").alias("title")))
    log.put(rows.filter(k % 1000 == 1).select(F.concat(F.lit("n"), "id").alias("id"), "width"))
    log.set(rows.filter(k % 1000 == 1).select(F.concat(F.lit("n"), "id").alias("id"), F.lit(9).cast("long").alias("size_bytes")))
    return log.read().select("id", "width", "title", "size_bytes")


@register("digest_sync", f"WITH {ASSETS_SQL}, n AS (SELECT max(cast(id AS bigint)) AS top FROM assets) SELECT id, CASE WHEN cast(id AS bigint) % 1499 = 4 THEN width + 2 ELSE width END AS width, size_bytes FROM assets WHERE cast(id AS bigint) % 1499 <> 3 UNION ALL SELECT 'new' || id, width, NULL FROM assets WHERE cast(id AS bigint) % 1499 = 5")
def digest_sync(spark, sf_dir):
    """A source that differs in few rows: digests of ranges of ids say where."""
    rows, k = assets(spark, sf_dir), F.col("id").cast("long") % 1499
    source = rows.filter(k != 3).select("id", "type", F.when(k == 4, F.col("width") + 2).otherwise(F.col("width")).alias("width"), "title")
    source = source.union(rows.filter(k == 5).select(F.concat(F.lit("new"), "id").alias("id"), "type", "width", "title"))
    return digest.sync(rows, source).select("id", "width", "size_bytes")


TURNED_SQL = """t AS (SELECT page_id, page_id % 256 AS k, 1 + page_id % 5 AS w, 1 + page_id % 3 AS h, page_id % 4 AS t, page_id % 8 >= 4 AS fh, page_id % 16 >= 8 AS fv, (page_id % 3) / 4.0::double AS cl, (page_id % 2) / 3.0::double AS ct FROM pages),
  a AS (SELECT *, CASE WHEN t % 2 = 1 THEN h ELSE w END AS wide, CASE WHEN t % 2 = 1 THEN w ELSE h END AS high FROM t),
  b AS (SELECT *, least(cast(floor(cl * wide + 0.5) AS bigint), wide - 1) AS x0, least(cast(floor(ct * high + 0.5) AS bigint), high - 1) AS y0 FROM a),
  c AS (SELECT *, least(greatest(cast(floor(0.6::double * wide + 0.5) AS bigint), 1), wide - x0) AS nx, least(greatest(cast(floor(0.75::double * high + 0.5) AS bigint), 1), high - y0) AS ny FROM b),
  d AS (SELECT *, unnest(range(y0, y0 + ny)) AS y FROM c), e AS (SELECT *, unnest(range(x0, x0 + nx)) AS x FROM d),
  f AS (SELECT *, CASE WHEN fh THEN wide - 1 - x ELSE x END AS fx, CASE WHEN fv THEN high - 1 - y ELSE y END AS fy FROM e),
  g AS (SELECT *, CASE t WHEN 0 THEN fx WHEN 1 THEN fy WHEN 2 THEN w - 1 - fx ELSE w - 1 - fy END AS col, CASE t WHEN 0 THEN fy WHEN 1 THEN h - 1 - fx WHEN 2 THEN h - 1 - fy ELSE fx END AS row FROM f)"""


@register("turned_pixels", f"WITH {TURNED_SQL} SELECT page_id, string_agg(format('{{:02X}}{{:02X}}{{:02X}}', col, row, k) || CASE WHEN page_id % 2 = 1 THEN '80' ELSE '' END, '' ORDER BY y, x) AS pixels FROM g GROUP BY page_id")
def turned_pixels(spark, sf_dir):
    """Raw images whose pixels tell their column and row, turned, flipped and cropped: the pixels that the PNG holds."""
    k = F.col("page_id")
    w, h = (1 + k % 5).cast("int"), (1 + k % 3).cast("int")
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    pixel = lambda i: F.concat(byte(i % w), byte(F.floor(i / w)), byte(k % 256), F.when(k % 2 == 1, "80").otherwise("FF"))
    rgba = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), w * h - 1), pixel), ""))
    png = binary.transformed(rgba, w, h, (k % 4).cast("int"), k % 8 >= 4, k % 16 >= 8, k % 3 / F.lit(4.0), k % 2 / F.lit(3.0), F.lit(0.6), F.lit(0.75))
    return read(spark, sf_dir, "pages").select("page_id", png.alias("png")).select("page_id", F.hex(binary.png_pixels("png")).alias("pixels"))


@register("turned_images", """WITH p AS (SELECT page_id, cast(1 + page_id % 5 AS integer) AS w, cast(1 + page_id % 3 AS integer) AS h, cast(page_id % 4 AS integer) AS t FROM pages)
  SELECT page_id, CASE WHEN t % 2 = 1 THEN h ELSE w END AS wide, CASE WHEN t % 2 = 1 THEN w ELSE h END AS high, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 6 END AS colour FROM p""")
def turned_images(spark, sf_dir):
    """Raw images of several sizes, turned: the size and colour type that the PNG's header names."""
    k = F.col("page_id")
    w, h, t = (1 + k % 5).cast("int"), (1 + k % 3).cast("int"), (k % 4).cast("int")
    pixel = F.when(k % 2 == 0, F.lit("102030FF")).otherwise(F.lit("10203080"))
    no = F.lit(False)
    png = binary.transformed(F.unhex(F.repeat(pixel, w * h)), w, h, t, no, no, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    number = lambda at, n: F.conv(F.hex(F.substring("png", at, n)), 16, 10).cast("int")
    return read(spark, sf_dir, "pages").select("page_id", png.alias("png")).select("page_id", number(17, 4).alias("wide"), number(21, 4).alias("high"), number(26, 1).alias("colour"))

