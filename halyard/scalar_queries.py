"""More registered queries: column functions and small operators over the driver's tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from halyard.functions import binary, numbers, text
from halyard.operators import catalog_index, estimate, journal, tasks
from halyard.plans import view
from halyard.plans.view import View, planned
from halyard.queries import ANCHOR, ANCHOR_BYTES, ANCHOR_MS, ANCHOR_SQL, AS_OF, ASSETS_SQL, ITEMS_SQL, SELECTION_SQL, TASKS_SQL, assets, read, register, rounded_sql, selection, task_events
from halyard.sources import catalog


def sized(spark, sf_dir):
    return assets(spark, sf_dir).filter("size_bytes > 0")


@register("text_functions", f"""WITH {ASSETS_SQL} SELECT id, regexp_extract(title, '\\.([^.]+)$', 1) AS ext, regexp_replace(title, '\\.[^.]*$', '') || '_clean.heic' AS clean_name,
  CASE WHEN size_bytes < 1024 THEN size_bytes || 'B' WHEN size_bytes < 1048576 THEN {rounded_sql('size_bytes', 1 << 10, 0)} || 'KB' WHEN size_bytes < 10485760 THEN {rounded_sql('size_bytes', 1 << 20, 1)} || 'MB'
    WHEN size_bytes < 1073741824 THEN {rounded_sql('size_bytes', 1 << 20, 0)} || 'MB' ELSE {rounded_sql('size_bytes', 1 << 30, 1)} || 'GB' END AS badge,
  CASE WHEN width > 99 THEN '99+' ELSE cast(width AS varchar) END AS count_badge, replace(replace(title, '_', '_'), '/', '%2F') AS route,
  CASE WHEN type = 2 THEN 'jpg' ELSE 'webp' END AS target_ext FROM assets""")
def text_functions(spark, sf_dir):
    rows = assets(spark, sf_dir)
    target = F.when(F.col("type") == 2, "auto").otherwise("webp")
    return rows.select("id", text.extension(F.col("title")).alias("ext"), text.output_name(F.col("title"), F.lit("heic"), F.lit("clean"), F.lit(0)).alias("clean_name"), text.bytes_badge(F.col("size_bytes")).alias("badge"), text.badge_count(F.col("width")).alias("count_badge"), text.route_id(F.col("title")).alias("route"), text.target_extension(target).alias("target_ext"))


@register("camera_lines", "SELECT p_partkey, nullif(concat_ws(' ', nullif(trim(p_brand), ''), CASE WHEN p_size % 3 = 0 THEN NULL ELSE nullif(trim(p_type), '') END), '') AS camera, array_to_string(list_filter(['f/' || p_size, CASE WHEN p_size % 2 = 0 THEN '1/' || p_size END], lambda p: p IS NOT NULL), ' · ') AS exposure, CASE lower(p_type) WHEN 'av01' THEN 'AV1' ELSE trim(p_type) END AS codec FROM part")
def camera_lines(spark, sf_dir):
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", text.camera_line(F.col("p_brand"), F.when(size % 3 != 0, F.col("p_type"))).alias("camera"), text.exposure_line(F.concat(F.lit("f/"), size.cast("string")), F.when(size % 2 == 0, F.concat(F.lit("1/"), size.cast("string"))), F.lit(None).cast("string")).alias("exposure"), text.fourcc_label(F.col("p_type")).alias("codec"))


@register("number_functions", f"""WITH {ASSETS_SQL} SELECT id, least(greatest((size_bytes - width * 1000.0::double) / size_bytes, -1), 1) AS fraction, cast(round((1 - height * 900 / cast(size_bytes AS double)) * 100) AS bigint) AS percent,
  width / cast(height AS double) AS ratio, height / cast(width AS double) AS turned, cast(least(greatest(round(63 - (width % 101) / 2.0::double), 12), 55) AS integer) AS max_q,
  cast(greatest(least(greatest(round(63 - (width % 101) / 2.0::double), 12), 55) - 12, 0) AS integer) AS min_q, 0.6::double + (width % 101) / 100.0::double * 3.4::double AS bpp,
  CASE WHEN width % 12 >= 8 AND height % 9 >= 6 THEN 'high' WHEN width % 12 >= 4 AND height % 9 >= 3 THEN 'mid' ELSE 'low' END AS tier,
  cast(round((width % 61) * (duration_ms / 1000.0::double)) AS bigint) AS frames FROM assets WHERE size_bytes > 0""")
def number_functions(spark, sf_dir):
    w, h, s = F.col("width"), F.col("height"), F.col("size_bytes")
    q = numbers.avif_quantizers(w % 101)
    return sized(spark, sf_dir).select("id", numbers.savings_fraction(s, w * 1000).alias("fraction"), numbers.saved_percent(s, h * 900).alias("percent"), numbers.aspect_ratio(F.lit("original"), w, h, F.lit(2)).alias("ratio"), numbers.aspect_ratio(F.lit("original"), w, h, F.lit(3)).alias("turned"), q["max_q"].alias("max_q"), q["min_q"].alias("min_q"), numbers.hardware_rate(w % 101)["bpp"].alias("bpp"), numbers.device_tier(w % 12, h % 9).alias("tier"), numbers.video_frames(w % 61, F.col("duration_ms") / 1000).alias("frames"))


@register("crop_rects", f"""WITH {ASSETS_SQL}, f AS (SELECT id, width AS w, height AS h, (width % 97) / 100.0::double AS l, (height % 89) / 100.0::double AS t, (width % 53) / 50.0::double AS cw, (height % 47) / 50.0::double AS ch FROM assets),
  g AS (SELECT *, cast(least(greatest(round(l * w), 0), w - 1) AS integer) AS x, cast(least(greatest(round(t * h), 0), h - 1) AS integer) AS y FROM f)
  SELECT id, x, y, cast(least(greatest(round(cw * w), 1), w - x) AS integer) AS w, cast(least(greatest(round(ch * h), 1), h - y) AS integer) AS h, 1 - l - cw AS flipped_left, t AS turned_left FROM g""")
def crop_rects(spark, sf_dir):
    w, h = F.col("width"), F.col("height")
    left, top, cw, ch = (w % 97) / 100, (h % 89) / 100, (w % 53) / 50, (h % 47) / 50
    rows = assets(spark, sf_dir).select("id", numbers.crop_rect(w, h, left, top, cw, ch).alias("r"), numbers.unturned_rect(left, top, cw, ch, F.lit(0), F.lit(True), F.lit(False)).alias("f"), numbers.unturned_rect(left, top, cw, ch, F.lit(1), F.lit(False), F.lit(False)).alias("t"))
    return rows.select("id", "r.x", "r.y", "r.w", "r.h", F.col("f.left").alias("flipped_left"), F.col("t.left").alias("turned_left"))


@register("time_functions", f"""WITH {ASSETS_SQL} SELECT id, nullif(created_date, 0) AS created, CASE WHEN ms // 1000 < 60 THEN (ms // 1000) || '.' || (ms % 1000) // 100 || 's' ELSE (ms // 60000) || 'm ' || lpad(cast(ms // 1000 % 60 AS varchar), 2, '0') || 's' END AS elapsed,
  CASE WHEN ms // 1000 < 60 THEN (ms // 1000) || 's' ELSE (ms // 60000) || ':' || lpad(cast(ms // 1000 % 60 AS varchar), 2, '0') END AS clock FROM (SELECT id, created_date, cast(width AS bigint) * height % 200000 AS ms FROM assets)""")
def time_functions(spark, sf_dir):
    ms = numbers.pixels(F.col("width"), F.col("height")) % 200_000
    return assets(spark, sf_dir).select("id", F.unix_seconds(numbers.seconds_time(F.col("created_date"))).alias("created"), numbers.elapsed_text(ms).alias("elapsed"), numbers.clock_text(F.floor(ms / 1000)).alias("clock"))


@register("stub_heuristics", f"""WITH {ASSETS_SQL}, d AS (SELECT id, duration_ms / 1000.0::double AS s, cast(width AS bigint) * height AS px, width FROM assets WHERE type = 2)
  SELECT id, cast(least(greatest(floor(s * 12), 1), 64) AS integer) AS frames, cast(round(px * 12 * least(greatest(s, 0.1), 60) * 0.0005::double * 0.55::double) AS bigint) AS bytes, (width % 10) / 20.0::double < 0.2 AND s - (s - 0.1::double) < 0.2 AS whole,
    '~' || (t // 60) || ':' || lpad(cast(t % 60 AS varchar), 2, '0') || ' min' AS eta FROM (SELECT *, cast(round(s * (0.4::double + (width % 101) / 100.0::double * 1.6::double)) AS bigint) AS t FROM d)""")
def stub_heuristics(spark, sf_dir):
    s, px = F.col("duration_ms") / 1000, numbers.pixels(F.col("width"), F.col("height"))
    return assets(spark, sf_dir).filter("type = 2").select("id", numbers.frame_count(s, fps=F.lit(12)).alias("frames"), numbers.animation_bytes(px, F.lit(12), s, F.lit("webp")).alias("bytes"), numbers.trims_nothing((F.col("width") % 10) / 20, s - 0.1, s).alias("whole"), numbers.separation_text(s, F.col("width") % 101).alias("eta"))


@register("id_lists", "SELECT o_custkey, '[\"' || string_agg(cast(o_orderkey AS varchar), '\",\"' ORDER BY o_orderkey) || '\"]' AS ids, count(*) AS n FROM orders GROUP BY o_custkey")
def id_lists(spark, sf_dir):
    lists = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")).alias("l"))
    encoded = lists.select("o_custkey", text.encode_ids(F.col("l")).alias("ids"))
    return encoded.withColumn("n", F.size(text.decode_ids(F.col("ids"))).cast("long"))


@register("metadata_flags", "SELECT event_id, event_type = 'view' AS has_gps, event_type = 'click' AS has_date, event_type = 'error' AS has_camera, 1 AS tags FROM events")
def metadata_flags(spark, sf_dir):
    name = F.when(F.col("event_type") == "view", "GPS Latitude").when(F.col("event_type") == "click", "EXIF DateTimeOriginal").when(F.col("event_type") == "error", "Image Make").otherwise("Other")
    return read(spark, sf_dir, "events").select("event_id", binary.metadata_summary(F.create_map(name, F.lit("x"))).alias("m")).select("event_id", "m.*")


@register("sync_mapping", "SELECT cast(o_orderkey AS varchar) AS id, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_orderkey END AS created_date, 0 AS width, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 600) * 1000 END AS duration_ms FROM orders")
def sync_mapping(spark, sf_dir):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("int")
    raw = read(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.lit(1).alias("type"), F.when(k % 50 != 0, k).alias("created"), k.alias("modified"), none.alias("width"), none.alias("height"), F.when(k % 3 != 0, k % 600).alias("seconds"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("mime_type"))
    return catalog_index.synced_rows(raw).select("id", "created_date", "width", "duration_ms")


@register("source_range", f"WITH {ASSETS_SQL} SELECT id, created_date FROM assets ORDER BY created_date DESC, id LIMIT 250 OFFSET 500")
def source_range(spark, sf_dir):
    return catalog_index.scanned(assets(spark, sf_dir), 500, 750).select("id", "created_date")


@register("size_lookup", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id, size_bytes FROM assets WHERE size_bytes > 0 AND id IN (SELECT id FROM selection)")
def size_lookup(spark, sf_dir):
    rows = assets(spark, sf_dir).select(F.col("id").cast("long").alias("_id"), F.col("size_bytes").alias("_size"))
    return catalog.store_sizes(rows, selection(spark, sf_dir).union(spark.createDataFrame([("not/a/number",)], "id string")))


@register("raw_sizes", f"WITH {ASSETS_SQL} SELECT id, size_bytes FROM assets WHERE size_bytes IS NOT NULL AND type = 1")
def raw_sizes(spark, sf_dir):
    sign = F.when(F.col("type") == 1, F.lit("")).otherwise(F.lit("-1"))
    return catalog.fresh_sizes(assets(spark, sf_dir).select("id", F.concat(sign, F.col("size_bytes").cast("string"), F.lit(".7")).alias("size")))


@register("resource_sizes", "SELECT cast(l_orderkey AS varchar) AS id, cast(arg_min(l_quantity, (CASE WHEN l_returnflag IN ('A', 'R') THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_quantity)) AS bigint) AS size_bytes FROM lineitem GROUP BY l_orderkey")
def resource_sizes(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "photo").when(F.col("l_returnflag") == "R", "video").otherwise("other")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.struct("l_linenumber", "l_partkey").alias("position"), kind.alias("kind"), F.col("l_quantity").cast("long").alias("size"))
    return catalog.resource_sizes(rows)


@register("album_page", f"WITH {ASSETS_SQL} SELECT id, type FROM assets JOIN orders ON id = cast(o_orderkey AS varchar) WHERE o_orderstatus = 'F' ORDER BY o_totalprice, id LIMIT 40 OFFSET 20")
def album_page(spark, sf_dir):
    members = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("album_id"), F.col("o_orderkey").cast("string").alias("asset_id"), F.col("o_totalprice").alias("position"))
    return catalog.album_page(assets(spark, sf_dir), members, "F", 20, 60).select("id", "type")


@register("album_strip", "SELECT n_nationkey AS position, n_name AS name, 19 AS more FROM nation WHERE n_nationkey > 0 ORDER BY n_nationkey LIMIT 5")
def album_strip(spark, sf_dir):
    albums = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("name"), (F.col("n_nationkey") == 0).alias("is_all"))
    return view.album_strip(albums).select("position", "name", "more")


@register("moved_items", "SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 10 WHEN n_nationkey > 3 AND n_nationkey <= 10 THEN n_nationkey - 1 ELSE n_nationkey END AS position FROM nation")
def moved_items(spark, sf_dir):
    return view.moved(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position")), 3, 10)


@register("shared_items", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id FROM assets WHERE id IN (SELECT id FROM selection) ORDER BY created_date DESC, id LIMIT 12")
def shared_items(spark, sf_dir):
    return view.shared(view.positions(assets(spark, sf_dir), planned(View())), selection(spark, sf_dir)).select("id")


@register("two_pages", f"WITH {ASSETS_SQL} SELECT id FROM assets ORDER BY created_date DESC, id LIMIT 200")
def two_pages(spark, sf_dir):
    rows, p = assets(spark, sf_dir), planned(View())
    return view.next_page(view.page(rows, p, 0, 100), rows, p, 100).select("id")


@register("trash_items", f"SELECT cast(event_id AS varchar) AS id, coalesce(nullif(nullif(event_type, 'view'), ''), 'IMG') AS name, CASE WHEN event_type = 'error' OR event_id = 0 THEN epoch_ms(TIMESTAMP '{AS_OF}') ELSE event_id END AS deleted_at_ms, CASE WHEN event_id % 2 = 1 THEN 'video' ELSE 'image' END AS kind FROM events")
def trash_items(spark, sf_dir):
    """Journal entries as a list shows them: no name or an empty one is IMG, and a time of 0, whatever the event, is now."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = F.col("event_type")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.when(e == "view", "").otherwise(e).alias("filename"), F.when(e == "error", 0).otherwise(F.col("event_id")).alias("deleted_at_ms"), (1 + F.col("event_id") % 2).alias("asset_type"))
    return journal.items(rows, F.to_timestamp(F.lit(AS_OF)))


@register("trash_by_id", "SELECT cast(event_id AS varchar) AS id, user_id FROM events WHERE event_id = 77")
def trash_by_id(spark, sf_dir):
    return journal.by_id(read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "user_id"), "77")


@register("trash_committed_rows", "SELECT cast(event_id AS varchar) AS id, CASE WHEN event_id = 5 THEN 1 ELSE 0 END AS state, CASE WHEN event_id = 5 THEN 'new' ELSE 'old' END AS new_asset_id, CASE WHEN event_id = 5 THEN 1000 ELSE 0 END AS deleted_at_ms, event_id AS new_bytes FROM events")
def trash_committed_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.lit(0).alias("state"), F.lit("old").alias("new_asset_id"), F.lit(0).cast("long").alias("deleted_at_ms"), F.col("event_id").alias("new_bytes"))
    return journal.mark_committed(rows, "5", 1000, "new")


@register("task_any_finished", f"WITH {TASKS_SQL} SELECT count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) > 0 AS any_finished FROM (SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks GROUP BY task_id)")
def task_any_finished(spark, sf_dir):
    return tasks.any_finished(tasks.latest(task_events(spark, sf_dir)))


@register("task_clear_finished", f"WITH {TASKS_SQL} SELECT * FROM (SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks GROUP BY task_id) WHERE status IN ('running', 'pending')")
def task_clear_finished(spark, sf_dir):
    return tasks.clear_finished(tasks.latest(task_events(spark, sf_dir)))


@register("task_new_outputs", f"WITH {TASKS_SQL}, b AS (SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks WHERE seq % 2 = 0 GROUP BY task_id), a AS (SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks GROUP BY task_id) SELECT task_id, unnest([task_id * 10, task_id * 10 + 1]) AS output_id FROM a WHERE status = 'completed' AND task_id NOT IN (SELECT task_id FROM b WHERE status = 'completed')")
def task_new_outputs(spark, sf_dir):
    events = task_events(spark, sf_dir)
    outputs = F.array(F.col("task_id") * 10, F.col("task_id") * 10 + 1).alias("outputs")
    before, after = (tasks.latest(e).select("*", outputs) for e in (events.filter("seq % 2 = 0"), events))
    return tasks.newly_completed(before, after)


@register("batch_outcome", "SELECT count(*) AS done, count(*) FILTER (event_type = 'purchase') AS saved, count(*) FILTER (event_type = 'view') AS skipped, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'completed' ELSE 'failed' END AS outcome FROM events")
def batch_outcome(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "saved").when(F.col("event_type") == "view", "skipped").otherwise("failed")
    return tasks.batch_outcome(read(spark, sf_dir, "events").select(status.alias("status")))


@register("estimate_run", f"WITH e AS ({ANCHOR_SQL}), s AS (WITH {ITEMS_SQL} SELECT sum(pixels) / 1e6 * ({ANCHOR_MS}.0::double / ((SELECT pixels FROM items WHERE id = '{ANCHOR}') / 1e6)) / 1000 AS seconds FROM items) SELECT e.*, s.seconds, 'heic' AS target FROM e, s")
def estimate_run(spark, sf_dir):
    rows = assets(spark, sf_dir)
    return estimate.estimate(rows, rows.filter("type = 1").select("id"), "auto", 80, {"heic": True}, (ANCHOR, ANCHOR_BYTES, ANCHOR_MS))
