"""The registered queries over the driver's tables, each beside SQL for the same rows.

``assets``, ``trash`` and ``tasks`` are views over ``orders`` and ``events``; times are fixed, so results are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.functions import binary, numbers, text
from halyard.operators import catalog_index, estimate, journal, tasks
from halyard.plans import view
from halyard.plans.rank_index import RankIndex
from halyard.plans.view import View, planned
from halyard.schema import TARGETS
from halyard.scratch import numbered, scratch_path, spooled
from halyard.sources.catalog import assets_of, tasks_of, trash_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"
ANCHOR, ANCHOR_BYTES, ANCHOR_MS = "2688", 900_000, 1500

ASSETS_SQL = """assets AS (
  SELECT cast(k AS varchar) AS id, CASE WHEN video THEN 2 ELSE 1 END AS type,
    CASE WHEN k % 50 = 0 THEN 0 ELSE cast(epoch(o_orderdate) AS bigint) END AS created_date,
    cast(640 + (k * 37) % 7360 AS integer) AS width, cast(480 + (k * 53) % 5520 AS integer) AS height,
    cast(CASE WHEN video THEN (k % 600) * 1000 ELSE 0 END AS bigint) AS duration_ms,
    CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN 0 ELSE cast(round(o_totalprice * 50) AS bigint) END AS size_bytes,
    'IMG_' || k || CASE WHEN video THEN CASE WHEN k % 2 = 0 THEN '.MP4' ELSE '.mov' END ELSE ['.JPG', '.png', '.HEIC', '.webp', '.avif'][d] END AS title,
    CASE WHEN k % 29 = 0 THEN NULL WHEN video THEN CASE WHEN k % 2 = 0 THEN 'video/mp4' ELSE 'video/quicktime' END
      ELSE ['image/jpeg', 'image/png', 'image/heic', 'image/webp', 'image/avif'][d] END AS mime_type
  FROM (SELECT o_orderkey AS k, o_orderstatus = 'O' AS video, cast(left(o_orderpriority, 1) AS integer) AS d, * FROM orders))"""
TRASH_SQL = """trash AS (
  SELECT cast(event_id AS varchar) AS id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS state,
    CASE WHEN event_type = 'error' THEN 0 ELSE (epoch_us(ts) // 1000) END AS deleted_at_ms,
    cast(round(value * 1000) AS bigint) AS original_bytes, cast(1 + event_id % 2 AS integer) AS asset_type
  FROM events)"""
TASKS_SQL = """tasks AS (
  SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running'
    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' END AS status
  FROM events)"""
STATES_SQL = f"""{TASKS_SQL}, states AS (
  SELECT task_id, list_reduce(list_prepend('pending', list(status ORDER BY ts, seq)), lambda s, e: CASE WHEN e = 'cancelled' THEN e WHEN s IN ('completed', 'failed', 'cancelled') THEN s
    WHEN e IN ('running', 'failed') THEN e WHEN e = 'completed' AND s = 'running' THEN e ELSE s END) AS status
  FROM tasks GROUP BY task_id)"""
SELECTION_SQL = "selection AS (SELECT DISTINCT cast(user_id AS varchar) AS id FROM events)"
FAMILY_SQL = """CASE WHEN m LIKE '%jpeg%' OR m LIKE '%jpg%' OR e IN ('jpeg', 'jpg') THEN 'jpeg' WHEN m LIKE '%png%' OR e IN ('png', 'jpng') THEN 'png'
    WHEN m LIKE '%hei%' OR e IN ('heic', 'heif') THEN 'heif' WHEN m LIKE '%avif%' OR e = 'avif' THEN 'avif' WHEN m LIKE '%webp%' OR e = 'webp' THEN 'webp' ELSE 'other' END"""
ITEMS_SQL = f"""{ASSETS_SQL}, items AS (
  SELECT id, cast(width AS bigint) * height AS pixels, coalesce(size_bytes, 0) AS source_bytes, {FAMILY_SQL} AS family, FALSE AS has_alpha
  FROM (SELECT *, lower(coalesce(mime_type, '')) AS m, lower(regexp_extract(title, '\\.([^.]+)$', 1)) AS e FROM assets) WHERE type = 1 AND size_bytes > 0)"""


def predicted_sql(target: str, quality: int) -> str:
    bpp = "source_bytes * 8.0::double / pixels"
    ref = "CASE family " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in estimate.SOURCE_BPP.items()) + " END"
    raw = f"pow({bpp} / {ref}, 0.8::double)"
    shaped = f"CASE WHEN family = 'png' THEN 1 + ({raw} - 1) * 0.35::double ELSE {raw} END"
    rate = f"{estimate.TARGET_BPP[target] * estimate.quality_factor(quality)!r}::double * least(greatest({shaped}, 0.3::double), 3.0::double)"
    if target != "jpeg":
        rate = f"CASE WHEN has_alpha THEN {rate} * 1.12::double ELSE {rate} END"
    size = f"greatest(cast(round(pixels * ({rate}) / 8) AS bigint), 512)"
    if target != "png":
        size = f"CASE WHEN source_bytes > 0 THEN least({size}, cast(round(source_bytes * 1.2::double) AS bigint)) ELSE {size} END"
    return f"CASE WHEN pixels > 0 THEN {size} ELSE 0 END"


TIER_SQL = "CASE WHEN source_bytes * 8.0::double / pixels < 1.2 THEN 0 WHEN source_bytes * 8.0::double / pixels < 2.6 THEN 1 WHEN source_bytes * 8.0::double / pixels < 4.0 THEN 2 ELSE 3 END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return assets_of(read(spark, sf_dir, "orders"))


def trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return trash_of(read(spark, sf_dir, "events"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return tasks_of(read(spark, sf_dir, "events"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id")).distinct()


def image_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.items(assets(spark, sf_dir).filter("type = 1 and size_bytes > 0"))


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


COLUMNS = ["id", "type", "created_date", "width", "height", "duration_ms", "size_bytes", "title", "mime_type"]


@register("page_medium_images", f"WITH {ASSETS_SQL} SELECT {', '.join(COLUMNS)} FROM assets WHERE type = 1 AND size_bytes >= 1048576 AND size_bytes < 10485760 ORDER BY size_bytes DESC NULLS LAST, id LIMIT 5 OFFSET 10")
def page_medium_images(spark, sf_dir):
    return view.page(assets(spark, sf_dir), planned(View("photos", "largest", "medium")), 10, 5).select(*COLUMNS)


@register("view_by_date", f"WITH {ASSETS_SQL} SELECT id, created_date FROM assets ORDER BY created_date DESC, id")
def view_by_date(spark, sf_dir):
    return view.entries(assets(spark, sf_dir), planned(View())).select("id", "created_date")


@register("view_by_size", f"WITH {ASSETS_SQL} SELECT id, size_bytes FROM assets WHERE type = 2 ORDER BY size_bytes ASC NULLS FIRST, id")
def view_by_size(spark, sf_dir):
    return view.entries(assets(spark, sf_dir), planned(View("videos", "smallest"))).select("id", "size_bytes")


@register("filter_format_jpeg", f"WITH {ASSETS_SQL} SELECT id, mime_type, title FROM assets WHERE lower(mime_type) LIKE '%jpeg%' OR lower(mime_type) LIKE '%jpg%' OR lower(title) LIKE '%.jpeg' OR lower(title) LIKE '%.jpg'")
def filter_format_jpeg(spark, sf_dir):
    return view.matching(assets(spark, sf_dir), planned(View(format="jpeg"))).select("id", "mime_type", "title")


@register("filter_format_mov", f"WITH {ASSETS_SQL} SELECT id, mime_type, title FROM assets WHERE type = 2 AND size_bytes >= 10485760 AND (lower(mime_type) LIKE '%mov%' OR lower(mime_type) LIKE '%quicktime%' OR lower(title) LIKE '%.mov' OR lower(title) LIKE '%.quicktime')")
def filter_format_mov(spark, sf_dir):
    return view.matching(assets(spark, sf_dir), planned(View("videos", size="large", format="mov"))).select("id", "mime_type", "title")


@register("client_view", f"WITH {ASSETS_SQL} SELECT id, size_bytes FROM assets WHERE (size_bytes IS NULL OR size_bytes < 1048576) AND (lower(mime_type) LIKE '%mov%' OR lower(mime_type) LIKE '%quicktime%' OR lower(title) LIKE '%.mov')")
def client_view(spark, sf_dir):
    rows = assets(spark, sf_dir).withColumn("position", F.col("id").cast("long"))
    return view.client_view(rows, View(sort="smallest", size="small", format="mov")).select("id", "size_bytes")


@register("select_all_ids", f"WITH {ASSETS_SQL} SELECT id FROM assets WHERE type = 1 AND size_bytes < 1048576")
def select_all_ids(spark, sf_dir):
    return view.select_all(assets(spark, sf_dir), View(size="small"))


@register("type_lock", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT cast(arg_min(type, pos) AS integer) AS type FROM (SELECT *, row_number() OVER (ORDER BY created_date DESC, id) AS pos FROM assets) WHERE id IN (SELECT id FROM selection)")
def type_lock(spark, sf_dir):
    return view.type_lock(view.positions(assets(spark, sf_dir), planned(View())), selection(spark, sf_dir))


@register("count_total", f"WITH {ASSETS_SQL} SELECT count(*) AS n FROM assets")
def count_total(spark, sf_dir):
    return view.count(assets(spark, sf_dir))


@register("count_filtered", f"WITH {ASSETS_SQL} SELECT count(*) AS n FROM assets WHERE type = 2 AND size_bytes >= 1048576 AND size_bytes < 10485760")
def count_filtered(spark, sf_dir):
    return view.count(assets(spark, sf_dir), planned(View("videos", size="medium")))


@register("size_buckets", f"WITH {ASSETS_SQL} SELECT type, CASE WHEN size_bytes IS NULL THEN 'unknown' WHEN size_bytes < 1048576 THEN 'small' WHEN size_bytes < 10485760 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n, cast(sum(size_bytes) AS bigint) AS total FROM assets GROUP BY ALL")
def size_buckets(spark, sf_dir):
    s = F.col("size_bytes")
    bucket = F.when(s.isNull(), "unknown").when(s < 1 << 20, "small").when(s < 10 << 20, "medium").otherwise("large")
    return assets(spark, sf_dir).groupBy("type", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("total"))


@register("missing_sizes", f"WITH {ASSETS_SQL} SELECT id FROM assets WHERE size_bytes IS NULL ORDER BY id LIMIT 200")
def missing_sizes(spark, sf_dir):
    return view.ids_missing_size(assets(spark, sf_dir))


@register("first_missing", f"WITH {ASSETS_SQL} SELECT id, created_date FROM assets WHERE size_bytes IS NULL ORDER BY created_date DESC, id LIMIT 300")
def first_missing(spark, sf_dir):
    return view.first_missing(assets(spark, sf_dir), planned(View())).select("id", "created_date")


@register("sizes_for", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id, size_bytes FROM assets WHERE size_bytes > 0 AND id IN (SELECT id FROM selection)")
def sizes_for(spark, sf_dir):
    return view.known_sizes(assets(spark, sf_dir), selection(spark, sf_dir))


@register("facts_for", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id, size_bytes, width, height FROM assets WHERE size_bytes > 0 AND id IN (SELECT id FROM selection)")
def facts_for(spark, sf_dir):
    return view.facts(assets(spark, sf_dir), selection(spark, sf_dir))


@register("estimate_facts", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id, width, height, size_bytes, mime_type, title FROM assets WHERE size_bytes > 0 AND id IN (SELECT id FROM selection)")
def estimate_facts(spark, sf_dir):
    return view.estimate_facts(assets(spark, sf_dir), selection(spark, sf_dir))


@register("selection_bytes", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT cast(coalesce(sum(size_bytes), 0) AS bigint) AS total FROM assets WHERE size_bytes > 0 AND id IN (SELECT id FROM selection)")
def selection_bytes(spark, sf_dir):
    return view.facts(assets(spark, sf_dir), selection(spark, sf_dir)).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total"))


@register("spine", f"WITH {ASSETS_SQL} SELECT id, type, CASE WHEN size_bytes > 0 THEN size_bytes WHEN cast(id AS bigint) % 74 = 0 THEN 4242 END AS size_bytes, cast(round(duration_ms / 1000.0) AS bigint) AS seconds, nullif(created_date, 0) AS created FROM assets")
def spine(spark, sf_dir):
    rows = assets(spark, sf_dir)
    fresh = rows.filter(F.col("id").cast("long") % 74 == 0).select("id", F.lit(4242).cast("long").alias("size_bytes"))
    return view.spine(rows, fresh).withColumn("created", F.unix_seconds("created"))


@register("sync_prune", f"WITH {ASSETS_SQL} SELECT id FROM assets WHERE cast(id AS bigint) % 10 = 3")
def sync_prune(spark, sf_dir):
    rows = assets(spark, sf_dir)
    return catalog_index.pruned(rows, rows.filter(F.col("id").cast("long") % 10 != 3).select("id"))


@register("upsert_preserve", f"WITH {ASSETS_SQL}, delta AS (SELECT id, type, width + 1 AS width, CASE WHEN cast(id AS bigint) % 14 = 0 THEN NULL ELSE 'new_' || title END AS title FROM assets WHERE cast(id AS bigint) % 7 = 0 UNION ALL SELECT 'n' || id, type, width + 1, 'new_' || title FROM assets WHERE cast(id AS bigint) % 1000 = 1) SELECT coalesce(a.id, d.id) AS id, coalesce(d.type, a.type) AS type, coalesce(d.width, a.width) AS width, CASE WHEN d.id IS NULL THEN a.title ELSE d.title END AS title, coalesce(a.height, 0) AS height, a.size_bytes FROM assets a FULL JOIN delta d ON a.id = d.id")
def upsert_preserve(spark, sf_dir):
    rows = assets(spark, sf_dir)
    k = F.col("id").cast("long")
    title = F.concat(F.lit("new_"), F.col("title"))
    delta = rows.filter(k % 7 == 0).select("id", "type", (F.col("width") + 1).alias("width"), F.when(k % 14 != 0, title).alias("title"))
    fresh = rows.filter(k % 1000 == 1).select(F.concat(F.lit("n"), "id").alias("id"), "type", (F.col("width") + 1).alias("width"), title.alias("title"))
    return catalog_index.upsert(rows, delta.union(fresh)).select("id", "type", "width", "title", "height", "size_bytes")


@register("sync_table", f"WITH {ASSETS_SQL} SELECT id, width + 2 AS width, size_bytes FROM assets WHERE cast(id AS bigint) % 10 <> 3")
def sync_table(spark, sf_dir):
    rows = assets(spark, sf_dir)
    source = rows.filter(F.col("id").cast("long") % 10 != 3).select("id", "type", (F.col("width") + 2).alias("width"))
    return catalog_index.sync(rows, source).select("id", "width", "size_bytes")


@register("size_pass", f"WITH {ASSETS_SQL} SELECT id, CASE WHEN size_bytes IS NOT NULL THEN size_bytes WHEN cast(id AS bigint) % 2 = 0 THEN cast(id AS bigint) * 10 ELSE 0 END AS size_bytes FROM assets")
def size_pass(spark, sf_dir):
    rows = assets(spark, sf_dir)
    found = rows.filter(F.col("id").cast("long") % 2 == 0).select("id", (F.col("id").cast("long") * 10).alias("size_bytes"))
    return catalog_index.resolve_sizes(rows, found).select("id", "size_bytes")


@register("set_sizes", f"WITH {ASSETS_SQL} SELECT id, CASE WHEN cast(id AS bigint) % 5 = 0 THEN cast(id AS bigint) ELSE size_bytes END AS size_bytes FROM assets")
def set_sizes(spark, sf_dir):
    rows = assets(spark, sf_dir)
    new = rows.filter(F.col("id").cast("long") % 5 == 0).select("id", F.col("id").cast("long").alias("size_bytes"))
    unknown = new.limit(1).select(F.lit("no such id").alias("id"), "size_bytes")
    return catalog_index.set_sizes(rows, new.union(unknown)).select("id", "size_bytes")


@register("delete_ids", f"WITH {ASSETS_SQL}, {SELECTION_SQL} SELECT id FROM assets WHERE id NOT IN (SELECT id FROM selection)")
def delete_ids(spark, sf_dir):
    return catalog_index.delete_ids(assets(spark, sf_dir), selection(spark, sf_dir)).select("id")


@register("family_classification", f"WITH {ASSETS_SQL} SELECT family, count(*) AS n FROM (SELECT {FAMILY_SQL} AS family FROM (SELECT lower(coalesce(mime_type, '')) AS m, lower(regexp_extract(title, '\\.([^.]+)$', 1)) AS e FROM assets)) GROUP BY family")
def family_classification(spark, sf_dir):
    return assets(spark, sf_dir).groupBy(text.family(F.col("mime_type"), F.col("title")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@register("predict_items", f"WITH {ITEMS_SQL} SELECT id, {predicted_sql('heic', 80)} AS heic, {predicted_sql('jpeg', 60)} AS jpeg, {predicted_sql('png', 95)} AS png FROM items")
def predict_items(spark, sf_dir):
    return image_items(spark, sf_dir).select("id", estimate.predicted("heic", 80).alias("heic"), estimate.predicted("jpeg", 60).alias("jpeg"), estimate.predicted("png", 95).alias("png"))


@register("prior_total", f"WITH {ITEMS_SQL}, t AS (SELECT cast(sum({predicted_sql('heic', 80)}) AS double) AS e FROM items) SELECT cast(round(e * 0.55::double) AS bigint) AS low, cast(e AS bigint) AS expected, cast(round(e * 1.45::double) AS bigint) AS high, 0.25::double AS confidence FROM t")
def prior_total(spark, sf_dir):
    return estimate.prior(image_items(spark, sf_dir), "heic", 80)


@register("batch_savings", f"WITH {ITEMS_SQL}, t AS (SELECT count(*) AS items, cast(sum(source_bytes) AS bigint) AS original, cast(sum(CASE WHEN source_bytes > 0 THEN least(p, source_bytes) ELSE p END) AS bigint) AS output FROM (SELECT *, {predicted_sql('heic', 80)} AS p FROM items)) SELECT items, original, output, least(greatest(original - output, 0), original) AS saved, cast(round(100.0 * least(greatest(original - output, 0), original) / original) AS bigint) AS percent, items > 0 AS is_approximation FROM t")
def batch_savings(spark, sf_dir):
    return estimate.batch_savings(image_items(spark, sf_dir), "heic", 80)


SAMPLES_SQL = f"""samples AS (SELECT *, cast(predicted * (70 + cast(id AS bigint) % 61) // 100 AS bigint) * CASE WHEN cast(id AS bigint) % 1900 = 0 THEN 9 ELSE 1 END AS actual
  FROM (SELECT *, {predicted_sql('heic', 80)} AS predicted, {TIER_SQL} AS tier FROM items WHERE cast(id AS bigint) % 95 = 0))"""
CALIBRATE_SQL = f"""WITH {ITEMS_SQL}, {SAMPLES_SQL},
  rated AS (SELECT *, actual / cast(predicted AS double) AS ratio FROM samples WHERE predicted > 0),
  kept AS (SELECT * FROM rated, (SELECT median(ratio) AS med FROM rated) WHERE ratio BETWEEN med / 3 AND med * 3),
  sums AS (SELECT family, tier, sum(actual) / cast(sum(predicted) AS double) AS alpha, count(*) AS n, grouping(family, tier) AS g FROM kept GROUP BY GROUPING SETS ((family, tier), (tier), ())),
  spread AS (SELECT alpha AS common, least(greatest(least(greatest((SELECT median(abs(ratio - alpha)) FROM kept) / alpha, 0), 1) / sqrt(n), 0.04), 0.5) AS half FROM sums WHERE g = 3),
  each AS (SELECT e * coalesce(f.alpha, c.alpha, s.common) AS x FROM (SELECT *, {predicted_sql('heic', 80)} AS e, {TIER_SQL} AS tier FROM items) i
    LEFT JOIN (SELECT * FROM sums WHERE g = 0 AND n >= 2) f ON f.family = i.family AND f.tier = i.tier LEFT JOIN (SELECT * FROM sums WHERE g = 2 AND n >= 2) c ON c.tier = i.tier, spread s),
  t AS (SELECT round(cast(sum(cast(x AS decimal(30, 6))) AS double)) AS e FROM each)
  SELECT cast(round(e * (1 - half)) AS bigint) AS low, cast(e AS bigint) AS expected, cast(round(e * (1 + half)) AS bigint) AS high, least(1 - half, 0.97) AS confidence FROM t, spread"""


@register("calibrate", CALIBRATE_SQL)
def calibrate(spark, sf_dir):
    rows = image_items(spark, sf_dir)
    k = F.col("id").cast("long")
    samples = rows.filter(k % 95 == 0).withColumn("predicted", estimate.predicted("heic", 80))
    samples = samples.withColumn("actual", F.floor(F.col("predicted") * (70 + k % 61) / 100).cast("long") * F.when(k % 1900 == 0, 9).otherwise(1))
    return estimate.calibrated(rows, samples, "heic", 80)


ANCHOR_SQL = f"""WITH {ITEMS_SQL}, each AS (SELECT *, {predicted_sql('heic', 80)} AS e, {TIER_SQL} AS tier FROM items),
  a AS (SELECT family AS f, tier AS t, least(greatest({ANCHOR_BYTES} / cast(e AS double), 0.2), 5.0) AS ratio FROM each WHERE id = '{ANCHOR}'),
  w AS (SELECT e, a.ratio, CASE WHEN family = f AND tier = t THEN 0.9::double WHEN family = f AND abs(tier - t) = 1 THEN 0.6::double WHEN tier = t THEN 0.5::double WHEN abs(tier - t) = 1 THEN 0.35::double ELSE 0.22::double END AS weight FROM each LEFT JOIN a ON TRUE),
  s AS (SELECT CASE WHEN any_value(ratio) IS NULL THEN cast(sum(e) AS double) ELSE round(cast(sum(cast(e * (1 + (ratio - 1) * weight) AS decimal(30, 6))) AS double)) END AS x, any_value(ratio) IS NOT NULL AS known FROM w)
  SELECT cast(round(x * (1 - CASE WHEN known THEN 0.22::double ELSE 0.45::double END)) AS bigint) AS low, cast(x AS bigint) AS expected, cast(round(x * (1 + CASE WHEN known THEN 0.22::double ELSE 0.45::double END)) AS bigint) AS high, CASE WHEN known THEN 0.55::double ELSE 0.25::double END AS confidence FROM s"""


@register("anchor_calibrate", ANCHOR_SQL)
def anchor_calibrate(spark, sf_dir):
    return estimate.anchored(image_items(spark, sf_dir), ANCHOR, ANCHOR_BYTES, "heic", 80)


@register("eta", f"WITH {ITEMS_SQL} SELECT sum(pixels) / 1e6 * ({ANCHOR_MS}.0::double / ((SELECT pixels FROM items WHERE id = '{ANCHOR}') / 1e6)) / 1000 AS seconds FROM items")
def eta(spark, sf_dir):
    return estimate.eta_seconds(image_items(spark, sf_dir), ANCHOR, ANCHOR_MS)


@register("stratified_sample", f"""WITH {ITEMS_SQL}, r AS (SELECT id, pixels, family, {TIER_SQL} AS tier, cast(id AS bigint) AS idx FROM items),
  w AS (SELECT *, row_number() OVER (PARTITION BY family, tier ORDER BY pixels, idx) AS i, count(*) OVER (PARTITION BY family, tier) AS n, min(idx) OVER (PARTITION BY family, tier) AS first FROM r)
  SELECT id, family, cast(tier AS integer) AS tier, row_number() OVER (ORDER BY least(2 * (n - i), 2 * (i - 1) + 1), first) - 1 AS place FROM w QUALIFY place < 40""")
def stratified_sample(spark, sf_dir):
    rows = image_items(spark, sf_dir).withColumn("idx", F.col("id").cast("long"))
    return estimate.stratified_sample(rows, 40).select("id", "family", "tier", "place")


POLICY_SQL = f"""WITH {ASSETS_SQL}, caps AS (SELECT * FROM (VALUES ('ios', TRUE, FALSE, TRUE, FALSE), ('android', FALSE, TRUE, TRUE, FALSE), ('other', FALSE, FALSE, TRUE, FALSE)) t(platform, heic, heif, webp, hw)),
  chosen AS (SELECT id, ['ios', 'android', 'other'][1 + cast(id AS bigint) % 3] AS platform, ['auto', 'avif', 'heic', 'webp', 'jpeg', 'png'][1 + width % 6] AS choice, height % 2 = 0 AS has_alpha FROM assets WHERE type = 1)
  SELECT id, platform, choice, has_alpha, CASE WHEN choice <> 'auto' THEN choice WHEN hw THEN 'avif' WHEN heic OR heif THEN 'heic' WHEN webp THEN 'webp' WHEN has_alpha THEN 'png' ELSE 'jpeg' END AS target,
    has_alpha AND choice = 'jpeg' AS flatten,
    array_to_string(list_filter(list_distinct_ordered, lambda t: t <> 'auto' AND NOT (has_alpha AND t = 'jpeg')), ',') AS chain
  FROM (SELECT *, CASE WHEN has_alpha THEN CASE choice WHEN 'webp' THEN ['webp', 'png'] WHEN 'png' THEN ['png', 'webp'] ELSE [choice, 'webp', 'png'] END
    ELSE CASE choice WHEN 'webp' THEN ['webp', 'jpeg', 'png'] WHEN 'jpeg' THEN ['jpeg', 'webp', 'png'] WHEN 'png' THEN ['png', 'webp', 'jpeg'] ELSE [choice, 'webp', 'jpeg', 'png'] END END AS list_distinct_ordered
    FROM chosen JOIN caps USING (platform))"""


@register("format_policy", POLICY_SQL)
def format_policy(spark, sf_dir):
    """The platform, choice and alpha of each image by its id, width and height; the platforms' defaults, three rows, are broadcast."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (1 + n % len(values)).cast("int"))
    rows = assets(spark, sf_dir).filter("type = 1").select("id", pick(("ios", "android", "other"), F.col("id").cast("long")).alias("platform"), pick(TARGETS, F.col("width")).alias("choice"), (F.col("height") % 2 == 0).alias("has_alpha"))
    rows = rows.join(F.broadcast(estimate.capability_defaults(spark)), "platform").withColumn("p", estimate.format_policy(F.col("choice"), F.col("has_alpha")))
    return rows.select("id", "platform", "choice", "has_alpha", "p.target", "p.flatten", F.array_join(estimate.fallback_chain(F.col("choice"), F.col("has_alpha")), ",").alias("chain"))


@register("trash_committed", f"WITH {TRASH_SQL} SELECT * FROM trash WHERE state = 1")
def trash_committed(spark, sf_dir):
    return journal.committed(trash(spark, sf_dir))


@register("trash_pending", f"WITH {TRASH_SQL} SELECT * FROM trash WHERE state = 0")
def trash_pending(spark, sf_dir):
    return journal.pending(trash(spark, sf_dir))


@register("trash_purge", f"WITH {TRASH_SQL} SELECT id, state, deleted_at_ms FROM trash WHERE NOT (state = 1 AND deleted_at_ms > 0 AND deleted_at_ms < epoch_ms(TIMESTAMP '{AS_OF}') - 14 * 86400000)")
def trash_purge(spark, sf_dir):
    return journal.purge(trash(spark, sf_dir), F.to_timestamp(F.lit(AS_OF)))[0].select("id", "state", "deleted_at_ms")


@register("trash_purged_count", f"WITH {TRASH_SQL} SELECT count(*) AS purged FROM trash WHERE state = 1 AND deleted_at_ms > 0 AND deleted_at_ms < epoch_ms(TIMESTAMP '{AS_OF}') - 14 * 86400000")
def trash_purged_count(spark, sf_dir):
    return journal.purge(trash(spark, sf_dir), F.to_timestamp(F.lit(AS_OF)))[1]


@register("days_remaining", f"WITH {TRASH_SQL} SELECT id, cast(least(greatest(floor((deleted_at_ms + 14 * 86400000 - epoch_ms(TIMESTAMP '{AS_OF}')) / 86400000.0), 0), 14) AS integer) AS days_remaining FROM trash WHERE state = 1")
def days_remaining(spark, sf_dir):
    return journal.with_days_remaining(journal.committed(trash(spark, sf_dir)), F.to_timestamp(F.lit(AS_OF))).select("id", "days_remaining")


@register("trash_empty_all", f"WITH {TRASH_SQL} SELECT id FROM trash WHERE state <> 1")
def trash_empty_all(spark, sf_dir):
    return journal.empty_all(trash(spark, sf_dir)).select("id")


@register("task_latest", f"WITH {TASKS_SQL} SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks GROUP BY task_id")
def task_latest(spark, sf_dir):
    return tasks.latest(task_events(spark, sf_dir))


@register("task_state", f"WITH {STATES_SQL} SELECT * FROM states")
def task_state(spark, sf_dir):
    return tasks.folded(task_events(spark, sf_dir))


@register("task_badge", f"WITH {TASKS_SQL}, states AS (SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks GROUP BY task_id), n AS (SELECT count(*) FILTER (status IN ('running', 'pending')) AS running, count(*) FILTER (status = 'failed') AS failed, count(*) > 0 AND count(*) FILTER (status <> 'completed') = 0 AS all_done FROM states) SELECT running, CASE WHEN running = 0 THEN failed ELSE 0 END AS failed, all_done FROM n")
def task_badge(spark, sf_dir):
    return tasks.badge(tasks.latest(task_events(spark, sf_dir)))


@register("task_filter_failed", f"WITH {TASKS_SQL} SELECT * FROM (SELECT task_id, arg_max(status, (ts, seq)) AS status FROM tasks GROUP BY task_id) WHERE status IN ('failed', 'cancelled')")
def task_filter_failed(spark, sf_dir):
    return tasks.shown(tasks.latest(task_events(spark, sf_dir)), "failed")


@register("debounced_changes", "WITH g AS (SELECT user_id AS key, ts, CASE WHEN (epoch_us(ts) // 1000) - (epoch_us(lag(ts) OVER w) // 1000) <= 3600000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts) AS run FROM g) SELECT key, (epoch_us(min(ts)) // 1000) AS started, (epoch_us(max(ts)) // 1000) AS last, count(*) AS changes FROM r GROUP BY key, run")
def debounced_changes(spark, sf_dir):
    changes = task_events(spark, sf_dir).select(F.col("task_id").alias("key"), "ts")
    return tasks.debounced_batch(changes, 3_600_000).select("key", F.unix_millis("started").alias("started"), F.unix_millis("last").alias("last"), "changes")


PLACED_SQL = f"{ASSETS_SQL}, placed AS (SELECT id, type, row_number() OVER (ORDER BY created_date DESC, id) - 1 AS position FROM assets)"


@register("all_positions", f"WITH {PLACED_SQL} SELECT id, type, position FROM placed")
def all_positions(spark, sf_dir):
    return view.positions(assets(spark, sf_dir), planned(View())).select("id", "type", "position")


@register("run_selection", f"WITH {PLACED_SQL} SELECT id FROM placed WHERE position BETWEEN 20 AND 90 AND type = (SELECT type FROM placed WHERE position = 90) UNION SELECT id FROM placed WHERE position < 3")
def run_selection(spark, sf_dir):
    index = RankIndex.built(assets(spark, sf_dir).select("id", "type", "created_date"), planned(View()))
    return view.select_run(index.run(20, 90), index.run(0, 2), 90, 20)


@register("middle_run", f"WITH {PLACED_SQL} SELECT id FROM placed WHERE position BETWEEN 700 AND 1400 AND type = (SELECT type FROM placed WHERE position = 700) UNION SELECT id FROM placed WHERE position BETWEEN 690 AND 710")
def middle_run(spark, sf_dir):
    """A drag through the middle of the view, away from the first range."""
    index = RankIndex.built(assets(spark, sf_dir).select("id", "type", "created_date"), planned(View()))
    return view.select_run(index.run(700, 1400), index.run(690, 710), 700, 1400)


@register("indexed_pages", f"""WITH {ASSETS_SQL}, placed AS (SELECT id, size_bytes, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, id) - 1 AS position FROM assets WHERE type = 1),
  n AS (SELECT count(*) AS n FROM placed)
  SELECT id, size_bytes, position, 'page' AS asked FROM placed, n WHERE position // 100 IN (0, n // 200, (n - 1) // 100) UNION ALL
  SELECT id, size_bytes, position, 'place' FROM placed WHERE id = (SELECT min(id) FROM placed) OR size_bytes IS NULL AND id = (SELECT max(id) FROM placed WHERE size_bytes IS NULL)""")
def indexed_pages(spark, sf_dir):
    """The first, the middle and the last page of a view by size, and the places of two entries, from one index."""
    rows = assets(spark, sf_dir)
    index = RankIndex.built(rows.select("id", "type", "size_bytes"), planned(View("photos", "largest")), rows_per_file=5_000)
    n = index.count()
    pages = [index.page(at * 100, 100) for at in sorted({0, n // 200, (n - 1) // 100})]
    out = reduce(DataFrame.unionByName, pages).select("id", "size_bytes", "position", F.lit("page").alias("asked"))
    photos = rows.filter("type = 1")
    some = photos.agg(F.min(F.struct("id", "size_bytes")).alias("a"), F.max(F.when(F.col("size_bytes").isNull(), F.struct("id", "size_bytes"))).alias("b")).first()
    found = [(e["id"], e["size_bytes"], index.place(e["size_bytes"], e["id"]), "place") for e in (some["a"], some["b"]) if e]
    return out.union(spark.createDataFrame(found, "id string, size_bytes long, position long, asked string"))


@register("last_shared", f"WITH {PLACED_SQL} SELECT id, position FROM placed WHERE id IN (SELECT id FROM placed WHERE cast(id AS bigint) > (SELECT max(cast(id AS bigint)) - 500 FROM placed)) ORDER BY position LIMIT 12")
def last_shared(spark, sf_dir):
    """What is shared of a selection that lies anywhere in the view: its first twelve by place."""
    rows = assets(spark, sf_dir)
    newest = rows.agg((F.max(F.col("id").cast("long")) - 500).alias("from"))
    chosen = rows.join(F.broadcast(newest), F.col("id").cast("long") > F.col("from"), "left_semi").select("id")
    return view.shared(view.positions(rows, planned(View())), chosen).select("id", "position")


@register("name_search", "SELECT p_partkey, p_name AS name FROM part WHERE lower(p_name) LIKE '%blue%'")
def name_search(spark, sf_dir):
    return view.named(read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), " BLUE")


def rounded_sql(c: str, unit: int, digits: int) -> str:
    """A size in units with some decimals, ties rounded up, in whole numbers throughout."""
    tens = 10**digits
    n = f"(({c} * {2 * tens} + {unit}) // {2 * unit})"
    return f"({n} // {tens}) || '.' || lpad(cast({n} % {tens} AS varchar), {digits}, '0')" if digits else n


def size_text_sql(c: str, mb: int) -> str:
    return f"CASE WHEN {c} < 1024 THEN {c} || ' B' WHEN {c} < 1048576 THEN {rounded_sql(c, 1 << 10, 1)} || ' KB' WHEN {c} < 1073741824 THEN {rounded_sql(c, 1 << 20, mb)} || ' MB' ELSE {rounded_sql(c, 1 << 30, 2)} || ' GB' END"


@register("label_bytes", f"WITH {ASSETS_SQL} SELECT id, {size_text_sql('size_bytes', 1)} AS short, {size_text_sql('size_bytes', 2)} AS long FROM assets")
def label_bytes(spark, sf_dir):
    """Of every asset: an unknown size has no text."""
    return assets(spark, sf_dir).select("id", text.bytes_text(F.col("size_bytes")).alias("short"), text.bytes_text(F.col("size_bytes"), 2).alias("long"))


@register("relative_time", f"SELECT event_id, CASE WHEN s < 60000 THEN 'now' WHEN s < 3600000 THEN 'minutes' WHEN s < 86400000 THEN 'hours' ELSE 'days' END AS unit, cast(CASE WHEN s < 60000 THEN 0 WHEN s < 3600000 THEN s // 60000 WHEN s < 86400000 THEN s // 3600000 ELSE s // 86400000 END AS bigint) AS count FROM (SELECT event_id, epoch_ms(TIMESTAMP '{AS_OF}') - (epoch_us(ts) // 1000) AS s FROM events)")
def relative_time(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", numbers.relative_time(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit(AS_OF))).alias("r")).select("event_id", "r.unit", "r.count")


@register("output_names", f"WITH {ASSETS_SQL} SELECT id, regexp_replace(title, '\\.[^.]*$', '') || '_copy.' || regexp_extract(title, '\\.([^.]+)$', 1) AS copy_name, upper(regexp_extract(title, '\\.([^.]+)$', 1)) AS label, CASE WHEN mime_type LIKE '%hei%' THEN 'HEIC' WHEN mime_type LIKE '%avif%' THEN 'AVIF' WHEN mime_type LIKE '%webp%' THEN 'WebP' WHEN mime_type LIKE '%png%' THEN 'PNG' WHEN mime_type LIKE '%jpeg%' THEN 'JPEG' ELSE upper(split_part(mime_type, '/', 2)) END AS kind FROM assets")
def output_names(spark, sf_dir):
    return assets(spark, sf_dir).select("id", text.copy_name(F.col("title"), F.col("type"), F.lit(0)).alias("copy_name"), text.format_label(F.col("title")).alias("label"), text.mime_label(F.col("mime_type")).alias("kind"))


@register("pixel_figures", f"WITH {ASSETS_SQL} SELECT id, cast(width AS bigint) * height AS pixels, coalesce(size_bytes, 0) * 8.0::double / (cast(width AS bigint) * height) AS bpp, cast(width AS bigint) * height / 1e6 AS megapixels, CASE WHEN greatest(width, height) > 8192 THEN 8192 END AS cap FROM assets")
def pixel_figures(spark, sf_dir):
    px = numbers.pixels(F.col("width"), F.col("height"))
    bpp = numbers.bits_per_pixel(F.coalesce("size_bytes", F.lit(0)), px)
    return assets(spark, sf_dir).select("id", px.alias("pixels"), bpp.alias("bpp"), numbers.megapixels(F.col("width"), F.col("height")).alias("megapixels"), numbers.encode_cap(F.col("width"), F.col("height"))["max_width"].alias("cap"))


@register("clip_figures", f"WITH {ASSETS_SQL} SELECT id, cast(least(greatest(floor(duration_ms / 1000.0::double / 2), 1), 64) AS integer) AS frames, (duration_ms // 60000) || ':' || lpad(cast((duration_ms // 1000) % 60 AS varchar), 2, '0') AS clock, cast(floor(duration_ms / 1000.0::double / 2) AS bigint) AS keyframes FROM assets WHERE type = 2")
def clip_figures(spark, sf_dir):
    seconds = F.col("duration_ms") / 1000
    return assets(spark, sf_dir).filter("type = 2").select("id", numbers.frame_count(seconds, every=F.lit(2)).alias("frames"), numbers.minutes_text(seconds).alias("clock"), F.size(numbers.keyframes(seconds)).cast("long").alias("keyframes"))


def _png_head(colour: int) -> bytes:
    head = b"IHDR" + struct.pack(">IIBBBBB", 1, 1, 8, colour, 0, 0, 0)
    return binary.PNG_START + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head))


def _gif_head(transparent: int) -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\x00\x00\x00\xff\xff\xff" + bytes([0x21, 0xF9, 4, transparent, 0, 0, 0, 0, 0x2C])


def _tiff_head(samples: int) -> bytes:
    return b"II*\x00" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 262, 3, 1, 2, 0) + struct.pack("<HHIHH", 277, 3, 1, samples, 0) + b"\x00" * 4


PNG_END = struct.pack(">I4sI", 0, b"IEND", zlib.crc32(b"IEND"))
VP8 = b"VP8 " + struct.pack("<I", 4) + bytes([1, 2, 3, 4])
#: An image for each page by its id's remainder: kind, whether it has alpha, and its bytes before and after the metadata.
IMAGES = (
    ("jpeg", False, b"\xff\xd8\xff\xe0\x00\x07JFIF\x00", b"\xff\xda\x00\x04\x01\x02scan\xff\xd9"),
    ("png", True, _png_head(6), PNG_END),
    ("png", False, _png_head(2), PNG_END),
    ("webp", True, b"", VP8),
    ("gif", True, _gif_head(1), b""),
    ("gif", False, _gif_head(0), b""),
    ("bmp", True, b"BM" + struct.pack("<IIIIIIHH", 58, 0, 54, 40, 1, 1, 1, 32), b""),
    ("bmp", False, b"BM" + struct.pack("<IIIIIIHH", 58, 0, 54, 40, 1, 1, 1, 24), b""),
    ("heic", False, b"\x00\x00\x00\x18ftypheic\x00\x00\x00\x00heicmif1", b""),
    ("avif", False, b"\x00\x00\x00\x18ftypavif\x00\x00\x00\x00avifmif1", b""),
    ("tiff", True, _tiff_head(4), b""),
    ("tiff", False, _tiff_head(3), b""),
    ("unknown", False, b"", b""),
)


def hex32(n, little: bool = False):
    """A number as four bytes in hexadecimal."""
    digits = F.lpad(F.hex(n), 8, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in ((7, 5, 3, 1) if little else (1, 3, 5, 7))])


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, image: a small image of a kind by the page's id, with the page's whole html as its metadata: as many comment
    segments as it needs (jpeg), a text chunk (png), an EXIF chunk (webp), else behind the image."""
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = read(spark, sf_dir, "pages").select("page_id", html.alias("html"), F.octet_length(html).alias("n"))
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 65_533).cast("int")), lambda k: F.substr("html", k * 65_533 + 1, F.lit(65_533)))
    segments = F.array_join(F.transform(parts, lambda d: F.concat(F.lit("FFFE"), F.lpad(F.hex(F.octet_length(d) + 2), 4, "0"), F.hex(d))), "")
    chunk = F.concat(F.lit("74455874"), F.hex("html"))
    text_chunk = F.concat(hex32(F.col("n")), chunk, hex32(F.crc32(F.unhex(chunk))))
    pad = F.when(F.col("n") % 2 == 1, F.lit("00")).otherwise(F.lit(""))
    # the flags say that EXIF and alpha are there
    webp = F.concat(F.lit((b"WEBPVP8X" + struct.pack("<IB9x", 10, 0x1C) + VP8 + b"EXIF").hex().upper()), hex32(F.col("n"), True), F.hex("html"), pad)
    webp = F.concat(F.lit("52494646"), hex32((F.length(webp) / 2).cast("long"), True), webp)
    image = F.hex("html")
    for k, (kind, _, head, tail) in enumerate(IMAGES):
        middle = {"jpeg": segments, "png": text_chunk}.get(kind)
        ends = F.lit(head.hex().upper()), F.lit(tail.hex().upper())
        whole = webp if kind == "webp" else F.concat(*ends, F.hex("html")) if middle is None else F.concat(ends[0], middle, ends[1])
        image = F.when(F.col("page_id") % len(IMAGES) == k, whole).otherwise(image)
    return rows.select("page_id", F.unhex(image).alias("image"))


def by_page_sql(values) -> str:
    """The value of each kind of image, by the page's id."""
    return "CASE page_id % " + str(len(IMAGES)) + " " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@register("sniff_pages", f"SELECT page_id, {by_page_sql(repr(kind) for kind, *_ in IMAGES)} AS kind, {by_page_sql(kind in ('jpeg', 'png', 'webp') for kind, *_ in IMAGES)} AS can_strip FROM pages")
def sniff_pages(spark, sf_dir):
    return page_images(spark, sf_dir).select("page_id", binary.sniffed(F.col("image")).alias("kind"), binary.can_strip(F.col("image")).alias("can_strip"))


@register("alpha_probe", f"SELECT page_id, {by_page_sql(alpha for _, alpha, *_ in IMAGES)} AS has_alpha FROM pages")
def alpha_probe(spark, sf_dir):
    return page_images(spark, sf_dir).select("page_id", binary.has_alpha(F.col("image")).alias("has_alpha"))


BARE_WEBP = b"RIFF" + struct.pack("<I", 34) + b"WEBPVP8X" + struct.pack("<IB9x", 10, 0x10) + VP8
STRIPPED = [head + tail if kind in ("jpeg", "png") else BARE_WEBP if kind == "webp" else None for kind, _, head, tail in IMAGES]
BEFORE = [
    f"{len(head) + len(tail)} + " + {"jpeg": "n + 4 * (n // 65533 + 1)", "png": "n + 12"}.get(kind, "n") if kind != "webp" else f"{len(BARE_WEBP)} + 8 + n + n % 2"
    for kind, _, head, tail in IMAGES
]


@register("strip_images", f"""SELECT page_id, cast({by_page_sql(BEFORE)} AS integer) AS before, {by_page_sql("NULL" if x is None else repr(x.hex().upper()) for x in STRIPPED)} AS bytes,
  {by_page_sql({"jpeg": "'jpg'", "png": "'png'", "webp": "'webp'"}.get(kind, "NULL") for kind, *_ in IMAGES)} AS ext FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n FROM pages)""")
def strip_images(spark, sf_dir):
    """The pages' images without their metadata, the pages' whole text; null for kinds that are not edited."""
    rows = page_images(spark, sf_dir)
    return rows.select("page_id", F.octet_length("image").alias("before"), binary.stripped(F.col("image")).alias("s")).select("page_id", "before", F.hex("s.bytes").alias("bytes"), "s.ext")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of one file."""
    source = read(spark, sf_dir, "events")
    return spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events*.parquet")


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream has given once it has read all there is, from a table in the shared folder: of updates the newest a
    key. A repeated batch writes its own folder again."""
    where = scratch_path(spark, name)
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/out/batch={n}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    out = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{where}/out")
    if keys:
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("last")).select(*keys, "last.*")
    return out.drop("batch")


@register("task_state_stream", f"WITH {STATES_SQL} SELECT * FROM states")
def task_state_stream(spark, sf_dir):
    from halyard.streaming.tasks import task_states, use_rocksdb

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    use_rocksdb(spark)
    return drained(spark, task_states(tasks_of(streamed(spark, sf_dir))), "task-states", "update", ["task_id"]).select("task_id", "status")


FORGET_MS = 2 * 86_400_000
LIVES_SQL = f"""{TASKS_SQL}, states AS (
  SELECT task_id, list_reduce(list_prepend({{'s': 'pending', 't': 0::bigint}}, list({{'s': status, 't': epoch_us(ts)}} ORDER BY ts, seq)), lambda a, e: {{'t': e.t, 's': CASE WHEN e.s = 'cancelled' THEN e.s
    WHEN a.s IN ('completed', 'failed', 'cancelled') AND e.t - a.t <= {FORGET_MS * 1000} THEN a.s
    WHEN e.s IN ('running', 'failed') THEN e.s WHEN e.s = 'completed' AND a.s = 'running' THEN e.s
    WHEN a.s IN ('completed', 'failed', 'cancelled') THEN 'pending' ELSE a.s END}}).s AS status
  FROM tasks GROUP BY task_id)"""


@register("task_lives", f"WITH {LIVES_SQL} SELECT * FROM states")
def task_lives(spark, sf_dir):
    """Finished tasks are forgotten after two quiet days."""
    return tasks.folded_lives(task_events(spark, sf_dir), FORGET_MS)


def in_batches(spark: SparkSession, rows: DataFrame, order: str, n: int) -> DataFrame:
    """A stream of ``n`` micro-batches of a table's rows, in order of a column, as even as ``ntile`` makes them.

    A batch is as many files as a shuffle has partitions, each with rows of its own, so no task sees a whole batch. Small batches
    are a file each."""
    where = scratch_path(spark, "batches")
    placed = spooled(numbered(rows, [F.col(order)], "place"), "told")
    count = placed.count()
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // n))
    first = 0
    # files go out one batch after another, as file streams take the oldest first
    for k in range(n):
        last = first + count // n + (k < count % n)
        batch = placed.filter((F.col("place") >= first) & (F.col("place") < last))
        batch.repartitionById(files, (F.col("place") % files).cast("int")).drop("place").write.mode("append").parquet(where)
        first = last
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(where)


@register("task_lives_stream", f"WITH {LIVES_SQL} SELECT * FROM states")
def task_lives_stream(spark, sf_dir):
    """The same as a stream of four batches that shuffle the events among them by up to a minute."""
    from halyard.streaming.tasks import task_states, use_rocksdb

    use_rocksdb(spark)
    late = F.unix_micros("ts") + F.pmod(F.xxhash64("seq"), F.lit(60_000_000))
    stream = in_batches(spark, task_events(spark, sf_dir).withColumn("at", late), "at", 4).drop("at")
    return drained(spark, task_states(stream, "2 minutes", FORGET_MS), "task-lives", "update", ["task_id"]).select("task_id", "status")


@register("new_outputs_stream", f"""WITH {TASKS_SQL}, b AS (SELECT *, ntile(3) OVER (ORDER BY seq) AS batch FROM tasks),
  ends AS (SELECT task_id, n, arg_max(status, (ts, seq)) AS status, max(batch) = n AS heard FROM b, (SELECT unnest([1, 2, 3]) AS n) WHERE batch <= n GROUP BY task_id, n)
  SELECT DISTINCT task_id, unnest([task_id * 10, task_id * 10 + 1]) AS output_id FROM ends WHERE status = 'completed' AND heard""")
def new_outputs_stream(spark, sf_dir):
    """The outputs of tasks that are completed at the end of one of three batches, once each."""
    from halyard.streaming.tasks import new_outputs, use_rocksdb

    use_rocksdb(spark)
    outputs = F.array(F.col("task_id") * 10, F.col("task_id") * 10 + 1)
    stream = in_batches(spark, task_events(spark, sf_dir).withColumn("outputs", outputs), "seq", 3)
    return drained(spark, new_outputs(stream), "new-outputs", "append").select("task_id", "output_id")


@register("newest_results_stream", """WITH r AS (SELECT user_id AS key, event_id AS seq, ts, event_type FROM events)
  SELECT key, seq FROM r a WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.key = a.key AND b.seq > a.seq AND b.ts <= a.ts + INTERVAL 6 HOUR)
    AND epoch_us(a.ts + INTERVAL 6 HOUR) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 + 6 * 3600000000::bigint - 60000000 FROM events WHERE event_type <> 'view')""")
def newest_results_stream(spark, sf_dir):
    """A user's requests, each but views answered after six hours: the answers that no newer request overtook, as a stream of
    three batches, up to the watermark a minute before its end."""
    from halyard.streaming.tasks import newest_results, use_rocksdb

    use_rocksdb(spark)
    events = task_events(spark, sf_dir).select(F.col("task_id").alias("key"), "seq", "ts", F.col("status"))
    requests = events.select("key", "seq", "ts", F.lit(False).alias("answer"))
    answers = events.filter("status <> 'pending'").select("key", "seq", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("ts"), F.lit(True).alias("answer"))
    stream = in_batches(spark, requests.union(answers), "ts", 3)
    out = newest_results(stream.filter("not answer"), stream.filter("answer"), "60 seconds")
    return drained(spark, out, "newest-results", "append").select("key", "seq")


@register("debounce_stream", """WITH g AS (SELECT user_id AS key, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 2000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  r AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g), b AS (SELECT key, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 2000000 AS settled, count(*) AS changes FROM r GROUP BY key, run)
  SELECT * FROM b WHERE settled <= (SELECT max(epoch_us(ts)) - 10000000 FROM events)""")
def debounce_stream(spark, sf_dir):
    """A user's bursts that have settled before the stream's end less ten seconds, the watermark; later ones are still open."""
    from halyard.streaming.tasks import change_bursts

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    changes = streamed(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return drained(spark, change_bursts(changes), "bursts", "append").select("key", F.unix_micros("started").alias("started"), F.unix_micros("settled").alias("settled"), "changes")
