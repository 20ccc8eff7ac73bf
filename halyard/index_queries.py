"""Registered queries over stored views, bitmaps, posting lists, change logs and digests, beside their SQL.

``page_assets`` is a view over ``pages``: a page is an asset that its address names, each byte of it standing for 512.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.operators import digest
from halyard.plans.bitmaps import Facets, Selection
from halyard.plans.postings import TextIndex, matching_formats, named
from halyard.plans.rank_index import RankIndex
from halyard.plans.view import BUCKETS, View, planned
from halyard.queries import ASSETS_SQL, PLACED_SQL, SELECTION_SQL, assets, read, register, selection
from halyard.schema import ASSETS
from halyard.scratch import scratch_path
from halyard.sources.change_log import ChangeLog

CHOICES = [View(kind, size=size, format=format) for kind in ("all", "photos", "videos") for size in BUCKETS for format in (None, "jpeg", "mov")]


def facets(spark, sf_dir) -> Facets:
    rows = assets(spark, sf_dir).select("id", "type", "created_date", "size_bytes", "title", "mime_type")
    return Facets.built(RankIndex.built(rows, planned(View())))


@register("bitmap_selection", f"""WITH {PLACED_SQL}, chosen AS (
    SELECT id FROM placed WHERE position BETWEEN 700 AND 1400 AND type = (SELECT type FROM placed WHERE position = 700)
    UNION SELECT id FROM assets WHERE type = 1 AND size_bytes < 1048576)
  SELECT id, position, type FROM placed WHERE id IN (SELECT id FROM chosen) AND id NOT IN (SELECT id FROM assets WHERE type = 1 AND (lower(coalesce(mime_type, '')) LIKE '%jpeg%' OR lower(coalesce(mime_type, '')) LIKE '%jpg%' OR lower(title) LIKE '%.jpeg' OR lower(title) LIKE '%.jpg'))""")
def bitmap_selection(spark, sf_dir):
    """Select-all of small photos, a drag on top of it, and the JPEG photos taken away again."""
    known = facets(spark, sf_dir)
    chosen = known.run(known.select_all(View(size="small")), 700, 1400).minus(known.matching(View("photos", format="jpeg")))
    return chosen.rows(known.index).select("id", "position", "type")


COUNTED_SQL = """SELECT kind, size, format, cast(count(*) FILTER ((kind = 'all' OR type = CASE kind WHEN 'photos' THEN 1 ELSE 2 END)
    AND (size = 'any' OR size = 'small' AND size_bytes < 1048576 OR size = 'medium' AND size_bytes >= 1048576 AND size_bytes < 10485760 OR size = 'large' AND size_bytes >= 10485760)
    AND (format = '' OR format = 'jpeg' AND (m LIKE '%jpeg%' OR m LIKE '%jpg%' OR t LIKE '%.jpeg' OR t LIKE '%.jpg') OR format = 'mov' AND (m LIKE '%mov%' OR m LIKE '%quicktime%' OR t LIKE '%.mov' OR t LIKE '%.quicktime'))) AS bigint) AS n
  FROM (SELECT *, lower(coalesce(mime_type, '')) AS m, lower(coalesce(title, '')) AS t FROM assets), (SELECT unnest(['all', 'photos', 'videos']) AS kind), (SELECT unnest(['any', 'small', 'medium', 'large']) AS size), (SELECT unnest(['', 'jpeg', 'mov']) AS format) GROUP BY ALL"""


@register("bitmap_counts", f"WITH {ASSETS_SQL} {COUNTED_SQL}")
def bitmap_counts(spark, sf_dir):
    """How many rows each choice of kind, size and format shows, all from one pass over the table."""
    return facets(spark, sf_dir).counts(CHOICES).withColumn("format", F.coalesce("format", F.lit("")))


@register("bitmap_lock", f"WITH {PLACED_SQL}, {SELECTION_SQL}, m AS (SELECT min(position) AS position FROM placed WHERE id IN (SELECT id FROM selection) AND position > 40) SELECT type FROM placed WHERE position = (SELECT position FROM m)")
def bitmap_lock(spark, sf_dir):
    """The type of the first selected entry after place 40."""
    known = facets(spark, sf_dir)
    return known.lock(Selection.of(known.index.places(selection(spark, sf_dir))).minus(Selection.between(known.index, 0, 40)))


NEEDLES = (" BLUE", "ed", "k", "re-", "green r", "none of them")


@register("indexed_names", f"""WITH now AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 3 THEN 'Re-' || p_name ELSE p_name END AS name FROM part WHERE p_partkey % 10 <> 4)
  SELECT needle, p_partkey, name FROM now, (SELECT unnest([{", ".join(f"'{n}'" for n in NEEDLES)}]) AS needle) WHERE contains(lower(name), lower(trim(needle)))""")
def indexed_names(spark, sf_dir):
    """Names found by posting lists, after a tenth of the parts got other names and a tenth went."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    index = TextIndex.built(parts, ["name"], scratch_path(spark, "names"), key="p_partkey")
    index.changed(parts.filter("p_partkey % 10 = 3").withColumn("name", F.concat(F.lit("Re-"), "name")))
    index.removed(parts.filter("p_partkey % 10 = 4").select("p_partkey"))
    return reduce(DataFrame.unionByName, (named(index, n).select(F.lit(n).alias("needle"), "p_partkey", "name") for n in NEEDLES))


@register("indexed_formats", f"""WITH {ASSETS_SQL}, t AS (SELECT *, lower(coalesce(mime_type, '')) AS m, lower(coalesce(title, '')) AS e FROM assets)
  SELECT id, 'jpeg' AS format FROM t WHERE m LIKE '%jpeg%' OR m LIKE '%jpg%' OR e LIKE '%.jpeg' OR e LIKE '%.jpg'
  UNION ALL SELECT id, 'mov' FROM t WHERE type = 2 AND size_bytes >= 10485760 AND (m LIKE '%mov%' OR m LIKE '%quicktime%' OR e LIKE '%.mov' OR e LIKE '%.quicktime')""")
def indexed_formats(spark, sf_dir):
    """Two format filters answered from one index."""
    rows = assets(spark, sf_dir).select("id", "type", "size_bytes", "title", "mime_type")
    index = TextIndex.built(rows, ["mime_type", "title"], scratch_path(spark, "formats"))
    found = [matching_formats(index, planned(v)).select("id", F.lit(v.format).alias("format")) for v in (View(format="jpeg"), View("videos", size="large", format="mov"))]
    return reduce(DataFrame.unionByName, found)


PAGES_SQL = """page_assets AS (
  SELECT cast(page_id AS varchar) AS id, CASE WHEN url LIKE 'https:%' THEN 1 ELSE 2 END AS type, page_id // 3 AS created_date, octet_length(encode(html)) * 512 AS size_bytes, url AS title,
    CASE page_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/quicktime' END AS mime_type, page_id AS k FROM pages)"""


def page_assets(spark, sf_dir) -> DataFrame:
    k, mime = F.col("page_id"), F.when(F.col("page_id") % 3 == 0, "image/jpeg").when(F.col("page_id") % 3 == 1, "video/quicktime")
    kind = F.when(F.col("url").startswith("https:"), 1).otherwise(2)
    return read(spark, sf_dir, "pages").select(k.cast("string").alias("id"), kind.alias("type"), F.floor(k / 3).alias("created_date"), (F.octet_length("html").cast("long") * 512).alias("size_bytes"), F.col("url").alias("title"), mime.alias("mime_type"))


@register("page_bitmaps", f"""WITH {PAGES_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY created_date DESC, id) - 1 AS position FROM page_assets), chosen AS (
    SELECT id FROM placed WHERE position >= 20 AND type = (SELECT type FROM placed WHERE position = 20) UNION SELECT id FROM page_assets WHERE type = 1 AND size_bytes < 1048576)
  SELECT id, position, type FROM placed WHERE id IN (SELECT id FROM chosen) AND NOT (type = 1 AND coalesce(mime_type, '') = 'image/jpeg')""")
def page_bitmaps(spark, sf_dir):
    """Select-all of small pages (the photos among them), a drag from place 20 to the end on top of them, and the JPEG photos taken away again."""
    known = Facets.built(RankIndex.built(page_assets(spark, sf_dir), planned(View())))
    chosen = known.run(known.select_all(View(size="small")), 20, known.index.count() - 1).minus(known.matching(View("photos", format="jpeg")))
    return chosen.rows(known.index).select("id", "position", "type")


@register("page_places", f"""WITH {PAGES_SQL}, placed AS (SELECT *, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, id) - 1 AS position, count(*) OVER () AS n FROM page_assets WHERE type = 1)
  SELECT id, title, size_bytes, position FROM placed WHERE position >= n // 2""")
def page_places(spark, sf_dir):
    """The lower half of the pages by size, from a stored view."""
    index = RankIndex.built(page_assets(spark, sf_dir), planned(View("photos", sort="largest")))
    n = index.count()
    return index.run(n // 2, n - 1).select("id", "title", "size_bytes", "position")


ADDRESSES = ("SPAM-farm", ".html", "example.net/es/", "ref=x", "//m", "?page=2&ref", "nowhere to be found")


@register("found_addresses", f"""WITH now AS (SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'http://moved.' || url WHEN page_id % 10 = 5 THEN NULL ELSE url END AS url FROM pages WHERE page_id % 10 <> 4)
  SELECT needle, page_id, url FROM now, (SELECT unnest([{", ".join(f"'{n}'" for n in ("moved.HTTP", *ADDRESSES))}]) AS needle) WHERE contains(lower(url), lower(needle))""")
def found_addresses(spark, sf_dir):
    """Addresses found by posting lists: a tenth of the pages moved and a tenth went before a compaction, a tenth lost theirs after it."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    index = TextIndex.built(pages, ["url"], scratch_path(spark, "addresses"), key="page_id")
    index.changed(pages.filter("page_id % 10 = 3").withColumn("url", F.concat(F.lit("http://moved."), "url")))
    index.removed(pages.filter("page_id % 10 = 4").select("page_id"))
    index.compacted()
    index.changed(pages.filter("page_id % 10 = 5").withColumn("url", F.lit(None).cast("string")))
    return reduce(DataFrame.unionByName, (named(index, n, "url").select(F.lit(n).alias("needle"), "page_id", "url") for n in ("moved.HTTP", *ADDRESSES)))


@register("followed_pages", f"""WITH {PAGES_SQL} SELECT id, type, CASE WHEN k % 100 = 7 THEN 'renamed' ELSE title END AS title, CASE WHEN k % 50 = 3 THEN NULL ELSE size_bytes END AS size_bytes FROM page_assets WHERE k % 100 <> 8
  UNION ALL SELECT 'new' || id, type, title, NULL FROM page_assets WHERE k % 100 = 9""")
def followed_pages(spark, sf_dir):
    """A change log that follows its source: digests of ranges of ids say which rows go into the log."""
    rows, k = page_assets(spark, sf_dir), F.col("id").cast("long")
    log = ChangeLog(spark, scratch_path(spark, "followed"), ASSETS)
    log.put(rows)
    log.compact()
    log.set(rows.filter(k % 50 == 3).select("id", F.lit(None).cast("long").alias("size_bytes")))
    source = rows.filter(k % 100 != 8).select("id", "type", F.when(k % 100 == 7, "renamed").otherwise(F.col("title")).alias("title"))
    source = source.unionByName(rows.filter(k % 100 == 9).select(F.concat(F.lit("new"), "id").alias("id"), "type", "title"))
    fresh, gone = digest.delta(log.read(), source)
    log.put(fresh)
    log.remove(gone)
    return log.read().select("id", "type", "title", "size_bytes")
