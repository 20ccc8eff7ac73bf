"""Changes of the asset index and its sync with a source. Each takes and gives whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.schema import ASSET_DEFAULTS, ASSETS


def upsert(table: DataFrame, rows: DataFrame, supplied: list[str] | None = None, defaults: dict | None = None, order: str | None = None) -> DataFrame:
    """``rows`` inserted; where an id exists, only the ``supplied`` columns are replaced, by null too if given so.

    Columns that ``rows`` leaves out keep their old value, or take the default in a new row. Of rows that repeat an
    id, the last by the column ``order`` wins, which is not stored; among equals, and without it, the greatest. One join
    on the id; both sides are hashed alike, so a table bucketed by id needs no shuffle."""
    supplied = [c for c in (supplied or rows.columns) if c not in ("id", order)]
    defaults = ASSET_DEFAULTS if defaults is None else defaults
    packed = F.struct(*[F.col(c) for c in supplied]) if supplied else F.lit(True)
    last = F.max(packed) if order is None else F.max_by(packed, F.struct(F.col(order), packed))
    new = rows.groupBy("id").agg(last.alias("__new")) if supplied else rows.select("id").distinct().withColumn("__new", packed)
    old = table.withColumn("__old", F.lit(True))
    both = old.join(new, "id", "full_outer")
    out = [F.col("id")]
    for f in table.schema.fields:
        if f.name == "id":
            continue
        kept = F.when(F.col("__old").isNotNull(), F.col(f.name)).otherwise(F.lit(defaults.get(f.name))).cast(f.dataType)
        value = F.when(F.col("__new").isNotNull(), F.col(f"__new.{f.name}")).otherwise(F.col(f.name)).cast(f.dataType) if f.name in supplied else kept
        out.append(value.alias(f.name))
    return both.select(*out)


def set_sizes(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sizes of ``sizes(id, size_bytes)`` put in; unknown ids do nothing."""
    new = sizes.groupBy("id").agg(F.max(F.struct("size_bytes")).alias("__new"))
    value = F.when(F.col("__new").isNotNull(), F.col("__new.size_bytes")).otherwise(F.col("size_bytes"))
    return table.join(new, "id", "left").withColumn("size_bytes", value).select(*table.columns)


def set_size(table: DataFrame, id_: str, size: int | None) -> DataFrame:
    return table.withColumn("size_bytes", F.when(F.col("id") == id_, F.lit(size).cast("long")).otherwise(F.col("size_bytes")))


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids, "id", "left_anti")


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)


def pruned(table: DataFrame, source: DataFrame) -> DataFrame:
    """Ids of the table that the source no longer has."""
    return table.join(source, "id", "left_anti").select("id")


def sync(table: DataFrame, source: DataFrame, keep_if_source_empty: bool = False) -> DataFrame:
    """The table after a sync: the source's columns upserted, what it lacks removed. Sizes stay unless the source
    supplies them. An empty source empties the table, unless asked not to."""
    out = upsert(table, source, [c for c in source.columns if c in table.columns]).join(source, "id", "left_semi")
    if keep_if_source_empty and source.limit(1).count() == 0:
        return table
    return out


def resolve_sizes(table: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Rows without a size get that of the lookup, or 0: tried, unknown. One join instead of batches."""
    found = looked_up.groupBy("id").agg(F.max("size_bytes").alias("__size"))
    size = F.when(F.col("size_bytes").isNull(), F.coalesce("__size", F.lit(0))).otherwise(F.col("size_bytes"))
    return table.join(found, "id", "left").withColumn("size_bytes", size).select(*table.columns)


def resolve_page(table: DataFrame, ids: DataFrame, looked_up: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found sizes of the given ids, table with only those put in)."""
    found = looked_up.join(ids, "id", "left_semi")
    return found, set_sizes(table, found)


def ingest(table: DataFrame, source: DataFrame, ids: DataFrame, looked_up: DataFrame) -> DataFrame:
    """New assets by id: resolved in the source, upserted, sized."""
    rows = source.join(ids, "id", "left_semi")
    return set_sizes(upsert(table, rows, [c for c in rows.columns if c in table.columns]), looked_up.join(rows, "id", "left_semi"))


def remove_assets(table: DataFrame, selection: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return delete_ids(table, ids), delete_ids(selection, ids)


def remaining_total(total: int, removed: int) -> int:
    return max(0, total - removed)


def intersects(a: DataFrame, b: DataFrame) -> bool:
    return a.join(b, "id", "left_semi").limit(1).count() > 0


def synced_rows(raw: DataFrame) -> DataFrame:
    """Rows of a source (id, type, created, modified, width, height, seconds, title, mime_type) as asset columns: unknown dates
    are 0, durations are milliseconds. There is no size: a sync must not touch it."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(0))
    return raw.select("id", "type", whole("created").cast("long").alias("created_date"), whole("modified").cast("long").alias("modified_date"), whole("width").cast("int").alias("width"), whole("height").cast("int").alias("height"), (whole("seconds") * 1000).cast("long").alias("duration_ms"), "title", "mime_type")


def scanned(source: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (excluded) of a source, newest first."""
    return source.orderBy(F.col("created_date").desc(), "id").offset(start).limit(max(end - start, 0))


def as_assets(rows: DataFrame) -> DataFrame:
    """Rows of any columns as whole asset rows: types cast, absent columns at their defaults."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(ASSET_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in ASSETS.fields])
