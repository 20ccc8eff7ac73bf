"""The two-state trash journal: a replaced original is pending, then committed, then purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halyard.functions.numbers import days_remaining, retention_cutoff
from halyard.schema import COMMITTED, PENDING, RETENTION_DAYS, TRASH_DEFAULTS
from halyard.scratch import spooled
from halyard.sources.backups import delete_backups, opened
from halyard.sources.catalog import VersionedTable, append_gallery


class DuplicateKey(ValueError):
    """A new entry's id is in the journal already."""


def insert_pending(journal: DataFrame, rows: DataFrame) -> DataFrame:
    """New entries in the pending state; absent columns take their defaults. An id that exists, or repeats, is an error."""
    again = rows.join(journal, "id", "left_semi").select("id").union(rows.groupBy("id").count().filter("count > 1").select("id")).limit(1).collect()
    if again:
        raise DuplicateKey(again[0]["id"])
    have = set(rows.columns) - {"state"}
    new = rows.select(*[(F.col(f.name) if f.name in have else F.lit(TRASH_DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in journal.schema.fields])
    return journal.unionByName(new.withColumn("state", F.lit(PENDING)))


def mark_committed(journal: DataFrame, id_: str, as_of_ms: int, new_asset_id: str | None = None, new_bytes: int | None = None, deleted_at_ms: int | None = None) -> DataFrame:
    """The new asset's id is set even to null; its bytes only if given; the time defaults to now, ``as_of_ms``."""
    hit = F.col("id") == id_
    put = lambda c, v, kind: F.when(hit, F.lit(v).cast(kind)).otherwise(F.col(c))
    changed = {"state": put("state", COMMITTED, "int"), "new_asset_id": put("new_asset_id", new_asset_id, "string"), "deleted_at_ms": put("deleted_at_ms", as_of_ms if deleted_at_ms is None else deleted_at_ms, "long")}
    if new_bytes is not None:
        changed["new_bytes"] = put("new_bytes", new_bytes, "long")
    return journal.withColumns(changed)


def drop(journal: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the journal without the ids, the backup paths that went with them)."""
    return journal.join(ids, "id", "left_anti"), journal.join(ids, "id", "left_semi").filter(F.col("backup_path") != "").select("backup_path")


def committed(journal: DataFrame) -> DataFrame:
    return journal.filter(F.col("state") == COMMITTED).orderBy(F.col("deleted_at_ms").desc(), F.col("id"))


def pending(journal: DataFrame) -> DataFrame:
    return journal.filter(F.col("state") == PENDING)


def expired(as_of: Column, days: int = RETENTION_DAYS) -> Column:
    return (F.col("state") == COMMITTED) & (F.col("deleted_at_ms") > 0) & (F.col("deleted_at_ms") < retention_cutoff(as_of, days))


def purge(journal: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row: how many went)."""
    gone = expired(as_of, days)
    return journal.filter(~gone), journal.agg(F.coalesce(F.count_if(gone), F.lit(0)).alias("purged"))


def empty_all(journal: DataFrame) -> DataFrame:
    """Every committed entry goes; pending ones stay."""
    return journal.filter(F.col("state") != COMMITTED)


def backed(journal: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted entries that have a backup."""
    return journal.join(ids.select("id").distinct(), "id", "left_semi").filter("backup_path <> ''")


def restorable(journal: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """Gallery rows of the wanted entries whose backup ``files(backup_path, content)`` still holds: the original's name,
    time and place. Entries without a name are called restored; a time of 0 is none."""
    created = F.when(F.col("created_date_ms") > 0, F.timestamp_millis("created_date_ms"))
    wanted = backed(journal, ids).join(files, "backup_path")
    return wanted.select("id", F.coalesce(F.nullif("filename", F.lit("")), F.lit("restored")).alias("title"), "content", created.alias("created"), "latitude", "longitude", "backup_path")


def restore(table: VersionedTable, ids: DataFrame, gallery: str) -> DataFrame:
    """Re-creates the wanted entries' originals in the gallery from their backups, then drops what was re-created from the
    journal and deletes its backups: (id, ok) of the wanted ids. One whose backup is gone stays in the journal.
    Only the wanted backups are opened.

    The gallery is written first, then the journal, the files last: a job that stops in between loses nothing."""
    before = table.read()
    rows = spooled(restorable(before, ids, opened(backed(before, ids))), "restored")
    append_gallery(rows, gallery)
    table.change(lambda now: now.join(rows, "id", "left_anti"))
    delete_backups(rows).collect()
    return ids.select("id").distinct().join(rows.select("id", F.lit(True).alias("ok")), "id", "left").select("id", F.coalesce("ok", F.lit(False)).alias("ok"))


def drop_entries(table: VersionedTable, ids: DataFrame) -> DataFrame:
    """Drops entries for ever, with their backups; one row: how many backups were deleted. Unknown ids do nothing."""
    before = table.change(lambda now: drop(now, ids)[0]).before
    return delete_backups(drop(before, ids)[1])


def empty_trash(table: VersionedTable) -> DataFrame:
    """Every committed entry goes for ever, with its backup; one row: how many backups were deleted. Pending entries and theirs
    stay."""
    before = table.change(empty_all).before
    return delete_backups(before.filter(F.col("state") == COMMITTED))


def launch_sweep(table: VersionedTable, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """The job that runs once at a start: expired entries go, with their backups; one row: how many went."""
    before = table.change(lambda now: purge(now, as_of, days)[0]).before
    delete_backups(before.filter(expired(as_of, days))).collect()
    return purge(before, as_of, days)[1]


def with_days_remaining(journal: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return journal.withColumn("days_remaining", days_remaining(F.col("deleted_at_ms"), as_of, days))


def by_id(journal: DataFrame, id_: str) -> DataFrame:
    return journal.filter(F.col("id") == id_)


def items(journal: DataFrame, as_of: Column) -> DataFrame:
    """What a list of the trash shows: a name, a time, a kind."""
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit("IMG"))
    when = F.when(F.col("deleted_at_ms") == 0, F.unix_millis(as_of)).otherwise(F.col("deleted_at_ms"))
    return journal.select("id", name.alias("name"), when.alias("deleted_at_ms"), F.when(F.col("asset_type") == 2, "video").otherwise("image").alias("kind"))
