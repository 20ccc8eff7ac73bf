"""Asset, journal and task tables: versions on disk, lookups, and views over star-schema tables.

A table is a folder of versions, each a whole Parquet table; a change reads the newest and writes the next, so
readers keep what they opened and a lost executor only repeats its part of the write. Writers may meet: each writes a data
folder of its own, and a version exists from the moment that its number is claimed by one atomic step, so a version is
whole when it is seen and no two writers share one. Who finds the number claimed has read a table that is no longer the
newest: his change runs again on the newest. Writers of one process take turns, so that none of them does his work in vain.
"""

from __future__ import annotations

import contextlib
import os
import re
import threading
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.schema import ASSETS, SCHEMA_VERSION, TRASH


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def claim(spark: SparkSession, target: str, content: str) -> bool:
    """Makes the file ``target`` with its content in one step, unless it exists: True for the one who made it.

    Local files are linked into place; elsewhere a file is renamed, which on HDFS fails where the target exists. The
    folder must exist."""
    parent, name = target.rsplit("/", 1)
    path, fs = _path(spark, parent)
    real = fs.resolvePath(path).toUri()
    own = f".{uuid.uuid4().hex}.claim"
    if real.getScheme() == "file":
        folder = real.getPath()
        with open(f"{folder}/{own}", "x", encoding="utf-8") as sink:
            sink.write(content)
        try:
            os.link(f"{folder}/{own}", f"{folder}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{folder}/{own}")
        return True
    staged, _ = _path(spark, f"{parent}/{own}")
    sink = fs.create(staged, True)
    sink.write(bytearray(content.encode()))
    sink.close()
    if fs.rename(staged, _path(spark, target)[0]):
        return True
    fs.delete(staged, False)
    return False


class Conflict(RuntimeError):
    """Another writer has made a version since the one that a write is based on."""


class Change(NamedTuple):
    """What a change found and what it left."""

    before: DataFrame
    after: DataFrame
    version: int


#: A table's folder and the lock of this process's changes of it.
_turns: dict[str, threading.RLock] = {}
_turns_lock = threading.Lock()


def turn(folder: str) -> threading.RLock:
    with _turns_lock:
        return _turns.setdefault(folder, threading.RLock())


class VersionedTable:
    """A table whose changes are new versions. Old ones stay until ``vacuum``.

    Version n is the file ``v`` n, which names the folder of its data."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _listed(self) -> tuple[list[int], dict[str, int]]:
        """(numbers of the versions in order, {data folder: the number it was written for})."""
        path, fs = _path(self.spark, self.folder)
        whole, data = [], {}
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name = status.getPath().getName()
            if found := re.fullmatch(r"v(\d+)(-[0-9a-f]+)?", name):
                if status.isDirectory():
                    data[name] = int(found[1])
                else:
                    whole.append(int(found[1]))
        return sorted(whole), data

    def _data(self, number: int) -> str:
        path, fs = _path(self.spark, f"{self.folder}/v{number:08d}")
        source = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def versions(self) -> list[int]:
        """Numbers of the versions, oldest first."""
        return self._listed()[0]

    def at(self, number: int) -> DataFrame:
        """A version; an empty table for number 0."""
        if not number:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self._data(number)}")

    def read(self) -> DataFrame:
        """The newest version; an empty table before the first."""
        return self.at(max(self.versions(), default=0))

    def _stored(self, df: DataFrame, number: int, sort_by: str | None) -> str:
        name = f"v{number:08d}-{uuid.uuid4().hex[:12]}"
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        if sort_by:
            out = out.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
        out.write.parquet(f"{self.folder}/{name}")
        return name

    def _remove(self, name: str) -> None:
        path, fs = _path(self.spark, f"{self.folder}/{name}")
        fs.delete(path, True)

    def _next(self) -> tuple[int, int]:
        """(the newest version or 0, the number after all that were ever begun)."""
        whole, data = self._listed()
        return max(whole, default=0), max([0, *whole, *(n for d, n in data.items() if "-" not in d)]) + 1

    def change(self, work: Callable[[DataFrame], DataFrame | None], sort_by: str | None = None, tries: int = 50) -> Change:
        """Puts ``work(newest version)`` in the next version, or nothing if it is None. If another writer was faster, the work
        is done again on what he left, so ``work`` must only describe rows."""
        for _ in range(tries):
            with turn(self.folder):  # until the claim: a writer of this process that comes meanwhile finds what this one leaves
                newest, number = self._next()
                before = self.at(newest)
                after = work(before)
                if after is None:
                    return Change(before, before, newest)
                name = self._stored(after, number, sort_by)
                if claim(self.spark, f"{self.folder}/v{number:08d}", name):
                    return Change(before, self.at(number), number)
            self._remove(name)
        raise Conflict(f"{self.folder}: {tries} other changes came first")

    def write(self, df: DataFrame, sort_by: str | None = None, since: int | None = None) -> DataFrame:
        """``df`` as the next version. With ``since``, the version that ``df`` was made from (0 for none), it is a conflict if
        there is a newer one; without, ``df`` replaces whatever is there. Sorted files let a filter on that column
        skip row groups. A write that was killed leaves a folder that is never read."""
        newest, number = self._next()
        if since is not None and since != newest:
            raise Conflict(f"{self.folder}: version {newest} came after {since}")
        name = self._stored(df, number, sort_by)
        while not claim(self.spark, f"{self.folder}/v{number:08d}", name):
            if since is not None:
                self._remove(name)
                raise Conflict(f"{self.folder}: version {number} came after {since}")
            number = self._next()[1]
        return self.at(number)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Removes versions before the newest ``keep``, and what killed writes before them left. A write that is still going on
        counts as killed if it began before the oldest version kept."""
        whole, data = self._listed()
        newest = whole[-keep:] if keep else []
        least = min(newest, default=max(whole, default=0) + 1)
        held = {self._data(n) for n in newest}
        gone = [n for n in whole if n < least]
        for name in [f"v{n:08d}" for n in gone] + [d for d, n in data.items() if n < least and d not in held]:
            self._remove(name)
        return gone


def open_tables(spark: SparkSession, folder: str) -> dict[str, VersionedTable]:
    """The tables of the current schema version, migrated to it first. A folder without a version marker is empty or of
    version 1, which had no journal: it gains an empty one, and its assets stay as they are."""
    tables = {"assets": VersionedTable(spark, f"{folder}/assets", ASSETS), "trash": VersionedTable(spark, f"{folder}/trash", TRASH)}
    marker = VersionedTable(spark, f"{folder}/schema", StructType.fromDDL("version int"))
    if schema_version(marker) < SCHEMA_VERSION:
        known = max(marker.versions(), default=0)
        steps = [(table, table.read(), 0) for table in tables.values() if not table.versions()]
        for table, first, since in [*steps, (marker, spark.createDataFrame([(SCHEMA_VERSION,)], marker.schema), known)]:
            with contextlib.suppress(Conflict):  # another opening was faster
                table.write(first, since=since)
    return tables


def schema_version(marker: VersionedTable) -> int:
    row = marker.read().agg(F.max("version").alias("version")).first()
    return row["version"] or 0


def fresh_sizes(raw: DataFrame) -> DataFrame:
    """(id, size_bytes) of a size lookup: numbers of any kind as whole bytes, negative and missing ones dropped."""
    size = F.expr("try_cast(size as double)")
    return raw.filter(size.isNotNull() & (size >= 0)).select("id", F.floor(size).cast("long").alias("size_bytes"))


def store_sizes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, size_bytes) of those ``ids`` that are numbers and whose size in ``rows(_id, _size)`` is above 0."""
    wanted = ids.select(F.expr("try_cast(id as bigint)").alias("_id")).filter(F.col("_id").isNotNull()).distinct()
    return rows.join(wanted, "_id", "left_semi").filter(F.col("_size") > 0).select(F.col("_id").cast("string").alias("id"), F.col("_size").cast("long").alias("size_bytes"))


def resource_sizes(resources: DataFrame) -> DataFrame:
    """(id, size_bytes): of each asset's resources (id, position, kind, size) the first photo, video or audio, else the
    first of all, at equal positions the smallest known size; only sizes above 0."""
    main = F.coalesce(F.col("kind").isin("photo", "video", "audio"), F.lit(False))
    first = F.min_by("size", F.struct(F.when(main, 0).otherwise(1), F.col("position"), F.col("size").isNull(), F.col("size")))
    return resources.groupBy("id").agg(first.alias("size_bytes")).filter(F.col("size_bytes") > 0)


def album_page(assets: DataFrame, membership: DataFrame, album_id: str, start: int, end: int) -> DataFrame:
    """Members ``start`` to ``end`` (excluded) of an album, in the album's own order."""
    inside = membership.filter(F.col("album_id") == album_id).select(F.col("asset_id").alias("id"), "position")
    return assets.join(inside, "id").orderBy("position", "id").offset(start).limit(max(end - start, 0))


def gallery_rows(saved: DataFrame) -> DataFrame:
    """Rows to append for saved results: a coordinate of 0 is none, each by itself."""
    return saved.withColumns({c: F.nullif(c, F.lit(0.0)) for c in ("latitude", "longitude")})


def append_gallery(saved: DataFrame, folder: str) -> None:
    """Adds saved results (id, title, content, created, latitude, longitude) to a gallery; nothing in it is replaced."""
    gallery_rows(saved).select("id", "title", "content", "created", "latitude", "longitude").write.mode("append").parquet(folder)


class Flags:
    """Named switches in a versioned table of their own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = VersionedTable(spark, folder, StructType.fromDDL("name string, on boolean"))

    def get(self, name: str) -> bool:
        rows = self.table.read().filter(F.col("name") == name).collect()
        return bool(rows and rows[0]["on"])

    def put(self, name: str, on: bool) -> None:
        self.put_all(self.table.spark.createDataFrame([(name, on)], self.table.schema))

    def put_all(self, rows: DataFrame) -> None:
        """Sets the switches of ``rows(name, on)``; the others stay."""
        self.table.change(lambda known: known.join(rows, "name", "left_anti").unionByName(rows.select("name", "on")))


def first_digit(c: Column) -> Column:
    return F.substring(c, 1, 1)


def assets_of(orders: DataFrame) -> DataFrame:
    """The ``assets`` view over ``orders``."""
    k = F.col("o_orderkey")
    video = F.col("o_orderstatus") == "O"
    kind = first_digit(F.col("o_orderpriority"))
    still = lambda names: F.element_at(F.array(*map(F.lit, names)), kind.cast("int"))
    mime = F.when(video, F.when(k % 2 == 0, "video/mp4").otherwise("video/quicktime")).otherwise(still(("image/jpeg", "image/png", "image/heic", "image/webp", "image/avif")))
    ending = F.when(video, F.when(k % 2 == 0, ".MP4").otherwise(".mov")).otherwise(still((".JPG", ".png", ".HEIC", ".webp", ".avif")))
    created = F.when(k % 50 == 0, F.lit(0)).otherwise(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).cast("long")
    size = F.when(k % 37 == 0, F.lit(None)).when(k % 41 == 0, F.lit(0)).otherwise(F.round(F.col("o_totalprice") * 50)).cast("long")
    return orders.select(
        k.cast("string").alias("id"),
        F.when(video, 2).otherwise(1).cast("int").alias("type"),
        created.alias("created_date"),
        created.alias("modified_date"),
        (640 + (k * 37) % 7360).cast("int").alias("width"),
        (480 + (k * 53) % 5520).cast("int").alias("height"),
        F.when(video, (k % 600) * 1000).otherwise(0).cast("long").alias("duration_ms"),
        size.alias("size_bytes"),
        F.concat(F.lit("IMG_"), k.cast("string"), ending).alias("title"),
        F.when(k % 29 == 0, F.lit(None)).otherwise(mime).alias("mime_type"),
    )


def trash_of(events: DataFrame) -> DataFrame:
    """The columns of ``trash`` that ``events`` can fill."""
    pending = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.when(pending, 0).otherwise(1).cast("int").alias("state"),
        F.when(pending, F.lit(0)).otherwise(F.unix_millis(F.col("ts").cast("timestamp"))).cast("long").alias("deleted_at_ms"),
        F.round(F.col("value") * 1000).cast("long").alias("original_bytes"),
        (1 + F.col("event_id") % 2).cast("int").alias("asset_type"),
    )


def tasks_of(events: DataFrame) -> DataFrame:
    """(task_id, seq, ts, status): the ``tasks`` view over ``events``."""
    names = {"view": "pending", "click": "running", "purchase": "completed", "error": "failed", "signup": "cancelled"}
    status = F.lit(None).cast("string")
    for event, name in names.items():
        status = F.when(F.col("event_type") == event, F.lit(name)).otherwise(status)
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
