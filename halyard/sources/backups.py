"""Backups of replaced originals: written before anything else happens, read back, deleted.

Many backups share a file, so that files are as many as the contents are large and not as many as the entries. A pack is the
contents one behind another, then an Arrow table of their names and places, then that table's length in eight bytes. A backup's path
is its pack's and its name in it, ``<folder>/<digest>.pack#<id>.bin``; any other path is that of a file of its own."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a pack holds at most; a larger content has a pack of its own.
PACK_ROWS, PACK_BYTES = 1 << 14, 32 << 20
#: What is handed to Spark at a time.
FRAME_ROWS, FRAME_BYTES = 10_000, 4 << 20
#: The pack in a backup's path.
PACK = r"(?s)^(.*?/[0-9a-f]{32}\.pack)#"


def open_fs(uri: str):
    """(file system, path) of a URI, for tasks that write or read files themselves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def named(folder: str) -> str:
    """A folder's URI as paths come back from reading: local ones with three slashes."""
    local = folder[5:] if folder.startswith("file:") else None if "://" in folder else folder
    return folder.rstrip("/") if local is None else "file:///" + local.strip("/")


def is_pack(file: str) -> bool:
    return re.search(PACK, f"{file}#") is not None


def store(fs, path: str, names: list[str], contents: Iterable) -> None:
    """Writes a pack, which appears only when whole."""
    draft, sizes = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}", []
    with fs.open_output_stream(draft, compression=None, buffer_size=1 << 20) as sink:
        for content in contents:
            sink.write(content)
            sizes.append(len(content))
        size = pa.array(sizes, pa.int64())
        index, out = pa.table({"name": pa.array(names, pa.string()), "start": pc.subtract(pc.cumulative_sum(size), size), "size": size}), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, index.schema) as stream:
            stream.write_table(index)
        packed = out.getvalue()
        sink.write(packed)
        sink.write(struct.pack("<q", packed.size))
    fs.move(draft, path)


def index_of(source) -> pa.Table:
    """(name, start, size) of the backups in an open pack."""
    end = source.size() - 8
    (length,) = struct.unpack("<q", source.read_at(8, end))
    return pa.ipc.open_stream(source.read_at(length, end - length)).read_all()


def places(index: pa.Table) -> Iterator[tuple[str, int, int]]:
    return zip(*(index[c].to_pylist() for c in ("name", "start", "size")), strict=True)


@contextlib.contextmanager
def alone(fs, path: str) -> Iterator[None]:
    """While a pack is changed, others that would change it wait, where the file system is local. Who waited for a pack that
    was replaced meanwhile waits for the new one."""
    import fcntl

    from pyarrow.fs import LocalFileSystem

    while isinstance(fs, LocalFileSystem):
        with open(path, "rb") as own:
            fcntl.flock(own, fcntl.LOCK_EX)
            if os.stat(path).st_ino == os.fstat(own.fileno()).st_ino:
                yield
                return
    yield


def remove(file: str, names: set[str]) -> int:
    """Deletes a file, or those backups of a pack that ``names`` has: how many were there. A pack of which some are kept is written
    again without the others."""
    fs, path = open_fs(file)
    if not is_pack(file):
        fs.delete_file(path)
        return 1
    with alone(fs, path), fs.open_input_file(path) as source:
        index = index_of(source)
        gone = pc.is_in(index["name"], pa.array(names, pa.string()))
        n = pc.sum(gone).as_py() or 0
        if n == len(index):
            fs.delete_file(path)
        elif n:
            kept = index.filter(pc.invert(gone))
            body = memoryview(source.read_at(pc.sum(index["size"]).as_py(), 0))
            store(fs, path, kept["name"].to_pylist(), (body[start : start + size] for _, start, size in places(kept)))
    return n


def contents(file: str, names: set[str] | None = None) -> Iterator[tuple[str, bytes]]:
    """(backup_path, content) of a file, or of a pack's backups that ``names`` has, or of all of them. Nothing else is read but the
    pack's index, and nothing if the file is gone."""
    fs, path = open_fs(file)
    try:
        source = fs.open_input_file(path)
    except FileNotFoundError:
        return
    with source:
        if not is_pack(file):
            yield file, source.read()
            return
        for name, start, size in places(index_of(source)):
            if names is None or name in names:
                yield f"{file}#{name}", source.read_at(size, start)


def packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of (id, content), a table for each pack."""
    held, rows, size = [], 0, 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch["content"]).to_pylist()):
            if rows and (rows == PACK_ROWS or size + n > PACK_BYTES):
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, rows, size, start = [], 0, 0, i
            rows, size = rows + 1, size + n
        held.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def framed(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, whose last value may be large, as batches of bounded size."""
    frame = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) == FRAME_ROWS or size >= FRAME_BYTES:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def by_file(paths: DataFrame) -> DataFrame:
    """(file, backup_path) of the paths that are not empty: those in one file are in one task, one behind another. The number of
    tasks is given, as little is shuffled for much work."""
    rows = paths.filter("backup_path <> ''").select(F.regexp_replace("backup_path", f"{PACK}.*$", "$1").alias("file"), "backup_path")
    parts = max(1, int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "file").sortWithinPartitions("file")


def files_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, set[str]]]:
    """(file, names wanted in it) from rows of ``by_file``."""
    rows = (row for batch in batches for row in zip(batch["file"].to_pylist(), batch["backup_path"].to_pylist(), strict=True))
    for file, met in groupby(rows, lambda row: row[0]):
        yield file, {path[len(file) + 1 :] for _, path in met}


def write_backups(entries: DataFrame, folder: str, ext: str = "bin") -> DataFrame:
    """(id, backup_path) of ``entries(id, content)``, each stored under its id in a pack of its task. A pack is named by what it
    holds and appears only when whole, so a repeated task does no harm (one that gets its rows in another order leaves packs that no
    path names). Null contents are left out; of an id's rows in one pack the last is stored. Nothing is written before an action."""

    folder = named(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        for table in packs(batches):
            ids = table["id"].to_pylist()
            last = {f"{id_}.{ext}": i for i, id_ in enumerate(ids)}
            stored = table["content"] if len(last) == len(ids) else table["content"].take(pa.array(last.values()))
            pack = f"{hashlib.sha256(json.dumps(list(last)).encode()).hexdigest()[:32]}.pack"
            store(fs, f"{path}/{pack}", list(last), (content.as_buffer() for content in stored))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "backup_path": pa.array([f"{folder}/{pack}#{id_}.{ext}" for id_ in ids], pa.string())})

    return entries.select(F.col("id").cast("string").alias("id"), "content").filter("id is not null and content is not null").mapInArrow(write, "id string, backup_path string")


OPENED = pa.schema([("backup_path", pa.string()), ("content", pa.binary())])


def read_backups(spark: SparkSession, folder: str) -> DataFrame:
    """(backup_path, content) of the backups below ``folder``; one that is gone gives no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from framed((row for batch in batches for file in batch["file"].to_pylist() for row in contents(file)), OPENED)

    return files.select(F.regexp_replace("path", r"^file:/+", "file:///").alias("file")).mapInArrow(read, "backup_path string, content binary")


def present(paths: DataFrame) -> DataFrame:
    """(backup_path) of the backups that ``paths(backup_path)`` names and that are there: each task looks for its own, so nobody lists the
    folder, and of a pack the index alone is read, of a file nothing. Empty paths are passed over."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from framed(((path,) for file, names in files_of(batches) for path in found(file, names)), OPENED.remove(1))

    def found(file: str, names: set[str]) -> list[str]:
        from pyarrow.fs import FileType

        fs, path = open_fs(file)
        if fs.get_file_info(path).type != FileType.File:
            return []
        if not is_pack(file):
            return [file]
        with fs.open_input_file(path) as source:
            return [f"{file}#{name}" for name in index_of(source)["name"].to_pylist() if name in names]

    return by_file(paths).mapInArrow(look, "backup_path string")


def opened(paths: DataFrame, counter=None) -> DataFrame:
    """(backup_path, content) of the backups that ``paths(backup_path)`` names, and no others: each task reads its own, one at
    a time. A backup that is gone gives no row; empty and repeated paths are passed over. ``counter``, an accumulator, counts the
    contents that were read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from framed(counted(row for file, names in files_of(batches) for row in contents(file, names)), OPENED)

    def counted(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
        for row in rows:
            if counter is not None:
                counter.add(1)
            yield row

    return by_file(paths).mapInArrow(read, "backup_path string, content binary")


def delete_backups(paths: DataFrame) -> DataFrame:
    """One row: how many backups of ``paths(backup_path)`` were there and are deleted. Empty paths and backups that
    are gone are passed over, and a file that cannot be deleted stays, which harms nothing."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for file, names in files_of(batches):
            with contextlib.suppress(OSError):
                n += remove(file, names)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return by_file(paths).mapInArrow(delete, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted"))
