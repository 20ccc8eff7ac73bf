"""WARC archives as a Spark data source, read and written.

``spark.read.format("warc").load(folder)`` plans one partition for some whole archives of about equal bytes.
Filters on record_type, page_id, target_uri and refers_to are pushed down: a record's headers are parsed
first, and of one that no filter wants, or whose payload no column asks for, the block is passed over without
being decoded. Ask for fewer columns with ``.schema(...)``.

Writing sends each partition to an archive of its own, one gzip member a record, and beside it an index with a line a
member: its bytes, type, id and reference. Filters on these are answered from the index, so unwanted members are never
read; of a member whose payload nobody asks for, only the beginning is. The driver lists the archives of the tasks that
committed in a new file below ``_archives``, one file a write; readers follow all lists, so appends add up, and
what lost or repeated tasks left is never read. Overwriting removes older lists and their archives once the new list stands.
A folder without lists is read whole, its archives from begin to end, headers first.

A record stands for a page: its id, URL, and either the payload (response) or where an equal payload stands
(revisit). Null URLs leave out the target; line ends in a URL are percent-encoded. Null payloads are
empty. Null page ids are written as such and come after all others. Equal ids with equal payloads are all responses if
theirs is the smallest id. An empty table gives an empty list of archives.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from halyard.llm.shared import open_fs, scratch_path, stored

SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"
NAME = b"urn:page:"
LISTS, INDEX = "_archives", ".index"
#: Members next to each other are read together up to so many bytes.
TOGETHER = 1 << 20
#: So much of a member is read at first where only its headers are wanted.
HEAD = 1 << 12


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, target: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit, which keeps the payload's headers only, if ``refers_to`` is given."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <%s%s>" % (NAME, b"" if page_id is None else b"%d" % page_id), b"WARC-Date: " + DATE]
    if target is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20%]", lambda m: f"%{ord(m[0]):02X}", target).encode("utf-8"))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.encode())
    if revisit:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <%s%d>" % (NAME, refers_to)]
    else:
        block += payload
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Member:
    """A line of an archive's index."""

    offset: int
    size: int
    record_type: str
    page_id: int | None
    refers_to: int | None

    def line(self) -> str:
        return "\t".join("" if x is None else str(x) for x in (self.offset, self.size, self.record_type, self.page_id, self.refers_to)) + "\n"

    @classmethod
    def of(cls, line: str) -> Member:
        offset, size, kind, page_id, refers_to = line.split("\t")
        return cls(int(offset), int(size), kind, int(page_id) if page_id else None, int(refers_to) if refers_to else None)


def whole_members(source, members: list[Member]) -> Iterator[bytes]:
    """The inflated records; members that follow one another are read together."""
    at = 0
    while at < len(members):
        upto, end = at, members[at].offset
        while upto < len(members) and members[upto].offset == end and (upto == at or end - members[at].offset < TOGETHER):
            end += members[upto].size
            upto += 1
        source.seek(members[at].offset)
        data = source.read(end - members[at].offset)
        for m in members[at:upto]:
            start = m.offset - members[at].offset
            yield zlib.decompress(data[start : start + m.size], 31)
        at = upto


def member_heads(source, members: list[Member]) -> Iterator[bytes]:
    """The headers of the records; payloads are not read, but for what a first small read holds of them."""
    for m in members:
        source.seek(m.offset)
        inflate, head, left = zlib.decompressobj(31), b"", m.size
        while (end := head.find(b"\r\n\r\n")) < 0:
            data = source.read(min(HEAD, left))
            if not data:
                raise EOFError("a record is cut off")
            left -= len(data)
            head += inflate.decompress(data, 2 * HEAD)
            while inflate.unconsumed_tail and b"\r\n\r\n" not in head:
                head += inflate.decompress(inflate.unconsumed_tail, 2 * HEAD)
        yield head[:end]


class Walk:
    """The bytes of an archive without an index, gzip members or plain, as they are asked for."""

    def __init__(self, source, chunk: int = 1 << 18):
        self.source, self.chunk = source, chunk
        self.inflate = None
        self.raw, self.ready = b"", bytearray()
        self.plain: bool | None = None

    def _more(self) -> bool:
        data = self.raw or self.source.read(self.chunk)
        self.raw = b""
        if not data:
            return False
        if self.plain is None:
            self.plain = not data.startswith(b"\x1f\x8b")
        if self.plain:
            self.ready += data
            return True
        if self.inflate is None:
            self.inflate = zlib.decompressobj(31)
        self.ready += self.inflate.decompress(data)
        if self.inflate.eof:
            self.raw, self.inflate = self.inflate.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next ``mark``, which is passed; None at the end."""
        looked = 0
        while (at := self.ready.find(mark, max(0, looked - len(mark)))) < 0:
            looked = len(self.ready)
            if not self._more():
                return None
        out = bytes(self.ready[:at])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise EOFError("a record is cut off")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.ready):
            n -= len(self.ready)
            self.ready.clear()
            if not self._more():
                raise EOFError("a record is cut off")
        del self.ready[:n]


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def number_of(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{NAME.decode()}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def described(head: dict[str, str]) -> dict:
    """The columns that a record's headers alone give."""
    target = head.get("warc-target-uri")
    return {
        "page_id": number_of(head.get("warc-record-id")),
        "target_uri": None if target is None else re.sub(r"%([01][0-9A-F]|20|25)", lambda m: chr(int(m[1], 16)), target),
        "record_type": head.get("warc-type"),
        "refers_to": number_of(head.get("warc-refers-to")),
    }


@dataclass
class Archives(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    PUSHED = ("record_type", "page_id", "target_uri", "refers_to")

    def __init__(self, folder: str, columns: list[str], group_bytes: int):
        self.folder, self.columns, self.group_bytes = folder, columns, group_bytes
        self.wanted: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else None
            if name not in self.PUSHED:
                yield f
            elif isinstance(f, IsNotNull):
                self.wanted.append((name, ()))
            else:
                self.wanted.append((name, (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))

    def partitions(self) -> list[Archives]:
        from pyarrow.fs import FileSelector

        fs, path = open_fs(self.folder)
        listed = []
        lists = sorted(lists_below(fs, path))
        for where in lists:
            with fs.open_input_stream(where, compression=None) as source:
                listed += [line.split("\t") for line in source.read().decode().splitlines()]
        if not lists:  # archives that others wrote
            found = fs.get_file_info(FileSelector(path))
            listed = sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")))
        groups: list[Archives] = []
        size = self.group_bytes
        for name, length in listed:
            if size >= self.group_bytes:
                groups.append(Archives([]))
                size = 0
            groups[-1].paths.append(f"{self.folder}/{name}")
            size += int(length)
        return groups or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        for uri in partition.paths:
            fs, path = open_fs(uri)
            if fs.get_file_info(f"{path}{INDEX}").is_file:
                with fs.open_input_stream(f"{path}{INDEX}", compression=None) as source:
                    members = [Member.of(line) for line in source.read().decode().splitlines()]
                with fs.open_input_file(path) as source:
                    yield from self.rows(source, members)
            else:
                with fs.open_input_stream(path, compression=None) as source:
                    yield from self.walked(Walk(source))

    @property
    def decodes(self) -> bool:
        return bool({"payload", "payload_bytes", "payload_digest"} & set(self.columns))

    @staticmethod
    def wants(value, values: tuple) -> bool:
        return value is not None if not values else value in values

    def rows(self, source, members: list[Member]) -> Iterator[tuple]:
        """The wanted rows of an archive, by its index."""
        members = [m for m in members if all(self.wants(getattr(m, c), v) for c, v in self.wanted if c != "target_uri")]
        for data in (whole_members if self.decodes else member_heads)(source, members):
            block, _, content = data.partition(b"\r\n\r\n")
            head = headers(block)
            row = described(head)
            if all(self.wants(row[c], v) for c, v in self.wanted):
                yield self.filled(row, head, content[: int(head["content-length"])] if self.decodes else None)

    def walked(self, walk: Walk) -> Iterator[tuple]:
        """The wanted rows of an archive from its begin to its end: blocks that nobody asks for are passed over unparsed."""
        while (block := walk.until(b"\r\n\r\n")) is not None:
            head = headers(block)
            length = int(head["content-length"])
            row = described(head)
            wanted = all(self.wants(row[c], v) for c, v in self.wanted)
            content = walk.take(length) if wanted and self.decodes else walk.skip(length)
            walk.skip(4)
            if wanted:
                yield self.filled(row, head, content)

    def filled(self, row: dict, head: dict[str, str], content: bytes | None) -> tuple:
        """A row, with its payload's columns if there is content. Only HTTP messages have headers of their own."""
        if content is not None:
            http, payload = b"", content
            if head.get("content-type", "").lower().startswith("application/http"):
                http, _, payload = content.partition(b"\r\n\r\n")
            if row["record_type"] != "revisit":
                row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": payload_digest(payload)}
            else:
                row |= {"payload_bytes": int(headers(http).get("content-length", 0)), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        return tuple(row.get(c) for c in self.columns)


def lists_below(fs, path: str) -> list[str]:
    """The lists of a folder's writes."""
    from pyarrow.fs import FileSelector

    return [f.path for f in fs.get_file_info(FileSelector(f"{path}/{LISTS}", allow_not_found=True)) if f.is_file and not f.base_name.startswith(".")]


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int


class WarcWriter(DataSourceWriter):
    def __init__(self, folder: str, level: int, overwrite: bool):
        self.folder, self.level, self.overwrite = folder, level, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        first = next(iterator, None)
        if first is None:
            return Written(None, 0)
        fs, path = open_fs(self.folder)
        fs.create_dir(path, recursive=True)
        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
        # the index is streamed beside the archive, so memory does not grow with it
        with fs.open_output_stream(f"{path}/{name}", compression=None) as sink, fs.open_output_stream(f"{path}/{name}{INDEX}", compression=None) as index:
            buffer, lines = io.BytesIO(), io.StringIO()
            row: Row | None = first
            while row is not None:
                data = record(row["page_id"], row["target_uri"], bytes(row["payload"] or b""), row["payload_digest"], row["refers_to"])
                member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                packed = member.compress(data) + member.flush()
                buffer.write(packed)
                lines.write(Member(size, len(packed), "response" if row["refers_to"] is None else "revisit", row["page_id"], row["refers_to"]).line())
                size += len(packed)
                row = next(iterator, None)
                if buffer.tell() > 1 << 20 or row is None:
                    sink.write(buffer.getvalue())
                    index.write(lines.getvalue().encode())
                    buffer, lines = io.BytesIO(), io.StringIO()
        return Written(name, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = open_fs(self.folder)
        fs.create_dir(f"{path}/{LISTS}", recursive=True)
        older = lists_below(fs, path) if self.overwrite else []
        name = uuid.uuid4().hex
        with fs.open_output_stream(f"{path}/{LISTS}/.{name}", compression=None) as sink:
            sink.write("".join(sorted(f"{m.name}\t{m.size}\n" for m in messages if m is not None and m.name)).encode())
        fs.move(f"{path}/{LISTS}/.{name}", f"{path}/{LISTS}/{name}")
        for where in older:
            with fs.open_input_stream(where, compression=None) as source:
                gone = [line.split("\t")[0] for line in source.read().decode().splitlines()]
            fs.delete_file(where)  # from here on its archives are not read
            self.remove(fs, path, gone)

    def abort(self, messages: list[Written | None]) -> None:
        self.remove(*open_fs(self.folder), [m.name for m in messages if m is not None and m.name])

    @staticmethod
    def remove(fs, path: str, names: list[str]) -> None:
        for name in names:
            for where in (f"{path}/{name}", f"{path}/{name}{INDEX}"):
                if fs.get_file_info(where).is_file:
                    fs.delete_file(where)


class WarcSource(DataSource):
    """Options: path; group_mb (bytes of archives in a partition, 32); level (of compression, 4)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"].rstrip("/"), schema.names, int(float(self.options.get("group_mb", "32")) * 1e6))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"].rstrip("/"), int(self.options.get("level", "4")), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(digest: Column) -> Column:
    """Upper-case base32 of a digest given in hexadecimal, a multiple of five bytes."""
    fives = [F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long") for k in range(4)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(letters, (F.shiftright(five, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for five in fives for j in range(8)])


def archived(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages(page_id, url, html)`` below ``folder``. Of equal payloads of at least
    ``least_bytes``, that with the smallest page_id is the response and the others revisit it. Ids and digests
    find the roles; the payloads are shuffled once, by page, so many copies of one are spread out."""
    spark = pages.sparkSession
    register(spark)
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    digest = F.sha1(html)
    marks = pages.select("page_id", digest.alias("digest"), F.octet_length(html).alias("size"))
    first = marks.filter((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"))
    roles = marks.select("page_id", "digest").distinct().join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first")
    p = pages.select("page_id", "url", html.alias("payload"), digest.alias("digest")).alias("p")
    r = stored(roles, "revisits").alias("r")
    rows = p.join(r, F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.digest") == F.col("r.digest")), "left")
    rows.select("p.page_id", F.col("p.url").alias("target_uri"), "p.payload", base32(F.col("p.digest")).alias("payload_digest"), F.col("r.first").alias("refers_to")).write.format("warc").mode("append").save(folder)


def read_archives(spark: SparkSession, folder: str, columns: str = SCHEMA, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).options(**options).load(folder)


def archive_digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from archives written and read back."""
    folder = scratch_path(pages.sparkSession, "archives")
    archived(pages, folder)
    return read_archives(pages.sparkSession, folder, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
