"""Substring search from posting lists: three-letter strings of a table's texts to the rows that hold them.

An index is a folder of segments, each written once: its rows as Parquet files, and for every field and three-letter string (in
lower case) the numbers of the rows that hold it, a list for each 32,768 rows of a file, so that a string that every
row has is many short lists. Two end marks follow a text, so one- and two-letter strings and endings are found by lists too.
A search counts the strings of its needles, intersects their lists from the rarest on, and reads only the files in which rows
are left; what it reads is tested against the texts themselves. Two small jobs answer for all needles and segments: one reads
the lengths of lists, one the lists.

A change is a segment of its changed rows alone, and a row of an older segment with the same key no longer counts;
a removal is a segment of keys. ``compacted`` makes one segment of all that counts. Segments are numbered by atomic claims, so
several writers may change an index at a time.

Null texts have no lists; an empty needle finds all rows; rows of one key in one change all stay; a null key is
replaced by nothing. Long texts are cut in one pass and give a list entry for each different string.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.plans.view import Parameters, has_format, matching, predicate
from halyard.sources.catalog import _path, claim

END = "\0\0"
LETTERS = 3
BLOCK = 32_768
LISTS = 4  # lists that are intersected, the rarest; the test of the texts does the rest
POSTINGS = "field string, gram string, file int, block int, n int, rows array<int>"
FILES = "path string, file int"


@dataclass(frozen=True)
class Term:
    """A needle in lower case that a field holds, or ends in."""

    field: str
    needle: str
    ends: bool = False

    @property
    def text(self) -> str:
        return self.needle + END * self.ends


@dataclass(frozen=True)
class TextIndex:
    """The posting lists of ``fields`` of a table with rows of ``schema``, told apart by ``key``."""

    spark: SparkSession
    folder: str
    schema: StructType
    fields: tuple[str, ...]
    key: str = "id"

    @staticmethod
    def built(rows: DataFrame, fields: Iterable[str], folder: str, key: str = "id", rows_per_file: int | None = None) -> TextIndex:
        index = TextIndex(rows.sparkSession, folder.rstrip("/"), rows.schema, tuple(fields), key)
        index.changed(rows, rows_per_file)
        return index

    # segments

    def _markers(self) -> list[tuple[int, str, int]]:
        """(number, data folder, number up to which it stands for all segments; -1 for a change), in order."""
        path, fs = _path(self.spark, self.folder)
        found = []
        for status in fs.listStatus(path) if fs.exists(path) else []:
            if name := re.fullmatch(r"s(\d+)", status.getPath().getName()):
                source = fs.open(status.getPath())
                try:
                    mark = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
                finally:
                    source.close()
                found.append((int(name[1]), mark["data"], mark["covers"]))
        return sorted(found)

    def segments(self) -> list[str]:
        """Data folders of the segments that count, oldest first."""
        return [data for _, data, _ in self._current()]

    def _current(self) -> list[tuple[int, str, int]]:
        marks = self._markers()
        whole = max((m for m in marks if m[2] >= 0), key=lambda m: m[2], default=None)
        return [whole] * (whole is not None) + [m for m in marks if m[2] < 0 and (whole is None or m[0] > whole[2])]

    def _claimed(self, data: str, covers: int = -1) -> None:
        while True:
            number = max((m[0] for m in self._markers()), default=0) + 1
            if claim(self.spark, f"{self.folder}/s{number:08d}", json.dumps({"data": data, "covers": covers})):
                return

    def _written(self, rows: DataFrame, rows_per_file: int | None) -> str:
        data = f"d-{uuid.uuid4().hex[:12]}"
        where = f"{self.folder}/{data}"
        writer = rows.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else rows.write
        writer.parquet(f"{where}/rows")
        lined = self._rows(data).withColumns({"path": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
        numbers = lined.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")))  # one row a file
        numbers.coalesce(1).write.parquet(f"{where}/files")
        files = self.spark.read.schema(FILES).parquet(f"{where}/files")
        texts = F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in self.fields))
        cut = lined.join(F.broadcast(files), "path").select("file", "row", F.inline(texts)).filter(F.col("text").isNotNull())
        # a match of no width at each letter, whose group is the letter and the next two
        grams = F.array_distinct(F.regexp_extract_all(F.concat("text", F.lit(END)), F.lit(f"(?s)(?=({'.' * LETTERS}))"), F.lit(1)))
        held = cut.select("field", "file", "row", F.explode(grams).alias("gram"))
        lists = held.groupBy("field", "gram", "file", F.floor(F.col("row") / BLOCK).cast("int").alias("block")).agg(F.sort_array(F.collect_list((F.col("row") % BLOCK).cast("int"))).alias("rows"))
        order = ["field", "gram", "file", "block"]
        lists.withColumn("n", F.size("rows")).repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{where}/postings")
        return data

    def _table(self, segments: list[str], name: str, schema: str) -> DataFrame:
        """A table of several segments, with the ``segment`` of each row."""
        rows = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{data}/{name}" for data in segments])
        return rows.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), f"/(d-[0-9a-f]+)/{name}/", 1))

    def _rows(self, *segments: str) -> DataFrame:
        return self._files([f"{self.folder}/{data}/rows" for data in segments])

    def _files(self, paths: list[str]) -> DataFrame:
        schema = StructType([*self.schema.fields]).add("__gone", "boolean")
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # changes

    def _made(self) -> None:
        path, fs = _path(self.spark, self.folder)
        fs.mkdirs(path)

    def changed(self, rows: DataFrame, rows_per_file: int | None = None) -> None:
        """Puts the rows in, each in place of those of its key."""
        self._made()
        self._claimed(self._written(rows.select(*self.schema.names).withColumn("__gone", F.lit(False)), rows_per_file))

    def removed(self, keys: DataFrame) -> None:
        """Takes the rows of these keys out."""
        self._made()
        blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(f.name) for f in self.schema.fields]
        self._claimed(self._written(keys.select(*blank).withColumn("__gone", F.lit(True)), None))

    def compacted(self, rows_per_file: int | None = None) -> None:
        """One segment of all rows that count, in place of those it was made from. Changes made meanwhile stay."""
        current = self._current()
        if current:
            covers = max(max(number if own < 0 else own for number, _, own in current), 0)
            live = self._united([(data, self._rows(data)) for _, data, _ in current])
            self._claimed(self._written(live.withColumn("__gone", F.lit(False)), rows_per_file), covers)

    # searches

    def _united(self, found: list[tuple[str, DataFrame]]) -> DataFrame:
        """Rows found in all segments, without those that a later segment has replaced."""
        parts = []
        for k, (_, rows) in enumerate(found):
            if later := [data for data, _ in found[k + 1 :]]:
                rows = rows.join(self._rows(*later).select(self.key), self.key, "left_anti")
            parts.append(rows.filter(~F.col("__gone")).select(*self.schema.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """All rows that count."""
        return self._united([(data, self._rows(data)) for data in self.segments()])

    def _counted(self, segments: list[str], terms: list[Term]) -> dict[str, dict[tuple[str, str], int]]:
        """{segment: {(field, three-letter string): rows}} of the strings of the terms: at most one a letter and segment."""
        wanted: dict[str, set[str]] = {}
        for t in terms:
            wanted.setdefault(t.field, set()).update(_cut(t.text))
        tests = [(F.col("field") == f) & F.col("gram").isin(*grams) for f, grams in wanted.items() if grams]
        counted: dict[str, dict[tuple[str, str], int]] = {data: {} for data in segments}
        if tests and segments:
            known = self._table(segments, "postings", POSTINGS).filter(reduce(Column.__or__, tests))
            for r in known.groupBy("segment", "field", "gram").agg(F.sum("n").alias("n")).collect():
                counted[r["segment"]][r["field"], r["gram"]] = r["n"]
        return counted

    def _lists(self, data: str, term: Term, counted: dict[tuple[str, str], int]) -> DataFrame | None:
        """(segment, file) of the rows of a segment that may hold a term; None where there are none."""
        text, wanted = term.text, _cut(term.text)
        if not all((term.field, g) in counted for g in wanted):
            return None
        postings = self._table([data], "postings", POSTINGS).filter(F.col("field") == term.field)
        if not wanted:
            return postings.filter(F.col("gram").startswith(text)).select("segment", "file")
        rarest = sorted(wanted, key=lambda g: (counted[term.field, g], g))[:LISTS]
        lists = [postings.filter(F.col("gram") == g).select("segment", "file", "block", F.col("rows").alias(f"rows{k}")) for k, g in enumerate(rarest)]
        met = lists[0].withColumnRenamed("rows0", "rows")
        for k, other in enumerate(lists[1:], 1):
            met = met.join(other, ["segment", "file", "block"]).withColumn("rows", F.array_intersect("rows", f"rows{k}")).drop(f"rows{k}").filter(F.size("rows") > 0)
        return met.select("segment", "file")

    def search(self, terms: Iterable[Term], test: Column) -> DataFrame:
        """The rows that pass ``test``, which must be false for those that hold none of the terms."""
        terms, segments = list(terms), self.segments()
        if not all(t.text for t in terms):
            return self._united([(data, self._rows(data).filter(test)) for data in segments])
        counted = self._counted(segments, terms)
        lists = [part for data in segments for t in terms if (part := self._lists(data, t, counted[data])) is not None]
        paths: dict[str, list[str]] = {data: [] for data in segments}
        if lists:
            held = reduce(DataFrame.unionByName, lists).distinct()
            for r in self._table(segments, "files", FILES).join(held, ["segment", "file"], "left_semi").select("segment", "path").collect():  # at most one a file
                paths[r["segment"]].append(r["path"])
        return self._united([(data, self._files(paths[data]).filter(test)) for data in segments])


def _cut(text: str) -> set[str]:
    """The three-letter strings of a text."""
    return {text[k : k + LETTERS] for k in range(len(text) - LETTERS + 1)}


def matching_formats(index: TextIndex, p: Parameters) -> DataFrame:
    """``view.matching`` over an index of ``mime_type`` and ``title``."""
    if not p.needles:
        return matching(index.rows(), p)
    return index.search([Term("mime_type", n) for n in p.needles] + [Term("title", "." + n, ends=True) for n in p.needles], predicate(p) & has_format(p.needles))


def named(index: TextIndex, query: str, field: str = "name") -> DataFrame:
    """``view.named`` over an index of names."""
    q = query.strip().lower()
    return index.search([Term(field, q)], F.lower(field).contains(q)) if q else index.rows()
