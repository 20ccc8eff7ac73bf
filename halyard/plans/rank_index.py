"""A stored view: its rows in order, in files with a count and fence keys each.

A view is sorted and written once a version of its table. Of every file the index keeps how many rows come before it, how
many it holds, and its first key, so a page, a run or an entry's place is found from one row a file and read from the
files that hold it; a row's place is its file's count before it and its row number in the file. Nothing is sorted again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.plans.view import Parameters, matching, order_of
from halyard.scratch import scratch_path
from halyard.sources.catalog import VersionedTable, _path, claim

FENCES = "path string, before long, n long, first struct<value: long, id: string>"


@dataclass(frozen=True)
class RankIndex:
    """The index of one view, below ``folder``: ``rows`` and ``fences``."""

    spark: SparkSession
    folder: str
    p: Parameters
    schema: StructType

    @staticmethod
    def built(assets: DataFrame, p: Parameters, folder: str | None = None, rows_per_file: int | None = None) -> RankIndex:
        """Sorts and writes the view of ``assets`` by ``p``, a file a range, or several of ``rows_per_file`` rows."""
        spark = assets.sparkSession
        index = RankIndex(spark, folder or scratch_path(spark, "rank-index"), p, assets.schema)
        order = order_of(p)
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        writer = matching(assets, p).repartitionByRange(parts, *order).sortWithinPartitions(*order).write
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.parquet(f"{index.folder}/rows")
        # a file's part and number in its name are its place among the files
        stored = spark.read.schema(assets.schema).parquet(f"{index.folder}/rows")
        path = F.col("_metadata.file_path")
        per = stored.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col(p.order).cast("long").alias("value"), "id"), F.col("_metadata.row_index")).alias("first"))
        w = Window.orderBy(_file_order(F.col("path"))).rowsBetween(Window.unboundedPreceding, -1)
        fences = per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))  # one row a file
        fences.select("path", "before", "n", "first").coalesce(1).write.parquet(f"{index.folder}/fences")
        return index

    @staticmethod
    def of(table: VersionedTable, p: Parameters, folder: str) -> RankIndex:
        """The index of a table's newest version, built if nobody has yet. Who builds it at the same time as another writes a
        folder of his own; the first to finish is the one that all read."""
        version = max(table.versions(), default=0)
        key = hashlib.sha256(repr(p).encode()).hexdigest()[:16]
        done = f"{folder.rstrip('/')}/v{version:08d}-{key}"
        path, fs = _path(table.spark, done)
        if not fs.exists(path):
            own = f"{folder.rstrip('/')}/{hashlib.sha256(scratch_path(table.spark, 'x').encode()).hexdigest()[:16]}"
            RankIndex.built(table.at(version), p, own)
            if claim(table.spark, done, own):
                return RankIndex(table.spark, own, p, table.schema)
            where, _ = _path(table.spark, own)
            fs.delete(where, True)
        return RankIndex(table.spark, table.spark.read.text(done).first()[0], p, table.schema)

    def fences(self) -> DataFrame:
        return self.spark.read.schema(FENCES).parquet(f"{self.folder}/fences")

    def count(self) -> int:
        return self.fences().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def placed(self) -> DataFrame:
        """All rows with their ``position``, unsorted: a count a file is broadcast."""
        return self._read(self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows"), self.fences())

    def run(self, first: int, last: int) -> DataFrame:
        """The rows at places ``first`` to ``last``, with their position, from the files that hold them."""
        some = self.fences().filter((F.col("before") <= last) & (F.col("before") + F.col("n") > first))
        rows = self._files(some)
        return rows.filter(F.col("position").between(first, last))

    def page(self, offset: int, limit: int) -> DataFrame:
        """A page in the view's order: only its own rows are sorted."""
        return self.run(offset, offset + limit - 1).orderBy("position")

    def place(self, value: int | None, id_: str) -> int | None:
        """The place of the entry with this order value and id, or None: one file is looked at."""
        key = F.struct(F.lit(value).cast("long").alias("value"), F.lit(id_).alias("id"))
        # the last file whose first key is not behind the entry's
        some = self.fences().filter(~_behind(F.col("first"), key, self.p.ascending)).orderBy(F.col("before").desc()).limit(1)
        found = self._files(some).filter(F.col("id") == id_).select("position").first()
        return found["position"] if found else None

    def places(self, ids: DataFrame) -> DataFrame:
        """id, position, type of the wanted ids that the view holds."""
        return self.placed().join(ids.select("id").distinct(), "id", "left_semi").select("id", "position", "type")

    def files(self, first: int, last: int) -> list[str]:
        """The files that hold these places."""
        return [r["path"] for r in self.fences().filter((F.col("before") <= last) & (F.col("before") + F.col("n") > first)).collect()]

    def _files(self, some: DataFrame) -> DataFrame:
        known = some.select("path", "before").collect()  # the files that hold what is asked for
        if not known:
            return self.spark.createDataFrame([], StructType([*self.schema.fields]).add("position", "long"))
        return self._read(self.spark.read.schema(self.schema).parquet(*[r["path"] for r in known]), self.spark.createDataFrame(known, "path string, before long"))

    def _read(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        columns = rows.columns
        rows = rows.withColumns({"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        return rows.join(F.broadcast(before.select(F.col("path").alias("__path"), "before")), "__path").select(*columns, (F.col("before") + F.col("__row")).alias("position"))


def _file_order(path: Column) -> Column:
    """part-00012-uuid-c003.parquet comes after part-00012-uuid-c002.parquet and before part-00013."""
    number = lambda pattern: F.regexp_extract(path, pattern, 1).cast("long")
    return F.struct(number(r"part-(\d+)-"), number(r"-c(\d+)[^/]*$"))


def _behind(a: Column, b: Column, ascending: bool) -> Column:
    """Whether key ``a`` (value, id) comes after ``b`` in the view's order: unknown values are the smallest."""
    less = F.when(a["value"].isNull(), b["value"].isNotNull()).otherwise(F.coalesce(a["value"] < b["value"], F.lit(False)))
    more = F.when(b["value"].isNull(), a["value"].isNotNull()).otherwise(F.coalesce(a["value"] > b["value"], F.lit(False)))
    return (more if ascending else less) | (a["value"].eqNullSafe(b["value"]) & (a["id"] > b["id"]))
