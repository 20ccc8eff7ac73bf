"""A table as a base and a log of changes: a change costs what it changes.

Each change is appended as rows of its own, (id, kind, names of the supplied columns, their values), and takes its place in
the order of changes by one atomic claim. Reading folds the log into the base: of each column the last change that
supplied it wins, null apart from absent. A compaction writes the folded table as the next version of the base and says up to
which change it goes, so changes that are appended meanwhile are still folded.

Kinds: ``put`` inserts or replaces supplied columns, ``set`` only touches rows that exist, ``gone`` removes rows, and
``clear`` removes all rows, which is a claim alone. An id that repeats within a change has its greatest row, as in ``upsert``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from halyard.schema import ASSET_DEFAULTS
from halyard.sources.catalog import VersionedTable, _path, claim


class ChangeLog:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, defaults: dict | None = None):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.defaults = ASSET_DEFAULTS if defaults is None else defaults
        self.base = VersionedTable(spark, f"{self.folder}/base", schema)
        self.columns = [f.name for f in schema.fields if f.name != "id"]
        rows = StructType.fromDDL("id string, kind string, names array<string>")
        for f in schema.fields:
            if f.name != "id":
                rows = rows.add(f.name, f.dataType)
        self.log_schema = rows

    # appending

    def put(self, rows: DataFrame, supplied: list[str] | None = None) -> int:
        """Rows inserted, or their supplied columns replaced: the place of the change."""
        return self._append(rows, "put", supplied)

    def set(self, rows: DataFrame, supplied: list[str] | None = None) -> int:
        """Supplied columns of rows that exist; unknown ids do nothing."""
        return self._append(rows, "set", supplied)

    def set_size(self, id_: str, size: int | None) -> int:
        return self.set(self.spark.createDataFrame([(id_, size)], "id string, size_bytes long"))

    def remove(self, ids: DataFrame) -> int:
        return self._append(ids.select("id"), "gone", [])

    def clear(self) -> int:
        return self._claim("clear")

    def _append(self, rows: DataFrame, kind: str, supplied: list[str] | None) -> int:
        supplied = [c for c in (rows.columns if supplied is None else supplied) if c in self.columns]
        kinds = {f.name: f.dataType for f in self.schema.fields}
        values = F.struct(*[F.col(c).cast(kinds[c]).alias(c) for c in supplied]) if supplied else F.lit(True)
        last = rows.groupBy("id").agg(F.max(values).alias("__v"))
        out = [F.col(f"__v.{c}") if c in supplied else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns]
        name = uuid.uuid4().hex
        last.select("id", F.lit(kind).alias("kind"), F.array(*[F.lit(c) for c in supplied]).cast("array<string>").alias("names"), *out).write.parquet(f"{self.folder}/log/{name}")
        return self._claim(f"rows {name}")

    def _claim(self, content: str) -> int:
        path, fs = _path(self.spark, f"{self.folder}/order")
        fs.mkdirs(path)
        while True:
            number = max(self._numbers(), default=0) + 1
            if claim(self.spark, f"{self.folder}/order/c{number:012d}", content):
                return number

    # reading

    def _numbers(self) -> list[int]:
        path, fs = _path(self.spark, f"{self.folder}/order")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[1:]) for n in names if n.startswith("c"))

    def _entries(self) -> tuple[int, int, list[tuple[int, str]], int]:
        """(version of the base, the change it goes up to, [(place, folder of rows)] since the last clearing, last place)."""
        numbers = self._numbers()
        if not numbers:
            return 0, 0, [], 0
        told = {r["n"]: r["value"] for r in self.spark.read.text([f"{self.folder}/order/c{n:012d}" for n in numbers]).select(F.regexp_extract(F.col("_metadata.file_name"), r"c(\d+)", 1).cast("long").alias("n"), "value").collect()}
        version, upto = max(((int(w[1]), int(w[2])) for v in told.values() if (w := v.split())[0] == "base"), key=lambda b: b[1], default=(0, 0))
        cleared = max((n for n, v in told.items() if v == "clear" and n > upto), default=0)
        if cleared:
            version, upto = 0, cleared
        return version, upto, [(n, v.split()[1]) for n, v in sorted(told.items()) if n > upto and v.startswith("rows ")], numbers[-1]

    def _logged(self, entries: list[tuple[int, str]]) -> DataFrame:
        rows = self.spark.read.schema(self.log_schema).parquet(*[f"{self.folder}/log/{name}" for _, name in entries])
        places = self.spark.createDataFrame(entries, "seq long, __name string")  # a row a change since the compaction
        return rows.withColumn("__name", F.regexp_extract(F.col("_metadata.file_path"), "/log/([0-9a-f]+)/", 1)).join(F.broadcast(places), "__name").drop("__name")

    def read(self) -> DataFrame:
        version, _, entries, _ = self._entries()
        base = self.base.at(version)
        return folded(base, self._logged(entries), self.defaults) if entries else base

    # compaction

    def compact(self) -> int:
        """Folds the changes so far into the next version of the base; those that come meanwhile stay in the log."""
        version, _, entries, last = self._entries()
        base = self.base.at(version)
        rows = folded(base, self._logged(entries), self.defaults) if entries else base
        made = self.base.change(lambda _: rows).version
        return self._claim(f"base {made} {last}")

    def waiting(self) -> int:
        """Changes that the next reading has to fold."""
        return len(self._entries()[2])


def folded(base: DataFrame, log: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``base`` after the changes of ``log(id, kind, names, columns, seq)``, one row an id and change.

    A removal voids what came before it; a ``set`` counts where the row exists at its place: from the base on, or from the first
    ``put`` after a removal. The base is joined with one row a changed id, which adaptive execution broadcasts while they are
    few, so a short log does not shuffle the base."""
    defaults = defaults or {}
    columns = [f for f in base.schema.fields if f.name != "id"]
    mine = Window.partitionBy("id")
    known = base.join(log.select("id").distinct(), "id", "left_semi").select("id", F.lit(True).alias("__known"))
    rows = log.join(known, "id", "left").withColumn("__gone", F.max(F.when(F.col("kind") == "gone", F.col("seq"))).over(mine))
    rows = rows.filter(F.col("__gone").isNull() | (F.col("seq") >= F.col("__gone")))
    first_put = F.min(F.when(F.col("kind") == "put", F.col("seq"))).over(mine)
    stays = F.col("__known").isNotNull() & F.col("__gone").isNull()
    rows = rows.withColumn("__from", F.when(stays, F.lit(0)).otherwise(first_put))
    last = [F.max_by(F.struct(F.col(f.name).alias("v")), F.when((F.col("kind") != "gone") & (F.col("seq") >= F.col("__from")) & F.array_contains("names", f.name), F.col("seq"))).alias(f"__{f.name}") for f in columns]
    news = rows.groupBy("id").agg(F.first(stays).alias("__stays"), F.first("__from").isNotNull().alias("__lives"), *last)

    def value(f, old):
        return F.when(F.col(f"__{f.name}").isNotNull(), F.col(f"__{f.name}.v")).otherwise(old).cast(f.dataType).alias(f.name)

    kept = base.join(news, "id", "left").filter(F.coalesce("__stays", F.lit(True)))
    kept = kept.select("id", *[value(f, F.col(f.name)) for f in columns])
    made = news.filter(~F.col("__stays") & F.col("__lives")).select("id", *[value(f, F.lit(defaults.get(f.name))) for f in columns])
    return kept.unionByName(made)
