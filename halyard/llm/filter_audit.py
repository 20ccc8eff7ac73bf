"""How document filters interact: what each removes in every order, part by part.

Five filters judge a text (null as empty). A to D look at the text alone: too few words, too few different words, too
many capitals, odd signs. E fails a text that a smaller doc_id holds too, anywhere in the table, removed or not.

Rows are dealt out by range of (text fingerprint, doc_id) and sorted by (fingerprint, full text, doc_id); each compares itself
with its predecessor, and the first row of a run of equal texts is the one that passes E. A run may fill many ranges:
each range tells its first and last run, a row each, and rows at a range's head are decided from what the ranges before
them ended with. Fingerprints are SHA-256, so texts move once and range bounds are drawn from 40 bytes a row.

A text's failures are a mask of five bits. Masks are counted a part, which adds up, and all 120 orders follow from
a part's 32 counters: a filter removes those masks that hold its bit and none of a filter before it.

A null doc_id is larger than all others; rows that share an id and a text do not fail each other. A document has a
label if any row of ``labels`` with its id says so. A null source is the part of the empty string. Words are runs of other
bytes than ASCII white space, of texts of any length. A part without failures has zeros; an empty table has no rows.
Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.shared import partitions, stored, trim_worker

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
CONTINUED = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point

JUDGED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("range", pa.int32()), ("undecided", pa.bool_()), ("head", pa.binary()), ("tail", pa.binary()), ("tail_doc", pa.int64())])
JUDGED_SQL = "doc_id long, part string, mask int, range int, undecided boolean, head binary, tail binary, tail_doc long"


def text_mask(data: bytes) -> int:
    """The bits of A to D that a text in UTF-8 fails."""
    words = data.split()  # at runs of the six ASCII white spaces
    points = len(data) - (0 if data.isascii() else len(data) - len(data.translate(None, CONTINUED)))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    failed = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * points, len(data.translate(None, SIGNS)) < len(data))
    return sum(1 << k for k, f in enumerate(failed) if f)


def judge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sorted (doc_id, part, text): a row a document and, last, one that tells the range's ends. Documents whose E
    hangs on earlier ranges are undecided: those of the first run that share its smallest doc_id."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    text = first = head = None  # the run's text, its first document, and the first run's text
    at_head, mask = True, 0
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for doc, part, value in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text"), strict=True):
            data = value.as_buffer()
            data = bytes(data) if data is not None else b""
            if data != text:
                at_head = text is None
                text, first, mask = data, doc, text_mask(data)
                head = data if at_head else head
            repeated = doc != first
            for column, x in zip(columns, (doc, part, mask | DUPLICATE if repeated else mask, at_head and not repeated), strict=True):
                column.append(x)
        n = len(columns[0])
        empty = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array([number] * n, pa.int32()), pa.array(columns[3], pa.bool_()), empty, empty, pa.nulls(n, pa.int64())], schema=JUDGED)
    if text is not None:
        ends = [[None], [None], [None], [number], [None], [hashlib.sha256(head).digest()], [hashlib.sha256(text).digest()], [first]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(ends, JUDGED, strict=True)], schema=JUDGED)
    trim_worker()


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of ``docs(doc_id, text, source)``."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("print", F.unhex(F.sha2("text", 256)))
    by = F.col("doc_id").asc_nulls_last()
    lined = rows.repartitionByRange(partitions(docs.sparkSession), F.col("print"), by).sortWithinPartitions("print", "text", by)
    told = stored(lined.select("doc_id", "part", "text").mapInArrow(judge_range, JUDGED_SQL), "judged")

    # one row a range: the first document of the run that it ends with, which earlier ranges may have begun
    w = Window.orderBy("range")
    ends = told.filter("head is not null").select("range", "head", "tail", F.struct("tail_doc").alias("own"))
    ends = ends.withColumn("goes_on", F.coalesce(F.lag("tail").over(w) == F.col("head"), F.lit(False)))
    known = F.when(F.col("goes_on") & (F.col("head") == F.col("tail")), F.lit(None)).otherwise(F.col("own"))
    ends = ends.withColumn("at_end", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    given = ends.withColumn("first", F.lag("at_end").over(w)).filter("goes_on").select("range", F.lit(True).alias("undecided"), "first")

    out = told.filter("head is null").join(F.broadcast(given), ["range", "undecided"], "left")
    repeated = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first.tail_doc"))
    return out.select("doc_id", "part", F.when(repeated, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask, and how many of them are labelled so. Sums of parts of a
    table are the counters of the whole."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(said("quality"), said("toxic"))
    both = masks.join(known, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic"))


def in_all_orders(counted: DataFrame) -> DataFrame:
    """The audit's rows of each part: 120 orders of five steps, from the part's counters alone."""
    masks = range(1 << len(FILTERS))
    kinds = ("n", "good", "toxic")
    held = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in masks]).alias(c) for c in kinds]
    parts = counted.groupBy("part").agg(*held)
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    rows = parts.select("part", *kinds, orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("mine", bits(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", bits(F.substr("filter_order", F.lit(1), F.col("step") - 1)))

    def total(of: str, test) -> Column:
        """Sum of a counter over the masks that meet ``test``."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(test(m), F.get(of, m)).otherwise(F.lit(0).cast("long")))

    has = lambda m: m.bitwiseAND(F.col("mine")) != 0
    clean = lambda m: m.bitwiseAND(F.col("before")) == 0
    # a mask of k bits is removed by each of them in 120 / k of the orders
    share = F.aggregate(F.sequence(F.lit(0), F.lit(len(masks) - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(has(m), F.get("n", m) * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(F.col("before").bitwiseOR(F.col("mine"))) == 0).alias("kept"),
        total("n", lambda m: has(m) & clean(m)).alias("removed"),
        total("n", lambda m: has(m) & ~clean(m)).alias("redundant"),
        F.get("n", F.col("mine")).alias("unique_fails"),
        total("good", lambda m: has(m) & clean(m)).alias("good_lost"),
        total("toxic", lambda m: has(m) & clean(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of ``docs(doc_id, text,
    source)`` and ``labels(doc_id, quality, toxic)``: 600 rows a part."""
    return in_all_orders(counters(judged(docs), labels))
