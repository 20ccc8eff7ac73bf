"""Line deduplication in DataFrame operations alone: every repeated line stays in the first document that holds it.

A line's key is the line without white space at its ends, A to Z lower-cased. Keys of ``least`` code points or more
are hashed to 128 bits, and the hashes, with document and position, are dealt out by range and sorted within each range,
so all lines of a key lie side by side in the order of their documents, however many ranges a hot key fills. One
pass over a range streams the first document of each key; a key that goes on from an earlier range takes its
first document from the ranges' ends, a row each. What comes back of a document is a bitmap of its kept lines, never text:
words of 64 lines, of which only those are listed that lose a line.

Documents are told apart by doc_id; rows that share one are one document here, and each of them keeps its own lines.
A null doc_id comes after all others. Null texts are empty texts, and an empty text is one empty line. Lines of equal
128-bit hashes count as equal. Long texts are arrays of lines, up to what one row may hold. Empty tables give no rows;
other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.shared import partitions, stored

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line stripped and lower-cased; letters beyond A to Z stay as they are."""
    bare = F.btrim(line, F.lit(BLANK))
    plain = F.octet_length(bare) == F.char_length(bare)  # ASCII alone has a fast way
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def sorted_lines(docs: DataFrame, least: int) -> DataFrame:
    """part, h1, h2, doc_id, mark, pos of every line whose key is long enough, stored in order of (hash, document,
    position): ``part`` numbers the ranges."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.transform(lines_of(F.col("text")), key_of)).alias("pos", "key"))
    hashed = marked.filter(F.char_length("key") >= least).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(least), "key").alias("h2"), "doc_id", "mark", "pos")
    order = _order()
    dealt = hashed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("part", F.spark_partition_id()), "lines")


def _order() -> list[Column]:
    return [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("pos")]


def carried(lines: DataFrame) -> DataFrame:
    """part, h1, h2, first: of each range that begins inside a key's run, that key and its first document."""
    key = F.struct("h1", "h2")
    # the first document of the last key: the greatest key and, under it, the smallest id, null the greatest
    back = F.struct("h1", "h2", F.col("doc_id").isNotNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))))
    ends = lines.groupBy("part").agg(F.min(key).alias("head"), F.max(key).alias("tail"), F.max_by(F.struct("doc_id"), back).alias("own"))
    # one row a range from here on
    w = Window.orderBy("part")
    goes_on = F.coalesce(F.lag("tail").over(w) == F.col("head"), F.lit(False))
    ends = ends.withColumn("goes_on", goes_on)
    # a range that is one key's alone passes on what it was given
    known = F.when(F.col("goes_on") & (F.col("head") == F.col("tail")), F.lit(None)).otherwise(F.col("own"))
    ends = ends.withColumn("at_end", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ends.withColumn("first", F.lag("at_end").over(w)).filter("goes_on").select("part", F.col("head.h1").alias("h1"), F.col("head.h2").alias("h2"), "first")


def repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, mark, pos of every line whose key an earlier document holds; ``mark`` is the hash of the row's text."""
    lines = sorted_lines(docs, least)
    w = Window.partitionBy("part").orderBy(*_order())
    before = F.lag(F.struct("h1", "h2")).over(w)
    begins = before.isNull() | (before != F.struct("h1", "h2"))
    first = F.last(F.when(begins, F.struct("doc_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    streamed = lines.repartition(partitions(docs.sparkSession), "part").withColumn("first", first).alias("l")
    given = F.broadcast(carried(lines)).alias("c")  # a row a range at most
    met = streamed.join(given, (F.col("l.part") == F.col("c.part")) & (F.col("l.h1") == F.col("c.h1")) & (F.col("l.h2") == F.col("c.h2")), "left")
    first = F.coalesce("c.first", "l.first")
    return met.filter(~F.col("l.doc_id").eqNullSafe(first["doc_id"])).select("l.doc_id", "l.mark", "l.pos")


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, mark, words of the documents that lose a line: ``words`` lists (word, kept), 64 lines each, the bit of a
    line set if it is kept; words that are not listed keep all their lines. Equal rows are one."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % WORD).cast("int"))
    gone = repeated_lines(docs, least).groupBy("doc_id", "mark", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("kept")))).alias("words"))


def with_kept(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text)`` with ``lines`` and ``kept_lines``, arrays: texts move once."""
    marked = docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text")).alias("d")
    b = bitmaps.alias("b")
    both = marked.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.mark") == F.col("b.mark")), "left")
    lines = both.select("d.doc_id", "d.text", lines_of(F.col("d.text")).alias("lines"), F.map_from_entries("b.words").alias("kept"))
    n_words = F.floor((F.size("lines") - 1) / WORD).cast("int")
    # one long a word, so that each line is one look at an array
    dense = F.when(F.col("kept").isNotNull(), F.transform(F.sequence(F.lit(0), n_words), lambda w: F.coalesce(F.try_element_at("kept", w), F.lit(-1).cast("long"))))
    lines = lines.withColumn("dense", dense)
    bit = lambda i: F.getbit(F.get("dense", F.floor(i / WORD).cast("int")), i % WORD)
    kept = F.when(F.col("dense").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: bit(i) == 1))
    return lines.select("doc_id", "text", "lines", kept.alias("kept_lines"))


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, text with the repeated lines gone; a document that loses them all is an empty text, a null text stays null."""
    out = with_kept(docs, keep_bitmaps(docs, least))
    return out.select("doc_id", F.when(F.col("text").isNotNull(), F.array_join("kept_lines", "\n")).alias("text"))


def line_digest(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs(doc_id, text)``."""
    bitmaps = stored(keep_bitmaps(docs, least), "bitmaps")
    out = with_kept(docs, bitmaps)
    n = F.size("lines").cast("long")
    return out.select("doc_id", n.alias("n_lines"), (n - F.size("kept_lines")).alias("n_dropped"), F.sha2(F.encode(F.array_join("kept_lines", "\n"), "utf-8"), 256).alias("kept_sha256"))
