"""Exact removal of long repeated byte strings by merging shard Burrows-Wheeler transforms.

Every window of ``LENGTH`` bytes is filed under the smallest hash of its 100-byte strings, so equal windows
of any documents meet under the same anchor and need no others. Windows under anchors that occur once are
unique. The rest, cut out as snippets that hold the windows of one anchor, are indexed:

* A snippet is read as 50 interleaved strings whose symbols are its 50-byte strings, so the suffix at any byte
  is a suffix of one of them, and 200 bytes are four symbols.
* Shards of snippets sort their own suffixes and keep their Burrows-Wheeler transforms.
* The transforms are merged by refining an interleave: a pass over the merged order hands each shard number
  to the bucket of its next symbol, which sorts the order by one symbol more; where a bucket first splits
  is the common prefix of its neighbours. After four passes, unsplit buckets are the repeated intervals.
  No suffixes are compared or sorted again across shards.

The common prefixes that the refinement derives bound the repeated intervals: rows whose prefix with the one before is
all four symbols are one interval.

Equal snippets are one with a count, and long ones are cut at fixed places, so a text of one letter is one snippet with a
large count. An anchor with very many different snippets (a common passage in different surroundings) is filed again
under the smallest hash of 150 bytes. Where that is not enough, windows are compared without an index: a task settles those that
it holds twice, in place, and passes on each other window once, to be counted over all tasks. So no anchor's snippets outgrow
a task, and each step moves only what the one before could not hold. Long texts are read in slices.

Nulls are empty texts; texts under 200 bytes keep everything; repeated rows are repeats of each other.
Windows are compared by 64-bit hashes of their four quarters, or 128 bits of these. Equal ids with equal texts share a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.minhash import chunks, mixed
from halyard.llm.shared import discard, partitions, stored, trim_worker

LENGTH, GRAM, STEP = 200, 100, 50
#: Under what strings the snippets of a hot anchor are filed again, in turn, before their windows are compared one by one.
FINER = (150,)
U64 = np.uint64
#: An anchor with more different snippets than this, or more bytes of them, is hot.
MOST_KINDS, MOST_BYTES = 2048, 1 << 19
#: A snippet holds so many windows at most, and a text is read in slices of so many bytes.
MOST_WINDOWS, SLICE = 1 << 14, 1 << 21
SHARDS = 8
#: Snippet bytes that are indexed together; each takes some 100 bytes of memory meanwhile.
INDEXED_BYTES = 1 << 19
#: Snippet bytes whose windows are compared together in a task.
COMPARED_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each place."""
    n = len(data)
    if n < width:
        return np.zeros(0, U64)
    size = 1 << max(16, n.bit_length())
    up, down = _powers(size)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_letters()[data] * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[: n - width + 1]) * down[: n - width + 1])


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def anchored_runs(texts: list[bytes], gram: int = GRAM, most: int = MOST_WINDOWS) -> dict[str, np.ndarray]:
    """Runs of at most ``most`` neighbouring windows under one anchor, the smallest hash of their ``gram`` bytes: text number,
    anchor, first byte, windows, and at how many places of the run (or of the run that it was cut from, where it is its
    first part) the anchor's string stands."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = {k: np.zeros(0, np.int64) for k in ("text", "anchor", "begin", "windows", "places")}
    if len(data) < LENGTH:
        return none
    hashes = gram_hashes(data, gram)
    low = slide(hashes, LENGTH - gram + 1, np.minimum)
    ends = np.cumsum(lengths)
    number = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(len(low)) + LENGTH <= ends[number[: len(low)]]
    if not inside.any():
        return none
    number = number[: len(hashes)]
    changes = inside.copy()
    changes[1:] &= (low[1:] != low[:-1]) | ~inside[:-1] | (number[1 : len(low)] != number[: len(low) - 1])
    begin = np.flatnonzero(changes)
    # a run ends where the next begins or its text's last window stands
    last = np.minimum(np.append(begin[1:], len(low)), ends[number[begin]] - LENGTH + 1)
    # a place is chosen if its hash is the smallest of one window over it
    padded = np.zeros(len(low) + 2 * (LENGTH - gram), U64)
    padded[LENGTH - gram : LENGTH - gram + len(low)] = np.where(inside, low, U64(0))
    chosen = np.flatnonzero(slide(padded, LENGTH - gram + 1, np.maximum)[: len(hashes)] == hashes)
    value, own = hashes[chosen], number[chosen]
    heads = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])))
    places = np.diff(np.append(heads, len(chosen)))
    if len(places) != len(begin):
        raise AssertionError("runs and their anchors differ")
    parts = -(-(last - begin) // most)
    run = np.repeat(np.arange(len(begin)), parts)
    part = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    return {
        "text": number[begin][run],
        "anchor": low[begin][run].view(np.int64),
        "begin": (begin - (ends - lengths)[number[begin]])[run] + part * most,
        "windows": np.minimum((last - begin)[run] - part * most, most),
        "places": np.where(part == 0, places[run], 0),
    }


def sliced(texts: list[bytes], most: int | None = None) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, first byte, slice) of about ``most`` bytes. Slices of a text share 199 bytes, so each window
    is in one of them."""
    most = most or SLICE
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), most - LENGTH + 1):
            piece = text[at : at + most]
            if held and size + len(piece) > most:
                yield held
                held, size = [], 0
            held.append((k, at, piece))
            size += len(piece)
    if held:
        yield held


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers below 2^32, sixteen bits at a time."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    if len(keys) and keys.max() > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]), dtype=np.int32)
    return out


class ShardTransform:
    """A shard's suffixes in order of their first four symbols, and the symbol before each: 0 where a string
    begins. Places run over each snippet's bytes and one more; the last 50 are the ends of its strings."""

    def __init__(self, symbol: np.ndarray, live: np.ndarray, place: np.ndarray, first: int):
        """symbol: rank at each place, 0 at ends; live: bytes left from each place; place: offset in its snippet."""
        two = self._pairs(symbol, live, STEP)
        four = self._pairs(two, live, 2 * STEP)
        self.suffixes = stable_order(four)
        before = np.zeros(len(symbol), np.int32)
        before[STEP:] = symbol[:-STEP]
        self.transform = np.where(place >= STEP, before, 0)[self.suffixes]
        self.suffixes = (self.suffixes + first).astype(np.int32)

    @staticmethod
    def _pairs(key: np.ndarray, live: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(len(key), np.int32)
        after[:-step] = key[step:] if step < len(key) else 0
        return ranks(key.astype(np.int64) * (int(key.max(initial=0)) + 1) + np.where(live >= step, after, 0))


def merge_transforms(shards: list[ShardTransform], depth: int = LENGTH // STEP) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, common prefix with the one before in symbols, ``depth`` at most) of the merged order, sorted by ``depth``
    symbols. A pass in which a border between two rows is first drawn gives their common prefix."""
    turn = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.suffixes) for s in shards])
    transform = np.concatenate([s.transform for s in shards])
    bucket = np.zeros(len(turn), np.int32)
    prefix = np.full(len(turn), depth, np.uint8)
    row = np.arange(len(turn), dtype=np.int32)
    for passed in range(depth):
        symbol = transform[row]
        moved = stable_order(symbol)
        turn, symbol, bucket = turn[moved], symbol[moved], bucket[moved]
        # ends of strings (symbol 0) are all alike; a border once drawn stays, later passes refine between borders
        split = np.append(True, (symbol[1:] != symbol[:-1]) | ((bucket[1:] != bucket[:-1]) & (symbol[1:] > 0)))
        bucket = np.cumsum(split, dtype=np.int32) - 1
        np.minimum(prefix, passed, out=prefix, where=split)
        row[np.argsort(turn, kind="stable")] = np.arange(len(turn), dtype=np.int32)  # each shard's rows keep their order
    return np.concatenate([s.suffixes for s in shards])[row], prefix


def repeated_windows(snippets: list[bytes], counts: np.ndarray, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(snippet number, offset) of each window that occurs twice or more, snippets occurring ``counts`` times."""
    lengths = np.fromiter(map(len, snippets), np.int64, len(snippets))
    sizes = lengths + 1
    who = np.repeat(np.arange(len(snippets), dtype=np.int32), sizes)
    place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    live = lengths.astype(np.int32)[who] - place
    data = np.frombuffer(b"\x00".join(snippets) + b"\x00", np.uint8)
    hashes = np.zeros(len(place), U64)
    hashes[: max(0, len(data) - STEP + 1)] = gram_hashes(data, STEP)
    real = live >= STEP
    symbol = np.zeros(len(place), np.int32)
    symbol[real] = ranks(hashes[real])
    cuts = np.searchsorted(np.cumsum(sizes), np.linspace(0, int(sizes.sum()), shards + 1)[1:-1])
    edges = np.concatenate([[0], np.append(0, np.cumsum(sizes))[cuts], [len(place)]]).astype(np.int64)
    built = [ShardTransform(symbol[a:b], live[a:b], place[a:b], a) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    suffix, prefix = merge_transforms(built)
    # a repeated interval: rows that share all symbols with the row before
    interval = np.cumsum(prefix < LENGTH // STEP, dtype=np.int32) - 1
    whole = live[suffix] >= LENGTH
    times = np.bincount(interval, np.where(whole, counts[who[suffix]], 0))
    hit = np.sort(suffix[whole & (times[interval] >= 2)])
    return who[hit], place[hit]


def runs_of_starts(snippet: np.ndarray, start: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each snippet the first bytes and the bytes covered of its runs of neighbouring windows."""
    heads = np.flatnonzero(np.append(True, (snippet[1:] != snippet[:-1]) | (start[1:] != start[:-1] + 1))) if len(start) else np.zeros(0, np.int64)
    size = np.diff(np.append(heads, len(start))) + LENGTH - 1
    bounds = np.searchsorted(snippet[heads], np.arange(n + 1))
    return [start[heads[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], [size[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _find_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchored runs of each text, in a row a slice of it."""
    for batch in batches:
        for group in sliced(batch["data"].tolist()):
            rows, at, pieces = map(list, zip(*group, strict=True))
            found = anchored_runs(pieces)
            found["begin"] = found["begin"] + np.array(at, np.int64)[found["text"]]
            bounds = np.searchsorted(found["text"], np.arange(len(rows) + 1))
            cut = lambda name, kind: [found[name][a:b].astype(kind) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]  # noqa: B023, E731
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[rows].tolist(), "text_key": batch["text_key"].iloc[rows].tolist(), "anchor": cut("anchor", np.int64), "begin": cut("begin", np.int32), "windows": cut("windows", np.int32), "places": cut("places", np.int32)})
    trim_worker()


def _cut_snippets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc_id, key, data, runs in zip(batch["doc_id"], batch["text_key"], batch["data"], batch["runs"], strict=True):
            for run in runs:
                snippet = data[run["begin"] : run["begin"] + run["windows"] + LENGTH - 1]
                name = hashlib.blake2b(snippet, digest_size=16).digest()
                fresh = name not in seen
                if fresh:
                    size += len(snippet)
                    if len(seen) < 1 << 19:  # a larger memory saves bytes only; counts don't use it
                        seen.add(name)
                rows.append((doc_id, key, run["begin"], run["anchor"], name, snippet if fresh else None))
            if size > 1 << 24 or len(rows) > 1 << 16:
                yield pd.DataFrame(rows, columns=["doc_id", "text_key", "begin", "anchor", "snippet", "data"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "begin", "anchor", "snippet", "data"])
    seen.clear()
    trim_worker()


def _filed_again(gram: int):
    """The runs of snippets under anchors of ``gram`` bytes, as snippets of their own."""

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in chunks(batch["data"].tolist(), 1 << 19):
                own = batch.iloc[part]
                data = own["data"].tolist()
                found = anchored_runs(data, gram)
                text, begin, windows = found["text"], found["begin"], found["windows"]
                times = own["times"].to_numpy(np.int64)[text]
                inner = [data[t][a : a + n] for t, a, n in zip(text.tolist(), begin.tolist(), (windows + LENGTH - 1).tolist(), strict=True)]
                yield pd.DataFrame({"outer": own["snippet"].to_numpy(object)[text], "offset": begin.astype(np.int32), "anchor": found["anchor"], "snippet": [hashlib.blake2b(x, digest_size=16).digest() for x in inner], "data": inner, "times": times, "places": times * found["places"]})
        trim_worker()

    return file


def window_keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the window from each place, in two halves, made of the hashes of its quarters."""
    hashes = gram_hashes(data, STEP)
    n = max(0, len(data) - LENGTH + 1)
    halves = np.full(n, 0x9E3779B97F4A7C15, U64), np.full(n, 0xC2B2AE3D27D4EB4F, U64)
    for at in range(0, LENGTH, STEP):
        halves = tuple(mixed(half * U64(0xD1342543DE82EF95) + hashes[at : at + n]) for half in halves)
    return halves


def _compare_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For snippets that hold windows twice among those compared together, a row with the runs of these; for each different window
    a row with its key, and where it stands if it occurs once."""
    for batch in batches:
        for part in chunks(batch["data"].tolist(), COMPARED_BYTES):
            own = batch.iloc[part]
            lengths = own["data"].map(len).to_numpy(np.int64)
            names, ends = own["snippet"].to_numpy(object), np.cumsum(lengths)
            high, low = window_keys(np.frombuffer(b"".join(own["data"]), np.uint8))
            who = np.repeat(np.arange(len(own)), lengths)[: len(high)]
            at = np.flatnonzero(np.arange(len(high)) + LENGTH <= ends[who])
            at = at[np.lexsort((low[at], high[at]))]
            high, low, who = high[at].view(np.int64), low[at].view(np.int64), who[at]
            heads = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
            many = np.add.reduceat(own["times"].to_numpy(np.int64)[who], heads) > 1
            held = np.sort(at[np.repeat(many, np.diff(np.append(heads, len(at))))])
            holder = np.searchsorted(ends, held, "right")
            starts, sizes = runs_of_starts(holder, held - (ends - lengths)[holder], len(own))
            some = [k for k, x in enumerate(starts) if len(x)]
            if some:
                yield pd.DataFrame({"snippet": names[some], "starts": [starts[k] for k in some], "sizes": [sizes[k] for k in some], "high": None, "low": None, "place": None})
            place = pd.array(at[heads] - (ends - lengths)[who[heads]], "Int32")
            place[many] = pd.NA
            yield pd.DataFrame({"snippet": np.where(many, None, names[who[heads]]), "starts": None, "sizes": None, "high": high[heads], "low": low[heads], "place": place})
    trim_worker()


def _join_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spans = [merged_spans((r["starts"], r["starts"] + r["sizes"]) for r in runs) for runs in batch["runs"]]
        yield pd.DataFrame({"snippet": batch["snippet"], "starts": [[a for a, _ in x] for x in spans], "sizes": [[b - a for a, b in x] for x in spans]})


def repeats_by_window(snippets: DataFrame) -> DataFrame:
    """snippet, starts, sizes: the runs of repeated bytes in ``snippets(snippet, data, times)``, however many share a string.
    A window that many hold is a row a task and not a row a snippet; the text of none is moved."""
    found = stored(snippets.mapInPandas(_compare_windows, "snippet binary, starts array<int>, sizes array<int>, high long, low long, place int"), "compared-windows")
    # who holds a window once in a task learns here whether another task has it too
    once = F.when(F.col("place").isNotNull(), F.struct("snippet", "place"))
    shared = found.filter("high IS NOT NULL").groupBy("high", "low").agg(F.sum(F.when(once.isNull(), 2).otherwise(1)).alias("times"), F.collect_list(once).alias("holders"))
    shared = shared.filter("times > 1").select(F.explode("holders").alias("r")).groupBy("r.snippet").agg(F.collect_list("r.place").alias("starts"))
    shared = shared.select("snippet", "starts", F.transform("starts", lambda _: F.lit(LENGTH)).alias("sizes"))
    runs = found.filter("high IS NULL").select("snippet", "starts", "sizes").unionByName(shared).select("snippet", F.arrays_zip("starts", "sizes").alias("runs"))
    return runs.groupBy("snippet").agg(F.flatten(F.collect_list("runs")).alias("runs")).mapInPandas(_join_runs, "snippet binary, starts array<int>, sizes array<int>")


def _merge_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor: whole anchors are indexed together, half a megabyte at a time."""
    held: list[pd.DataFrame] = []
    size = 0

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        who, start = repeated_windows(rows["data"].tolist(), rows["times"].to_numpy(np.int64))
        starts, sizes = runs_of_starts(who, start, len(rows))
        out = pd.DataFrame({"snippet": rows["snippet"].tolist(), "starts": starts, "sizes": sizes})
        return out[out["starts"].map(len) > 0]

    for batch in batches:
        at = 0
        while at < len(batch):
            piece = batch.iloc[at : at + 1024]
            at += len(piece)
            held.append(piece)
            size += int(piece["data"].map(len).sum())
            if size > INDEXED_BYTES:
                rows = pd.concat(held)
                last = rows["anchor"].to_numpy() == rows["anchor"].iloc[-1]
                if not last.all():
                    yield index(rows[~last])
                held = [rows[last]]
                size = int(held[0]["data"].map(len).sum())
    if held:
        rows = pd.concat(held)
        if len(rows):
            yield index(rows)
    held.clear()
    trim_worker()


def merged_spans(runs) -> list[tuple[int, int]]:
    """Sorted disjoint (begin, end) of what the runs cover; touching ones are one."""
    out: list[list[int]] = []
    for begin, end in sorted(runs):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def repeats_within(kinds: DataFrame, finer: tuple[int, ...]) -> DataFrame:
    """snippet, starts, sizes: the runs of repeated bytes in the snippets of ``kinds(anchor, snippet, times, data)``, a row a
    snippet that has any. Calm anchors are indexed; the snippets of hot ones are filed under the next of ``finer`` and come back
    here, or have their windows compared after the last."""
    hot = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.octet_length("data")).alias("bytes"))
    hot = stored(hot.filter((F.col("kinds") > MOST_KINDS) | ((F.col("kinds") > 1) & (F.col("bytes") > MOST_BYTES))).select("anchor"), "hot-anchors")
    again = hot.limit(1).count() > 0
    calm = kinds.join(hot, "anchor", "left_anti") if again else kinds
    found = calm.repartition(partitions(kinds.sparkSession), "anchor").sortWithinPartitions("anchor").mapInPandas(_merge_groups, "snippet binary, starts array<int>, sizes array<int>")
    if not again:
        return found
    crowded = kinds.join(hot, "anchor", "left_semi").select("snippet", "data", "times")
    if not finer:
        return found.unionByName(repeats_by_window(crowded))
    kind = "outer binary, offset int, anchor long, snippet binary, data binary, times long, places long"
    filed = stored(crowded.mapInPandas(_filed_again(finer[0]), kind), "filed-again")
    common = filed.groupBy("anchor").agg(F.sum("places").alias("places")).filter("places > 1").select("anchor")
    inner = filed.join(common, "anchor", "left_semi").groupBy("anchor", "snippet").agg(F.sum("times").alias("times"), F.first("data").alias("data"))
    inner = repeats_within(stored(inner, "finer-snippets"), finer[1:])
    back = filed.select("outer", "offset", "snippet").join(inner, "snippet")
    back = back.select("outer", F.arrays_zip(F.transform("starts", lambda x: x + F.col("offset")).alias("starts"), "sizes").alias("runs"))
    # a row a snippet again, so that many copies of one do not multiply its runs
    back = back.groupBy(F.col("outer").alias("snippet")).agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return found.unionByName(back.select("snippet", "runs.starts", "runs.sizes"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, spans of the documents that hold repeats: array of (begin, end) bytes, disjoint
    and sorted. ``text_key`` is a hash of the text that tells rows of one id apart; rows equal in both share their spans."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    keyed = docs.select("doc_id", F.xxhash64(data).alias("text_key"), data.alias("data"))
    kind = "doc_id long, text_key long, anchor array<long>, begin array<int>, windows array<int>, places array<int>"
    runs = stored(keyed.filter(F.octet_length("data") >= LENGTH).mapInPandas(_find_runs, kind), "anchored-runs")
    one = runs.select("doc_id", "text_key", F.explode(F.arrays_zip("anchor", "begin", "windows", "places")).alias("r")).select("doc_id", "text_key", "r.*")
    common = one.groupBy("anchor").agg(F.sum("places").alias("times")).filter(F.col("times") > 1).select("anchor")
    hits = one.join(common, "anchor").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "windows", "anchor")).alias("runs"))
    k, h = keyed.alias("k"), hits.alias("h")
    same = F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("k.text_key") == F.col("h.text_key"))
    cut = k.join(h, same).select("k.doc_id", "k.text_key", "k.data", "h.runs").mapInPandas(_cut_snippets, "doc_id long, text_key long, begin int, anchor long, snippet binary, data binary")
    cut = stored(cut, "snippets")
    discard(runs)

    kinds = cut.groupBy("anchor", "snippet").agg(F.count(F.lit(1)).alias("times"), F.first("data", True).alias("data"))
    covers = repeats_within(stored(kinds, "distinct-snippets"), FINER)
    spans = cut.select("doc_id", "text_key", "begin", "snippet").join(covers, "snippet")
    grouped = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("begin", "starts", "sizes")).alias("parts"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = []
            for parts in batch["parts"]:
                runs = ((p["begin"] + a, p["begin"] + a + n) for p in parts for a, n in zip(p["starts"], p["sizes"], strict=True))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in merged_spans(runs)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "spans": spans})

    return stored(grouped.mapInPandas(settle, "doc_id long, text_key long, spans array<struct<begin:int,end:int>>"), "spans")


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")).cast("binary"))
    return docs.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (key == F.col("s.text_key")), "left")


def kept_bytes(data: bytes, spans) -> bytes:
    at, out = 0, []
    for s in spans if spans is not None else ():
        out.append(data[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, data[at:]])


def repeat_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = [kept_bytes(d, s) for d, s in zip(batch["data"], batch["spans"], strict=True)]
            n = batch["data"].map(len)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": n, "n_removed": n - [len(x) for x in kept], "n_spans": [0 if s is None else len(s) for s in batch["spans"]], "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]})

    joined = _with_spans(docs.select("doc_id", "text"), repeated_spans(docs))
    data = F.coalesce("d.text", F.lit("")).cast("binary").alias("data")
    return joined.select("d.doc_id", data, "s.spans").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated bytes, all columns and rows kept. A character of which a part
    goes, goes whole, so texts stay valid. A column ``n_chars`` follows the text."""

    def cut(data: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(d, s).decode("utf-8", "ignore") if d is not None else None for d, s in zip(data, spans, strict=True)], dtype="object")

    shorter = F.pandas_udf(cut, "string")
    names = docs.columns
    joined = _with_spans(docs, repeated_spans(docs))
    text = F.when(F.col("s.spans").isNotNull(), shorter(F.col("d.text").cast("binary"), F.col("s.spans"))).otherwise(F.col("d.text"))
    out = joined.select(*[text.alias(c) if c == "text" else F.col(f"d.`{c}`") for c in names])
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in names else out
