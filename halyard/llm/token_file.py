"""Token-ID output: patched frame-of-reference files.

A file holds one stream of ids cut into blocks of 1024. Each block subtracts its minimum and packs
the remainders at the width that a given percentile of them needs. Remainders that need more bits
leave their high part in the block's exception list. Two indexes follow the blocks: the byte at which
each block starts, and the id at which each document starts.

    header     magic, then u32 block size
    blocks     u32 minimum, u8 width, 3 pad bytes, u32 exceptions,
               32 * width u32 words (value s of lane l at bit s * width of lane l's words),
               exceptions as u16 positions then u32 high parts
    documents  i64 doc_id, u64 start, in order
    index      u64 byte offset of each block
    footer     u64 ids, u64 documents, u64 blocks, u64 offset of documents, u64 offset of index, magic

Nulls are empty texts, an empty text holds only the end id, equal doc_ids keep one entry a row. A null doc_id is
written as the smallest number and read as null.
Texts of any length are split into blocks without holding more than a batch.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.shared import open_fs, partitions, scratch_path, stored

MAGIC = b"PFORids1"
NO_ID = -(1 << 63)  # stands for a null doc_id, which comes first
LANES = STEPS = 32
BLOCK = LANES * STEPS
FOOTER = struct.Struct("<QQQQQ8s")


def bit_width(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def pack_blocks(values: np.ndarray, percentile: float) -> list[bytes]:
    """Encodes whole blocks; ``values`` has the shape (blocks, 1024) and dtype uint32."""
    if not len(values):
        return []
    low = values.min(axis=1)
    rest = values - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = bit_width(np.partition(rest, at, axis=1)[:, at])
    out: list[bytes] = [b""] * len(values)
    for w in np.unique(width):
        w = int(w)
        rows = np.flatnonzero(width == w)
        mine = rest[rows]
        kept = mine & np.uint32((1 << w) - 1)
        lanes = kept.reshape(len(rows), STEPS, LANES)
        words = np.zeros((len(rows), w, LANES), np.uint32)
        for s in range(STEPS if w else 0):
            word, shift = divmod(s * w, 32)
            words[:, word] |= lanes[:, s] << np.uint32(shift)
            if shift + w > 32:
                words[:, word + 1] |= lanes[:, s] >> np.uint32(32 - shift)
        high = mine >> np.uint32(w) if w < 32 else np.zeros_like(mine)
        for k, r in enumerate(rows):
            (odd,) = np.nonzero(high[k])
            out[r] = b"".join((struct.pack("<IBxxxI", int(low[r]), w, len(odd)), words[k].tobytes(), odd.astype("<u2").tobytes(), high[k][odd].astype("<u4").tobytes()))
    return out


def unpack_blocks(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Decodes the blocks that start at ``offsets`` of ``data``: (blocks, 1024) of uint32."""
    out = np.empty((len(offsets), BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBxxxI", data, int(o)) for o in offsets]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        w = int(w)
        rows = np.flatnonzero(width == w)
        words = np.stack([np.frombuffer(data, "<u4", w * LANES, int(offsets[r]) + 12) for r in rows]).reshape(len(rows), w, LANES) if w else None
        lanes = np.zeros((len(rows), STEPS, LANES), np.uint32)
        mask = np.uint32((1 << w) - 1)
        for s in range(STEPS if w else 0):
            word, shift = divmod(s * w, 32)
            got = words[:, word] >> np.uint32(shift)
            if shift + w > 32:
                got = got | (words[:, word + 1] << np.uint32(32 - shift))
            lanes[:, s] = got & mask
        out[rows] = lanes.reshape(len(rows), BLOCK)
    for k, (o, (low, w, n)) in enumerate(zip(offsets, heads, strict=True)):
        if n:
            at = int(o) + 12 + 4 * w * LANES
            where = np.frombuffer(data, "<u2", n, at)
            out[k, where] |= np.frombuffer(data, "<u4", n, at + 2 * n) << np.uint32(w)
        out[k] += np.uint32(low)
    return out


class IdWriter:
    """Writes one file from a stream of documents; memory stays at a batch and the indexes."""

    def __init__(self, sink, percentile: float = 0.9, flush_ids: int = 1 << 20):
        self.sink, self.percentile, self.flush_ids = sink, percentile, flush_ids
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.doc_ids: list[int] = []
        self.starts: list[int] = []
        self.offsets: list[int] = []
        self.at = self._write(MAGIC + struct.pack("<I", BLOCK))

    def _write(self, data: bytes) -> int:
        self.sink.write(data)
        return len(data)

    def add(self, doc_ids: list[int], ids: np.ndarray, lengths: np.ndarray) -> None:
        """``ids``: those of all documents joined; ``lengths``: how many each has."""
        self.doc_ids += doc_ids
        self.starts += (self.n_ids + np.cumsum(lengths) - lengths).tolist()
        self.n_ids += len(ids)
        self.pending.append(ids.astype(np.uint32))
        self.n_pending += len(ids)
        if self.n_pending >= self.flush_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        whole = len(ids) // BLOCK * BLOCK
        tail = ids[whole:]
        if last and len(tail):
            ids = np.concatenate([ids, np.full(BLOCK - len(tail), tail.min(), np.uint32)])
            whole, tail = len(ids), tail[:0]
        for block in pack_blocks(ids[:whole].reshape(-1, BLOCK), self.percentile):
            self.offsets.append(self.at)
            self.at += self._write(block)
        self.pending, self.n_pending = [tail], len(tail)

    def close(self) -> int:
        self._flush(True)
        docs_at = self.at
        both = np.empty((len(self.doc_ids), 2), "<i8")
        both[:, 0], both[:, 1] = self.doc_ids, self.starts
        self.at += self._write(both.tobytes())
        index_at = self.at
        self.at += self._write(np.array(self.offsets, "<u8").tobytes())
        self.at += self._write(FOOTER.pack(self.n_ids, len(self.doc_ids), len(self.offsets), docs_at, index_at, MAGIC))
        return self.at


def read_documents(source, size: int, group: int = 1 << 10) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start in this file, ids) of each document, reading ``group`` blocks at a time."""
    source.seek(size - FOOTER.size)
    n_ids, n_docs, n_blocks, docs_at, index_at, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(docs_at)
    docs = np.frombuffer(source.read(16 * n_docs), "<i8").reshape(-1, 2)
    source.seek(index_at)
    offsets = np.append(np.frombuffer(source.read(8 * n_blocks), "<u8"), docs_at).astype(np.int64)
    ends = np.append(docs[1:, 1], n_ids)
    have, base, block = np.zeros(0, np.uint32), 0, 0
    for (doc_id, start), end in zip(docs.tolist(), ends.tolist(), strict=True):
        parts = []
        while base + len(have) < end:
            upto = min(n_blocks, block + group)
            source.seek(int(offsets[block]))
            data = source.read(int(offsets[upto] - offsets[block]))
            fresh = unpack_blocks(data, offsets[block:upto] - offsets[block]).reshape(-1)
            parts.append(have[max(0, start - base) :])
            base, have, block = base + len(have), fresh, upto
            start_here = max(start, base)
        if parts:
            ids = np.concatenate([*parts, have[start_here - base : end - base]])
        else:
            ids = have[start - base : end - base]
        yield doc_id, start, ids


class WordEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    The library's splitting rule always starts a token at a space that a non-space follows. A run of white space
    before a non-space ends one character early, and if that last character is no space it is a token of its own. So
    texts fall into independent pieces before a run, before its last character and after it. Arrow cuts and numbers
    the pieces, the library is asked once a distinct piece, and numpy lays out the ids. Texts in which a space stands
    before white space or at the end, or that hold other white space or the mark used here, go to the library whole."""

    FIRST = "\x01"  # stands before a piece that no space comes before: a text's first, a line's first, a comma
    WHOLE = r" \s|[ \x01\x1c-\x1f]$|[\x01\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

    def __init__(self, path: str, remember: int = 1 << 20, chunk_chars: int = 1 << 22):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # it only ever sees a piece once
        added = [t["content"] for t in json.loads(self.library.to_str()).get("added_tokens", [])]
        self.whole = "|".join([self.WHOLE, *map(re.escape, added)])
        vocabulary = self.library.get_vocab()
        self.after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self.after_space[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.remember, self.chunk_chars = remember, chunk_chars
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces after a space are joined, 512 at a time: ids that start with a space begin a piece."""
        spaced = [p for p in pieces if p[:1] != self.FIRST]
        other = [p for p in pieces if p[:1] == self.FIRST]
        parts = [self._ids(" " + " ".join(spaced[at : at + 512])) for at in range(0, len(spaced), 512)]
        joined = np.concatenate([np.zeros(0, np.uint32), *parts])
        sizes = np.diff(np.append(np.flatnonzero(self.after_space[joined]), len(joined)))
        rest = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast([p.removeprefix(self.FIRST) for p in other], add_special_tokens=False)]
        sizes = np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest))]).astype(np.int64)
        if len(sizes) != len(pieces):
            raise ValueError("the tokenizer's splitting rule is not the byte-level one")
        self.known.update(zip([*spaced, *other], range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.flat = np.concatenate([self.flat, joined, *rest])

    def encode(self, texts: list[str], end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some of the texts at a time: how many, all their ids joined with ``end_id`` after each
        text, and how many ids each text has."""
        at = 0
        while at < len(texts):
            upto, chars = at, 0
            while upto < len(texts) and (upto == at or chars + len(texts[upto]) <= self.chunk_chars):
                chars += len(texts[upto])
                upto += 1
            yield upto - at, *self._encode(texts[at:upto], end_id)
            at = upto

    def _encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.remember:
            self._forget()
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, self.whole).to_numpy(zero_copy_only=False)
        first = pa.scalar(self.FIRST, pa.large_string())
        cut = pc.binary_join_element_wise(first, column.filter(pa.array(~odd)), pa.scalar("", pa.large_string()))
        # a comma or point between a letter and white space is a token; so is the last line end or tab before a non-space,
        # and the run before that last one (an empty piece where there is none)
        cut = pc.replace_substring_regex(cut, r"([A-Za-z])([,.])([ \n])", rf"\1 {self.FIRST}\2\3")
        cut = pc.replace_substring_regex(cut, r"([\t\n\f\r]*)([\t\n\f\r])([^\s])", rf" {self.FIRST}\1 {self.FIRST}\2 {self.FIRST}\3")
        lists = pc.split_pattern(cut, " ")
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [p for p in distinct if p not in self.known]
        if fresh:
            self._learn(fresh)
        codes = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.lengths[codes]
        ends = np.cumsum(sizes)
        laid = self.flat[np.repeat(self.starts[codes] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        out, lengths, before = [], [], 0
        stop = np.array([end_id], np.uint32)
        for k, upto in enumerate(text_ends.tolist()):
            ids = self._ids(texts[k]) if odd[k] else laid[before:upto]
            out += [ids, stop]
            lengths.append(len(ids) + 1)
            before = upto
        return np.concatenate(out), np.asarray(lengths, np.int64)


#: A Python worker serves many tasks; what it has learned of words stays with it.
ENCODERS: dict[str, WordEncoder] = {}


def byte_bpe(path: str, end_id: int) -> Callable[[], Callable]:
    def make():
        if path not in ENCODERS:
            ENCODERS[path] = WordEncoder(path)
        encoder = ENCODERS[path]
        return lambda texts: encoder.encode(texts, end_id)

    return make


def write_token_files(docs: DataFrame, make_encoder: Callable, folder: str, percentile: float = 0.9, files: int | None = None) -> DataFrame:
    """Writes ``docs(doc_id, text)`` in ascending doc_id order as one file a range partition.

    Returns the manifest: file_no, path, n_ids, n_docs, n_bytes, first_id (ids in all files before).
    A file appears under its name only when whole, and a retried task writes another name, so the
    manifest never names a torn file. The ordering shuffles the texts once."""
    spark = docs.sparkSession
    n = files or partitions(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.pfor"
        encode, writer = None, None
        with fs.open_output_stream(f"{path}/.{name}") as sink:
            for batch in batches:
                if not len(batch):
                    continue
                if writer is None:
                    encode, writer = make_encoder(), IdWriter(sink, percentile)
                at, doc_ids = 0, batch["doc_id"].tolist()
                for n_texts, ids, lengths in encode(batch["text"].fillna("").tolist()):
                    writer.add(doc_ids[at : at + n_texts], ids, lengths)
                    at += n_texts
            size = writer.close() if writer else 0
        if writer is None:
            fs.delete_file(f"{path}/.{name}")
            return
        fs.move(f"{path}/.{name}", f"{path}/{name}")
        yield pd.DataFrame({"file_no": [context.partitionId()], "path": [f"{folder}/{name}"], "n_ids": [writer.n_ids], "n_docs": [len(writer.doc_ids)], "n_bytes": [size]})

    numbered = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    ordered = numbered.repartitionByRange(n, F.col("doc_id").asc()).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = stored(ordered.mapInPandas(write, "file_no int, path string, n_ids long, n_docs long, n_bytes long"), "token-manifest")
    # one row a file, so this window holds as many rows as there are files
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files of a manifest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                fs, path = open_fs(row.path)
                with fs.open_input_file(path) as source:
                    rows = []
                    for doc_id, start, ids in read_documents(source, row.n_bytes):
                        rows.append((doc_id, row.first_id + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = partitions(manifest.sparkSession)
    out = manifest.repartition(n, "file_no").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the token files of ``docs`` and returns the digest of what reading them back gives."""
    spark: SparkSession = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    return read_token_files(write_token_files(docs, byte_bpe(tokenizer, end_id), folder))
