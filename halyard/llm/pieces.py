"""SentencePiece encoding and decoding with seeded merge-dropout.

A text is cut before every run of spaces and around line ends, where no piece of the model reaches across. A segment starts as
characters; its candidate merges wait in an agenda, best score first, ties to the left. A candidate is skipped when
the keyed hash of (seed, segment, variant, its three borders) falls below the dropout, else it merges and proposes
its new neighbours. Here the agendas of all new segments of a batch advance together, one merge each a
turn. What the model does not know falls back to bytes; so does the space mark itself when a text holds it,
which makes decoding lossless for every text.

Every occurrence of a segment has its own draw, by its text's key and its place, so equal words differ within and
between texts, while the same seed repeats everything. An occurrence whose draw skips none of the merges that the
model itself makes has the model's own pieces, which are kept; only the others run an agenda. ``variants`` bounds
the draws of a segment where a caller wants that; 0, the default, does not. With a dropout of 0 the pieces are the model's own.

Null texts give null ids and decode to null; empty texts have no ids. Texts of any length are encoded in
whole. Equal rows with equal keys get equal ids.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.llm.minhash import chunks, mixed
from halyard.llm.shared import trim_worker

U64 = np.uint64
SPACE = "▁"
BARE = "\x01"  # stands before a segment that no space comes before


class PieceModel:
    """The vocabulary of a SentencePiece BPE model as merge tables."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        self.unknown = library.unk_id()
        self.byte_ids = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        score = np.zeros(n)
        for i, piece in enumerate(self.pieces):
            score[i] = library.get_score(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.ids[piece] = i
        # every split of a piece in two pieces is a merge; keys are sorted for lookup by numpy
        made = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        left, right, result = (np.array(x, np.int64) for x in zip(*made, strict=True))
        order = np.argsort(left * n + right)
        self.size, self.keys, self.results = n, (left * n + right)[order], result[order]
        self.score = score
        self.bytes_of = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two neighbours form, or -1; -1 stands for unknown characters and no neighbour."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.results[at], -1)


def segment_hashes(segments: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) for s in segments), U64, len(segments))


def drawn(hashes: np.ndarray, variants: np.ndarray, seed: int) -> np.ndarray:
    """The keys of the draws of segments."""
    return mixed(hashes + mixed(variants.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))


def threshold(dropout: float) -> np.uint64:
    return U64(min(int(dropout * 2.0**64), 2**64 - 1))


def borders(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What a merge's borders add to the key of its draw."""
    return start.astype(U64) * U64(0xA0761D6478BD642F) + middle.astype(U64) * U64(0xE7037ED1A0B428DB) + end.astype(U64) * U64(0x8EBC6AF09C88C6E3)


def encode_segments(model: PieceModel, segments: list[str], variants: np.ndarray, dropout: float, seed: int, taken: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all segments joined, and how many each has. A space in a segment is the space mark.

    ``variants``: an unsigned 64-bit number a segment, on which its skips depend. ``taken`` gets the number of the segment
    and the ``borders`` of each merge that is made."""
    known = model.ids
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(segments), np.int64)
    own = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
    start = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    letters = "".join(segments)
    # a text's own space marks are unknown characters; the model's marks stand for spaces
    table = {c: (-1 if c == SPACE else known.get(SPACE if c == " " else c, -1)) for c in set(letters)}
    symbol = np.fromiter(map(table.__getitem__, letters), np.int32, n)
    end = start + 1  # borders of each live symbol in its segment
    key = drawn(segment_hashes(segments), variants, seed)
    bar = threshold(dropout)
    after = np.where(np.append(own[1:] == own[:-1], False), np.arange(1, n + 1, dtype=np.int32), np.int32(-1))
    before = np.where(np.append(False, own[1:] == own[:-1]), np.arange(-1, n - 1, dtype=np.int32), np.int32(-1))
    offered = np.full(n, -1, np.int32)  # what each symbol and the next would merge to

    def propose(at: np.ndarray) -> None:
        right = after[at]
        made = np.where(right >= 0, model.merge(symbol[at], symbol[right]), -1)
        if dropout > 0:
            spot = mixed(key[own[at]] + borders(start[at], end[at], end[right]))
            made = np.where(spot < bar, -1, made)
        offered[at] = made

    propose(np.arange(n))
    live = np.flatnonzero(offered >= 0)
    while len(live):
        # the best offer of each segment: highest score, then leftmost; live is sorted, so segments are together
        groups = np.flatnonzero(np.append(True, own[live[1:]] != own[live[:-1]]))
        size = np.diff(np.append(groups, len(live)))
        score = model.score[offered[live]]
        top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, groups), size))
        best = live[top[np.append(True, own[live[top[1:]]] != own[live[top[:-1]]])]]
        gone = after[best]
        if taken is not None:
            taken.append((own[best], borders(start[best], end[best], end[gone])))
        symbol[best], end[best] = offered[best], end[gone]
        follow = after[gone]
        after[best] = follow
        before[follow[follow >= 0]] = best[follow >= 0]
        symbol[gone], offered[gone] = -2, -1
        propose(best)
        lefts = before[best]
        propose(lefts[lefts >= 0])
        live = np.sort(np.concatenate([live, lefts[lefts >= 0]]))
        live = live[np.append(True, live[1:] != live[:-1]) & (offered[live] >= 0)]
    kept = np.flatnonzero(symbol != -2)
    values = symbol[kept]
    unknown = np.flatnonzero(values == -1)
    if not len(unknown):
        return values, np.bincount(own[kept], minlength=len(segments))
    chars = [letters[k] for k in kept[unknown].tolist()]
    fallback = {c: model.byte_ids[np.frombuffer(c.encode("utf-8", "surrogatepass"), np.uint8)] for c in set(chars)}
    width = np.ones(len(values), np.int64)
    width[unknown] = [len(fallback[c]) for c in chars]
    flat = np.repeat(values, width)
    flat[flat == -1] = np.concatenate([fallback[c] for c in chars])
    return flat, np.bincount(own[kept], width, len(segments)).astype(np.int64)


def written(segment: str) -> str:
    """A segment with the space that it was cut at."""
    return segment[1:] if segment[:1] == BARE else " " + segment


class Encoder:
    """Encodes texts, remembering the model's own pieces and merges of each segment."""

    def __init__(self, path: str, dropout: float, seed: int, variants: int, remember: int = 1 << 18):
        self.model = PieceModel(path)
        self.dropout, self.seed, self.variants, self.remember = dropout, seed, variants, remember
        # a character that no piece joins with others is a border on both sides: line ends, as a rule
        self.lines = not any("\n" in p for p in self.model.ids if len(p) > 1)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.hashes = np.zeros(0, U64)
        self.flat = np.zeros(0, np.uint16 if self.model.size <= 1 << 16 else np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.merges = np.zeros(0, U64)  # borders of the merges of each segment
        self.first_merge = np.zeros(0, np.int64)
        self.n_merges = np.zeros(0, np.int64)

    def rest(self) -> None:
        self._forget()
        trim_worker()

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Number of each segment in the list of distinct ones, that list, and how many segments each text has.

        Segments are cut at single spaces, which they lose; a run of spaces stays with what follows it."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, r"  |^ | $|\x01").to_numpy(zero_copy_only=False)
        plain = column.filter(pa.array(~odd))
        if self.lines:
            plain = pc.replace_substring_regex(plain, r"(\n+)", f" {BARE}\\1 {BARE}")
        lists = pc.split_pattern(plain, " ")
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if odd.any():
            number = {s: k for k, s in enumerate(distinct)}
            parts, at = [], np.concatenate([[0], np.cumsum(counts)])
            for k, text in enumerate(texts):
                if not odd[k]:
                    parts.append(codes[at[k] : at[k + 1]])
                    continue
                own = [BARE + s for s in re.findall(r" +[^ ]*|[^ ]+", " " + text)]
                parts.append(np.array([number.setdefault(s, len(number)) for s in own], np.int64))
                counts[k] = len(own)
            codes, distinct = np.concatenate(parts), list(number)
        empty = np.fromiter((not t for t in texts), bool, len(texts))
        if empty.any():  # splitting gives one empty segment
            codes = np.delete(codes, (np.cumsum(counts) - counts)[empty])
            counts[empty] = 0
        return codes, distinct, counts

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids joined, and how many each text has. ``keys``: an unsigned 64-bit number a text."""
        if len(self.known) > self.remember:
            self._forget()
        codes, distinct, counts = self._cut(texts)
        known = self.known
        fresh = [s for s in distinct if s not in known]
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        if fresh:
            taken: list = []
            flat, sizes = encode_segments(self.model, list(map(written, fresh)), np.zeros(len(fresh), U64), 0.0, self.seed, taken)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])
            whose, merge = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else (np.zeros(0, np.int64), np.zeros(0, U64))
            n = np.bincount(whose, minlength=len(fresh))
            self.first_merge = np.concatenate([self.first_merge, len(self.merges) + np.cumsum(n) - n])
            self.n_merges = np.concatenate([self.n_merges, n])
            self.merges = np.concatenate([self.merges, merge[np.argsort(whose, kind="stable")]])
            self.hashes = np.concatenate([self.hashes, segment_hashes(list(map(written, fresh)))])
        row = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))[codes]
        starts, sizes, pool = self.starts[row], self.sizes[row], self.flat
        if self.dropout > 0:
            # an occurrence that skips none of the model's own merges has the model's own pieces
            place = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
            draw = mixed(np.repeat(keys, counts) + place.astype(U64) * U64(0x9E3779B97F4A7C15))
            draw = draw % U64(self.variants) if self.variants else draw
            n = self.n_merges[row]
            which = np.repeat(np.arange(len(row)), n)
            at = np.repeat(self.first_merge[row] - (np.cumsum(n) - n), n) + np.arange(len(which))
            skips = mixed(drawn(self.hashes[row], draw, self.seed)[which] + self.merges[at]) < threshold(self.dropout)
            other = np.unique(which[skips])
            if len(other):
                flat, own = encode_segments(self.model, [written(distinct[k]) for k in codes[other].tolist()], draw[other], self.dropout, self.seed)
                starts[other], sizes[other] = len(pool) + np.cumsum(own) - own, own
                pool = np.concatenate([pool, flat.astype(pool.dtype)])
        ends = np.cumsum(sizes)
        ids = pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        totals = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
        return ids, totals


ENCODERS: dict[tuple, Encoder] = {}


def encoder(*parameters) -> Encoder:
    """A Python worker keeps its model from task to task; what a task learned of segments goes with it."""
    if parameters not in ENCODERS:
        ENCODERS[parameters] = Encoder(*parameters)
    return ENCODERS[parameters]


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of a sequence of ids: the bytes of all pieces, without the first space."""
    return b"".join(map(model.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


PIECE_COLUMNS = "n_pieces long, pieces_crc32 long, round_trip boolean, decoded_crc32 long"


def _digest(batch: pd.DataFrame, own: Encoder) -> pd.DataFrame:
    texts = [None if pd.isna(t) else t for t in batch["text"]]
    frames = []
    for part in chunks([t or "" for t in texts], 1 << 20):
        some = [t or "" for t in texts[part]]
        ids, totals = own.encode(some, batch["key"].to_numpy(np.int64)[part].view(U64))
        bounds = np.concatenate([[0], np.cumsum(totals)])
        rows = []
        for k, text in enumerate(some):
            mine = ids[bounds[k] : bounds[k + 1]]
            back = decode(own.model, mine)
            rows.append((len(mine), zlib.crc32(mine.astype("<u4").tobytes()), back == text, zlib.crc32(back.encode("utf-8", "surrogatepass"))))
        frames.append(pd.DataFrame(rows, columns=["n_pieces", "pieces_crc32", "round_trip", "decoded_crc32"]))
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=["n_pieces", "pieces_crc32", "round_trip", "decoded_crc32"])


def numbered_copies(docs: DataFrame) -> DataFrame:
    """The rows with ``copy_number``: 0, 1, ... for rows of one doc_id and text, which meet in one task. Rows that are alike but for
    the number are as good as one another, so any order gives the same table."""
    mark = f"mark_{uuid.uuid4().hex}"
    alike = Window.partitionBy("doc_id", mark).orderBy(mark)
    return docs.withColumn(mark, F.xxhash64("text")).withColumn("copy_number", F.row_number().over(alike) - 1).drop(mark)


def encode_documents(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 7, variants: int = 0, copies: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` as doc_id, ids. Nothing is shuffled, unless ``copies`` asks for a segmentation of its own for each
    copy of a document: then the first has the one that it has alone."""
    if copies:
        rows = numbered_copies(docs.select("doc_id", "text"))
        key = F.when(F.col("copy_number") == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", "copy_number"))
    else:
        rows, key = docs, F.xxhash64("doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, dropout, seed, variants)
        for batch in batches:
            texts = batch["text"].tolist()
            for part in chunks([t or "" for t in texts], 1 << 20):
                ids, totals = own.encode([t or "" for t in texts[part]], batch["key"].to_numpy(np.int64)[part].view(U64))
                bounds = np.concatenate([[0], np.cumsum(totals)])
                lists = [None if t is None else ids[a:b].astype(np.int32) for t, a, b in zip(texts[part], bounds[:-1], bounds[1:], strict=True)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].tolist(), "ids": pd.Series(lists, dtype="object")})
        own.rest()

    return rows.select("doc_id", "text", key.alias("key")).mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, ids)`` as doc_id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder(path, 0.0, 0, 1).model
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": pd.Series([None if i is None else decode(model, np.asarray(i)) for i in batch["ids"]], dtype="object")})

    return encoded.mapInPandas(run, "doc_id long, text string")


def piece_digest(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 7, variants: int = 0) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (of the ids as little-endian 32-bit numbers), round_trip (whether decoding
    gives the text, null as empty), decoded_crc32 (of the decoded text in UTF-8)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, dropout, seed, variants)
        for batch in batches:
            out = _digest(batch, own)
            out.insert(0, "doc_id", batch["doc_id"].tolist())
            yield out
        own.rest()

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key")).mapInPandas(run, f"doc_id long, {PIECE_COLUMNS}")
