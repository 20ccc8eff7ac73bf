"""Near-duplicate embeddings by hierarchical navigable small-world graphs, a graph a shard.

Vectors are scaled to unit length in double precision. Equal vectors of a label are one node with a count. A label's
nodes are dealt by hash into shards of about ``SHARD_ROWS``, fewer where vectors are long; each shard builds one graph,
and every node of the label is asked of every shard. A task holds one shard and lets blocks of nodes stream past it: all
blocks of the label, or where they are more than ``ROUND_BLOCKS``, so many of them. So a block moves once a shard, and a shard
once for so many blocks, an eighth of what the blocks move.

Searches of a block walk in step, so that each step is a few array operations. Beams widen until two tests hold: every
found neighbour list ends below the threshold, and an audit of each block against all of the shard's vectors finds the
recall asked for. Walks that would have to widen to a sixteenth of the shard become comparisons with all of it, so shards of
up to twice the first beam (64 nodes) are never walked.
Neighbours are verified by their cosines in double precision; links are counted and contracted to a forest a block before
they are united into components.

Vectors that are null, empty, zero, or that hold null or non-finite numbers link with nothing, nor do rows without a
label; each is a component of its own. Vectors of different lengths do not link. A pair whose cosine, rounded in double precision, is
the threshold itself links. Repeated rows of a vec_id count as
separate vectors with one id. Empty tables give no rows. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.components import components
from halyard.llm.shared import partitions, stored, trim_worker

SHARD_ROWS = 32_768
#: Bytes of a shard's vectors in double precision.
SHARD_BYTES = 1 << 25
BLOCK_ROWS = 1_024
ROUND_BLOCKS = 256


class Graph:
    """A layered neighbour graph over unit vectors; levels shrink by ``links``-fold draws of a seeded hash."""

    def __init__(self, vectors: np.ndarray, links: int = 12, beam: int = 48, seed: int = 3):
        self.vectors, self.links = vectors, links
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-300)) / np.log(links)).astype(np.int64), 6)
        self.order = np.argsort(-level, kind="stable")  # upper levels first
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(len(self.sizes))]
        for k in range(len(self.sizes) - 1, -1, -1):
            self._build(k, beam)

    def _build(self, k: int, beam: int) -> None:
        """Members of a layer are inserted in rounds that each at most double it. A newcomer's neighbours are chosen
        among what a search of the layer so far finds and the other newcomers of its round."""
        members = self.order[: self.sizes[k]]
        done = 0
        while done < len(members):
            fresh = members[done : max(2 * done, min(256, len(members)))]
            found = np.full((len(fresh), 0), -1, np.int64)
            if done:
                found, _ = self.search(self.vectors[fresh], beam, bottom=k, entry=members[:done])
            near = self.vectors[fresh] @ self.vectors[fresh].T
            np.fill_diagonal(near, -np.inf)
            most = min(len(fresh) - 1, self.links)
            if most > 0:
                peers = fresh[np.argpartition(-near, most - 1, axis=1)[:, :most]]
                found = np.concatenate([found, peers], axis=1)
            self._connect(k, fresh, found)
            done += len(fresh)

    def _connect(self, k: int, nodes: np.ndarray, found: np.ndarray) -> None:
        layer = self.layers[k]
        # both directions, then each touched node keeps a spread of its nearest
        a, b = np.repeat(nodes, found.shape[1]), found.reshape(-1)
        ok = (b >= 0) & (a != b)
        a, b = a[ok], b[ok].astype(np.int64)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        touched = np.unique(src)
        old = layer[touched]
        src = np.concatenate([src, np.repeat(touched, old.shape[1])[old.reshape(-1) >= 0]])
        dst = np.concatenate([dst, old.reshape(-1)[old.reshape(-1) >= 0].astype(np.int64)])
        pair = np.unique(src * len(self.vectors) + dst)
        src, dst = pair // len(self.vectors), pair % len(self.vectors)
        close = np.empty(len(src), np.float32)
        for at in range(0, len(src), 1 << 16):
            part = slice(at, at + (1 << 16))
            close[part] = np.einsum("ij,ij->i", self.vectors[src[part]], self.vectors[dst[part]])
        order = np.lexsort((-close, src))
        src, dst = src[order], dst[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        # half of the room for the nearest, the rest spread over what follows, so that graphs stay connected
        count = np.bincount(np.searchsorted(touched, src), minlength=len(touched))
        room = layer.shape[1]
        size = count[np.searchsorted(touched, src)]
        near = room // 2
        step = np.maximum(1, -(-(size - near) // (room - near)))
        keep = (place < near) | ((place - near) % step == 0)
        src, dst = src[keep], dst[keep]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        fits = place < room
        layer[touched] = -1
        layer[src[fits], place[fits]] = dst[fits]

    def search(self, queries: np.ndarray, beam: int, bottom: int = 0, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``beam`` best that walks from the top find, best first, -1 where there are fewer."""
        top = len(self.sizes) - 1
        start = np.full((len(queries), 1), self.order[0], np.int64)
        for k in range(top, bottom, -1):
            start, _ = self._walk(k, queries, start, 4)
        if entry is not None and len(entry) <= beam:
            start = np.broadcast_to(entry, (len(queries), len(entry))).copy()
        return self._walk(bottom, queries, start, beam)

    def _walk(self, k: int, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        layer, n, q = self.layers[k], len(self.vectors), len(queries)
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)[:, None]
        nodes = start.astype(np.int64)
        cosines = np.where(nodes >= 0, np.einsum("qcd,qd->qc", self.vectors[np.maximum(nodes, 0)], queries), -np.inf)
        seen[np.broadcast_to(rows, nodes.shape)[nodes >= 0], nodes[nodes >= 0]] = True
        open_ = nodes >= 0
        width = 4  # nodes that each walk opens at a step
        live = np.arange(q)
        out_nodes, out_cos = np.full((q, beam), -1, np.int64), np.full((q, beam), -np.inf)
        while len(live):
            pick = np.argsort(np.where(open_, -cosines, np.inf), axis=1, kind="stable")[:, :width]
            r = np.arange(len(live))[:, None]
            chosen = np.where(open_[r, pick], nodes[r, pick], -1)
            open_[r, pick] = False
            next_ = np.where(chosen[:, :, None] >= 0, layer[np.maximum(chosen, 0)], -1).reshape(len(live), -1).astype(np.int64)
            # first sight only: sort makes repeats within a step neighbours
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            known = seen[live[:, None], np.maximum(next_, 0)]
            next_[known] = -1
            at = next_ >= 0
            seen[np.broadcast_to(live[:, None], next_.shape)[at], next_[at]] = True
            fresh = np.full(next_.shape, -np.inf)
            who = np.broadcast_to(live[:, None], next_.shape)[at]
            fresh[at] = np.einsum("ij,ij->i", self.vectors[next_[at]], queries[who])
            nodes, cosines, open_ = np.concatenate([nodes, next_], 1), np.concatenate([cosines, fresh], 1), np.concatenate([open_, at], 1)
            best = np.argsort(-cosines, axis=1, kind="stable")[:, :beam]
            nodes, cosines, open_ = nodes[r, best], cosines[r, best], open_[r, best]
            going = open_.any(axis=1)
            if not going.all():
                ended = np.flatnonzero(~going)
                out_nodes[live[ended], : nodes.shape[1]] = nodes[ended]
                out_cos[live[ended], : nodes.shape[1]] = cosines[ended]
                live, nodes, cosines, open_ = live[going], nodes[going], cosines[going], open_[going]
        out_nodes[np.isneginf(out_cos)] = -1
        return out_nodes, out_cos


def matches(graph: Graph, queries: np.ndarray, least: float, beam: int = 32, recall: float = 0.99, audit: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(query number, node) of all pairs found with a cosine of ``least`` or more.

    A walk whose beam ends above ``least`` may have missed more: its beam doubles. Then ``audit`` of the queries, at even
    steps, are compared with every vector; while the walks found less than ``recall`` of what those find, all beams double.
    A beam that has grown to a sixteenth of the shard costs more than the comparison with every vector, which takes its place."""
    n = len(graph.vectors)
    least -= 1e-5  # single precision proposes, double precision decides
    found: dict[int, np.ndarray] = {}
    probe = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(np.int64))
    truth = queries[probe] @ graph.vectors.T >= least
    size = beam
    while True:
        rest, wide = np.arange(len(queries)), size
        while len(rest):
            if 2 * wide >= n or (wide > beam and 16 * wide >= n):
                for part in np.array_split(rest, max(1, len(rest) // 256)):
                    hit = queries[part] @ graph.vectors.T >= least
                    for k, row in zip(part.tolist(), hit, strict=True):
                        found[k] = np.flatnonzero(row)
                break
            nodes, cosines = graph.search(queries[rest], wide)
            full = cosines[:, -1] >= least
            for k, row, c in zip(rest[~full].tolist(), nodes[~full], cosines[~full], strict=True):
                found[k] = row[c >= least]
            rest = rest[full]
            wide *= 2
        got = sum(int(truth[k, found[p]].sum()) for k, p in enumerate(probe.tolist()))
        if got >= recall * int(truth.sum()):
            break
        size *= 2  # at last all are compared
    q = np.repeat(np.arange(len(queries)), [len(found[k]) for k in range(len(queries))])
    return q, np.concatenate([found[k] for k in range(len(queries))]) if len(queries) else np.zeros(0, np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def pack_graph(graph: Graph) -> bytes:
    """The layers as bytes: those of their members, upper ones first."""
    parts = [np.array([len(graph.sizes), graph.links, *graph.sizes], "<i4").tobytes(), graph.order.astype("<i4").tobytes()]
    parts += [layer[graph.order[:size]].astype("<i4").tobytes() for layer, size in zip(graph.layers, graph.sizes, strict=True)]
    return b"".join(parts)


def unpack_graph(blob: bytes, vectors: np.ndarray) -> Graph:
    data = np.frombuffer(blob, "<i4")
    graph = Graph.__new__(Graph)
    graph.vectors, graph.links, n = vectors, int(data[1]), len(vectors)
    graph.sizes = data[2 : 2 + data[0]].tolist()
    at = 2 + int(data[0])
    graph.order = data[at : at + n].astype(np.int64)
    at += n
    graph.layers = []
    for k, size in enumerate(graph.sizes):
        room = 2 * graph.links if k == 0 else graph.links
        layer = np.full((n, room), -1, np.int32)
        layer[graph.order[:size]] = data[at : at + size * room].reshape(size, room)
        at += size * room
        graph.layers.append(layer)
    return graph


def near_vectors(vectors: DataFrame, least: float = 0.93, recall: float = 0.99, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units: list[bytes | None] = []
            for embedding, label in zip(batch["embedding"], batch["label"], strict=True):
                unit = None
                if embedding is not None and len(embedding) and not pd.isna(label):
                    v = np.array([np.nan if x is None else x for x in embedding], np.float64)
                    top = np.abs(v).max()
                    if np.isfinite(v).all() and top > 0:
                        v = v / top + 0.0  # no overflow in the norm, and no negative zeros
                        unit = (v / np.sqrt((v * v).sum())).tobytes()
                units.append(unit)
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"].astype("Int64"), "unit": pd.Series(units, dtype="object", index=batch.index)})

    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).mapInPandas(scale, "vec_id long, label long, unit binary")
    rows = stored(rows.withColumn("node", F.unhex(F.md5(F.concat(F.encode(F.concat(F.col("label").cast("string"), F.lit(":")), "utf-8"), "unit")))), "unit-vectors")
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("label", "node").agg(F.max("unit").alias("unit"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.withColumn("dim", F.octet_length("unit")), "nodes")
    counts = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    size = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / F.col("dim"))))
    counts = counts.withColumn("shards", F.ceil(F.col("n") / size).cast("long")).withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long"))
    counts = stored(counts.withColumn("rounds", F.ceil(F.col("blocks") / round_blocks).cast("long")), "label-sizes")
    dealt = nodes.join(counts, ["label", "dim"])
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    dealt = stored(dealt.withColumn("shard", part("shards", 1)).withColumn("block", part("blocks", 2)), "dealt")

    def pack(name: str, indexed: bool) -> DataFrame:
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            units = b"".join(group["unit"])
            graph = pack_graph(Graph(np.frombuffer(units, np.float64).reshape(len(group), -1).astype(np.float32))) if indexed else None
            return pd.DataFrame([(*map(int, key), b"".join(group["node"]), group["copies"].to_numpy("<i8").tobytes(), units, graph)], columns=["label", "dim", name, "nodes", "copies", "units", "graph"])

        grouped = dealt.select("label", "dim", name, "node", "copies", "unit").groupBy("label", "dim", name)
        return stored(grouped.applyInPandas(run, f"label long, dim int, {name} long, nodes binary, copies binary, units binary, graph binary"), f"{name}s")

    # a round of a shard is the shard, which comes first (block -1), and every block of that round
    each = lambda of, n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(of)
    shards = pack("shard", True).join(counts, ["label", "dim"]).select("label", "dim", "shard", each("round", "rounds"), F.lit(-1).cast("long").alias("block"), "nodes", "copies", "units", "graph")
    blocks = pack("block", False).join(counts, ["label", "dim"]).select("label", "dim", each("shard", "shards"), (F.col("block") % F.col("rounds")).alias("round"), "block", "nodes", F.lit(None).cast("binary").alias("copies"), "units", F.lit(None).cast("binary").alias("graph"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, number, copies, units, graph = [], {}, None, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                asking = [row.nodes[k : k + 16] for k in range(0, len(row.nodes), 16)]
                queries = np.frombuffer(row.units, np.float64).reshape(len(asking), -1)
                if row.block < 0:
                    names, units = asking, queries
                    number = {n: k for k, n in enumerate(names)}
                    copies = np.frombuffer(row.copies, "<i8")
                    graph = unpack_graph(row.graph, units.astype(np.float32))
                    continue
                q, found = matches(graph, queries.astype(np.float32), least, recall=recall)
                sure = np.concatenate([np.einsum("ij,ij->i", queries[q[k : k + 65536]], units[found[k : k + 65536]]) >= least for k in range(0, len(q), 65536)] or [np.zeros(0, bool)])
                q, found = q[sure], found[sure]
                itself = np.array([number.get(n, -1) for n in asking])
                other = itself[q] != found
                q, found = q[other], found[other]
                links = np.bincount(q, copies[found], len(asking)).astype(np.int64)
                told = [(n, None, int(c)) for n, c in zip(asking, links, strict=True) if c]
                told += [(asking[x], names[y - len(asking)], 0) for x, y in forest(q, found + len(asking))]
                yield pd.DataFrame(told, columns=["a", "b", "n"])
        trim_worker()

    # about as many tasks as rounds of shards, so that a task holds little and a lost one costs little
    tiles = counts.agg(F.sum(F.col("shards") * F.col("rounds"))).first()[0] or 0
    asked = shards.unionByName(blocks).repartition(max(4 * partitions(spark), int(tiles)), "label", "dim", "shard", "round").sortWithinPartitions("label", "dim", "shard", "round", "block")
    told = stored(asked.mapInPandas(ask, "a binary, b binary, n long"), "vector-links")
    links = told.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n_links"))
    classes = components(told.filter(F.col("b").isNotNull()))
    own = nodes.select("node", (F.col("copies") - 1).alias("own"))
    out = rows.select("vec_id", "node").join(own, "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left").join(classes, "node", "left")
    out = out.withColumn("component", F.coalesce("component", "node"))
    first = out.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("vec_id").alias("first"))
    out = out.join(first, "component", "left").withColumn("component_id", F.coalesce("first", "vec_id"))
    n_links = F.coalesce("own", F.lit(0)) + F.coalesce("n_links", F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
