"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node that holds its smallest ids, ``k`` + 1 at most: no more of them can be among the k nearest of
a query, and a window with a limit keeps so many before the shuffle. Nodes are dealt to shards by a hash of the vector.
Within a shard nodes enter the graph in seeded random order, in batches that double: a greedy search from the first ones
proposes neighbours, and robust pruning keeps the nearest and drops every other that is ``alpha`` times nearer to a kept
one than to the node, so that edges point different ways. Kept edges are also added backwards; a node beyond its room is
pruned anew. The graph is a table, a row for each node.

Largest inner products are nearest points once every vector has one more component, the root of M^2 - |x|^2 with M the
longest length in the shard, and 0 for a query; that is what the graph is made of, in 32 bits. A query searches every
shard with a beam; the nodes of its last beam get their inner product of the original vectors in double precision.

The number of shards grows with the root of the number of nodes, and with their bytes where a shard would outgrow a
task. Queries are broadcast in blocks of bounded bytes. All searches of a batch advance together in arrays.

Defined cases: rows with null id, and vectors that are null, empty, zero or hold null or non-finite components, take no
part; vectors of another length are no candidates; an id that several rows bear counts once, with its best score; equal
scores go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; other columns
are ignored. Scores are doubles; where products overflow they are infinite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import stored, unstore

K = 20
#: Edges that pruning leaves, edges that a node has room for, and how much nearer a kept neighbour has to be to drop another.
DEGREE, ROOM, ALPHA = 32, 48, 1.2
#: Nodes that a search keeps, while building and for queries, and nodes that it expands at a time.
BUILD_BEAM, BEAM, EXPANDED = 64, 96, 4
#: Nodes that searches begin at and that enter first, so that their edges are long: the middle one, the longest, and others.
ENTRIES = 32
#: Searches that advance together, and cells of their table of seen nodes.
BATCH, SEEN_CELLS = 512, 1 << 24
#: A shard of n nodes has a root of NODES * n; and no shard more bytes of 32-bit vectors and edges than this.
NODES, SHARD_BYTES = 4_096, 1 << 29
#: Bytes of a broadcast block of queries.
BLOCK_BYTES = 32 << 20
SEED = 20_240_117

GRAPH = "width int, shard int, position int, ids array<bigint>, v array<double>, links array<int>"
FOUND = "query_id long, vec_id long, score double"


def beam_search(points: np.ndarray, links: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, trail) of searches from the entries: the nearest nodes found, nearest first, and those that were expanded on the
    way and are no longer among them; -1 where there are fewer."""
    count, room = len(queries), links.shape[1]
    ids, far, done = np.full((count, beam), -1, np.int32), np.full((count, beam), np.inf, np.float32), np.ones((count, beam), bool)
    entries = entries[:beam]
    apart = queries[:, None] - points[entries]
    start = np.einsum("ikj,ikj->ik", apart, apart)
    order = np.argsort(start, axis=1, kind="stable")
    ids[:, : len(entries)], far[:, : len(entries)], done[:, : len(entries)] = entries[order], np.take_along_axis(start, order, axis=1), False
    seen = np.full((count, len(points)), -1, np.int32)
    seen[:, entries] = 0
    active, trail = np.arange(count), []
    while len(active):
        waiting = ~done[active]
        r, c = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= EXPANDED))
        row = active[r]
        done[row, c] = True
        trail.append((row, ids[row, c]))
        node, row = links[ids[row, c]].ravel(), np.repeat(row, room)
        fresh = node >= 0
        node, row = node[fresh], row[fresh]
        fresh = seen[row, node] < 0
        node, row = node[fresh], row[fresh]
        mark = np.arange(len(node), dtype=np.int32)
        seen[row, node] = mark
        fresh = seen[row, node] == mark  # once, if several expanded nodes lead there
        node, row = node[fresh], row[fresh]
        apart = points[node] - queries[row]  # not by norms: near copies differ in the last bits of those
        distance = np.einsum("ij,ij->i", apart, apart)
        near = distance < far[row, -1]
        node, row, distance = node[near], row[near], distance[near]
        if len(row):
            own, begin, several = np.unique(row, return_index=True, return_counts=True)
            lane = np.repeat(np.arange(len(own)), several)
            place = beam + np.arange(len(row)) - np.repeat(begin, several)
            width = beam + several.max()
            all_ids, all_far, all_done = np.full((len(own), width), -1, np.int32), np.full((len(own), width), np.inf, np.float32), np.ones((len(own), width), bool)
            all_ids[:, :beam], all_far[:, :beam], all_done[:, :beam] = ids[own], far[own], done[own]
            all_ids[lane, place], all_far[lane, place], all_done[lane, place] = node, distance, False
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[own], far[own], done[own] = (np.take_along_axis(x, order, axis=1) for x in (all_ids, all_far, all_done))
        active = active[~done[active].all(axis=1)]
    row, node = (np.concatenate(x) for x in zip(*trail, strict=True))
    left = ~(ids[row] == node[:, None]).any(axis=1)
    row, node = row[left], node[left]
    order = np.argsort(row, kind="stable")
    row, node = row[order], node[order]
    several = np.bincount(row, minlength=count)
    passed = np.full((count, several.max(initial=0)), -1, np.int32)
    passed[row, np.arange(len(row)) - (np.cumsum(several) - several)[row]] = node
    return ids, passed


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node at most ``degree`` diverse neighbours of its candidates (-1: none), which are distinct.

    The nearest candidate is kept, and those drop out that are ``alpha`` times nearer to it than to the node, and so on.
    """
    apart = points[candidates] - points[nodes][:, None]  # what lies close is compared at its own scale
    distances = np.where(candidates < 0, np.float32(np.inf), np.einsum("ikj,ikj->ik", apart, apart))
    order = np.argsort(distances, axis=1, kind="stable")
    candidates, distances = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(distances, order, axis=1)
    apart = np.take_along_axis(apart, order[:, :, None], axis=1)
    squares = np.einsum("ikj,ikj->ik", apart, apart)
    between = np.maximum(squares[:, :, None] + squares[:, None, :] - 2 * (apart @ apart.transpose(0, 2, 1)), 0) * np.float32(alpha * alpha)
    alive, rows = candidates >= 0, np.arange(len(candidates))
    kept = np.full((len(candidates), degree), -1, np.int32)
    for k in range(degree):
        star = alive.argmax(axis=1)
        some = alive[rows, star]
        if not some.any():
            break
        kept[some, k] = candidates[some, star[some]]
        alive &= between[rows, star] > distances
        alive[rows, star] = False
    return kept


class Graph:
    """Nodes of a shard, scaled to a greatest length of 1 and lifted by the component that makes inner products distances."""

    def __init__(self, vectors: np.ndarray):
        size = np.abs(vectors).max(axis=1)
        lengths = size * np.sqrt(((vectors / size[:, None]) ** 2).sum(axis=1))
        unit = vectors / lengths.max()
        rest = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
        self.points = np.hstack([unit, rest[:, None]]).astype(np.float32)
        self.links = np.full((len(vectors), ROOM), -1, np.int32)
        middle = ((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1).argmin()
        order = np.random.default_rng(SEED).permutation(len(vectors))
        longest = np.lexsort((order, -lengths))[: ENTRIES // 2]
        first = np.unique(np.r_[middle, longest])
        self.order = np.r_[first, order[~np.isin(order, first)]].astype(np.int32)  # in which nodes enter the graph
        self.entries = self.order[:ENTRIES]

    def together(self) -> int:
        return max(16, min(BATCH, SEEN_CELLS // len(self.points)))

    def build(self) -> None:
        count, order = len(self.points), self.order
        at = min(count, BUILD_BEAM)
        first = np.tile(order[:at], (at, 1))
        first[np.arange(at), np.arange(at)] = -1  # a node is no neighbour of its own
        self._link(order[:at], first)
        while at < count:
            batch = order[at : at + min(self.together(), at)]
            # what was passed on the way leads out of groups of near copies, which may fill the whole beam
            self._link(batch, np.hstack(beam_search(self.points, self.links, self.entries, self.points[batch], BUILD_BEAM)))
            at += len(batch)

    def _link(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        kept = robust_prune(self.points, nodes, candidates, DEGREE, ALPHA)
        self.links[nodes, :DEGREE] = kept
        r, c = np.nonzero(kept >= 0)
        back, new = kept[r, c], nodes[r]
        fresh = ~(self.links[back] == new[:, None]).any(axis=1)
        back, new = back[fresh], new[fresh]
        order = np.argsort(back, kind="stable")
        back, new = back[order], new[order]
        own, begin, several = np.unique(back, return_index=True, return_counts=True)
        held = (self.links[own] >= 0).sum(axis=1)
        fits = held + several <= ROOM
        lane, offset = np.repeat(np.arange(len(own)), several), np.arange(len(back)) - np.repeat(begin, several)
        easy = fits[lane]
        self.links[back[easy], (held[lane] + offset)[easy]] = new[easy]
        for full in self._alike(np.flatnonzero(~fits), several):
            wide = np.full((len(full), ROOM + several[full].max()), -1, np.int32)
            wide[:, :ROOM] = self.links[own[full]]
            for i, k in enumerate(full):
                wide[i, ROOM : ROOM + several[k]] = new[begin[k] : begin[k] + several[k]]
            self.links[own[full]] = -1
            self.links[own[full], :DEGREE] = robust_prune(self.points, own[full], wide, DEGREE, ALPHA)

    @staticmethod
    def _alike(full: np.ndarray, several: np.ndarray) -> Iterator[np.ndarray]:
        """The nodes to prune anew in parts of bounded memory, those with as many new edges together."""
        full = full[np.argsort(several[full], kind="stable")]
        while len(full):
            most = ROOM + several[full[: 1 << 8]].max()
            part = max(1, min(1 << 8, (1 << 22) // most**2))
            yield full[:part]
            full = full[part:]


def _vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    width, shard = (k.as_py() for k in key)
    table = table.combine_chunks()
    v = _vectors(table.column("v"), width)
    order = np.lexsort((*v.T[: min(width, 4)], np.array([i[0].as_py() for i in table.column("ids")])))  # the order of arrival must not matter
    table, v = table.take(pa.array(order)), v[order]
    graph = Graph(v)
    graph.build()
    held = (graph.links >= 0).sum(axis=1)
    links = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)], pa.int32()), pa.array(graph.links[graph.links >= 0], pa.int32()))
    flat = [pa.array(np.full(len(v), x), pa.int32()) for x in (width, shard)]
    position = pa.array(np.arange(len(v)), pa.int32())
    return pa.Table.from_arrays([*flat, position, table.column("ids"), table.column("v"), links], names=["width", "shard", "position", "ids", "v", "links"])


def usable(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def build_graph(rows: DataFrame, k: int = K, shards: int | None = None) -> DataFrame:
    """(width, shard, position, ids, v, links) of rows (vec_id, v): the graphs of all shards, a row for each node."""
    once = rows.select("vec_id", "v").dropDuplicates(["vec_id", "v"])
    smallest = once.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    nodes = stored(smallest.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    extent = nodes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if shards is None:
        n, size = extent["n"], 4 * (1 + (extent["width"] or 1) + ROOM)
        shards = max(1, math.ceil(math.sqrt(n / NODES)), math.ceil(n * size / SHARD_BYTES))
    dealt = nodes.select(F.size("v").alias("width"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "ids", "v").repartition(4 * shards, "width", "shard")
    graph = stored(dealt.groupBy("width", "shard").applyInArrow(_build, GRAPH))
    unstore(nodes)
    return graph


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each query, each once."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[new], ids[new], score[new]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], score[kept]


def _search(asked, k: int, beam: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        width = key[0].as_py()
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if width in asked.value:
            table = table.combine_chunks()
            table = table.take(pa.array(np.argsort(table.column("position").to_numpy())))
            v = _vectors(table.column("v"), width)
            graph = Graph(v)
            links = table.column("links").combine_chunks()
            held = np.diff(links.offsets.to_numpy())
            lane = np.repeat(np.arange(len(v)), held)
            graph.links[lane, np.arange(len(lane)) - np.repeat(np.cumsum(held) - held, held)] = links.flatten().to_numpy()
            ids = table.column("ids").combine_chunks()
            several, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            begin = np.cumsum(several) - several
            query_ids, queries = asked.value[width]
            scaled = queries / np.abs(queries).max(axis=1)[:, None]
            scaled = np.hstack([scaled / np.sqrt((scaled**2).sum(axis=1))[:, None], np.zeros((len(queries), 1))]).astype(np.float32)
            step = graph.together()
            for a in range(0, len(queries), step):
                nodes, _ = beam_search(graph.points, graph.links, graph.entries, scaled[a : a + step], beam)
                r, c = np.nonzero(nodes >= 0)
                node, r = nodes[r, c], r + a
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,ij->i", queries[r], v[node])
                copies = np.repeat(np.arange(len(node)), several[node])
                one = flat[np.repeat(begin[node], several[node]) + np.arange(len(copies)) - np.repeat(np.cumsum(several[node]) - several[node], several[node])]
                query, score = query_ids[r][copies], score[copies]
                other = one != query
                for column, part in zip(found, _best(query[other], one[other], score[other], k), strict=True):
                    column.append(part)
        return pa.table({"query_id": pa.array(np.concatenate(found[0]), pa.int64()), "vec_id": pa.array(np.concatenate(found[1]), pa.int64()), "score": pa.array(np.concatenate(found[2]), pa.float64())})

    return run


def search_graph(graph: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that searches of every shard find for queries (vec_id, v)."""
    spark = graph.sparkSession
    extent = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not extent["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = math.ceil(extent["n"] * extent["width"] * 8 / block_bytes)
    shards = graph.select("width", "shard").distinct().count()
    dealt = graph.repartition(4 * max(1, shards), "width", "shard").groupBy("width", "shard")
    found = []
    for block in range(blocks):
        taken = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).select("vec_id", "v", F.size("v").alias("width")).toArrow().combine_chunks()
        widths = taken.column("width").to_numpy()
        by_width = {}
        for width in np.unique(widths).tolist():
            part = taken.take(pa.array(np.flatnonzero(widths == width)))
            by_width[width] = (part.column("vec_id").to_numpy(), _vectors(part.column("v"), width))
        found.append(stored(dealt.applyInArrow(_search(spark.sparkContext.broadcast(by_width), k, beam), FOUND)))
    merged = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds, against all other rows."""
    rows = usable(vectors, is_query, id_col, vector_col)
    graph = build_graph(rows, k, shards)
    found = search_graph(graph, rows.filter("asked"), k, beam, block_bytes)
    unstore(graph)
    return found
