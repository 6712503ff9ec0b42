"""Connected components and the block-wise pair search that feeds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut


#: Tables of (node, smallest neighbour) up to this many rows, 16 bytes each, are broadcast.
BROADCAST_NODES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, component): each node that an edge names, with the smallest node of its component.

    Alternating large and small stars: edges are rewired to ever smaller neighbours until only stars are left, which
    takes about log n rounds. Each round is a partial minimum by key and a join with the minima, which are checkpointed
    first: they are broadcast while they are few, else both sides are dealt anew and Spark can split the edges of a hub.
    """
    stars = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _small(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = cut(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        small = large.join(_small(large.groupBy("a").agg(F.min("b").alias("low"))), "a")
        stars = cut(small.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(small.select("a", F.col("low").alias("b"))).filter("a <> b").distinct())
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
        if before == now:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _small(minima: DataFrame) -> DataFrame:
    minima = cut(minima)
    return F.broadcast(minima) if minima.count() <= BROADCAST_NODES else minima


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, at most one less than it has rows."""
    unseen = np.ones(len(linked), dtype=bool)
    edges = []
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not unseen[start]:
            continue
        unseen[start] = False
        queue = [start]
        while queue:
            k = queue.pop()
            new = np.flatnonzero(linked[k] & unseen)
            unseen[new] = False
            edges += [(k, x) for x in new.tolist()]
            queue += new.tolist()
    return edges


def spanning_across(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) edges of a spanning forest between the rows and the columns of a boolean matrix."""
    sides = linked, np.ascontiguousarray(linked.T)
    unseen = np.ones(linked.shape[0], dtype=bool), np.ones(linked.shape[1], dtype=bool)
    edges = []
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not unseen[0][start]:
            continue
        unseen[0][start] = False
        queue = [(0, start)]
        while queue:
            side, k = queue.pop()
            new = np.flatnonzero(sides[side][k] & unseen[1 - side])
            unseen[1 - side][new] = False
            edges += [(k, x) if side == 0 else (x, k) for x in new.tolist()]
            queue += [(1 - side, x) for x in new.tolist()]
    return edges


def by_key(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int, work: Callable[[tuple, dict[str, np.ndarray]], None]) -> Iterator[None]:
    """Call ``work(key, {column: values})`` for each run of rows with equal first ``keys`` columns (sorted by them).

    Yields after each batch, so that the caller can send off what has gathered.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and len(rest):
            table = pa.concat_tables([rest, table]).combine_chunks()
        values = [table.column(k).to_numpy() for k in range(keys)]
        changed = np.zeros(len(table) - 1, dtype=bool) if len(table) else np.zeros(0, dtype=bool)
        for v in values:
            changed |= v[1:] != v[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        if len(table):
            _each(table.slice(0, starts[-1]), values, starts, columns, work)
            rest = table.slice(starts[-1])
        yield
    if rest is not None and len(rest):
        _each(rest, [rest.column(k).to_numpy() for k in range(keys)], [0, len(rest)], columns, work)
    yield


def _each(table: pa.Table, values: list[np.ndarray], starts: list[int], columns: list[str], work) -> None:
    if not len(table):
        return
    data = {c: np.array(table.column(c).to_pylist(), dtype=object) if pa.types.is_binary(table.schema.field(c).type) or pa.types.is_list(table.schema.field(c).type) else table.column(c).to_numpy() for c in columns}
    for a, b in zip(starts, starts[1:], strict=False):
        work(tuple(v[a] for v in values), {c: x[a:b] for c, x in data.items()})
