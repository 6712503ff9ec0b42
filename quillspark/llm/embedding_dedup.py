"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length 1. A table has ``width`` hash functions floor((a . v + b) / cell) with Gaussian a; vectors
of one label that agree in all of them share a bucket. Cosines inside buckets are then computed in double precision and
a pair is linked at ``similarity`` or more, never below. Table width and number follow from the number of vectors, so
that a pair just at the threshold is found with probability ``recall`` and buckets of unlike vectors stay small.

Equal vectors of one label are one node with a number of copies. Buckets with one node end there. A bucket over
``BLOCK`` nodes is compared in pairs of blocks, each a task of its own. Two vectors are compared in the first table in
which they share a bucket and in no other; a bucket over ``BLOCK`` nodes that lies whole inside a bucket of an earlier
table is not dealt out at all. A unit sends on link counts and a spanning forest of its links, never all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with null label or id, link
with nothing and are kept; vectors of different length never link; repeated rows are vectors of their own; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, stored, unstore
from quillspark.llm.components import by_key, components, spanning, spanning_across

SIMILARITY, RECALL = 0.98, 0.9999
#: Width of a hash cell in units of the distance at the threshold.
CELL = 10.0
BLOCK = 2048
#: Rows of a block that are compared at a time; units up to so many pairs are compared before their earlier buckets are looked at.
STRIP, FEW_PAIRS = 256, 4096
SEED = 20240117


def collision(ratio: float) -> float:
    """Probability that two points at distance d share a cell of width ratio * d."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def tables_for(n: int, similarity: float, recall: float) -> tuple[int, int, float]:
    """(hash functions in a table, tables, cell width): unlike vectors, at distance sqrt 2, meet in about one of n cells."""
    near = math.sqrt(2 - 2 * similarity)
    cell = CELL * near
    width = max(4, math.ceil(math.log(max(n, 2)) / -math.log(collision(cell / math.sqrt(2)))))
    found = collision(CELL) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - found)), cell


def bucket_keys(unit: np.ndarray, labels: np.ndarray, width: int, tables: int, cell: float) -> np.ndarray:
    """n x tables keys of rows scaled to length 1."""
    rng = np.random.default_rng([SEED, unit.shape[1], width, tables])
    directions = rng.standard_normal((unit.shape[1], tables * width))
    cells = np.floor((unit @ directions + rng.uniform(0, cell, tables * width)) / cell).astype(np.int64).reshape(len(unit), tables, width)
    mixers = rng.integers(1, 2**62, width, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    with np.errstate(over="ignore"):
        keys = (cells.astype(np.uint64) * mixers).sum(axis=2, dtype=np.uint64)
        keys += (labels.astype(np.int64).astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(unit.shape[1])
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(32)
    return keys.astype(np.int64)


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``embeddings``."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )
    marked = rows.withColumn("node", F.when(usable, F.xxhash64("label", "v")))
    nodes = stored(marked.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")))
    width, tables, cell = tables_for(nodes.count(), similarity, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, copies, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2), batch.column(3).to_pylist()
            for length in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == length]
                x = np.array([vectors[k] for k in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = bucket_keys(x, labels[at], width, tables, cell)
                buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), copies.take(pa.array(at)), buckets, *[pa.array([row.tobytes() for row in rows], type=pa.binary()) for rows in (keys, x)]], names=["node", "copies", "keys", "marks", "unit"])

    keyed = stored(nodes.select("node", F.col("label").cast("bigint").alias("label"), "copies", "v").mapInArrow(hashed, "node long, copies long, keys array<long>, marks binary, unit binary"))
    placed = keyed.select("node", F.posexplode("keys").alias("place", "bucket"))
    # stored, so that the join deals both sides anew and Spark can split the rows of a hot bucket over tasks
    shared = stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    dealt = without_covered(keyed, shared, block)
    meeting = placed.join(dealt, "bucket")
    split = meeting.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.col("node"), F.col("blocks")).cast("int"))
    units = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "place", "own", "node")
    # of the keys only those of earlier tables travel along
    payload = units.join(keyed.select("node", "copies", "marks", "unit"), "node").withColumn("marks", F.substring("marks", F.lit(1), F.col("place") * 8))
    work = payload.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").select("bucket", "i", "j", "own", "node", "copies", "marks", "unit")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Links()
        for _ in by_key(batches, ["own", "node", "copies", "marks", "unit"], 3, lambda key, data: link_unit(data, key, similarity, found)):
            if found.size():
                yield found.batch()

    links = stored(work.mapInArrow(compared, "a long, b long, n long"))
    unstore(keyed, shared, dealt)
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    classes = components(links.filter("b is not null").select("a", "b"))
    firsts = classes.join(nodes.select("node", "first_id"), "node")
    lowest = firsts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    resolved = cut(
        nodes.select("node", "first_id", "copies")
        .join(classes.join(lowest, "component").select("node", "component_id"), "node", "left")
        .join(counts, "node", "left")
        .select("node", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    unstore(nodes, links)
    told = marked.select("vec_id", "node").join(resolved, "node", "left")
    return told.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def without_covered(keyed: DataFrame, shared: DataFrame, block: int) -> DataFrame:
    """The shared buckets but those over ``block`` nodes whose nodes all share one bucket of an earlier table too."""
    hot = shared.filter(F.col("n") > block).select("bucket")
    if hot.isEmpty():
        return shared
    placed = keyed.select("node", "keys", F.posexplode("keys").alias("place", "bucket")).join(hot, "bucket")
    earlier = placed.select("bucket", F.posexplode(F.slice("keys", F.lit(1), F.col("place"))).alias("table", "key"))
    covered = cut(earlier.groupBy("bucket", "table").agg((F.min("key") == F.max("key")).alias("one")).filter("one").select("bucket").distinct())
    return stored(shared.join(covered, "bucket", "left_anti"))


class Links:
    """Link counts (b null) and forest edges (n 0) that gather between batches."""

    def __init__(self):
        self.a, self.b, self.n = [], [], []

    def size(self) -> int:
        return len(self.a)

    def counts(self, nodes: np.ndarray, n: np.ndarray) -> None:
        some = np.flatnonzero(n)
        self.a += nodes[some].tolist()
        self.b += [None] * len(some)
        self.n += n[some].tolist()

    def edges(self, rows: np.ndarray, columns: np.ndarray, pairs: list[tuple[int, int]]) -> None:
        self.a += rows[[x for x, _ in pairs]].tolist() if pairs else []
        self.b += columns[[y for _, y in pairs]].tolist() if pairs else []
        self.n += [0] * len(pairs)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (self.a, self.b, self.n)], names=["a", "b", "n"])
        self.a, self.b, self.n = [], [], []
        return out


def link_unit(data: dict[str, np.ndarray], key: tuple, similarity: float, found: Links) -> None:
    """Links of one bucket, or of one pair of its blocks, between vectors that share no bucket of an earlier table."""
    _, i, j = key
    if len(data["node"]) < 2:
        return
    own, sizes = data["own"], np.array([len(u) for u in data["unit"]])
    marks = np.frombuffer(b"".join(data["marks"]), dtype=np.int64).reshape(len(own), -1)
    for size in set(sizes.tolist()):
        a, b = (np.flatnonzero((sizes == size) & (own == side)) for side in (i, j))
        if not len(a) or not len(b) or (i == j and len(a) < 2):
            continue
        few = len(a) * len(b) <= FEW_PAIRS
        if not few and ((marks[a] == marks[a[0]]).all(axis=0) & (marks[b] == marks[a[0]]).all(axis=0)).any():
            continue  # all have met before
        left, right = (np.frombuffer(b"".join(data["unit"][at]), dtype=np.float64).reshape(len(at), -1) for at in (a, b))
        if few:
            linked = left @ right.T >= similarity
            if linked.any():
                linked &= ~(marks[a, None, :] == marks[None, b, :]).any(axis=2)
        else:
            linked = np.ones((len(a), len(b)), dtype=bool)
            for start in range(0, len(a), STRIP):
                strip = slice(start, start + STRIP)
                for t in range(marks.shape[1]) if linked[strip].any() else ():
                    linked[strip] &= marks[a[strip], t, None] != marks[None, b, t]
                if linked[strip].any():
                    linked[strip] &= left[strip] @ right.T >= similarity
        if i == j:
            np.fill_diagonal(linked, False)
        copies, nodes = data["copies"], data["node"]
        found.counts(nodes[a], linked @ copies[b])
        if i == j:
            found.edges(nodes[a], nodes[a], spanning(linked))
        else:
            found.counts(nodes[b], copies[a] @ linked)
            found.edges(nodes[a], nodes[b], spanning_across(linked))
