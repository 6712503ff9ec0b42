"""Exact top-k search with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments, and the mean and standard deviation of each segment are kept. With n
components in a segment, a squared distance is at least the sum of n ((mq - mx)^2 + (sq - sx)^2) over the segments; as
the squared norms are known, that is an upper bound on the inner product, the sum of n (mq mx + sq sx). A candidate is
dropped at the coarsest resolution whose bound cannot reach the query's k-th best score; the survivors of the finest
get their exact score.

The vectors that take part are stored once, floored. The stated queries are taken in blocks of bounded bytes, broadcast as
they are. A first pass over a seeded sample of the candidates, on the executors like the second, gives a lower bound on
each query's k-th score, its k-th best in the sample. In the second pass every task streams its candidates against the
block, raises the bounds as it goes, and sends on k rows a query at most.

Defined cases: rows with null id, and vectors that are null, empty or hold null or non-finite components, take no part;
vectors of another length are no candidates; an id that several rows bear counts once, with its best score; ties go to
the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns are
ignored. Scores are 64-bit integers; components past 2^31 / sqrt(length), whose products may exceed them, wrap around.
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

K, SCALE = 5, 256.0
LEVELS = (1, 4, 16)
#: Bytes of a broadcast block of queries (8 a component), and rows in the tiles that a task multiplies.
BLOCK_BYTES, TILE_QUERIES, TILE_ROWS = 8 << 20, 2_048, 1_024
#: Candidates expected in the sample that gives the first bounds.
SAMPLE_ROWS, SEED = 4_096, 20_240_117
#: Pairs whose exact scores are computed at a time.
CHUNK = 1 << 14
#: Up to this size of components, products summed in double are exact integers.
EXACT_DOUBLE = 1 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, asked, v): scaled and floored components of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col("_asked").alias("asked"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False))).select("vec_id", "asked", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")).alias("v"))


class Statistics:
    """Rows of vectors with their segment means and deviations, finest last; lengths are padded with zeros."""

    def __init__(self, rows: np.ndarray):
        finest = LEVELS[-1]
        width = -(-rows.shape[1] // finest) * finest
        self.rows = np.zeros((len(rows), width))
        self.rows[:, : rows.shape[1]] = rows
        self.levels = []
        for segments in LEVELS:
            cut = self.rows.reshape(len(rows), segments, width // segments)
            root = math.sqrt(width // segments)
            self.levels.append(np.hstack([cut.mean(axis=2) * root, cut.std(axis=2) * root]))
        self.norms = np.sqrt((self.rows**2).sum(axis=1))
        self.exact = bool(np.abs(self.rows).max(initial=0) <= EXACT_DOUBLE)

    def take(self, a: int, b: int) -> Statistics:
        part = object.__new__(Statistics)
        part.rows, part.norms, part.levels, part.exact = self.rows[a:b], self.norms[a:b], [x[a:b] for x in self.levels], self.exact
        return part


def survivors(queries: Statistics, rows: Statistics, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs whose score is at least ``least`` of the query."""
    slack = 1e-9 * queries.norms[:, None] * rows.norms[None, :] + 1e-6
    alive: np.ndarray | None = None
    at = None
    for q, x in zip(queries.levels, rows.levels, strict=True):
        if at is None:
            reach = q @ x.T + slack >= least[:, None]
            alive = reach if alive is None else alive & reach
            if alive.mean() < 0.05:  # few are left: go on with them alone
                at = np.nonzero(alive)
        else:
            a, b = at
            kept = (q[a] * x[b]).sum(axis=1) + slack[a, b] >= least[a]
            at = a[kept], b[kept]
    a, b = np.nonzero(alive) if at is None else at
    if queries.exact and rows.exact and len(a) * 4 > alive.size:
        scores = (queries.rows @ rows.rows.T)[a, b].astype(np.int64)
    else:
        kind = np.float64 if queries.exact and rows.exact else np.int64
        parts = [np.einsum("ij,ij->i", queries.rows[a[k : k + CHUNK]].astype(kind), rows.rows[b[k : k + CHUNK]].astype(kind)) for k in range(0, len(a), CHUNK)]
        scores = np.concatenate(parts or [np.zeros(0)]).astype(np.int64)
    kept = scores >= least[a]
    return a[kept], b[kept], scores[kept]


class Best:
    """The k best candidates of each query so far, and the score that a new one has to reach."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray):
        self.ids, self.k, self.least = ids, k, least.copy()
        self.query, self.row, self.score = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, query: np.ndarray, row_ids: np.ndarray, score: np.ndarray) -> None:
        other = row_ids != self.ids[query]
        q, r, s = np.r_[self.query, query[other]], np.r_[self.row, row_ids[other]], np.r_[self.score, score[other]]
        order = np.lexsort((-s, r, q))  # of one id, its best score
        q, r, s = q[order], r[order], s[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (r[1:] != r[:-1])] if len(q) else np.zeros(0, dtype=bool)
        q, r, s = q[new], r[new], s[new]
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])
        kept = place < self.k
        self.query, self.row, self.score = q[kept], r[kept], s[kept]


def search(queries: Statistics, best: Best, rows: Statistics, row_ids: np.ndarray) -> None:
    for a in range(0, len(rows.rows), TILE_ROWS):
        tile = rows.take(a, a + TILE_ROWS)
        for q in range(0, len(queries.rows), TILE_QUERIES):
            query, row, score = survivors(queries.take(q, q + TILE_QUERIES), tile, best.least[q : q + TILE_QUERIES])
            best.add(query + q, row_ids[a + row], score)


def by_length(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield ids[at], values[offsets[at][:, None] + np.arange(length)[None, :]]


def _arrays(ids: pa.Array, vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    return ids.to_numpy(zero_copy_only=False), flat, offsets - offsets[0]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates by inner product of the floored, scaled vectors."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors.withColumn("_asked", F.coalesce(is_query, F.lit(False))), id_col, vector_col))
    extent = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.max(F.size("v")).alias("width")).first()
    if not extent["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = math.ceil(extent["asked"] * extent["width"] * 8 / block_bytes)
    share = min(1.0, SAMPLE_ROWS / extent["n"])
    candidates = rows.select("vec_id", "v")
    sample = stored(candidates.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20))))
    found = []
    for block in range(blocks):
        table = rows.filter(F.col("asked") & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)).select("vec_id", "v").toArrow().combine_chunks()
        if not len(table):
            continue
        asked = spark.sparkContext.broadcast(list(by_length(*_arrays(table.column(0).chunk(0), table.column(1).chunk(0)))))
        first = _best(sample, asked, {}, k).filter(F.col("rank") == k).select("query_id", "score")
        # one number for each query of the block
        least = spark.sparkContext.broadcast({r["query_id"]: r["score"] for r in first.collect()})
        found.append(stored(candidates.mapInArrow(_scan(asked, least, k), SCORED)))
    merged = _ranked(reduce(DataFrame.unionByName, found), k)
    unstore(rows, sample)
    return merged


SCORED = "query_id long, vec_id long, score long"


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    one = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(rows: DataFrame, asked, least, k: int) -> DataFrame:
    return _ranked(rows.mapInArrow(_scan(asked, rows.sparkSession.sparkContext.broadcast(least), k), SCORED), k)


def _scan(asked, least, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for batch in batches:
            for ids, values in by_length(*_arrays(batch.column(0), batch.column(1))):
                width = values.shape[1]
                if width not in state:  # not before a batch has come: many tasks may have none
                    own = [(q, v) for q, v in asked.value if v.shape[1] == width]
                    state[width] = [(Statistics(v), Best(q, k, np.array([least.value.get(x, -(2.0**62)) for x in q.tolist()]))) for q, v in own]
                for queries, best in state[width]:
                    search(queries, best, Statistics(values), ids)
        for best in (best for several in state.values() for _, best in several):
            yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (best.ids[best.query], best.row, best.score)], names=["query_id", "vec_id", "score"])

    return run
