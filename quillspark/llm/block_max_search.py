"""Ranked lexical search over shards of an inverted index with blocks of variable length.

One pass counts each document's terms and keeps those that are asked for. A stretch of documents that a task reads is a
shard: its posting lists hold ordinals of documents and impacts, the part of a score that the document decides. Dynamic
programming cuts each list into blocks: of all boundaries at multiples of ``GRAIN`` postings it takes those with the least
sum of (block maximum - impact) over the postings and ``BLOCK_COST`` a block, blocks having ``GRAIN * LONGEST`` postings at
most. The index is a table with a row for each shard and term.

A search in a shard adds the block maxima of an item's terms to a bound for every range of documents between two ends of
blocks. Ranges are scored exactly from the highest bound on; those under the k-th best score so far are skipped, with
the blocks that lie in skipped ranges alone. So results are exact. The best of all shards are ranked together.

Weights need the documents that hold a term; they are summed from the index. Items are read to the driver in blocks of
bounded bytes, with one index of their terms for each block; ``build_index`` without terms holds all.

Defined cases: null texts have no terms; each row is a document, also where ids are repeated; equal scores go to the smaller
doc_id, null ids last; items with null id take no part, and rows of one item id are one item; an item without terms, or
without a document that scores above 0, has no rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, stored, unstore

K = 20
#: Postings between two possible block boundaries, and such pieces in the longest block.
GRAIN, LONGEST = 4, 64
#: What a block costs in units of impact; a posting's impact is below 10^6.
BLOCK_COST = 2_000_000
#: Documents of a shard.
SHARD_DOCUMENTS = 1 << 14
#: Bytes of the texts of items that are searched for together.
ITEM_BYTES = 4 << 20
#: Ranges that are scored before the others are compared with the k-th score.
FIRST_RANGES = 64

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
COUNTED = "doc_id long, n long, terms array<string>, tfs array<int>"
INDEX = "shard long, term string, ordinals array<int>, impacts array<int>, ends array<int>, maxima array<int>, ids array<long>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and everything beyond ASCII, with A-Z in lower case."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def _count_terms(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                found = terms_of(text.as_py())
                sizes.append(len(found))
                counts = Counter(found)
                wanted = counts.keys() if asked is None else counts.keys() & asked.value
                terms += wanted
                tfs += [counts[t] for t in wanted]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return run


def count_terms(documents: DataFrame, terms: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): the number of all terms of a document, and the counts of those asked for."""
    asked = None if terms is None else documents.sparkSession.sparkContext.broadcast(frozenset(terms))
    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count_terms(asked), COUNTED)


def block_ends(lists: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of impacts the ends of its blocks, all lists advancing together.

    A slot of the tables stands for a beginning of the last block, of which the ``LONGEST`` latest are open; it holds the
    cost before it, the maximum since and the number of postings since.
    """
    order = sorted(range(len(lists)), key=lambda k: -len(lists[k]))
    grains = [-(-len(lists[k]) // GRAIN) for k in order]
    if not grains or not grains[0]:
        return [np.zeros(0, np.int64) for _ in lists]
    count = len(order)
    parts = [np.arange(0, len(lists[k]), GRAIN) for k in order]
    peaks = np.concatenate([np.maximum.reduceat(lists[k], x) for k, x in zip(order, parts, strict=True) if len(x)]).astype(np.float64)
    sizes = np.concatenate([np.minimum(GRAIN, len(lists[k]) - x) for k, x in zip(order, parts, strict=True)]).astype(np.float64)
    first = np.cumsum(grains) - grains  # of each list, in peaks and sizes
    before, peak, held = np.full((LONGEST, count), np.inf), np.zeros((LONGEST, count)), np.zeros((LONGEST, count))
    cost, begins = np.zeros(count), []
    grains_left = np.array(grains)
    active = count
    for j in range(grains[0]):
        while active and grains_left[active - 1] <= j:
            active -= 1
        slot = j % LONGEST
        before[slot, :active], peak[slot, :active], held[slot, :active] = cost[:active], 0, 0
        np.maximum(peak[:, :active], peaks[first[:active] + j], out=peak[:, :active])
        held[:, :active] += sizes[first[:active] + j]
        total = before[:, :active] + peak[:, :active] * held[:, :active]
        best = total.argmin(axis=0)
        cost[:active] = total[best, np.arange(active)] + BLOCK_COST
        begins.append((j - (slot - best) % LONGEST).astype(np.int32))
    ends: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    for lane, k in enumerate(order):
        at, own = grains[lane], []
        while at > 0:
            own.append(min(at * GRAIN, len(lists[k])))
            at = int(begins[at - 1][lane])
        ends[k] = np.array(own[::-1], np.int64)
    return ends


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, in 64-bit integers."""
    m = 75 + (25 * n.astype(np.int64) * documents) // occurrences
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1_000 * tf + 12 * m)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in values])], pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _shard_rows(number: int, rows: pa.Table, documents: int, occurrences: int) -> Iterator[pa.RecordBatch]:
    ids, n = rows.column("doc_id").combine_chunks(), rows.column("n").to_numpy()
    order = np.argsort(ids.fill_null(np.iinfo(np.int64).max).to_numpy(), kind="stable")
    ordinal = np.empty(len(order), np.int64)
    ordinal[order] = np.arange(len(order))
    lists, tfs = rows.column("terms").combine_chunks(), rows.column("tfs").combine_chunks()
    lane = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    impact = impacts_of(tfs.flatten().to_numpy(), n[lane], documents, occurrences)
    by = np.lexsort((ordinal[lane], codes))
    codes, place, impact = codes[by], ordinal[lane][by], impact[by]
    cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])[1:] if len(codes) else []
    places, impacts = (np.split(x, cuts) if len(codes) else [] for x in (place, impact))
    ends = block_ends(impacts)
    maxima = [np.maximum.reduceat(v, np.r_[0, e[:-1]]) for v, e in zip(impacts, ends, strict=True)]
    none, count = [np.zeros(0, np.int64)], len(places)
    first = _lists([order], pa.int64())
    held = pa.ListArray.from_arrays(first.offsets, ids.take(pa.array(order)))
    empty = [_lists(none, pa.int32())] * 4
    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.string()), *empty, held], names=["shard", "term", "ordinals", "impacts", "ends", "maxima", "ids"])
    if count:
        columns = [_lists(x, pa.int32()) for x in (places, impacts, ends, maxima)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(count, number), pa.int64()), coded.dictionary.cast(pa.string()), *columns, _lists(none * count, pa.int64())], names=["shard", "term", "ordinals", "impacts", "ends", "maxima", "ids"])


def _index(documents: int, occurrences: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= most:
                rows = pa.Table.from_batches(held)
                yield from _shard_rows(number, rows.slice(0, most), documents, occurrences)
                number, held, count = number + 1, rows.slice(most).to_batches(), count - most
        if count:
            yield from _shard_rows(number, pa.Table.from_batches(held), documents, occurrences)

    return run


def build_index(counted: DataFrame, documents: int, occurrences: int, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """The index of ``count_terms``, stored by the caller: its shards follow how the rows are read."""
    return counted.mapInArrow(_index(documents, max(1, occurrences), shard_documents), INDEX)


class Shard:
    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        terms = rows.column("term").to_pylist()
        ids = rows.column("ids").combine_chunks()[terms.index(None)].values
        self.known = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy()
        parts = [rows.column(name).combine_chunks() for name in ("ordinals", "impacts", "ends", "maxima")]
        flat = [(p.offsets.to_numpy(), p.values.to_numpy()) for p in parts]
        self.lists = {t: tuple(values[offsets[k] : offsets[k + 1]] for offsets, values in flat) for k, t in enumerate(terms) if t is not None}

    def best(self, weights: dict[str, int], k: int, first_ranges: int = FIRST_RANGES) -> tuple[list, np.ndarray]:
        """Ordinals and scores of the k best documents, best first."""
        lists = [(w, *self.lists[t]) for t, w in weights.items() if w > 0 and t in self.lists]
        found, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        if not lists:
            return found, scores
        spans = [(ordinals[np.r_[0, ends[:-1]]], ordinals[ends - 1] + 1) for _, ordinals, _, ends, _ in lists]
        edges = np.unique(np.concatenate([x for span in spans for x in span]))
        change, covers = np.zeros(len(edges), np.int64), []
        for (w, _, _, _, maxima), (begin, end) in zip(lists, spans, strict=True):
            covers.append((np.searchsorted(edges, begin), np.searchsorted(edges, end)))
            np.add.at(change, covers[-1][0], w * maxima.astype(np.int64))
            np.subtract.at(change, covers[-1][1], w * maxima.astype(np.int64))
        bound = np.cumsum(change)  # of the documents from an edge to the next
        ranked = np.argsort(-bound, kind="stable")
        widths = np.diff(np.append(edges, len(self.ids)))
        at, step = 0, first_ranges
        while at < len(ranked) and bound[ranked[at]] >= least:
            chosen = np.zeros(len(edges), bool)
            part = ranked[at : at + step]
            chosen[part[bound[part] >= least]] = True
            inside = np.zeros(len(self.ids), bool)
            inside[edges[0] :] = np.repeat(chosen, widths)
            passed = np.r_[0, np.cumsum(chosen)]
            total = np.zeros(len(self.ids), np.int64)
            for (w, ordinals, impacts, ends, _), (begin, end) in zip(lists, covers, strict=True):
                alive = passed[end] > passed[begin]
                if not alive.any():
                    continue
                read = np.repeat(alive, np.diff(np.r_[0, ends]))
                place, impact = ordinals[read], impacts[read]
                wanted = inside[place]
                total[place[wanted]] += w * impact[wanted].astype(np.int64)  # a list holds a document once
            new = np.flatnonzero(total >= least)
            found, scores = np.r_[found, new], np.r_[scores, total[new]]
            order = np.lexsort((found, -scores))[:k]  # ordinals are in the order of ids
            found, scores = found[order], scores[order]
            if len(found) == k:
                least = max(least, int(scores[-1]))
            at, step = at + step, step * 4
        return found, scores


def _search(items, k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, out = Shard(rows), ([], [], [])
        for item, weights in items.value:
            found, scores = shard.best(weights, k)
            out[0].extend([item] * len(found))
            out[1].extend(int(shard.ids[f]) if shard.known[f] else None for f in found.tolist())
            out[2].extend(scores.tolist())
        return pa.table({name: pa.array(values, pa.int64()) for name, values in zip(("item_id", "doc_id", "score"), out, strict=True)})

    return run


def search_index(index: DataFrame, documents: int, items: list[tuple[int, Counter]], k: int = K) -> DataFrame:
    """(item_id, doc_id, score): the k best of every shard for items of bounded number, each with the counts of its terms."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted({t for _, counts in items for t in counts})], "term string")
    wanted = index.filter(F.col("term").isNull()).unionByName(index.join(F.broadcast(asked), "term", "left_semi"))  # terms of bounded items
    held = dict(index.join(F.broadcast(asked), "term", "left_semi").groupBy("term").agg(F.sum(F.size("ordinals"))).toArrow().to_pandas().itertuples(index=False))
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in held.items()}
    weighted = [(item, {t: c * weight[t] for t, c in counts.items() if t in weight}) for item, counts in items]
    return wanted.groupBy("shard").applyInArrow(_search(spark.sparkContext.broadcast(weighted), k), FOUND)


def rank(documents: DataFrame, items: DataFrame, k: int = K, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item."""
    spark = documents.sparkSession
    asked = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    blocks, found = math.ceil((size or 0) / item_bytes), []
    with small_batches(spark):
        for block in range(blocks):
            own: dict[int, Counter] = {}
            for row in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():  # item_bytes or so
                own.setdefault(row["item_id"], Counter()).update(t.decode("utf-8", "surrogatepass") for t in terms_of(row["text"]))
            counted = stored(count_terms(documents, {t.encode("utf-8", "surrogatepass") for c in own.values() for t in c}, id_col, text_col))
            whole = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("occurrences")).first()
            index = stored(build_index(counted, whole["documents"], whole["occurrences"] or 0, shard_documents))
            found.append(stored(search_index(index, whole["documents"], sorted(own.items()), k)))
            unstore(counted, index)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
