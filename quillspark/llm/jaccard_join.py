"""N-gram Jaccard join by chosen paths.

Documents are sets of hashed shingles of five words. Sets split recursively: at each node of a path a shared token is
sampled, the one that a fixed random order of tokens puts first in the set (its minhash), and sets that sample the same
token go on together. A node with one set ends; one with up to ``leaf`` sets, or at the largest depth, is searched by
brute force. Each run takes other orders; runs repeat until a pair just at the threshold has been met with probability
``recall``. At the deeper nodes a second token is followed with probability 1 / similarity - 1, so that a pair at the
threshold is expected to stay together on one path.

What leaves share is only candidates: their minhashes must agree in ``LOOSE`` of all places, and a spanning forest of
such pairs is kept. In each component of candidates every pair of sets is then compared exactly, by the products of
0/1 matrices over shared shingles; large components are compared in pairs of packed blocks, each a task of its own.
Only link counts and spanning forests are sent on, so no step makes all pairs of a group.

Documents with equal sets are one node with a number of copies; two sets never link below the threshold. Nodes are
known by 64 bits of a hash of their set.

Defined cases: a text of one to four words is one shingle; null and empty texts have none and link with nothing, nor do
rows with null id; all of these are classes of their own (null for a null id); repeated rows are copies; an empty table
gives an empty result; extra columns are ignored; texts are compared whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_batches, stored, unstore
from quillspark.llm.components import by_key, components, spanning
from quillspark.llm.embedding_dedup import Links

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
PLACES, LEAF, DEPTH, LOOSE = 64, 512, 4, 0.62
#: A block holds about this many sets and shingles at most; one larger set makes a block of its own.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000
#: Candidate nodes up to this many (six numbers, about 50 bytes each) are broadcast to the second scan of the texts, else joined by shuffle.
BROADCAST_NODES = 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CACHED_WORDS = 100_000
#: Rows of a block that are decided at a time.
STRIP = 256
SEED = 7919


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(word) <= 48:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    found = WORD.findall(text or "") if any(c in (text or "") for c in "\x1c\x1d\x1e\x1f\x85\xa0") or not (text or "").isascii() else (text or "").split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(found))
    with np.errstate(over="ignore"):
        h, total = _mix(h), np.full(len(h) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
        return np.unique(_mix(total))


def set_hash(s: np.ndarray) -> int:
    """64 bits that depend on the set alone."""
    return xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) - (1 << 63)


#: Odd multipliers: the token order of each place.
ORDERS = np.random.default_rng(SEED).integers(1, 2**62, PLACES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(s: np.ndarray) -> np.ndarray:
    """For each place the smallest value of the set under that place's order of tokens."""
    out = np.full(PLACES, np.iinfo(np.uint32).max, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 512):  # products that stay in a core's cache
            out = np.minimum(out, ((s[None, k : k + 512] * ORDERS[:, None]).min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return out.view(np.int32)


def met(similarity: float, runs: int, depth: int, loose: float = LOOSE) -> float:
    """Probability that a pair at ``similarity`` shares a leaf of this depth in some run and passes the loose filter.

    All tokens come from the same places, so this averages over the number of places in which the minhashes agree.
    """
    total, both = 0.0, 1 / similarity - 1
    for agreed in range(math.ceil(loose * PLACES), PLACES + 1):
        p, onward = agreed / PLACES, 1.0
        for _ in range(depth - 1):
            onward = (1 - both) * p * onward + both * (1 - (1 - p * onward) ** 2)
        missed = sum(math.comb(agreed, k) * math.comb(PLACES - agreed, runs - k) * (1 - onward) ** k for k in range(runs + 1)) / math.comb(PLACES, runs)  # roots are distinct places
        total += math.comb(PLACES, agreed) * similarity**agreed * (1 - similarity) ** (PLACES - agreed) * (1 - missed)
    return total


def runs_for(similarity: float, recall: float, depth: int, loose: float = LOOSE) -> int:
    """Runs after which a pair at the threshold is met with probability ``recall``, in leaves of the largest depth.

    One run for each place where the loose filter keeps ``recall`` out of reach.
    """
    return next((n for n in range(1, PLACES) if met(similarity, n, depth, loose) >= recall), PLACES)


def fingerprints(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, n_shingles, minhash array) of every row with an id and a shingle at least."""
    rows = documents.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes, sizes, marks = [], [], [], []
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = shingles(text)
                if len(s):
                    ids.append(doc_id)
                    nodes.append(set_hash(s))
                    sizes.append(len(s))
                    marks.append(minhashes(s))
            values = pa.array(np.concatenate(marks) if marks else np.zeros(0, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(nodes, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * PLACES), values)],
                names=["doc_id", "node", "n_shingles", "minhash"],
            )

    return rows.mapInArrow(run, "doc_id long, node long, n_shingles long, minhash array<int>")


def leaves(nodes: DataFrame, runs: int, leaf: int, depth: int, similarity: float) -> DataFrame:
    """(path, node, n): the members of all leaves with two sets at least, n of them."""

    def token(path: Column, draw: int) -> Column:
        place = F.pmod(F.xxhash64(path, F.lit(draw)), F.lit(PLACES)).cast("int")
        return F.xxhash64(path, F.lit(draw), F.element_at("minhash", place + 1))

    roots = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, F.element_at("minhash", F.pmod(r * 17, F.lit(PLACES)).cast("int") + 1)))
    open_paths = nodes.select("node", F.explode(roots).alias("path"))
    done = None
    for level in range(1, depth + 1):
        # stored, so that the join deals both sides anew and Spark can split the rows of a hot path over tasks
        sizes = stored(open_paths.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"))
        members = stored(open_paths.join(sizes, "path"))
        ended = members if level == depth else members.filter(F.col("n") <= leaf)
        done = ended if done is None else done.unionByName(ended)
        if level == depth:
            break
        large = members.filter(F.col("n") > leaf).select("path", "node")
        if large.isEmpty():
            break
        second = F.pmod(F.xxhash64("path", F.lit("second")), F.lit(1000)) < int(1000 * (1 / similarity - 1))
        onward = F.when(second, F.array(token(F.col("path"), 1), token(F.col("path"), 2))).otherwise(F.array(token(F.col("path"), 1)))
        open_paths = large.join(nodes.select("node", "minhash"), "node").select("node", F.explode(onward).alias("path"))
    return done


def in_block_pairs(members: DataFrame, block: int, key: str) -> DataFrame:
    """Deal the members of each key into blocks and each pair of blocks into a unit (key, i, j)."""
    split = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.col("node"), F.col("blocks")).cast("int"))
    return split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")


def candidates(nodes: DataFrame, members: DataFrame, leaf: int, loose: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs in each leaf whose minhashes agree in ``loose`` of the places."""
    units = in_block_pairs(members, 4 * leaf, "path").join(nodes.select("node", "minhash"), "node")
    work = units.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j", "node").select("path", "i", "j", "own", "node", "minhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Links()

        def unit(key: tuple, data: dict[str, np.ndarray]) -> None:
            if len(data["node"]) < 2:
                return
            m = np.array(data["minhash"].tolist(), dtype=np.int32)
            n = len(m)
            agree = np.zeros((n, n), dtype=np.uint8)
            for k in range(PLACES):
                agree += m[:, k, None] == m[None, :, k]
            linked = agree >= loose * PLACES
            np.fill_diagonal(linked, False)
            if key[1] != key[2]:
                linked &= data["own"][:, None] != data["own"][None, :]
            found.edges(data["node"], data["node"], spanning(linked))

        for _ in by_key(batches, ["own", "node", "minhash"], 3, unit):
            if found.size():
                yield found.batch()

    return work.mapInArrow(run, "a long, b long, n long").select("a", "b")


def packed_blocks(documents: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(component, blocks, own, node array, copies array, sizes array, sets binary) of the shingle sets of all members.

    members: (doc_id, node, copies, component, n, total), doc_id being the one document that stands for the node.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    wanted = members.select("doc_id", "node", "copies", "component", blocks.alias("blocks")).withColumn("own", F.pmod(F.col("node"), F.col("blocks")).cast("int"))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(wanted, "doc_id")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # an id that several rows bear stands for the node of one of them: the others' sets differ
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            fits = pa.array([len(s) > 0 and set_hash(s) == node for s, node in zip(sets, batch.column("node").to_pylist(), strict=True)], type=pa.bool_())
            kept = batch.select(["component", "blocks", "own", "node", "copies"]).append_column("set", pa.array([s.tobytes() for s in sets], type=pa.binary()))
            yield kept.filter(fits)

    rows = texts.select("text", "component", "blocks", "own", "node", "copies").mapInArrow(shingled, "component long, blocks int, own int, node long, copies long, set binary")
    dealt = rows.repartition("component", "own").sortWithinPartitions("component", "own", "node")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def unit(key: tuple, data: dict[str, np.ndarray]) -> None:
            at = np.unique(data["node"], return_index=True)[1]  # repeated rows of one id
            sets = data["set"][at]
            out.append((key[0], data["blocks"][0], key[1], data["node"][at].tolist(), data["copies"][at].tolist(), [len(s) // 8 for s in sets], b"".join(sets)))

        for _ in by_key((b.select(["component", "own", "blocks", "node", "copies", "set"]) for b in batches), ["blocks", "node", "copies", "set"], 2, unit):
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
                for k in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out[k : k + 64], strict=True), kinds, strict=True)], names=["component", "blocks", "own", "nodes", "copies", "sizes", "sets"])
                out.clear()

    return dealt.mapInArrow(pack, "component long, blocks int, own int, nodes array<long>, copies array<long>, sizes array<long>, sets binary")


def exact_links(packed: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n): link counts (b null) and forest edges of all pairs of sets in each component."""
    units = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    work = units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own").select("component", "i", "j", "own", "nodes", "copies", "sizes", "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Links()
        for _ in by_key(batches, ["own", "nodes", "copies", "sizes", "sets"], 3, lambda key, data: compare(data, key[1] != key[2], similarity, found)):
            if found.size():
                yield found.batch()

    return work.mapInArrow(run, "a long, b long, n long")


def compare(data: dict[str, np.ndarray], across: bool, similarity: float, found: Links) -> None:
    nodes = np.concatenate([np.asarray(x, dtype=np.int64) for x in data["nodes"]])
    if len(nodes) < 2:
        return
    copies = np.concatenate([np.asarray(x, dtype=np.int64) for x in data["copies"]])
    sizes = np.concatenate([np.asarray(x, dtype=np.int64) for x in data["sizes"]])
    own = np.repeat(np.arange(len(data["nodes"])), [len(x) for x in data["nodes"]])
    tokens = np.frombuffer(b"".join(data["sets"]), dtype=np.uint64)
    rows = np.repeat(np.arange(len(nodes)), sizes)
    order = np.argsort(tokens, kind="stable")
    new = np.r_[True, np.diff(tokens[order].astype(np.uint64)) != 0]
    column = np.empty(len(tokens), dtype=np.int64)
    column[order] = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1  # a token of one set alone is in no intersection
    rows, column = rows[several], np.unique(column[several], return_inverse=True)[1]
    shared = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
    width = max(1, 2_000_000 // len(nodes))
    by_column = np.argsort(column, kind="stable")
    rows, column = rows[by_column], column[by_column]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(nodes), int(column[b - 1]) - start + 1), dtype=np.float32)
        part[rows[a:b], column[a:b] - start] = 1
        shared += part @ part.T
    linked = np.zeros(shared.shape, dtype=bool)
    counts = np.zeros(len(nodes), dtype=np.int64)
    for start in range(0, len(nodes), STRIP):  # decided in double precision, a strip of rows at a time
        strip = slice(start, start + STRIP)
        both = shared[strip].astype(np.float64)
        linked[strip] = both / (sizes[strip, None] + sizes[None, :] - both) >= similarity
        if across:
            linked[strip] &= own[strip, None] != own[None, :]
        at = np.arange(start, start + len(both))
        linked[at, at] = False
        counts[strip] = linked[strip] @ copies
    found.counts(nodes, counts)
    found.edges(nodes, nodes, spanning(linked))


def jaccard_classes(documents: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, leaf: int = LEAF, depth: int = DEPTH, loose: float = LOOSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document, with the smallest id of its class and its links."""
    with small_batches(documents.sparkSession):  # all Python work runs in here, as its results are stored
        resolved, prints = _linked_nodes(documents, similarity, recall, leaf, depth, loose, id_col, text_col)
    told = prints.join(resolved, "node").select("doc_id", "class_id", "n_links")
    linked = told.groupBy(F.col("doc_id").alias("linked_id")).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"))
    return rows.join(linked, rows["doc_id"] == linked["linked_id"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def _linked_nodes(documents: DataFrame, similarity: float, recall: float, leaf: int, depth: int, loose: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(node, class_id, n_links) of the nodes that have links, and (doc_id, node) of all documents."""
    prints = stored(fingerprints(documents, id_col, text_col))
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("minhash").alias("minhash")))
    members = leaves(nodes, runs_for(similarity, recall, depth, loose), leaf, depth, similarity)
    pairs = stored(candidates(nodes, members, leaf, loose))
    grouped = stored(components(pairs).join(nodes.select("node", "first_id", "copies", "n_shingles"), "node"))
    extent = grouped.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    wanted = stored(grouped.join(extent, "component").withColumnRenamed("first_id", "doc_id"))
    packed = stored(packed_blocks(documents, wanted, id_col, text_col))
    links = stored(exact_links(packed, similarity))
    counts = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    classes = components(links.filter("b is not null").select("a", "b")).join(nodes.select("node", "first_id"), "node")
    lowest = classes.groupBy("component").agg(F.min("first_id").alias("class_id"))
    resolved = stored(
        nodes.select("node", "first_id", "copies")
        .join(classes.join(lowest, "component").select("node", "class_id"), "node", "left")
        .join(counts, "node", "left")
        .select("node", F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .filter((F.col("n_links") > 0))
    )
    unstore(nodes, pairs, grouped, wanted, packed, links)
    return resolved, prints.select("doc_id", "node")


def keep_one_of_each_class(documents: DataFrame, **settings) -> DataFrame:
    """The documents but those that a class with a smaller id stands for; a repeated id keeps its rows together."""
    away = stored(jaccard_classes(documents, **settings).filter("class_id <> doc_id").select("doc_id").distinct())
    return documents.join(F.broadcast(away) if away.count() <= BROADCAST_NODES else away, "doc_id", "left_anti").select(*documents.columns)
