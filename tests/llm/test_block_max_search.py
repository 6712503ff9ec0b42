"""Ranked search against SQL and plain loops; blocks against the best of all cuts."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA, DOCUMENTS, duck, same_as_sql

from quillspark.llm import block_max_search, queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(documents, items, k=20):
    """documents: (doc_id, text); items: {item_id: text}."""
    counts = [(i, Counter(words(t))) for i, t in documents]
    total, occurrences = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items.items():
        scored = []
        for i, c in counts:
            n = sum(c.values())
            score = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * total // occurrences))) for t, q in Counter(words(text)).items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_ranks_equal_sql(spark):
    same_as_sql(queries.op11_block_max_search(spark, str(DATA)), duck(DATA), queries.ORACLE_SQL["op11_block_max_search"])


@pytest.mark.parametrize("options", [{}, {"shard_documents": 37, "item_bytes": 300}])
def test_ranks_of_odd_texts(spark, options):
    rng = random.Random(6)
    vocabulary = ["a", "B", "b", "ß", "É", "the", "x1", "9", "日本", "w" * 300] + [f"t{k}" for k in range(60)]
    rows = [(k, "".join(rng.choice(vocabulary[: rng.choice([10, 70])]) + rng.choice([" ", "-", "\x00", "\n", "_", " "]) for _ in range(rng.randrange(40)))) for k in range(400)]
    rows += [(500, None), (None, "the ß"), (None, None), (501, ""), (502, "... --"), (503, "the " * 30_000), (7, rows[7][1]), (7, "the the ß")] + [(600 + k, "hot copy ß") for k in range(200)]
    items = {0: "the ß b B", 1: "the the the", 2: "hot COPY", 3: "none of it here", 4: "", 5: " ".join(vocabulary), 6: "日本 x1_9", 7: "ß"}
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCUMENTS).selectExpr("*", "1 AS n", "2 AS terms", "3 AS shard", "4 AS item_id").repartition(5)
    asked = spark.createDataFrame([(i, t) for i, t in items.items()] + [(8, None), (None, "the")], "item_id long, text string")
    found = block_max_search.rank(table, asked, **options)
    assert sorted(map(tuple, found.collect()), key=str) == brute_ranks(rows, items)
    assert block_max_search.rank(table.limit(0), asked).count() == 0 and block_max_search.rank(table, asked.limit(0)).count() == 0


def test_rows_of_one_item_are_one(spark):
    table = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (1, "b b"), (1, None)], "item_id long, text string")
    assert sorted(map(tuple, block_max_search.rank(table, asked).collect()), key=str) == brute_ranks([(1, "a b"), (2, "b"), (3, "c")], {1: "a b b"})


def cost(impacts, ends):
    begins = [0, *ends[:-1]]
    return sum(max(impacts[a:b]) * (b - a) + block_max_search.BLOCK_COST for a, b in zip(begins, ends, strict=True))


def test_blocks_cost_the_least():
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 900_000, size=n) * (rng.random(n) < 0.2) for n in (0, 1, 3, 4, 5, 90, 700, 33)] + [np.full(1500, 7)]
    for impacts, ends in zip(lists, block_max_search.block_ends(lists), strict=True):
        n, grain, longest = len(impacts), block_max_search.GRAIN, block_max_search.LONGEST * block_max_search.GRAIN
        best = {0: 0}
        for at in [*range(grain, n, grain), n] if n else []:
            best[at] = min(c + max(impacts[b:at]) * (at - b) + block_max_search.BLOCK_COST for b, c in best.items() if -(-(at - b) // grain) * grain <= longest)
        assert cost(impacts.tolist(), ends.tolist()) == best[n] if n else not len(ends)


def test_blocks_are_skipped():
    """Where one stretch of documents holds the best scores, few postings elsewhere are read."""
    n = 40_000
    rng = np.random.default_rng(1)
    terms, tfs = [], []
    for k in range(n):
        good = 20_000 <= k < 20_030
        terms.append(["common", "rare"] if good or k % 97 == 0 else ["common"])
        tfs.append([int(rng.integers(1, 3)) + 20 * good] + [5 * good + 1] * (len(terms[-1]) - 1))
    rows = pa.table({"doc_id": pa.array(range(n), pa.int64()), "n": pa.array([100] * n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.string())), "tfs": pa.array(tfs, pa.list_(pa.int32()))})
    shard = block_max_search.Shard(pa.Table.from_batches(list(block_max_search._shard_rows(0, rows, n, 100 * n))))
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype == bool:
                read.append(int(np.count_nonzero(key)))
            return np.asarray(super().__getitem__(key))

    shard.lists = {t: (o.view(Watched), *rest) for t, (o, *rest) in shard.lists.items()}
    found, scores = shard.best({"common": 10, "rare": 5_000}, 20, first_ranges=8)
    assert set(found.tolist()) <= set(range(20_000, 20_030)) and len(found) == 20
    assert sum(read) < 0.1 * (n + n // 97)
