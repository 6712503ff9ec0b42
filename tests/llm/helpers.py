"""What several tests of the training-data operators share."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.01")
SMALL = Path("/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def duck(directory: Path):
    con = duckdb.connect()
    for t in "documents embeddings labels conversations benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet')")
    return con


def told(rows, names):
    """Rows as sorted tuples by column name, floats rounded."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(r[k], 7)) if isinstance(r[k], float) and math.isfinite(r[k]) else str(r[k]) for k in order) for r in rows)


def same_as_sql(df, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert told(df.collect(), df.columns) == told(result.fetchall(), names)


def documents(spark, rows):
    """rows: (doc_id, text, source) or (doc_id, text)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text, n=5):
    w = words_of(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


class Classes:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def find(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_jaccard(texts, similarity=0.8):
    """{id: (class, links)} by comparing every pair that shares a shingle. texts: {id: text}."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    classes, links = Classes(sets), dict.fromkeys(sets, 0)
    for a, s in sets.items():
        for b in {b for x in s for b in holders[x] if b > a}:
            both = len(s & sets[b])
            if both / (len(s) + len(sets[b]) - both) >= similarity:
                classes.join(a, b)
                links[a] += 1
                links[b] += 1
    return {k: (classes.find(k), links[k]) for k in sets}
