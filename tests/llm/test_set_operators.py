"""Search, sharding, joins, mixing, embedding dedup and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import DATA, Classes, brute_jaccard, documents, duck, same_as_sql, words_of
from pyspark.sql import functions as F

from quillspark.llm import embedding_dedup, jaccard_join, mixing, queries, sharding, topk_segments

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k=5):
    usable = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in usable:
        if q % 50 == 0:
            best = {}
            for i, v in usable:
                if i != q and len(v) == len(qv):
                    best[i] = max(best.get(i, -(2**62)), int(qv @ v))
            out += [(q, rank, i, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k], 1)]
    return sorted(set(out))


def test_top_k_on_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall()
    assert sorted(map(tuple, queries.op1_topk_segments(spark, str(DATA)).collect())) == brute_top(rows)


def test_top_k_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=20)]) for k in range(1, 160)]
    rows += [(0, rows[3][1]), (200, rows[3][1]), (201, rows[3][1]), (202, rows[3][1]), (250, None), (300, []), (350, [1.0, None]), (400, [float("nan")] * 20), (450, [float("inf")] * 20), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (None, rows[0][1]), (550, [1e7] * 20)]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    found = topk_segments.top_k(table.selectExpr("*", "1 AS rank", "2 AS score", "3 AS asked", "4 AS v"), F.col("vec_id") % 50 == 0, block_bytes=400)
    assert sorted(map(tuple, found.collect())) == brute_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows])
    assert topk_segments.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def check_shards(rows, texts, shards=40):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - (min(counts.values()) if len(counts) == shards else 0) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is None:  # several texts
            continue
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return counts


def test_shards_on_whole_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    rows = queries.op4_balanced_shards(spark, str(DATA)).collect()
    assert len(rows) == 1000 and len(check_shards(rows, texts)) == 40
    homes = defaultdict(Counter)
    for r in rows:
        homes[texts[r["doc_id"]]][r["shard"]] += 1
    together = sum(c.most_common(1)[0][1] for c in homes.values() if sum(c.values()) > 1)
    assert together >= 0.95 * sum(sum(c.values()) for c in homes.values() if sum(c.values()) > 1)


def test_shards_of_odd_tables(spark):
    rows = [(k, "hot copy") for k in range(300)] + [(k, f"text {k % 150}") for k in range(300, 500)] + [(None, "x"), (None, None), (600, None), (601, ""), (602, ""), (0, "hot copy"), (603, "long " * 50000)]
    texts = dict(rows)
    found = sharding.shard(documents(spark, rows).selectExpr("*", "1 AS shard", "2 AS number", "3 AS peers", "4 AS ordinal", "5 AS draw"), shards=8).collect()
    assert len(found) == len(rows)
    assert len(check_shards(found, texts, 8)) == 8
    hot = Counter(r["shard"] for r in found if texts.get(r["doc_id"]) == "hot copy")
    assert sum(n for _, n in hot.most_common(5)) >= 0.8 * sum(hot.values())  # five shards are what it fills
    assert len(sharding.shard(documents(spark, rows[:3])).collect()) == 3
    assert sharding.shard(documents(spark, [])).count() == 0


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(k, f"text {k % 130}") for k in range(400)] + [(7, "text 7")] * 40 + [(None, None)] * 60 + [(None, "x")] * 3
    found = [sorted(map(tuple, sharding.shard(documents(spark, rows).repartition(n), shards=8).collect()), key=str) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_rounds_cut_fewer_edges_than_chance(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 1, 2, 3, 8, 20]) for _ in range(150)] + [1] * 300
    rows = [(k, f"text {g}") for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    edges, shards = sum(n * (n - 1) / 2 for n in sizes), 8
    keys = sharding.keyed(documents(spark, rows), shards)
    placed, cuts = sharding.propagated(sharding.with_peers(keys), len(rows) / shards, 8)
    held = Counter((r["group"], r["shard"]) for r in placed.collect())
    assert cuts[-1] == edges - sum(n * (n - 1) / 2 for n in held.values()) and cuts == sorted(cuts, reverse=True)
    assert 0.8 * edges * (1 - 1 / shards) < cuts[0] and cuts[-1] < 0.15 * cuts[0]  # where hashing puts the documents is chance
    texts = dict(rows)
    final = Counter((texts[r["doc_id"]], r["shard"]) for r in sharding.shard(documents(spark, rows), shards=shards).collect())
    assert edges - sum(n * (n - 1) / 2 for n in final.values()) < 0.25 * cuts[0]  # counts evened out


def near_copies(seed=5):
    rng = random.Random(seed)
    lexicon = [f"w{k}" for k in range(3000)]
    texts = {}
    for g in range(60):
        base = [rng.choice(lexicon) for _ in range(rng.randint(20, 300))]
        for c in range(rng.choice([1, 1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(lexicon)
            texts[len(texts)] = " ".join(copy)
    return texts


def test_jaccard_on_whole_table(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op6_jaccard_join(spark, str(DATA)).collect()}
    assert found == brute_jaccard(texts)
    same_as_sql(queries.op6_jaccard_join(spark, str(DATA)), duck(DATA), queries.JACCARD_SQL)


@pytest.mark.parametrize("settings", [{}, {"leaf": 4}])
def test_jaccard_of_near_copies(spark, settings):
    texts = near_copies()
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(documents(spark, list(texts.items())), **settings).collect()}
    expected = brute_jaccard(texts)
    linked = sum(n for _, n in expected.values())
    assert linked > 500 and sum(n for _, n in found.values()) >= 0.999 * linked
    assert all(found[k][1] <= expected[k][1] for k in texts)
    assert sum(found[k] == expected[k] for k in texts) >= 0.99 * len(texts)


def test_jaccard_runs_reach_their_recall():
    """Pairs at the threshold in paths that stay over the leaf size down to the largest depth."""
    rng = np.random.default_rng(3)
    places, depth, n = jaccard_join.PLACES, jaccard_join.DEPTH, 20_000

    def simulated(runs):
        agree = rng.random((n, places)) < 0.8
        found = np.zeros(n, dtype=bool)
        for r in range(runs):
            paths = agree[:, r * 17 % places].astype(int)
            for _ in range(depth - 1):
                # each shared path goes on by one token, a quarter of them by two
                tokens = paths + rng.binomial(paths, 0.25)
                paths = rng.binomial(tokens, agree.mean(axis=1))
            found |= paths > 0
        return (found & (agree.sum(axis=1) >= jaccard_join.LOOSE * places)).mean()

    for runs in (2, 5, 11):
        expected = jaccard_join.met(0.8, runs, depth)
        assert abs(simulated(runs) - expected) < 5 * (expected * (1 - expected) / n) ** 0.5
    runs = jaccard_join.runs_for(0.8, jaccard_join.RECALL, depth)
    assert jaccard_join.met(0.8, runs, depth) >= jaccard_join.RECALL > jaccard_join.met(0.8, 11, depth)


def test_jaccard_measured_recall_in_deep_paths(spark):
    """Pairs at 0.8 to 0.85 that share a passage with all others, in leaves of four sets."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(100)]
    texts = {}
    for g in range(400):
        own = passage + [f"g{g}w{k}" for k in range(150)]  # 246 shingles, of which 96 are everyone's
        texts[2 * g], texts[2 * g + 1] = " ".join(own), " ".join([*own, *(f"g{g}x{k}" for k in range(rng.randint(44, 61)))])
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_classes(documents(spark, list(texts.items())), leaf=4).collect()}
    expected = brute_jaccard(texts)
    assert set(expected.values()) == {(2 * g, 1) for g in range(400)}
    assert sum(found[k] == expected[k] for k in texts) >= 0.99 * len(texts)


def test_jaccard_of_odd_rows(spark):
    rows = [(1, "one two"), (2, "one  two"), (3, ""), (4, None), (5, ""), (None, "one two"), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "q " * 100000), (8, "q\tq\nq q q q")]
    docs = documents(spark, rows).selectExpr("*", "1 AS node", "2 AS class_id", "3 AS n_links")
    found = sorted((tuple(r) for r in jaccard_join.jaccard_classes(docs).collect()), key=str)
    assert found == sorted([(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0), (5, 5, 0), (None, None, 0), (6, 6, 1), (6, 6, 1), (7, 7, 1), (8, 7, 1)], key=str)
    kept = jaccard_join.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, None, 6, 6, 7]))
    assert jaccard_join.jaccard_classes(docs.limit(0)).count() == 0


def test_mixing_on_whole_table(spark):
    df = queries.op9_mix_sources(spark, str(DATA))
    same_as_sql(df, duck(DATA), queries.MIXING_SQL)
    rows = df.collect()
    assert sorted(rows) == sorted(queries.op9_mix_sources(spark, str(DATA)).collect()) and all(r["taken"] <= 3 * r["size"] for r in rows)


def test_mixing_of_odd_rows(spark):
    rows = [(k, "w " * 40, "a") for k in range(400)] + [(k, "v v", "b") for k in range(400, 450)] + [(500, None, "c"), (501, "", "d"), (502, "x y z", None), (None, "x y z", None), (0, "w " * 40, "a")]
    docs = documents(spark, rows).selectExpr("*", "'1' AS size", "'2' AS copies", "'3' AS target", "'4' AS rated_source", "'5' AS rate")
    planned = mixing.plan(docs).collect()
    assert len(planned) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    total, free = sum(sizes.values()), {s: w for s, w in zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)}
    targets = {}
    while True:
        left = total - sum(targets.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > 3 * sizes[s] + 1e-9]
        if not over:
            targets |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            targets[s] = 3.0 * sizes[s]
            del free[s]
    for r in planned:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["copies"] <= 3
    taken = sum(r["size"] * r["copies"] for r in planned if r["source"] == "a")
    assert taken == pytest.approx(targets["a"], rel=0.1)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in planned)
    assert {tuple(r)[5:] for r in mixed.collect()} == {("1", "2", "3", "4", "5")}
    assert mixing.plan(docs.limit(0)).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0


def brute_embeddings(rows, similarity=0.98):
    usable = [(k, r) for k, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    classes, links = Classes(range(len(rows))), [0] * len(rows)
    for label in {r[2] for _, r in usable}:
        for length in {len(r[1]) for _, r in usable}:
            at = [k for k, r in usable if r[2] == label and len(r[1]) == length]
            if at:
                x = np.array([rows[k][1] for k in at], dtype=np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for a, b in zip(*np.nonzero(np.triu(x @ x.T >= similarity, 1)), strict=True):
                    classes.join(at[a], at[b])
                    links[at[a]] += 1
                    links[at[b]] += 1
    least = {}
    for k, r in enumerate(rows):
        c = classes.find(k)
        least[c] = r[0] if c not in least or least[c] is None else min(least[c], r[0])
    return sorted(((r[0], links[k], least[classes.find(k)], r[0] is None or r[0] == least[classes.find(k)]) for k, r in enumerate(rows)), key=str)


def test_embedding_dedup_on_whole_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{DATA}/embeddings.parquet'").fetchall()
    df = queries.op10_embedding_dedup(spark, str(DATA))
    assert sorted(map(tuple, df.collect()), key=str) == brute_embeddings(rows)
    same_as_sql(df, duck(DATA), queries.EMBEDDING_SQL)


def test_embedding_sql_on_near_copies(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        base = rng.normal(size=16)
        rows += [(len(rows) + k, [float(x) for x in base + rng.normal(size=16) * 0.08], g % 2) for k in range(int(rng.integers(1, 9)))]
    rows += [(900, rows[0][1], rows[0][2]), (901, None, 1), (902, [0.0] * 16, 1), (903, rows[0][1], None)]
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = queries.op10_embedding_dedup(spark, str(tmp_path))
    same_as_sql(found, con, queries.EMBEDDING_SQL)
    assert found.filter("n_links > 1").count() > 50


def test_units_of_near_copies_meet_once():
    """Blocks of a tight cluster: links are counted in the first table that a pair shares, and nowhere else."""
    rng = np.random.default_rng(6)
    unit = rng.normal(size=48) + rng.normal(size=(300, 48)) * 0.03
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    keys = rng.integers(0, 2, size=(300, 3))
    totals = np.zeros(300, dtype=np.int64)
    for place in range(3):
        for value in (0, 1):
            at = np.flatnonzero(keys[:, place] == value)
            for i, j in ((0, 0), (0, 1), (1, 1)):
                kept = at[np.isin(at % 2, (i, j))]
                bytes_of = lambda rows: np.array([*(r.tobytes() for r in rows), None], dtype=object)[:-1]
                found = embedding_dedup.Links()
                embedding_dedup.link_unit({"own": kept % 2, "node": kept, "copies": np.ones(len(kept), dtype=np.int64), "marks": bytes_of(keys[kept, :place]), "unit": bytes_of(unit[kept])}, (0, i, j), 0.98, found)
                for a, b, n in zip(found.a, found.b, found.n, strict=True):
                    totals[a] += n if b is None else 0
    linked = (unit @ unit.T >= 0.98) & (keys[:, None, :] == keys[None, :, :]).any(axis=2)
    assert (totals == linked.sum(axis=1) - 1).all() and totals.sum() > 10_000


def test_covered_hot_buckets_are_left_to_the_earlier_table(spark):
    rows = [(k, [7, 8 if k < 30 else 9, 10]) for k in range(40)]
    keyed = spark.createDataFrame(rows, "node long, keys array<long>")
    shared = keyed.select(F.explode("keys").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    assert {r["bucket"] for r in embedding_dedup.without_covered(keyed, shared, 5).collect()} == {7}
    assert {r["bucket"] for r in embedding_dedup.without_covered(keyed, shared, 20).collect()} == {7, 9}
    assert {r["bucket"] for r in embedding_dedup.without_covered(keyed, shared, 50).collect()} == {7, 8, 9, 10}


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_dedup_of_near_copies(spark, block):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(80):
        base = rng.normal(size=32)
        for _ in range(int(rng.choice([1, 2, 5, 60], p=[0.4, 0.3, 0.2, 0.1]))):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=32) * rng.uniform(0, 0.15)], int(g % 3)))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(10)] + [(2000, rows[0][1], None), (2001, None, 1), (2002, [0.0] * 32, 1), (2003, [float("nan")] * 32, 1), (2004, [None] * 32, 1), (2005, [], 1), (2006, [1.0], 1), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    table = spark.createDataFrame([(i, v, y) for i, v, y in rows], VECTORS).selectExpr("*", "1 AS node", "2 AS kept")
    found = sorted(map(tuple, embedding_dedup.near_duplicates(table, block=block).collect()), key=str)
    expected = brute_embeddings(rows)
    assert len(found) == len(expected) and sum(a == b for a, b in zip(found, expected, strict=True)) >= 0.99 * len(rows)
    assert sum(r[1] for r in found) >= 0.999 * sum(r[1] for r in expected)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs.toPandas()]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(DATA))
        if k < len(cp.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = cp.stored(out)
            kept.append(docs.toPandas())
        else:
            last = out.toPandas()
    raw, gentle, lines, single, mixed = kept
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").fetchall())
    gone = set(raw.doc_id) - set(gentle.doc_id)
    clean = [k for k, y in labels.items() if y == 0]
    assert sum(k in gone for k in clean) <= 0.03 * len(clean)
    assert sum(k in gone for k, y in labels.items() if y == 1) >= 0.7 * sum(labels.values())
    assert sorted(lines.doc_id) == sorted(gentle.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    classes = brute_jaccard(dict(zip(lines.doc_id, lines.text, strict=True)))
    assert sorted(single.doc_id) == sorted({c for c, _ in classes.values()})
    copies = Counter(mixed.doc_id)
    assert set(copies) <= set(single.doc_id) and max(copies.values()) <= 3
    assert len(last) == len(mixed) and Counter(last.doc_id) == copies
    assert {len(x) for x in last.ids_sha256} == {len(hashlib.sha256().hexdigest())}


def test_pipeline_of_empty_and_null_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(1, None, "a"), (2, "", None), (None, "some text", "b"), (None, "some text", "b"), (3, "fine words here", "b")]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()} <= {1, 2, 3, None}
    documents(spark, []).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
