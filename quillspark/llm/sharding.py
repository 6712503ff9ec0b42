"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked; a group is a hub node that all its documents are neighbours of, so no pairs are
made. Every document starts in the shard that its id hashes to. In each round a group looks at the shards that hold most
of it, as many as its size needs, and its other documents ask to move there; a shard admits movers while documents with
neighbours do not fill its quota, by a hashed draw whose chance is the room left over the requests. After each round the
cut edges, pairs of neighbours in different shards, are counted from the sizes of the groups in each shard; a round that
leaves as many as before is taken back and is the last. At the end shards
over their quota give up their surplus, documents without neighbours first, to those under it, so that counts are at
most one apart (law ``rows``), and documents get gapless slots.

A hot group is spread over as many shards as it fills. Requests and loads are aggregated by (group, shard) before they
are shuffled; ranks are taken in buckets of about ``BUCKET_ROWS`` rows and shifted by the counts of those before, so no
shard or group has to fit into one task. Texts are read once; only keys and sizes move.

Defined cases: null texts have no neighbours, size 16 and checksum 0; empty texts are equal texts; null ids and
repeated rows are documents of their own, told apart by an ordinal among rows of equal id and text, so that the result
does not depend on how the rows are partitioned; with fewer documents than shards some shards stay empty; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import stored, unstore

SHARDS, ROUNDS, BUCKET_ROWS = 40, 8, 50_000
SIZE_BASE = 16


def keyed(documents: DataFrame, shards: int) -> DataFrame:
    """One narrow row for each document: id, size, checksum, group (null without text), number, draw, ordinal, first shard."""
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + SIZE_BASE).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.md5("text"), "text")).alias("group"),
        F.monotonically_increasing_id().alias("number"),
    )
    # the number only brings results back to their rows; draws depend on the document and its ordinal
    narrow = stored(rows.withColumn("draw", F.xxhash64("doc_id", "text_crc32", "group")))
    return stored(with_ordinals(narrow).withColumn("shard", F.pmod(F.xxhash64("draw", "ordinal"), F.lit(shards)).cast("int")))


def with_ordinals(rows: DataFrame) -> DataFrame:
    """Adds ``ordinal``: 0, 1, ... among rows of equal draw, which are alike, so that any order of them will do.

    Counted within the partitions that the numbers tell, then shifted by the counts of those before: a row that is
    repeated very often is never gathered in one task.
    """
    sliced = rows.withColumn("slice", F.shiftright("number", 33))
    counts = stored(sliced.groupBy("draw", "slice").agg(F.count("*").alias("n")))
    repeated = stored(counts.groupBy("draw").agg(F.sum("n").alias("n")).filter("n > 1").select("draw"))
    if repeated.isEmpty():
        return rows.withColumn("ordinal", F.lit(0).cast("bigint"))
    before = W.partitionBy("draw").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.join(repeated, "draw", "left_semi").select("draw", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = stored(sliced.join(repeated, "draw", "left_semi")).withColumn("inside", F.row_number().over(W.partitionBy("draw", "slice").orderBy("number")) - 1)
    told = inside.join(starts, ["draw", "slice"]).withColumn("ordinal", F.col("inside") + F.col("start"))
    return rows.join(repeated, "draw", "left_anti").withColumn("ordinal", F.lit(0).cast("bigint")).unionByName(told.select(*rows.columns, "ordinal"))


def cut_edges(rows: DataFrame) -> float:
    """Pairs of neighbours in different shards."""
    held = rows.filter(F.col("peers") > 1).groupBy("group", "shard").agg(F.count("*").cast("double").alias("n"))
    pairs = held.groupBy("group").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    return pairs.agg(F.sum("pairs").alias("cut")).first()["cut"] or 0.0


def homes_of_groups(linked: DataFrame, quota: float, salt: int) -> DataFrame:
    """(group, homes array): the shards that hold most of each group, as many as it fills, fullest first; ties by hash."""
    held = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
    ranked = W.partitionBy("group").orderBy(F.col("n").desc(), F.xxhash64("group", "shard", F.lit(salt)))
    placed = held.withColumn("total", F.sum("n").over(W.partitionBy("group"))).withColumn("order", F.row_number().over(ranked))
    homes = F.transform(F.array_sort(F.collect_list(F.struct("order", "shard"))), lambda h: h["shard"])
    return placed.filter(F.col("order") <= F.ceil(F.col("total") / F.lit(quota))).groupBy("group").agg(homes.alias("homes"))


def move(rows: DataFrame, quota: float, salt: int) -> DataFrame:
    """One round, stored: documents ask for a shard of their group and move where the quota admits them."""
    linked = rows.filter(F.col("peers") > 1)
    # a quota's worth of a large group for each of its homes, the rest for the last
    part = F.floor(F.pmod(F.xxhash64("draw", "ordinal", F.lit(salt)), F.col("peers")) / F.lit(quota)) + 1
    drawn = F.element_at("homes", F.least(part, F.size("homes")).cast("int"))
    wish = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(drawn)
    # stored, so that the join deals both sides anew and Spark can split the rows of a hot group over tasks
    homes = stored(homes_of_groups(linked, quota, salt))
    asking = stored(linked.join(homes, "group").withColumn("wish", wish).drop("homes"))
    demand = asking.groupBy("wish").agg(F.count(F.when(F.col("wish") == F.col("shard"), 1)).alias("staying"), F.count(F.when(F.col("wish") != F.col("shard"), 1)).alias("requests"))
    chance = F.greatest(F.lit(quota) - F.col("staying"), F.lit(0.0)) / F.greatest("requests", F.lit(1))
    draw = F.pmod(F.xxhash64("draw", "ordinal", F.lit(salt), F.lit("admit")), F.lit(1 << 30)) / float(1 << 30)
    admitted = asking.join(F.broadcast(demand.select("wish", chance.alias("chance"))), "wish")  # one row for each shard
    moved = admitted.withColumn("shard", F.when(draw < F.col("chance"), F.col("wish")).otherwise(F.col("shard")))
    after = stored(rows.filter(F.col("peers") <= 1).unionByName(moved.select(*rows.columns)))
    unstore(homes, asking)
    return after


def propagated(rows: DataFrame, quota: float, rounds: int) -> tuple[DataFrame, list[float]]:
    """The rows after at most so many rounds, and the cut edges before and after each that was kept."""
    cuts = [cut_edges(rows)]
    for salt in range(rounds):
        after = move(rows, quota, salt)
        now = cut_edges(after)
        unstore(after if now >= cuts[-1] else rows)
        if now >= cuts[-1]:
            break
        rows = after
        cuts.append(now)
    return rows, cuts


def ranks(rows: DataFrame, keys: list[str], n_rows: int, name: str, parts: int, first: Column | None = None) -> DataFrame:
    """Gapless ranks from 0 within ``keys``: by ``first``, then by hash bucket, then inside the bucket; groups that fit a bucket stay together."""
    buckets = max(1, n_rows // (parts * BUCKET_ROWS))
    order = first if first is not None else F.lit(0)
    unit = F.when(F.col("peers").between(2, BUCKET_ROWS), F.col("group")).otherwise(F.col("draw"))
    placed = rows.withColumn("rank_class", order).withColumn("unit", unit).withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit("bucket")), F.lit(buckets)))
    inside = placed.withColumn("inner_rank", F.row_number().over(W.partitionBy(*keys, "rank_class", "bucket").orderBy("unit", "draw", "ordinal")) - 1)
    sizes = placed.groupBy(*keys, "rank_class", "bucket").agg(F.count("*").alias("bucket_rows"))
    before = W.partitionBy(*keys).orderBy("rank_class", "bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("bucket_rows").over(before), F.lit(0))).drop("bucket_rows")
    return inside.join(starts, [*keys, "rank_class", "bucket"]).withColumn(name, F.col("inner_rank") + F.col("start")).drop("rank_class", "unit", "bucket", "inner_rank", "start")


def even_out(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Move the surplus of shards over their quota into the gaps of those under it. Quotas differ by one at most."""
    spark = rows.sparkSession
    quotas = spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.floor(F.lit(n_rows) / shards) + (F.col("id") < n_rows % shards).cast("int")).cast("bigint").alias("quota"))
    loads = quotas.join(rows.groupBy("shard").agg(F.count("*").alias("load")), "shard", "left").na.fill(0, ["load"])
    # documents without neighbours leave first, then those of groups that fill shards, then the others
    ranked = ranks(rows, ["shard"], n_rows, "place", shards, F.when(F.col("peers") <= 1, 2).when(F.col("peers") > n_rows / shards, 1).otherwise(0))
    order = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row for each shard
    offers = loads.select("shard", "quota", F.greatest(F.col("load") - F.col("quota"), F.lit(0)).alias("surplus"), F.greatest(F.col("quota") - F.col("load"), F.lit(0)).alias("gap"))
    offers = offers.withColumn("surplus_start", F.coalesce(F.sum("surplus").over(order), F.lit(0))).withColumn("gap_start", F.coalesce(F.sum("gap").over(order), F.lit(0)))
    offers = offers.orderBy("shard").collect()
    takers = [o for o in offers if o["gap"]]
    ticket = F.col("place") - F.element_at(F.array(*[F.lit(o["quota"] - o["surplus_start"]) for o in offers]), F.col("shard") + 1)
    over = F.col("place") >= F.element_at(F.array(*[F.lit(o["quota"]) for o in offers]), F.col("shard") + 1)
    if takers:
        starts, names = F.array(*[F.lit(o["gap_start"]) for o in takers]), F.array(*[F.lit(o["shard"]) for o in takers])
        at = F.size(F.filter(starts, lambda s: s <= F.col("ticket")))
        ranked = ranked.withColumn("ticket", ticket).withColumn("shard", F.when(over, F.element_at(names, at)).otherwise(F.col("shard")))
    return ranked.select(*rows.columns)


def shard(documents: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    keys = keyed(documents, shards)
    n_rows = keys.count()
    quota = max(1.0, n_rows / shards)
    rows, _ = propagated(with_peers(keys), quota, rounds)
    evened = stored(even_out(rows, n_rows, shards))
    placed = stored(ranks(evened, ["shard"], n_rows, "slot", shards).select("number", "shard", F.col("slot").cast("bigint").alias("slot")))
    unstore(rows, evened)
    return (
        keys.select("number", "doc_id", "size", "text_crc32")
        .join(placed, "number")
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )


def with_peers(keys: DataFrame) -> DataFrame:
    """(number, draw, ordinal, group, shard, peers), stored: peers are the documents of the row's group."""
    peers = stored(keys.filter(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("peers")).filter("peers > 1"))
    rows = stored(keys.join(peers, "group", "left").select("number", "draw", "ordinal", "group", "shard", F.coalesce("peers", F.lit(1)).alias("peers")))
    unstore(peers)
    return rows
