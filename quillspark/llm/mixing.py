"""Mixing sources to target weights.

Sizes are words, ``[^\\x20\\x09-\\x0D]+``. Sources in code-point order, null last, get the weights in turn and share the
whole size of the corpus by them; a target stops at ``cap`` times its source's size and the excess goes to the others
by weight until none is above. The repetition rate is target / source size: a document is taken floor(rate) times, and
once more if a number hashed from the seed, its id and its text falls under the fraction.

Defined cases: a null text has size 0 and, like an empty one, takes nothing; null sources form one source, the last;
rows repeated with id and text draw alike; an empty table gives an empty plan and an empty mix. A plan has columns of its
own only; a mix has the documents' columns as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut, stored, uniform

WORD = r"[^\x20\x09-\x0D]+"
#: Source tables up to this many rows are broadcast (about 50 bytes each); longer ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size) -> also target. One row a source: the only global order taken is over sources.

    Sources reach their caps in order of cap / weight. One is capped if, with all before it capped, the level of the
    remaining size to the remaining weight still lies above its own ratio.
    """
    ranked = sources.withColumn("position", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * F.lit(float(cap)))
    order = W.orderBy(F.col("limit") / F.col("weight"), "position")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy(F.lit(0))
    level = (F.sum(F.col("source_size").cast("double")).over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    marked = limited.withColumn("capped", level * F.col("weight") > F.col("limit"))
    free_size = F.sum(F.col("source_size").cast("double")).over(all_rows) - F.sum(F.when(F.col("capped"), F.col("limit")).otherwise(0.0)).over(all_rows)
    free_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(all_rows)
    return marked.select("source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(free_size * F.col("weight") / free_weight).alias("target"))


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw_of(seed: str) -> Column:
    return uniform(seed, F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))


def rated(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, size) of documents -> (source, source_size, target, rate) of each source, broadcast while they are few."""
    told = cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    return (F.broadcast(told) if told.count() <= BROADCAST_SOURCES else told).withColumn("rate", rate)


def copies_of(rate: Column, draw: Column) -> Column:
    return F.floor(rate).cast("int") + (draw < rate - F.floor(rate)).cast("int")


def plan(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document. Texts are read once; sizes and draws are stored."""
    sized = stored(documents.select("doc_id", "source", size_of().alias("size"), draw_of(seed).alias("draw")))
    sources = rated(sized, weights, cap).withColumnRenamed("source", "rated_source")
    joined = sized.join(sources, F.col("source").eqNullSafe(F.col("rated_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies_of(F.col("rate"), F.col("draw")).alias("copies"))


def mix(documents: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as it is taken."""
    source, rate, copy = (f"_{uuid.uuid4().hex}" for _ in range(3))
    sources = rated(documents.select("source", size_of().alias("size")), weights, cap).select(F.col("source").alias(source), F.col("rate").alias(rate))
    joined = documents.join(sources, F.col("source").eqNullSafe(F.col(source)))
    taken = joined.withColumn(copy, copies_of(F.col(rate), draw_of(seed))).filter(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), copy))).select(*documents.columns)
