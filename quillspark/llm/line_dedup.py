"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Lines are hashed and first counted: one that stands in fewer rows than
``min_sites`` cannot reach it and gets no sketch. Of the others a HyperLogLog sketch of the sites is kept for each hash,
merged by aggregation where the lines are read, so that only sketches are shuffled. Estimates far from the threshold
decide by themselves, lines near it get an exact distinct count.

Boilerplate lines leave every document that has words in other lines too. A document of boilerplate lines alone is left
whole, for a near-duplicate join to reduce its copies to one.

Lines end at line feeds and are compared without surrounding spaces; blank lines are kept. Rows without a site add no
spread.

The keys of the boilerplate lines are broadcast while there are at most ``BROADCAST_LINES`` of them, and each text is
cleaned where it is read; beyond that, every document is joined with the boilerplate lines that it holds. Both ways give
the same rows.

Defined cases: a null text stays null and has no lines; an empty one stays empty; repeated rows count as one more
document of the same site and are cleaned alike; null ids are allowed; an empty table gives an empty result; other
columns pass through, and clashing ones (``n_lines``, ``n_removed``) are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import cut, stored, unstore

#: Sites that make a line boilerplate.
MIN_SITES = 10
#: Estimates within this part of the threshold are counted exactly: over 15 standard errors of a sketch of 2^12 registers.
NEAR, SKETCH_BITS = 0.25, 12
#: Tables of line keys (8 bytes each) up to this many rows are broadcast.
BROADCAST_LINES = 500_000
#: What a line of a document's own holds: a character that is no white space.
WORD = r"[^\x20\x09-\x0D]"


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def row_key() -> Column:
    """What the lines of a row are gathered by: equal for equal texts, which hold the same lines."""
    return F.xxhash64(F.md5("text"), "text")


def occurrences(documents: DataFrame, *columns: Column) -> DataFrame:
    """The columns and ``line_key`` for each line that is not blank."""
    lines = documents.select(*columns, F.explode(F.split("text", "\n", -1)).alias("_line")).filter(F.trim("_line") != "")
    return lines.withColumn("line_key", line_key(F.col("_line"))).drop("_line")


def only(rows: DataFrame, keys: DataFrame, broadcast_lines: int) -> DataFrame:
    """The rows with one of the line keys. Many keys are met by shuffle; stored, so that Spark can split a hot line over tasks."""
    if keys.count() <= broadcast_lines:
        return rows.join(F.broadcast(keys), "line_key", "left_semi")
    return stored(rows.join(keys, "line_key", "left_semi"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """(line_key) of the lines that stand on ``min_sites`` sites at least. lines: (site, line_key), without null sites."""
    frequent = cut(lines.groupBy("line_key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("line_key"))
    placed = only(lines, frequent, broadcast_lines)
    spread = cut(placed.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites")))
    far = spread.filter(F.col("sites") > min_sites * (1 + NEAR)).select("line_key")
    near = spread.filter(F.col("sites").between(min_sites * (1 - NEAR), min_sites * (1 + NEAR))).select("line_key")
    exact = only(placed, near, broadcast_lines).groupBy("line_key").agg(F.countDistinct("site").alias("sites"))
    return far.unionByName(exact.filter(F.col("sites") >= min_sites).select("line_key"))


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The documents with ``text`` cleaned, ``n_lines`` and ``n_removed`` added."""
    documents = documents.drop("n_lines", "n_removed")
    lines = stored(occurrences(documents.filter(F.col(site_col).isNotNull()), F.col(site_col).cast("string").alias("site")))
    bad = cut(boilerplate(lines, min_sites, broadcast_lines))
    unstore(lines)
    if bad.count() <= broadcast_lines:
        return cleaned_in_place(documents, [r["line_key"] for r in bad.collect()])
    return cleaned_by_join(documents, bad)


def cleaned_in_place(documents: DataFrame, bad_lines: list[int]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(bad_lines))
    at = documents.columns.index("text")
    own_words = re.compile(WORD)
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]

    def key(line: str) -> int:
        k = xxhash.xxh64_intdigest(line.strip(" ").encode(), seed=42)  # what xxhash64 of Spark gives
        return k - (1 << 64) if k >> 63 else k

    def clean(text: str | None, bad: frozenset[int]) -> tuple[str | None, int, int]:
        if text is None:
            return None, 0, 0
        lines = text.split("\n")
        gone = [bool(line.strip(" ")) and key(line) in bad for line in lines]
        removed = sum(gone)
        if not removed or not any(own_words.search(line) for line, g in zip(lines, gone, strict=True) if not g):
            return text, len(lines), 0
        return "\n".join(line for line, g in zip(lines, gone, strict=True) if not g), len(lines), removed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = shared.value
        for batch in batches:
            rows = [clean(t, bad) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([r[0] for r in rows], type=pa.string())
            columns += [pa.array([r[k] for r in rows], type=pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_lines", "n_removed"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *counts]))


def cleaned_by_join(documents: DataFrame, bad: DataFrame) -> DataFrame:
    """For more boilerplate lines than can be broadcast. Names of our own keep all columns of the documents apart."""
    row, held_key, held = (f"_{uuid.uuid4().hex}" for _ in range(3))
    split = F.split("text", "\n", -1)
    # equal texts are one row key, so a text in a third of all rows is a few rows here
    met = occurrences(documents.select("text", row_key().alias(held_key)), F.col(held_key)).distinct()
    lines = stored(met).join(bad, "line_key").groupBy(held_key).agg(F.collect_set("line_key").alias(held))
    # stored, so that the join deals both sides anew and Spark can split the rows of a hot text over tasks
    joined = documents.withColumn(row, row_key()).join(stored(lines), F.col(row) == F.col(held_key), "left")

    def removed(line: Column) -> Column:
        return (F.trim(line) != "") & F.array_contains(held, line_key(line))

    accompanies = F.coalesce(F.col(held).isNotNull() & F.exists(split, lambda line: ~removed(line) & line.rlike(WORD)), F.lit(False))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(split)), F.lit(0)).cast("bigint")
    marked = joined.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(accompanies, F.size(F.filter(split, removed))).otherwise(0).cast("bigint"))
    cleaned = F.when(F.col("n_removed") > 0, F.array_join(F.filter(split, lambda line: ~removed(line)), "\n")).otherwise(F.col("text"))
    return marked.withColumn("text", cleaned).select(*documents.columns, "n_lines", "n_removed")
