"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next reads it. All but the last return the
columns of documents.

Defined cases: null and empty texts pass every stage (not toxic, nothing to remove, near copies of nothing, as often as
their source is taken, no tokens); null ids and repeated rows are documents of their own, save that the join keeps or
drops the rows of an id together; an empty table gives an empty result; extra columns of any name pass all stages but the
last unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, line_dedup, mixing, toxicity
from quillspark.llm.common import stored, table
from quillspark.llm.queries import BPE_VOCABULARY, bpe_digests

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those given, doesn't predict toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sources share; only documents of nothing else keep them.

    ``n_chars`` is that of the cleaned text; other columns, those of clashing names included, stay as they are.
    """
    kept = [c for c in docs.columns if c in ("n_lines", "n_removed")]
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in kept})
    cleaned = line_dedup.remove_boilerplate(renamed).drop("n_lines", "n_removed").withColumnsRenamed({f"_own_{c}": c for c in kept})
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return jaccard_join.keep_one_of_each_class(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe_digests(docs, public_tokenizers.path(BPE_VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing", mixed),
    ("BPE", encoded),
]
#: Training a classifier and hashed paths are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
