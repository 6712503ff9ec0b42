"""How far the numbers of an analysis stand in its sources, and how complete its documents are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import number_tokens

PARTS = ("md_only", "chart_only", "both", "neither")


def grounded(rows: DataFrame) -> DataFrame:
    """(report_id, report_type, analysis, body, charts) -> counts of the analysis' numbers by where they stand."""
    told = rows.select(
        "report_id",
        F.coalesce("report_type", F.lit("unknown")).alias("report_type"),
        *[F.coalesce(number_tokens(c), F.array().cast("array<string>")).alias(c) for c in ("analysis", "body", "charts")],
    )
    in_charts = F.array_intersect("analysis", "charts")
    in_body = F.array_intersect("analysis", "body")
    size = lambda c: F.size(c).cast("bigint")
    return told.select(
        "report_id",
        "report_type",
        size(F.col("analysis")).alias("layer2_total"),
        size(F.array_except(in_body, "charts")).alias("md_only"),
        size(F.array_except(in_charts, "body")).alias("chart_only"),
        size(F.array_intersect(in_body, "charts")).alias("both"),
        size(F.array_except(F.array_except("analysis", "body"), "charts")).alias("neither"),
    )


def grounding_by_type(counted: DataFrame) -> DataFrame:
    """Reports and per cent of numbers in each part, by type."""
    total = F.sum("layer2_total")
    share = lambda c: F.coalesce(F.round(F.sum(c) * 100 / F.nullif(total, F.lit(0)), 2), F.lit(0.0)).alias(f"{c}_pct")
    return counted.groupBy("report_type").agg(F.count("*").alias("n_reports"), total.alias("layer2_total"), *[share(c) for c in PARTS])


def step_grounding(documents: DataFrame, steps: list[str]) -> DataFrame:
    """Per wanted step: how many, how many per cent hold a number, their numbers, and how many of those stand in ``body``.

    documents: (report_id, chain array of (step, text), body).
    """
    told = documents.select("body", F.explode("chain").alias("s")).filter(F.col("s.step").isin(steps) & (F.coalesce("s.text", F.lit("")) != ""))
    numbers = lambda c: F.coalesce(number_tokens(c), F.array().cast("array<string>"))
    counted = told.select(F.col("s.step").alias("step"), numbers("s.text").alias("own"), numbers("body").alias("source"))
    sized = counted.select("step", F.size("own").cast("bigint").alias("n"), F.size(F.array_intersect("own", "source")).cast("bigint").alias("grounded"))
    pct = lambda part, whole: F.coalesce(F.round(part * 100 / F.nullif(whole, F.lit(0)), 1), F.lit(0.0))
    total = F.sum("n")
    return sized.groupBy("step").agg(
        F.count("*").alias("n_steps"), pct(F.count_if(F.col("n") > 0), F.count("*")).alias("with_number_pct"), total.alias("n_numbers"), pct(F.sum("grounded"), total).alias("grounded_pct"), pct(total - F.sum("grounded"), total).alias("ungrounded_pct")
    )


def fill_rates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, filled, pct): how often each field is told, in one pass."""
    n = F.count("*")
    told = rows.agg(*[F.count(F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))).alias(f) for f in fields], n.alias("n_rows"))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in fields])
    return told.select(F.explode(pairs).alias("p"), "n_rows").select("p.field", "p.filled", F.round(F.col("p.filled") * 100 / F.nullif(F.col("n_rows"), F.lit(0)), 2).alias("pct"))


def key_histogram(rows: DataFrame, column: str, most: int = 15) -> DataFrame:
    """The most frequent keys of a map column."""
    return rows.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "key").limit(most)


def document_text(document: Column | str) -> Column:
    """All told texts of a structured analysis."""
    d = F.col(document) if isinstance(document, str) else document
    return F.concat_ws(" ", d["thesis"]["summary"], F.array_join(F.transform(d["chain"], lambda s: s["text"]), " "), F.array_join(F.map_values(d["financials"]["key_metrics"]), " "))


def date_repair(rows: DataFrame, threshold: int = 90) -> DataFrame:
    """(stored, found) days -> same, update, miss or diff when they are too far apart to be believed."""
    gap = F.abs(F.datediff("found", "stored"))
    return rows.withColumn("gap", gap).withColumn("class", F.when(F.col("found").isNull(), "miss").when(F.col("gap") == 0, "same").when(F.col("gap") > threshold, "diff").otherwise("update"))


def arbitrated_date(rows: DataFrame, near: int = 3) -> DataFrame:
    """(stored, found, message_day) with ``chosen``, its ``source`` and the ``outcome``.

    The found day counts if it is within ``near`` days of the message's, else the message's does, whatever is stored. Without
    a message's day nothing is chosen.
    """
    close = F.coalesce(F.abs(F.datediff("found", "message_day")) <= near, F.lit(False))
    known = F.col("message_day").isNotNull()
    chosen = F.when(known & close, F.col("found")).otherwise(F.col("message_day"))
    outcome = F.when(~known, "not_found").when(F.col("chosen").eqNullSafe(F.col("stored")), "no_change").otherwise("update")
    return rows.withColumn("chosen", chosen).withColumn("source", F.when(known, F.when(close, "regex").otherwise("msg"))).withColumn("outcome", outcome)
