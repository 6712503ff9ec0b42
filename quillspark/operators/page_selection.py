"""Which pages of a document are worth rendering: signals, scores with neighbours, and the cap on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the page score.
SKIP_FIRST, SKIP_LAST, SHORT_DOCUMENT = 1, 1, 3
VECTORS, IMAGE_RATIO, TEXT_COVERAGE = 50, 0.5, 0.30
LEAST_SCORE, MOST_PAGES = 3, 15


def page_signals(pages: DataFrame) -> DataFrame:
    """Adds text_coverage and largest_image_ratio from ``blocks`` and ``images``, arrays of boxes (x0, y0, x1, y1, ...).

    pages: (doc_id, page_idx, width, height, blocks with text, images); blank text blocks don't count.
    """
    area = F.aggregate(F.filter("blocks", lambda b: F.trim(b["text"]) != ""), F.lit(0.0), lambda n, b: n + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    widest = F.array_max(F.transform("images", lambda i: (i["x1"] - i["x0"]) / F.coalesce(F.nullif(F.col("width"), F.lit(0.0)), F.lit(1.0))))
    page_area = F.col("width") * F.col("height")
    return pages.withColumn("text_coverage", F.when(page_area > 0, F.coalesce(area, F.lit(0.0)) / page_area).otherwise(0.0)).withColumn("largest_image_ratio", F.greatest(F.coalesce(widest, F.lit(0.0)), F.lit(0.0)))


def scored_pages(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``score``; first and last pages of documents with over three pages score 0."""
    order = W.partitionBy(doc).orderBy("page_idx")
    told = F.col("has_keyword") | F.col("section_header_keyword")
    beside = lambda f: F.coalesce((F.abs(f("page_idx").over(order) - F.col("page_idx")) == 1) & f("told").over(order), F.lit(False))
    marked = pages.withColumn("told", F.coalesce(told, F.lit(False))).withColumn("total", F.count("*").over(W.partitionBy(doc)))
    near = marked.withColumn("near", beside(F.lag) | beside(F.lead))
    rules = [(F.col("has_keyword"), 3), (F.col("section_header_keyword"), 2), (F.col("vector_count") >= VECTORS, 2), (F.col("largest_image_ratio") >= IMAGE_RATIO, 2), (F.col("near"), 1)]
    points = sum((F.when(rule, n).otherwise(0) for rule, n in rules), F.lit(0))
    cover = (F.col("total") > SHORT_DOCUMENT) & ((F.col("page_idx") < SKIP_FIRST) | (F.col("page_idx") >= F.col("total") - SKIP_LAST))
    return near.withColumn("score", F.when(cover, 0).otherwise(points)).drop("told", "near", "total")


def selected_pages(pages: DataFrame, doc: str = "doc_id", most: int = MOST_PAGES) -> DataFrame:
    """Pages with score enough, the first ``most`` of each document, and whether to render them whole."""
    passed = scored_pages(pages, doc).filter(F.col("score") >= LEAST_SCORE)
    placed = passed.withColumn("place", F.row_number().over(W.partitionBy(doc).orderBy("page_idx"))).filter(F.col("place") <= most)
    whole = (F.col("text_coverage") <= TEXT_COVERAGE) | (F.col("largest_image_ratio") >= IMAGE_RATIO)
    return placed.withColumn("source", F.when(whole, "page_render").otherwise("embedded")).drop("place")


def digitized_totals(images: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document: images, successes, token sums, characters, digits and table rows of what was read from them."""
    text = F.coalesce("text", F.lit(""))
    return images.groupBy(doc).agg(
        F.count("*").alias("image_count"),
        F.count_if(text != "").alias("success_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum(F.length(text)).alias("total_chars"),
        F.sum(F.length(F.regexp_replace(text, "[^0-9]", ""))).alias("digit_chars"),
        F.sum(F.regexp_count(text, F.lit(r"\n\|"))).alias("table_rows"),
    )
