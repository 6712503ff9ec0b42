"""Checks and repairs of analysis payloads: JSON text in, clean mentions and a VARIANT document or the reason of rejection out.

Each text is parsed once. Fields that no rule touches go into the document as they came.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Categories, their Korean names, and qualities.
CATEGORIES = ("stock", "industry", "macro")
CATEGORY_NAMES = {"경제": "macro", "거시": "macro", "거시경제": "macro", "종목": "stock", "기업": "stock", "산업": "industry", "섹터": "industry"}
QUALITIES = ("high", "medium", "low", "truncated")
#: Fields of the mentions, and those of which one and one more have to be told, with the reason of dropping an item else.
ITEMS = {
    "stock_mentions": {"company_name": "string", "stock_code": "string", "mention_type": "string", "impact": "string", "relevance_score": "double"},
    "sector_mentions": {"sector": "string", "mention_type": "string", "impact": "string"},
    "keywords": {"keyword": "string", "keyword_type": "string"},
}
REQUIRED = {
    "stock_mentions": ((("company_name", "stock_code"), "dropped_missing_company_name"), (("mention_type",), "dropped_missing_mention_type")),
    "sector_mentions": ((("sector",), "dropped_missing_sector"), (("mention_type",), "dropped_missing_mention_type")),
    "keywords": ((("keyword",), "dropped_missing_keyword"),),
}
#: Fields of a payload that the stored document holds as they came, if they came.
UNTOUCHED = ("target", "opinion", "financials")


def _kind(v: Column, path: str) -> Column:
    """OBJECT, ARRAY, STRING, ... of the value at a path; VOID for a JSON null; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^([A-Z]+)", 1)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def sanitized(payloads: DataFrame) -> DataFrame:
    """(report_id, payload string) -> reject_reason, the repaired fields and ``corrections``: (field, reason) of repairs."""
    rows = payloads.withColumn("v", F.try_parse_json("payload"))
    v = F.col("v")
    category = F.lower(F.trim(_text(v, "$.report_category")))
    known = F.create_map(*[F.lit(x) for pair in ({c: c for c in CATEGORIES} | CATEGORY_NAMES).items() for x in pair])
    rows = rows.withColumns(
        {
            "root_kind": _kind(v, "$"),
            "category_kind": _kind(v, "$.report_category"),
            "category": F.try_element_at(known, category),
            "chain_kind": _kind(v, "$.chain"),
            **{f"{name}_kind": _kind(v, f"$.{name}") for name in ("stock_mentions", "sector_mentions", "keywords", "thesis", "meta", "extraction_quality")},
        }
    )

    def not_a_list(name: str) -> Column:
        return F.col(f"{name}_kind").isNotNull() & (F.col(f"{name}_kind") != "ARRAY")

    reason = (
        F.when(v.isNull(), "json_parse_failed")
        .when(F.col("root_kind") != "OBJECT", "not_a_dict")
        .when(F.col("category_kind").isNull() | (F.col("category_kind") == "VOID"), "missing_report_category")
        .when(F.col("category_kind") != "STRING", "report_category_not_string")
        .when(F.col("category").isNull(), "invalid_report_category")
        .when(F.col("chain_kind").isNull() | (F.col("chain_kind") == "VOID"), "missing_chain")
        .when(~F.col("chain_kind").isin("ARRAY", "OBJECT"), "chain_not_list_or_dict")
        .when(not_a_list("stock_mentions"), "stock_mentions_not_list")
        .when(not_a_list("sector_mentions"), "sector_mentions_not_list")
        .when(not_a_list("keywords"), "keywords_not_list")
    )
    confidence_kind = _kind(v, "$.category_confidence")
    given = F.when(confidence_kind.isNull(), F.lit(1.0)).otherwise(F.try_variant_get(v, "$.category_confidence", "double"))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(given, F.lit(1.0))))

    def items(name: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

    def why_dropped(name: str):
        def reason_of(item: Column) -> Column:
            said = F.when(_kind(item, "$") != "OBJECT", "dropped_non_dict")
            for fields, why in REQUIRED[name]:
                told = [F.coalesce(_text(item, f"$.{f}"), F.lit("")) != "" for f in fields]
                said = said.when(~reduce(lambda a, b: a | b, told), why)
            return said

        return reason_of

    def kept(name: str) -> Column:
        told = F.filter(items(name), lambda i: why_dropped(name)(i).isNull())
        return F.transform(told, lambda i: F.struct(*[F.try_variant_get(i, f"$.{f}", kind).alias(f) for f, kind in ITEMS[name].items()]))

    stocks, sectors, keywords = (kept(name) for name in ITEMS)
    quality = F.lower(F.trim(_text(v, "$.extraction_quality")))
    valid_quality = (F.col("extraction_quality_kind") == "STRING") & quality.isin(*QUALITIES)

    def note(field: str, why: str, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(why).alias("reason")))

    def dropped(name: str, clean: Column) -> list[Column]:
        each = F.transform(F.filter(F.transform(items(name), why_dropped(name)), lambda why: why.isNotNull()), lambda why: F.struct(F.lit(f"{name}[item]").alias("field"), why.alias("reason")))
        return [each, F.array_compact(F.array(note(name, "items_dropped_missing_required_fields", F.size(clean) != F.size(items(name)))))]

    def notes(*said: Column) -> Column:
        return F.array_compact(F.array(*said))

    corrections = F.concat(
        notes(
            note("report_category", "lowercased", category.isin(*CATEGORIES) & (category != _text(v, "$.report_category"))),
            note("report_category", "korean_mapped", category.isin(*CATEGORY_NAMES)),
            note("category_confidence", "float_cast_failed_defaulted", confidence_kind.isNotNull() & given.isNull()),
            note("category_confidence", "clamped_0_1", given.isNotNull() & (given != confidence)),
            note("chain", "dict_wrapped_in_list", F.col("chain_kind") == "OBJECT"),
        ),
        *dropped("stock_mentions", stocks),
        *dropped("sector_mentions", sectors),
        *dropped("keywords", keywords),
        notes(
            note("thesis", "defaulted_missing_or_non_dict", F.coalesce(F.col("thesis_kind"), F.lit("")) != "OBJECT"),
            note("meta", "defaulted_non_dict_to_empty", F.coalesce(F.col("meta_kind"), F.lit("")) != "OBJECT"),
            note("extraction_quality", "lowercased", valid_quality & (quality != _text(v, "$.extraction_quality"))),
            note("extraction_quality", "invalid_enum_defaulted", F.col("extraction_quality_kind").isNotNull() & ~F.coalesce(valid_quality, F.lit(False))),
        ),
    )

    def json_of(field: str) -> Column:
        return F.to_json(F.try_variant_get(v, f"$.{field}", "variant"))

    chain = F.when(F.col("chain_kind") == "OBJECT", F.concat(F.lit("["), json_of("chain"), F.lit("]"))).otherwise(json_of("chain"))
    second = _text(v, "$.secondary_category")
    told_second = ~F.coalesce(_kind(v, "$.secondary_category"), F.lit("VOID")).isin("VOID") & ~F.coalesce(second, F.lit("x")).isin("", "0", "false", "[]", "{}")
    parts = {
        **{f: F.when(_kind(v, f"$.{f}").isNotNull(), json_of(f)) for f in UNTOUCHED},
        "thesis": F.when(F.col("thesis_kind") == "OBJECT", json_of("thesis")).otherwise('{"summary": "", "sentiment": 0.0}'),
        "chain": chain,
        "meta": F.when(F.col("meta_kind") == "OBJECT", json_of("meta")).otherwise("{}"),
        "category_confidence": confidence.cast("string"),
        "secondary_category": F.when(told_second, json_of("secondary_category")),
    }
    document = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), text) for f, text in parts.items()]), F.lit("}"))
    good = reason.isNull()
    return rows.select(
        "report_id",
        reason.alias("reject_reason"),
        F.when(good, F.col("category")).alias("report_category"),
        F.when(good, confidence).alias("category_confidence"),
        F.when(good, stocks).alias("stock_mentions"),
        F.when(good, sectors).alias("sector_mentions"),
        F.when(good, keywords).alias("keywords"),
        F.when(good, F.coalesce(F.try_variant_get(v, "$.thesis.summary", "string"), F.lit(""))).alias("thesis_summary"),
        F.when(good, F.coalesce(F.try_variant_get(v, "$.thesis.sentiment", "double"), F.lit(0.0))).alias("thesis_sentiment"),
        F.when(good, F.when(valid_quality, quality).otherwise("medium")).alias("extraction_quality"),
        F.when(good, F.try_parse_json(document)).alias("document"),
        F.when(good, corrections).alias("corrections"),
    )


def stored_documents(clean: DataFrame) -> DataFrame:
    """(report_id, report_category, extraction_quality, document, stock_mentions, sector_mentions, keywords) of the payloads
    that were not rejected.

    The document is a VARIANT with target, opinion, thesis, chain, financials, meta, category_confidence and
    secondary_category; mentions are rows beside it. A column ``truncated``, if there is one, overrides the quality that the
    payload told.
    """
    cut = F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in clean.columns else F.lit(False)
    quality = F.when(cut, "truncated").otherwise(F.col("extraction_quality"))
    return clean.filter("reject_reason is null").select("report_id", "report_category", quality.alias("extraction_quality"), "document", *ITEMS)


def imported_results(lines: DataFrame) -> DataFrame:
    """(custom_id, payload, truncated) of JSON lines -> checked payloads by report, the last line of each report in order of ``line``."""
    known = lines.withColumn("report_id", report_id_of("custom_id")).filter("report_id is not null")
    newest = known.groupBy("report_id").agg(F.max_by(F.struct("payload", "truncated"), "line").alias("n")).select("report_id", "n.*")
    return sanitized(newest.select("report_id", "payload")).join(newest.select("report_id", "truncated"), "report_id")


def import_outcomes(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """(line, report_id, outcome, document columns) of a result file (line, report_id, status, payload) over reports (id, pipeline_status).

    Lines that succeeded and hold a result count. A report that is done, before or by an earlier line, skips the line; a line
    without id, of no known report or with a rejected payload fails and leaves the report as it was.
    """
    told = lines.filter((F.col("status") == "success") & F.col("payload").isNotNull())
    known = reports.select(F.col("id").alias("report_id"), F.coalesce(F.col("pipeline_status") == "done", F.lit(False)).alias("was_done"))
    # line and id stand for the id while payloads are checked: a report may have several, and nothing is joined back
    clean = sanitized(told.select(F.struct("line", "report_id").alias("report_id"), "payload")).withColumnRenamed("report_id", "told")
    rows = clean.select("told.*", *[c for c in clean.columns if c != "told"]).join(known, "report_id", "left")
    fits = F.col("was_done").isNotNull() & F.col("reject_reason").isNull() & ~F.col("was_done")
    first = F.min(F.when(fits, F.col("line"))).over(W.partitionBy("report_id"))
    done = F.coalesce(F.col("was_done"), F.lit(False)) | F.coalesce((F.col("line") > first) & F.col("report_id").isNotNull(), F.lit(False))
    return rows.withColumn("outcome", F.when(done, "skipped").when(fits & (F.col("line") == first), "imported").otherwise("failed")).drop("was_done")


def report_id_of(custom_id: Column | str) -> Column:
    """The number in ``report-123``."""
    return F.regexp_extract(F.col(custom_id) if isinstance(custom_id, str) else custom_id, "^report-([0-9]+)$", 1).try_cast("bigint")
