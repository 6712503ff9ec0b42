"""Upserts, deletes and state changes as functions from snapshots to snapshots.

Plain Parquet has no MERGE: each function takes the stored rows and the incoming ones and returns the rows to store.
Incoming rows carry ``seq``; of several with one key the highest wins unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import retryable

REPORT_KEY = ["broker", "report_date", "analyst", "stock_name", "title_normalized"]
#: What a repeated report overwrites.
REPORT_UPDATES = ["pdf_url", "opinion", "target_price", "raw_text", "source_channel"]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of keys: two unknown analysts are one."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def upsert_reports(stored: DataFrame, incoming: DataFrame, keys: list[str] | None = None, updates: list[str] | None = None, preserve_existing: bool = False) -> DataFrame:
    """The stored reports after ``incoming``, with ``action``: inserted, updated, skipped or kept.

    A known report is updated only by a row with an address or an opinion; it then takes all update columns of that row,
    nulls included, unless ``preserve_existing``. Rows without a normalised title are left out.
    """
    keys, updates = keys or REPORT_KEY, updates or REPORT_UPDATES
    fresh = incoming.filter(F.coalesce("title_normalized", F.lit("")) != "")
    known = stored.withColumn("is_known", F.lit(True))
    order = W.partitionBy(*keys).orderBy("seq")
    tells = F.col("pdf_url").isNotNull() | F.col("opinion").isNotNull()
    # the first row of a key inserts, if the key is new; of all rows that tell something the last one's values stay
    ranked = fresh.withColumn("n", F.row_number().over(order)).withColumn("tells", tells)
    effect = ranked.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in incoming.columns if c not in keys]), F.when(F.col("n") == 1, 1)).alias("first"),
        *[F.max_by(c, F.when((F.col("tells")) & (F.col(c).isNotNull() if preserve_existing else F.lit(True)), F.col("seq"))).alias(f"new_{c}") for c in updates],
        F.max("tells").alias("any_tells"),
        F.max(F.when(F.col("n") > 1, F.col("tells"))).alias("later_tells"),
    )
    joined = known.alias("s").join(effect.alias("i"), _same(known, effect, keys), "full_outer")
    is_known, came = F.coalesce(F.col("s.is_known"), F.lit(False)), F.col("i.any_tells").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.when(is_known, F.col(f"s.{c}")).otherwise(F.col(f"i.{c}"))
        old = F.when(is_known, F.col(f"s.{c}")).otherwise(F.col(f"i.first.{c}"))
        if c not in updates:
            return old
        changed = F.when(is_known, F.col("i.any_tells")).otherwise(F.col("i.later_tells"))
        new = F.coalesce(F.col(f"i.new_{c}"), old) if preserve_existing else F.col(f"i.new_{c}")
        return F.when(F.coalesce(changed, F.lit(False)), new).otherwise(old)

    action = F.when(~came, "kept").when(~is_known, "inserted").when(F.col("i.any_tells"), "updated").otherwise("skipped")
    return joined.select(*[value(c).alias(c) for c in stored.columns], action.alias("action"))


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows to append: unknown keys, the first row of each."""
    first = incoming.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("seq"))).filter("n = 1").drop("n")
    return first.join(stored.select(*keys).distinct(), keys, "left_anti")


def latest_wins(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows replaced by the newest incoming row of their key, and new keys added."""
    newest = incoming.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("seq").desc()))).filter("n = 1").drop("n", "seq")
    return stored.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(*stored.columns))


def point_updates(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the values that the newest change of their key tells; nulls of a change leave the old value."""
    names = [c for c in changes.columns if c not in (*keys, "seq")]
    newest = changes.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in names])
    joined = stored.join(newest, keys, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in names else c for c in stored.columns])


def replace_children(stored: DataFrame, payloads: DataFrame, array: str, key: Column, parent: str = "report_id", keep: Column | None = None) -> DataFrame:
    """Children of the payloads' parents replaced by the arrays' items, the first of each ``key``.

    ``payloads`` hold one row a parent; items are exploded with their position, so nothing is collected.
    """
    items = payloads.select(parent, F.posexplode(array).alias("position", "item")).select(parent, "position", "item.*")
    if keep is not None:
        items = items.filter(keep)
    keyed = items.withColumn("child_key", key)
    first = keyed.withColumn("n", F.row_number().over(W.partitionBy(parent, "child_key").orderBy("position"))).filter("n = 1")
    return stored.join(payloads.select(parent).distinct(), parent, "left_anti").unionByName(first.select(*stored.columns))


def stock_key() -> Column:
    """The code, or the name where there is none."""
    return F.coalesce(F.nullif(F.col("stock_code"), F.lit("")), F.concat(F.lit("_name_"), F.coalesce("company_name", F.lit(""))))


def sector_key() -> Column:
    return F.concat_ws("/", "sector", "mention_type")


def told(name: str) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(name), F.lit("")) != ""


#: What an event makes of pipeline_status and, if it tells one, of analysis_status. Fixed values.
EVENT_STATES = {
    "classified": ("s2a_done", None),
    "downloaded": ("pdf_done", None),
    "download_failed": ("pdf_failed", None),
    "submitted": ("analysis_pending", None),
    "analysed": ("done", "done"),
    "truncated": ("done", "truncated"),
    "analysis_failed": ("analysis_failed", "failed"),
    "batch_failed": ("analysis_failed", None),
}
REASON_CHARS = 500


def after_event(rows: DataFrame, event: str = "event", reason: str = "reason") -> DataFrame:
    """Reports (pipeline_status, analysis_status, pdf_download_failed, pdf_fail_reason, pdf_fail_retryable) after an event each.

    A failed download sets four columns; an analysis sets both states; unknown events change nothing.
    """
    told = F.col(event)
    told_reason = F.coalesce(F.col(reason), F.lit("unknown"))
    failed = told.eqNullSafe(F.lit("download_failed"))

    def state(at: int, old: str) -> Column:
        values = [F.lit(x) for name, states in EVENT_STATES.items() if states[at] is not None for x in (name, states[at])]
        return F.coalesce(F.try_element_at(F.create_map(*values), told), F.col(old))

    return rows.withColumns(
        {
            "pipeline_status": state(0, "pipeline_status"),
            "analysis_status": state(1, "analysis_status"),
            "pdf_download_failed": F.when(failed, F.lit(True)).otherwise(F.col("pdf_download_failed")),
            "pdf_fail_reason": F.when(failed, F.substring(told_reason, 1, REASON_CHARS)).otherwise(F.col("pdf_fail_reason")),
            "pdf_fail_retryable": F.when(failed, retryable(told_reason)).otherwise(F.col("pdf_fail_retryable")),
        }
    )


def backfill_status(reports: DataFrame, analysed: DataFrame) -> DataFrame:
    """``pipeline_status`` and ``pdf_fail_retryable`` of reports (id, pdf_path, pdf_download_failed, pdf_fail_reason) from what is stored.

    An analysis makes a report done; else a failed download tells, then a path beside a download that didn't fail.
    """
    rows = reports.drop("pipeline_status", "pdf_fail_retryable").join(analysed.select("id").distinct().withColumn("has_analysis", F.lit(True)), "id", "left")
    downloaded = F.col("pdf_path").isNotNull() & ~F.col("pdf_download_failed")
    status = F.when(F.col("has_analysis"), "done").when(F.col("pdf_download_failed"), "pdf_failed").when(downloaded, "pdf_done").otherwise("new")
    why = F.col("pdf_fail_reason")
    lasting = why.isin("http_404", "http_410", "no_url") | why.like("not_pdf%") | why.like("unsupported_host:%")
    return rows.withColumn("pipeline_status", status).withColumn("pdf_fail_retryable", F.when(lasting, F.lit(False)).when(why.isNotNull(), F.lit(True))).drop("has_analysis")


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key), key, "left_anti")


def changed_fields(before: DataFrame, after: dict[str, Column], key: str) -> DataFrame:
    """(key, field, old, new) of the values that a rewrite would change."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old"), new.cast("string").alias("new")) for c, new in after.items()])
    rows = before.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    return rows.filter(~F.col("old").eqNullSafe(F.col("new")))


def merged_value(new: Column, old: Column) -> Column:
    """The new value unless it is blank."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def advanced_cursors(cursors: DataFrame, seen: DataFrame, reverse: bool = False) -> DataFrame:
    """(channel, last_message_id, reverse_min_id) after a run over ``seen`` (channel, message_id) in one direction.

    A forward run overwrites the last id with the highest it has seen, be it lower; a reverse run lowers the least id, which
    none or 0 stands for unset. Channels without messages stay, new ones are added.
    """
    end = seen.groupBy("channel").agg((F.min if reverse else F.max)("message_id").alias("end"))
    joined = cursors.join(end, "channel", "full_outer")
    least = F.nullif(F.col("reverse_min_id"), F.lit(0))
    lowered = F.when(F.col("end").isNotNull() & (least.isNull() | (F.col("end") < least)), F.col("end")).otherwise(F.col("reverse_min_id"))
    last, low = (F.col("last_message_id"), lowered) if reverse else (F.coalesce("end", "last_message_id"), F.col("reverse_min_id"))
    return joined.select("channel", last.alias("last_message_id"), low.alias("reverse_min_id"))


def missing_days(bars: DataFrame, as_of: str) -> DataFrame:
    """(symbol, day): days to fetch, from the day after each symbol's last bar."""
    last = bars.groupBy("symbol").agg(F.max("day").alias("last_day"))
    behind = last.filter(F.col("last_day") < F.lit(as_of).cast("date"))
    return behind.select("symbol", F.explode(F.sequence(F.date_add("last_day", 1), F.lit(as_of).cast("date"))).alias("day"))
