"""Message ingest and event statistics as Structured Streaming jobs.

A batch is written under its own number, replacing what a failed attempt left there, and messages that earlier batches
hold are dropped, so that a batch that runs twice, or a message that comes again, has the effect of one. Reports are
upserted inside their batch into a table that is merged when it is read. Bounded replay uses the same jobs with ``availableNow``; its results are Parquet tables in
the shared folder, like its checkpoints, and its state is in RocksDB, on the executors' disks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.messages import parse_messages
from quillspark.operators.upserts import REPORT_KEY, REPORT_UPDATES, upsert_reports
from quillspark.streaming.merge_table import MergeTable

#: Keys seen and open sessions can exceed the memory of executors; that of RocksDB is bounded, for all tasks of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def parquet_stream(spark: SparkSession, directory: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """One table, a file or a folder of part files, as a stream; event times are cast to a zoned timestamp, which watermarks need.

    All files that are there make one batch, so that a bounded replay takes no event for late whatever the files' order.
    With ``files_per_trigger`` they make several, and events behind the watermark of earlier ones are dropped.
    """
    path = f"{directory}/{name}.parquet"
    rows = spark.readStream.schema(schema := spark.read.parquet(path).schema)
    if files_per_trigger is not None:
        rows = rows.option("maxFilesPerTrigger", files_per_trigger)
    rows = rows.parquet(path) if is_folder(spark, path) else rows.option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    for field in schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            rows = rows.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return rows


def daily_counts(events: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events and their value by day and type."""
    windowed = events.withWatermark(time, delay).groupBy(F.window(time, "1 day"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.to_date("window.start").alias("day"), "event_type", "n", "value")


def sessions(events: DataFrame, time: str = "ts", gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    windowed = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), "user_id")
    return windowed.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def branch(messages: DataFrame, classify: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Parsed messages with ``branch``: report, pending (no stock and no broker) or skip.

    ``classify`` adds ``kind``; without one every message counts as a broker's report.
    """
    parsed = parse_messages(messages)
    kinds = classify(parsed) if classify is not None else parsed.withColumn("kind", F.lit("broker_report"))
    return kinds.withColumn("branch", F.when(F.col("kind") != "broker_report", "skip").when(F.col("quality") == "poor", "pending").otherwise("report"))


def unseen(messages: DataFrame, target: str, number: int, counted: Observation | None = None) -> DataFrame:
    """The messages of a batch, each once, that no earlier batch under ``target`` holds.

    Of several rows of one message the one posted last counts, then the one whose columns are greatest. Two columns are read
    of the stored messages whose ids lie in the batch's span of their channel; the span over all channels prunes row groups.
    ``counted`` gets the number of all rows as ``scanned`` when the result is made.
    """
    spark = messages.sparkSession
    told = [c for c in messages.columns if c not in ("channel", "message_id")]
    order = [F.col(c).desc_nulls_last() for c in sorted(told, key=lambda c: (c != "posted_at", c))]
    scan = messages if counted is None else messages.observe(counted, F.count(F.lit(1)).alias("scanned"))
    rows = scan.withColumn("_n", F.row_number().over(W.partitionBy("channel", "message_id").orderBy(*order, F.lit(1)))).filter("_n = 1").drop("_n")
    if not exists(spark, target):
        return rows
    spans = messages.groupBy("channel").agg(F.min("message_id").alias("low"), F.max("message_id").alias("high"))
    whole = spans.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    if whole["low"] is None:
        return rows
    stored = spark.read.parquet(target).filter((F.col("batch") < number) & F.col("message_id").between(whole["low"], whole["high"]))
    known = stored.select("channel", "message_id").join(spans, "channel").filter("message_id BETWEEN low AND high")
    return rows.join(known.select("channel", "message_id"), ["channel", "message_id"], "left_anti")


def report_rows(parsed: DataFrame) -> DataFrame:
    """Parsed messages as incoming reports, in the order of their channel's messages; the day is that of ``posted_at``, if told."""
    day = F.to_date("posted_at") if "posted_at" in parsed.columns else F.lit(None).cast("date")
    return parsed.select("broker", day.alias("report_date"), "analyst", "stock_name", "title_normalized", "title", "stock_code", "pdf_url", "opinion", "target_price", F.col("body").alias("raw_text"), F.col("channel").alias("source_channel"), F.struct("message_id", "block_no", "channel").alias("seq"))


def report_table(spark: SparkSession, path: str) -> MergeTable:
    return MergeTable(spark, path, REPORT_KEY)


def stored_reports(spark: SparkSession, path: str) -> DataFrame | None:
    """The reports as the last batch left them."""
    return report_table(spark, path).read()


def upsert_batch(parsed: DataFrame, path: str, number: int) -> int:
    """Upsert a batch's reports and return the rows that were written: those that are new or changed, and no others."""
    spark = parsed.sparkSession
    table, incoming = report_table(spark, path), report_rows(parsed)
    names = [c for c in incoming.columns if c != "seq"]
    known = table.read()
    if known is None:
        touched = spark.createDataFrame([], incoming.select(*names).schema)
    else:
        keys = incoming.select(*REPORT_KEY).distinct()
        touched = known.join(keys, reduce(lambda a, b: a & b, [known[k].eqNullSafe(keys[k]) for k in REPORT_KEY]), "left_semi")
    after = upsert_reports(touched, incoming, REPORT_KEY, REPORT_UPDATES)
    written = table.commit(number, after.filter(F.col("action").isin("inserted", "updated")).select(*names))
    table.compact()
    table.vacuum()
    return written


COUNTERS = ("scanned", "fresh", "saved", "pending", "skipped")


def start_ingest(
    messages: DataFrame, target: str, checkpoint: str, active: Callable[[SparkSession], DataFrame] | None = None, classify: Callable[[DataFrame], DataFrame] | None = None, reports: str | None = None, runs: str | None = None
) -> StreamingQuery:
    """Branch each micro-batch and write it, partitioned by branch, under its batch number; upsert its reports in ``reports``.

    ``active`` reads the channels that count; it is read anew for every batch. The job that writes a batch also counts its
    messages and what became of them, one row under ``runs`` for each batch: scanned, fresh (not stored before, of a channel
    that counts), and rows saved, pending and skipped. A new run of the job goes on with the numbers of its checkpoint;
    another checkpoint over the same target would start again from 0.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        scanned, fresh, made = (Observation(f"{name}-{uuid.uuid4().hex}") for name in ("scanned", "fresh", "made"))
        rows = unseen(batch, target, number, scanned)
        if active is not None:
            rows = rows.join(active(spark), "channel", "left_semi")
        told = branch(rows.observe(fresh, F.count(F.lit(1)).alias("fresh")), classify)
        counts = [F.count_if(F.col("branch") == name).alias(alias) for name, alias in (("report", "saved"), ("pending", "pending"), ("skip", "skipped"))]
        told.observe(made, *counts).write.mode("overwrite").partitionBy("branch").parquet(f"{target}/batch={number}")
        if runs is not None:
            counted = {k: v for o in (scanned, fresh, made) for k, v in o.get.items()}
            row = [(int(number), *(counted[c] for c in COUNTERS))]
            spark.createDataFrame(row, ", ".join(f"{c} long" for c in ("number", *COUNTERS))).coalesce(1).write.mode("overwrite").parquet(f"{runs}/batch={number}")
        if reports is not None:
            written = spark.read.schema(told.schema).parquet(f"{target}/batch={number}")
            upsert_batch(written.filter("branch = 'report'"), reports, number)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where that is absent and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillspark-"))
    return context.getCheckpointDir()


def run_to_files(rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return its result, read from Parquet files.

    Appended batches are written under their own number; in complete mode each batch replaces the one before.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{folder}/rows"

    def path(number: int) -> str:
        return target if mode == "complete" else f"{target}/batch={number}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path(number))

    spark.createDataFrame([], rows.schema).write.parquet(path(-1))  # for a stream without rows
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(rows.schema).parquet(target).select(*rows.columns)
