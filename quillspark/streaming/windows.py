"""Windows that close, and late rows that are kept apart.

A gate writes each batch of a stream in one pass, parted into rows in time and late ones: a row is late if it is older than
the greatest event time of the batches before, less the delay. The rule is Spark's own watermark over the same batches, so
that what passes the gate is never dropped behind it, while late rows stay in files of their own. Aggregations over the gated
rows run in append mode: a window is told once, when the watermark has passed it, and its state is dropped. At the end of a
bounded replay an end mark, a row without content far behind the last one, lets the watermark pass all windows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspark.streaming.ingest import exists

#: Number of the batch that an end mark is written as.
END = 1 << 30


def watermark(spark: SparkSession, folder: str, before: int):
    """The greatest event time that batches before this one have told, None for the first."""
    marks = f"{folder}/marks"
    return spark.read.schema("number int, high timestamp").parquet(marks).filter(F.col("number") < before).agg(F.max("high")).first()[0] if exists(spark, marks) else None


def gate(events: DataFrame, folder: str, delay: str = "1 day", time: str = "ts") -> StreamingQuery:
    """Part the rows of a stream under ``folder``; a batch that runs twice is written anew under its number."""
    spark = events.sparkSession
    spark.createDataFrame([(events.schema.json(),)], "schema string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/schema")

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        high = watermark(own, folder, number)
        late = F.lit(False) if high is None else F.coalesce(F.col(time) < F.lit(high) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        told = Observation(f"gate-{uuid.uuid4().hex}")
        rows = batch.observe(told, F.max(time).alias("high")).withColumn("_end", F.lit(False)).withColumn("late", late)
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")
        mark = own.createDataFrame([(int(number), told.get["high"])], "number int, high timestamp")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/gate-checkpoint").trigger(availableNow=True).start()


def end_replay(spark: SparkSession, folder: str, span: str = "7 days", time: str = "ts") -> None:
    """Write the end mark: ``span`` has to exceed the longest window or gap and the delay together."""
    high = watermark(spark, folder, END)
    if high is None:
        return
    kinds = {f.name: f.dataType for f in _schema(spark, folder).fields}
    mark = spark.range(1).select(*[(F.lit(high) + F.expr(f"INTERVAL {span}")).alias(c) if c == time else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()], F.lit(True).alias("_end"))
    mark.write.mode("overwrite").parquet(f"{folder}/rows/batch={END}/late=false")


def _schema(spark: SparkSession, folder: str) -> StructType:
    return StructType.fromJson(json.loads(spark.read.parquet(f"{folder}/schema").first()["schema"]))


def _gated_schema(spark: SparkSession, folder: str) -> StructType:
    return StructType([*_schema(spark, folder).fields]).add("_end", "boolean").add("batch", "integer").add("late", "boolean")


def in_time(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of rows in time, all files that are there in one batch, end mark included."""
    return spark.readStream.schema(_gated_schema(spark, folder)).parquet(f"{folder}/rows").filter("NOT late").drop("batch", "late")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_gated_schema(spark, folder)).parquet(f"{folder}/rows").filter("late").drop("late", "_end")


def closed_days(rows: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """(day, event_type, n, value) of gated rows, for append mode."""
    windowed = rows.withWatermark(time, delay).groupBy(F.window(time, "1 day"), "event_type")
    # the mark has windows of its own, and is left out as an aggregate: a filter on rows would be pushed below the watermark
    told = windowed.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.max("_end").alias("mark")).filter("NOT mark")
    return told.select(F.to_date("window.start").alias("day"), "event_type", "n", "value")


def closed_sessions(rows: DataFrame, time: str = "ts", gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """(user_id, started, ended, n) of gated rows, for append mode."""
    windowed = rows.withWatermark(time, delay).groupBy(F.session_window(time, gap), "user_id")
    return windowed.agg(F.count("*").alias("n"), F.max("_end").alias("mark")).filter("NOT mark").select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
