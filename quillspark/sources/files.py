"""JSON lines, CSV and spool files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that parse; broken and blank ones are skipped."""
    marked = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("line"))
    return rows.filter("line is not null and line._broken is null").select(*[F.col("line")[c].alias(c) for c in schema.names])


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def without_batch(rows: DataFrame, batch_id: str, column: str = "batch_id") -> DataFrame:
    """A spool without one batch, to be written to a new folder that takes the old one's place."""
    return rows.filter(~F.col(column).eqNullSafe(F.lit(batch_id)))


def spooled_ids(rows: DataFrame) -> DataFrame:
    """(id) of the reports that spooled batches hold: (custom_ids array) of report-123."""
    return rows.select(F.explode("custom_ids").alias("c")).select(F.regexp_extract("c", "^report-([0-9]+)$", 1).try_cast("bigint").alias("id")).filter("id is not null").distinct()


def write_classes(rows: DataFrame, path: str, column: str = "class") -> None:
    """One folder of CSV for each class, in one pass."""
    rows.write.mode("overwrite").option("header", True).partitionBy(column).csv(path)


def with_byte_order_mark(rows: DataFrame) -> DataFrame:
    """The rows with a mark before the first column's name, so that spreadsheets read the CSV as UTF-8."""
    return rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])


def write_classes_for_spreadsheets(rows: DataFrame, path: str, column: str = "class") -> None:
    """One folder of CSV for each class; every file begins with a byte-order mark."""
    first = next(c for c in rows.columns if c != column)
    write_classes(with_byte_order_mark(rows.select(first, *[c for c in rows.columns if c != first])), path, column)


def with_existing_file(rows: DataFrame, folder: str, column: str = "path") -> DataFrame:
    """The rows whose file, a path under ``folder``, is there. Only the listing is read."""
    found = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return rows.join(found.select(F.element_at(F.split("path", folder.rstrip("/").replace("file:", "") + "/", 2), 2).alias(column)), column, "left_semi")


def master_data(spark: SparkSession, path: str, schema: str, fallback: list[tuple]) -> DataFrame:
    """A table of master data, or the few literal rows where it has not been loaded yet or is empty."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        rows = spark.read.schema(schema).parquet(path)
        if not rows.isEmpty():
            return rows
    return spark.createDataFrame(fallback, schema)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_reports_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def messages_after(messages: DataFrame, cursors: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages behind each channel's forward cursor, oldest first."""
    rows = messages.join(cursors, "channel", "left").filter(F.col("message_id") > F.coalesce("last_message_id", F.lit(0))).select(*messages.columns).orderBy("channel", "message_id")
    return rows if limit is None else rows.limit(limit)


def messages_before(messages: DataFrame, cursors: DataFrame, limit: int | None = None) -> DataFrame:
    """Messages before each channel's backward cursor, newest first."""
    rows = messages.join(cursors, "channel", "left").filter(F.col("first_message_id").isNull() | (F.col("message_id") < F.col("first_message_id"))).select(*messages.columns)
    rows = rows.orderBy("channel", F.col("message_id").desc())
    return rows if limit is None else rows.limit(limit)
