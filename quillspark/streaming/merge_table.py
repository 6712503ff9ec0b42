"""A keyed table that is merged when it is read: each batch appends its changed rows alone.

The folder holds segments (Parquet folders of rows with ``_version`` and ``_deleted``) and one pointer file that names those
that count, their schema and the number of the last batch. A commit writes a segment and then swaps the pointer by one
rename; what a failed attempt has written is named nowhere and does not count, and a batch that comes again is not applied
again. Reading takes the newest version of each key, without deleted ones. Compaction rewrites the table as one base segment
when dead rows are a given share of it or deltas are many; segments of the state before the last stay for its readers.

There is one writer at a time; on stores whose rename over a file is not atomic the pointer needs a store of its own.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTER = "_current"
DEAD_SHARE, MOST_DELTAS = 0.3, 32


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def state(self) -> dict | None:
        """The pointer: number of the last batch, schema, segments (path, rows, base) and the segments before."""
        at = self._at(POINTER)
        fs = at.getFileSystem(self._conf)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _swap(self, state: dict) -> None:
        temporary, target = self._at(f"{POINTER}.{uuid.uuid4().hex}"), self._at(POINTER)
        stream = target.getFileSystem(self._conf).create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        kind = getattr(self._hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        self._hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(temporary, target, over)

    def _segments(self, state: dict, base: bool) -> DataFrame | None:
        paths = [f"{self.path}/{s['path']}" for s in state["segments"] if s["base"] == base]
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in self.keys])

    def read(self) -> DataFrame | None:
        """The rows as the last commit left them; None before the first.

        Deltas are ranked by key; the base, whose keys are unique, only loses those that a delta tells anew.
        """
        state = self.state()
        if state is None:
            return None
        names = json.loads(state["columns"])
        base, deltas = self._segments(state, True), self._segments(state, False)
        if deltas is None:
            return base.select(*names)
        newest = deltas.withColumn("_n", F.row_number().over(W.partitionBy(*self.keys).orderBy(F.col("_version").desc()))).filter("_n = 1")
        rows = newest.filter("NOT _deleted").select(*names)
        if base is None:
            return rows
        told = newest.select(*self.keys)
        return base.join(told, self._same(base, told), "left_anti").select(*names).unionByName(rows)

    def commit(self, number: int, changes: DataFrame, deleted: Column | None = None) -> int:
        """Append the changed rows of a batch, one for each key; ``deleted`` marks those that go. Returns the rows written.

        A number that was committed before has no effect.
        """
        state = self.state()
        if state is not None and state["number"] >= number:
            return 0
        names = changes.columns
        counted = Observation(f"commit-{uuid.uuid4().hex}")
        rows = changes.withColumn("_deleted", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).withColumn("_version", F.lit(number).cast("bigint"))
        segment = f"delta-{number}-{uuid.uuid4().hex}"
        rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{segment}")
        written = counted.get["rows"]
        before = state["segments"] if state is not None else []
        after = [*before, {"path": segment, "rows": written, "base": False}] if written else before
        self._swap({"number": number, "columns": json.dumps(names), "schema": rows.schema.json() if state is None else state["schema"], "segments": after, "before": before})
        return written

    def dead_share(self) -> float:
        """Rows that no reader sees, as a share of those stored."""
        state = self.state()
        stored = sum(s["rows"] for s in state["segments"]) if state is not None else 0
        return 1 - self.read().count() / stored if stored else 0.0

    def compact(self, dead_share: float = DEAD_SHARE, most_deltas: int = MOST_DELTAS) -> bool:
        """Rewrite the table as one base segment, if its dead rows or its deltas are enough; it is ranged by its keys."""
        state = self.state()
        deltas = [s for s in state["segments"] if not s["base"]] if state is not None else []
        if not deltas or (len(deltas) < most_deltas and self.dead_share() < dead_share):
            return False
        segment = f"base-{state['number']}-{uuid.uuid4().hex}"
        counted = Observation(f"compact-{uuid.uuid4().hex}")
        rows = self.read().withColumn("_deleted", F.lit(False)).withColumn("_version", F.lit(state["number"]).cast("bigint"))
        ranged = rows.repartitionByRange(*self.keys).sortWithinPartitions(*self.keys)  # counted after it, as its ranges are drawn from a run before
        ranged.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{segment}")
        self._swap(state | {"segments": [{"path": segment, "rows": counted.get["rows"], "base": True}], "before": state["segments"]})
        return True

    def vacuum(self) -> list[str]:
        """Delete segments that neither the state nor the one before names, and left-over pointers; returns their names."""
        state = self.state()
        named = {POINTER, f".{POINTER}.crc", *(s["path"] for k in ("segments", "before") for s in state[k])} if state is not None else set()
        root = self._hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self._conf)
        gone = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName() not in named] if fs.exists(root) else []
        for path in gone:
            fs.delete(path, True)
        return sorted(p.getName() for p in gone)
