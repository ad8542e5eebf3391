"""Structured Streaming over a folder of structures or events: exactly-once batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metalith.plans.state import latest


def file_batches(spark: SparkSession, folder: str, fmt: str, schema, checkpoint: str, each: Callable[[DataFrame, int], None], files: int = 50, **options) -> StreamingQuery:
    """Give ``each`` batch of at most ``files`` new files to a function, until none are left;
    the checkpoint remembers what was seen."""
    source = spark.readStream.format(fmt).options(maxFilesPerTrigger=files, **options)
    source = source.schema(schema) if schema is not None else source
    return source.load(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class StatusTable:
    """A keyed table in a folder: batches of rows, of which the latest of a key counts.

    A batch writes a folder of its own number, so a replay writes the same one. Every ``most`` batches the table is written whole as
    the next number and the older folders go; a crash between the two leaves rows twice, which changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, key: str, seq: list[str], schema: str, most: int = 20):
        self.spark, self.folder, self.key, self.seq, self.schema, self.most = spark, folder.rstrip("/"), key, seq, schema, most

    def numbers(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def table(self) -> DataFrame:
        """The latest row of each key; empty before the first batch."""
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={n}").withColumn("_batch", F.lit(n)) for n in self.numbers()]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return latest(rows, self.key, ["_batch", *self.seq]).drop("_batch").select(*self.spark.createDataFrame([], self.schema).columns)

    def put(self, rows: DataFrame, number: int | None = None) -> None:
        """Write a batch, under ``number`` if it may be replayed."""
        known = self.numbers()
        number = (known[-1] + 1 if known else 0) if number is None else 2 * number
        latest(rows, self.key, self.seq).write.mode("overwrite").parquet(f"{self.folder}/batch={number}")
        old = self.numbers()
        if len(old) > self.most:
            self.table().write.mode("overwrite").parquet(f"{self.folder}/batch={old[-1] + 1}")
            for n in old:
                _removed(self.spark, f"{self.folder}/batch={n}")


def latest_status(spark: SparkSession, folder: str, schema, checkpoint: str, out: str, key: str, seq: list[str]) -> StreamingQuery:
    """Keep a keyed status table current from a folder of status rows; ``StatusTable(...).table()`` reads it."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    state = StatusTable(spark, out, key, seq, ddl)
    return file_batches(spark, folder, "parquet", schema, checkpoint, state.put)


STATUS = "entry_id string, status string, seq long, reason string"


def keep_until(candidates: DataFrame, process: Callable[[DataFrame], DataFrame], state: StatusTable, target: int, batch: int = 75, tries: int = 100_000) -> int:
    """Take candidates (pos, kind, value) in order, ``batch`` at a time, until ``target`` are kept in all, earlier runs
    counted; returns how many are.

    ``process`` gets a batch and returns ``entry_id, status, reason``; ``matched`` is kept. The state table is all that a restart
    needs: what was in progress is pending again, what is finished is not taken up. A batch runs whole, so a few
    more than ``target`` may be kept. Candidates without a result count as errors, so that a run always ends."""
    from metalith.sources.inputs import FINISHED

    for _ in range(tries):
        seen = state.table()
        kept = seen.where("status = 'matched'").count()
        if kept >= target:
            return kept
        taken = candidates.join(seen.where(F.col("status").isin(*FINISHED)).select(F.col("entry_id").alias("value")), "value", "left_anti").orderBy("pos").limit(batch)
        now = candidates.sparkSession.createDataFrame(taken.select("pos", "kind", "value").collect(), "pos long, kind string, value string")
        if not now.limit(1).count():
            return kept
        ids = now.select(F.col("value").alias("entry_id")).distinct()
        state.put(ids.select("entry_id", F.lit("in_progress").alias("status"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("reason")))
        done = ids.join(process(now), "entry_id", "left")
        state.put(done.select("entry_id", F.coalesce("status", F.lit("error")).alias("status"), F.lit(1).cast("long").alias("seq"), "reason"))
    return state.table().where("status = 'matched'").count()
