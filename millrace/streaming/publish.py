"""Publication exactly once, job counts that follow a stream, and a static side that is read again after its age limit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.curated import CuratedStore
from ..sources.shared import cut, new_folder


def _there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


class Publisher:
    """A foreachBatch function that publishes each batch once.

    A batch goes to a folder of its own (query, batch id), which a second try replaces; then a row in the ledger says that it
    is whole.  Readers take only folders that the ledger names, so a batch that died half-way is not seen, and one that runs
    again adds nothing.  ``before_commit`` is called between the two writes.
    """

    def __init__(self, path: str, name: str, key: str = "job_id", before_commit: Callable[[int], None] | None = None):
        self.path, self.name, self.key, self.before_commit = path, name, key, before_commit

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"query={self.name}/batch={batch_id}"
        if _there(spark, f"{self.path}/ledger/{place}"):
            return
        rows = batch.dropDuplicates()
        rows.repartition(F.col(self.key)).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/rows/{place}")
        if self.before_commit:
            self.before_commit(batch_id)
        ledger = spark.read.schema(rows.schema).parquet(f"{self.path}/rows/{place}").agg(F.count("*").alias("rows"), F.count_distinct(self.key).alias("keys"))
        ledger.write.mode("overwrite").parquet(f"{self.path}/ledger/{place}")


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all published batches, with their query and batch."""
    whole = spark.read.schema("rows long, keys long, query string, batch long").option("basePath", f"{path}/ledger").parquet(f"{path}/ledger").select("query", "batch")
    return spark.read.schema(f"{schema}, query string, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows").join(whole, ["query", "batch"], "left_semi")


def publish_keys(stream: DataFrame, path: str, name: str, checkpoint: str, key: str = "job_id", columns: tuple[str, ...] = ("file_id", "status"), before_commit: Callable[[int], None] | None = None):
    """Each batch's status changes, without repeats, by job."""
    rows = stream.select(key, *columns)
    return rows.writeStream.foreachBatch(Publisher(path, name, key, before_commit)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class StatusDeltas(StatefulProcessor):
    """What a file's newer status changes in the counts of its job: state is the file's newest event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long, event_id long, job string, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.newest.get()) if self.newest.exists() else None
        best = before
        for batch in rows:
            for us, event_id, job, status in zip(batch["us"], batch["event_id"], batch["job"], batch["status"], strict=True):
                event = (int(us), int(event_id), job, status)
                if best is None or event[:2] > best[:2]:
                    best = event
        if best == before:
            return
        self.newest.update(best)
        out = [(best[2], 1, int(best[3] == "completed"))]
        if before:
            out.append((before[2], -1, -int(before[3] == "completed")))
        yield pd.DataFrame(out, columns=["job", "files", "completed"])

    def close(self) -> None:
        pass


class JobCounts:
    """Counts per job in a curated store; a batch of changes is added once, as each row names the last batch that it has."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", buckets: int = 64):
        self.store = CuratedStore(spark, path, "job", "bucket", order=["batch"], buckets=buckets)
        self.schema, self.buckets = f"job {kind}, files long, completed long, batch long, bucket int", buckets

    def add(self, deltas: DataFrame, batch_id: int) -> None:
        kind = self.schema.split(",")[0].split()[1]
        new = deltas.groupBy(F.col("job").cast(kind).alias("job")).agg(F.sum("files").alias("df"), F.sum("completed").alias("dc"))
        new = cut(new.withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(self.buckets)).cast("int")))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        old = self.store.rows(self.schema).filter(F.col("bucket").isin(touched)).select("job", "files", "completed", F.col("batch").alias("had"))
        both = new.join(old, "job", "left").filter(F.col("had").isNull() | (F.col("had") < batch_id))
        grown = lambda c, d: (F.coalesce(c, F.lit(0)) + F.col(d)).cast("long").alias(c)
        self.store.merge(both.select("job", grown("files", "df"), grown("completed", "dc"), F.lit(batch_id).cast("long").alias("batch"), "bucket"))

    def states(self) -> DataFrame:
        """(job, files, completed, job_status) of jobs that have files."""
        state = F.when(F.col("files") == F.col("completed"), "completed").when(F.col("completed") > 0, "partial").otherwise("failed")
        return self.store.rows(self.schema).filter("files > 0").select("job", "files", "completed", state.alias("job_status"))


def rollup_by_deltas(stream: DataFrame, path: str, checkpoint: str, key: str = "file_id", job: str = "job_id", ts: str = "ts", order: str = "event_id"):
    """Job states that follow a stream: files keep their newest event in the state store, only changes reach the jobs' counts,
    and only the touched buckets of these are read and written."""
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("event_id"), F.col(job).cast("string").alias("job"), "status")
    deltas = rows.groupBy("key").transformWithStateInPandas(StatusDeltas(), "job string, files int, completed int", "Update", "None")
    counts = JobCounts(stream.sparkSession, path, dict(stream.dtypes)[job])
    return deltas.writeStream.outputMode("update").foreachBatch(lambda batch, n: counts.add(batch, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Refreshed:
    """A table that is read again once it is older than a limit.

    Each version is written to the shared folder, so all readers of a version see the same rows though its source changes,
    and a lost executor reads them again.
    """

    def __init__(self, spark: SparkSession, load: Callable[[], DataFrame], max_age: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.load, self.max_age, self.clock = spark, load, max_age, clock
        self.version, self.read_at, self.path = 0, 0.0, ""

    def frame(self) -> DataFrame:
        now = self.clock()
        if not self.path or now - self.read_at >= self.max_age:
            path = new_folder(self.spark, "version")
            self.load().write.parquet(path)
            self.version, self.read_at, self.path = self.version + 1, now, path
        return self.spark.read.parquet(self.path)


def with_static(stream: DataFrame, static: Refreshed, join: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str):
    """Batches joined with the version of the static side that is current when they run, each to a folder of its own."""

    def step(batch: DataFrame, n: int) -> None:
        join(batch, static.frame()).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
