"""Streams over a bounded input equal their batch forms."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.sources.fixtures import view
from millrace.streaming import flows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    view(spark, SF, "file_events").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(path)
    return path


@pytest.fixture()
def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_latest_status(spark, folder, stream, tmp_path):
    flows.replay(flows.latest_status(stream), "", str(tmp_path / "c"), "update", "latest").awaitTermination()
    got = spark.table("latest").groupBy("file_id").agg(F.max_by("status", F.struct("ts_ns", "event_id")).alias("status"))
    want = flows.latest_status_batch(spark.read.parquet(folder)).select("file_id", "status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_request_rate_up_to_the_watermark(spark, folder, stream, tmp_path):
    rated = flows.request_rate(stream.withWatermark("ts", "1 day"), "job_id", 1)
    flows.replay(rated, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = set(map(tuple, spark.read.schema(rated.schema).parquet(str(tmp_path / "out")).collect()))
    want = set(map(tuple, flows.request_rate(spark.read.parquet(folder), "job_id", 1).collect()))
    assert got <= want


def test_duplicates_within_a_delay(spark, stream, tmp_path):
    out = flows.without_repeats(stream.union(stream), ["event_id"], within="3650 days")
    flows.replay(out.select("event_id"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.distinct().count() > 0


def test_retries_stop_at_the_limit(spark, tmp_path):
    rows = [("f", datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=k), s) for k, s in enumerate(["failed"] * 4 + ["completed", "failed"])]
    spark.createDataFrame(rows, "file_id string, ts timestamp, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("file_id string, ts timestamp, status string").parquet(str(tmp_path / "in"))
    flows.replay(flows.retries(src), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = [(r["retries"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("due").collect()]
    assert sorted(got) == [(1, "retry"), (1, "retry"), (2, "retry"), (3, "retry"), (4, "failed")]


def test_stuck_needs_time_to_pass(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=m)
    schema = "file_id string, ts timestamp, status string"
    for k, rows in enumerate([[("a", at(0), "processing"), ("b", at(0), "processing")], [("b", at(5), "completed")], [("z", at(200), "pending")], [("z", at(400), "pending")], [("z", at(600), "pending")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = flows.stuck(src, 60_000)
    flows.replay(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {r["file_id"] for r in spark.read.schema("file_id string, since timestamp").parquet(str(tmp_path / "out")).collect()}
    assert "z" not in got and got <= {"a", "b"} and "a" in got


def test_audit_feed_joins_users(spark, stream, tmp_path):
    users = view(spark, SF, "users")
    out = flows.audit_with_users(stream.select("event_id", F.col("file_id").alias("user_id")), users)
    flows.replay(out, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("user_name IS NOT NULL").count() > 0


def test_active_sessions(spark):
    s = spark.createDataFrame([(1, "2024-01-02", None), (2, "2023-12-31", None), (3, "2024-01-02", "2024-01-01")], "id int, expires_at string, accepted_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    as_of = F.to_timestamp(F.lit("2024-01-01"))
    assert [r["id"] for r in flows.active_sessions(s, as_of).orderBy("id").collect()] == [1, 3]
    assert [r["id"] for r in flows.active_sessions(s, as_of, accepted="accepted_at").collect()] == [1]


def test_running_rollup_follows_the_batch_form(spark, folder, stream, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "k"))
    flows.running_rollup(stream, str(tmp_path / "states"), str(tmp_path / "jobs"), str(tmp_path / "c")).awaitTermination()
    newest = spark.read.parquet(folder).groupBy("job_id", "file_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    columns = ["job_id", "files", "completed", "job_status"]
    got = spark.read.parquet(str(tmp_path / "jobs")).select(F.col("job_id").cast(dict(newest.dtypes)["job_id"]), *columns[1:])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, flows.rollup_of(newest).select(*columns).collect()))


def test_late_events_do_not_rearm(spark, tmp_path):
    """A file that has finished is not reported, though an older event of it arrives in a later batch."""
    at = lambda m: datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=m)
    schema = "file_id string, ts timestamp, status string"
    for k, rows in enumerate([[("f", at(2), "completed"), ("g", at(1), "processing")], [("f", at(1), "processing")], [("z", at(60), "completed")], [("z", at(90), "completed")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.replay(flows.stuck(src, 300_000), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert [r["file_id"] for r in spark.read.schema("file_id string, since timestamp").parquet(str(tmp_path / "out")).collect()] == ["g"]


def test_ages_of_a_long_queue(spark):
    """8,000 items' times in microseconds add up to more than a long holds."""
    now = datetime(2026, 1, 1, tzinfo=UTC)
    start = int(now.timestamp() * 1_000_000)
    items = spark.range(8000).select(F.timestamp_micros(F.lit(start) - (F.col("id") + 1) * 1000).alias("ts"), F.when(F.col("id") < 7999, "processing").otherwise("pending").alias("status"))
    row = flows.queue_figures(items, spark.createDataFrame([(now,)], "as_of timestamp")).collect()[0]
    assert (row.active, row.waiting, row.mean_age_ms, row.wait_ms) == (7999, 1, 4000, 8000)
