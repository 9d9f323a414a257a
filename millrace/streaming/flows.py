"""Event flows as Structured Streaming, each with its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import queue_health

RETRY_LIMIT, BACKOFF_MS = 3, 5000


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def latest_status(stream: DataFrame, key: str = "file_id", ts: str = "ts", status: str = "status", order: str = "event_id") -> DataFrame:
    """Latest status per key, by event time and then id; a late event never overwrites a newer one."""
    kind = dict(stream.dtypes)[key]

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (pd.Timestamp.min.value, -1, None)
        before = best
        for b in batches:
            t = b[ts].astype("int64").to_numpy()
            at = max(range(len(b)), key=lambda i: (t[i], b[order].iloc[i]))
            best = max(best, (int(t[at]), int(b[order].iloc[at]), b[status].iloc[at]), key=lambda x: x[:2])
        if best != before:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], "ts_ns": [best[0]], "event_id": [best[1]], "status": [best[2]]})

    rows = stream.select(key, ts, order, status)
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, ts_ns long, event_id long, status string", "ts_ns long, event_id long, status string", "update", GroupStateTimeout.NoTimeout)


def latest_status_batch(events: DataFrame, key: str = "file_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(F.struct("status", order), F.struct(ts, order)).alias("r")).select(key, F.col(f"r.{order}").alias("event_id"), F.col("r.status").alias("status"))


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    return event_time(stream, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def retries(stream: DataFrame, key: str = "file_id", ts: str = "ts") -> DataFrame:
    """Per failure: the number of the retry and its due time, or that the limit is reached; success starts anew."""
    kind = dict(stream.dtypes)[key]

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for e in pd.concat(list(batches)).sort_values(ts).itertuples():
            if e.status == "completed":
                n = 0
            elif e.status == "failed":
                n += 1
                due = getattr(e, ts) + pd.Timedelta(milliseconds=BACKOFF_MS * 2 ** (n - 1))
                out.append((k[0], n, "retry" if n <= RETRY_LIMIT else "failed", due))
        state.update((n,))
        yield pd.DataFrame(out, columns=[key, "retries", "outcome", "due"])

    return stream.select(key, ts, "status").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, retries int, outcome string, due timestamp", "n int", "append", GroupStateTimeout.NoTimeout)


def stuck(stream: DataFrame, limit_ms: int, key: str = "file_id", ts: str = "ts") -> DataFrame:
    """Keys that stay in processing for longer than a limit of event time."""
    kind = dict(stream.dtypes)[key]

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The state is the newest event's time and whether it is in processing, so a late event changes nothing.
        if state.hasTimedOut:
            since, waits = state.get
            state.remove()
            if waits:
                yield pd.DataFrame({key: [k[0]], "since": [pd.Timestamp(since, unit="ms", tz="UTC")]})
            return
        last = pd.concat(list(batches)).sort_values(ts).iloc[-1]
        at = int(last[ts].value // 1_000_000)
        if not state.exists or at >= state.get[0]:
            state.update((at, bool(last["status"] == "processing")))
        state.setTimeoutTimestamp(max(state.get[0] + limit_ms, state.getCurrentWatermarkMs() + 1))

    return event_time(stream, ts).withWatermark(ts, "1 minute").select(key, ts, "status").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, since timestamp", "since long, waits boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stuck_batch(events: DataFrame, as_of: Column, limit: str, key: str = "file_id", ts: str = "ts") -> DataFrame:
    last = events.groupBy(key).agg(F.max_by(F.struct("status", ts), F.struct(ts, "event_id")).alias("r"))
    return last.filter((F.col("r.status") == "processing") & (F.col(f"r.{ts}") + F.expr(f"INTERVAL {limit}") < as_of)).select(key, F.col(f"r.{ts}").alias("since"))


def request_rate(events: DataFrame, key: str, limit: int, ts: str = "ts", width: str = "15 minutes") -> DataFrame:
    """Keys with more than a limit of events in a fixed window; on a stream the caller sets the watermark."""
    w = F.window(ts, width)
    return events.groupBy(w.alias("w"), key).agg(F.count("*").alias("requests")).filter(F.col("requests") > limit).select(F.col("w.start").alias("window_start"), key, "requests")


def queue_metrics(events: DataFrame, ts: str = "ts", width: str = "1 hour", wait_ms: Column | None = None) -> DataFrame:
    """Per window: items waiting, in progress, oldest and newest, and the health of the queue; wait_ms: what an event waited,
    whose mean over the waiting ones counts for health (without it waits count as none).  See queue_waiting for the age of
    the oldest item as the wait."""
    w = F.window(ts, width)
    wait = F.lit(0) if wait_ms is None else F.coalesce(F.avg(F.when(F.col("status") == "pending", wait_ms)), F.lit(0.0))
    m = events.groupBy(w.alias("w")).agg(F.count_if(F.col("status") == "pending").alias("waiting"), F.count_if(F.col("status") == "processing").alias("active"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"), wait.alias("wait") if wait_ms is not None else F.max(F.lit(0)).alias("wait"))
    score, kind = queue_health(F.col("waiting"), F.col("active"), F.col("wait"))
    out = m.select(F.col("w.start").alias("window_start"), "waiting", "active", "oldest", "newest", "wait", score.alias("score"), kind.alias("health"))
    return out.drop("wait") if wait_ms is None else out.withColumnRenamed("wait", "mean_wait_ms")


def newest_items(events: DataFrame, key: str = "file_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """(key, status, ts): where each item stands by its newest event."""
    return events.groupBy(key).agg(F.max_by(F.struct("status", ts), F.struct(ts, order)).alias("r")).select(key, "r.*")


def queue_figures(items: DataFrame, as_of: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """One row for a queue of (status, ts): waiting and active items, oldest and newest waiting, utilisation in percent (active
    of active and waiting, 0 without any active), and as of a time (one row) the mean age of active items and the age of the
    oldest waiting one in milliseconds, 0 if there is none."""
    pending, active = F.col("status") == "pending", F.col("status") == "processing"
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    found = items.agg(
        F.count_if(pending).alias("waiting"),
        F.count_if(active).alias("active"),
        F.min(F.when(pending, F.col(ts))).alias("oldest"),
        F.max(F.when(pending, F.col(ts))).alias("newest"),
        F.sum(F.when(active, micros.cast("decimal(20,0)"))).alias("began"),  # beyond a long from some 5,000 items on
        F.min(F.when(pending, micros)).alias("first"),
    )
    share = F.when(F.col("active") > 0, F.lit(100.0) * F.col("active") / (F.col("active") + F.col("waiting"))).otherwise(F.lit(0.0))
    found = found.withColumn("utilisation", share)
    if as_of is None:
        return found.drop("began", "first")
    now = as_of.toDF("as_of").select(F.unix_micros(F.col("as_of").cast("timestamp")).alias("t"))
    mean = F.when(F.col("active") > 0, F.expr("(CAST(t AS DECIMAL(19,0)) * CAST(active AS DECIMAL(18,0)) - began) div active div 1000")).otherwise(F.lit(0))
    wait = F.when(F.col("waiting") > 0, F.expr("(t - first) div 1000")).otherwise(F.lit(0))
    return found.join(F.broadcast(now)).withColumn("mean_age_ms", mean.cast("long")).withColumn("wait_ms", wait.cast("long")).drop("began", "first", "t")


def queue_waiting(events: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Per window, as of its end: the items waiting and in progress, the age of the oldest waiting one as the queue's wait,
    and the health that follows."""
    w = F.window(ts, width)
    pending = F.col("status") == "pending"
    m = events.groupBy(w.alias("w")).agg(F.count_if(pending).alias("waiting"), F.count_if(F.col("status") == "processing").alias("active"), F.min(F.when(pending, F.col(ts))).alias("oldest"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    m = m.withColumn("wait_ms", F.coalesce(F.floor((micros("w.end") - micros("oldest")) / 1000), F.lit(0)).cast("long"))
    score, kind = queue_health(F.col("waiting"), F.col("active"), F.col("wait_ms"))
    return m.select(F.col("w.start").alias("window_start"), "waiting", "active", "wait_ms", score.cast("long").alias("score"), kind.alias("health"))


def rollup_of(latest: DataFrame, job: str = "job_id") -> DataFrame:
    """A job's state from its files' latest states: completed if all are, partial if some are, else failed."""
    n = latest.groupBy(job).agg(F.count("*").alias("files"), F.count_if(F.col("status") == "completed").alias("completed"))
    return n.withColumn("job_status", F.when(F.col("files") == F.col("completed"), "completed").when(F.col("completed") > 0, "partial").otherwise("failed"))


def running_rollup(stream: DataFrame, states: str, rollups: str, checkpoint: str, key: str = "file_id", job: str = "job_id", ts: str = "ts", order: str = "event_id"):
    """Job states that follow a stream of file events: each micro-batch folds the newest event of each file into the jobs it
    touches, and only those jobs' folders are replaced.  A batch that is run again after a failure gives the same rows."""
    from ..sources.io import write_curated
    from ..sources.shared import cut

    def fold(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(job, key, ts, order, "status")
        try:
            rows = spark.read.schema(rows.schema).parquet(states).join(rows.select(job).distinct(), job, "left_semi").select(*rows.columns).union(rows)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        newest = cut(rows.groupBy(job, key).agg(F.max_by(F.struct(ts, order, "status"), F.struct(ts, order)).alias("r")).select(job, key, "r.*"))
        write_curated(newest, states, job)
        write_curated(rollup_of(newest, job), rollups, job)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def active_sessions(sessions: DataFrame, as_of: Column, expires: str = "expires_at", accepted: str | None = None) -> DataFrame:
    """Sessions (or open invitations) that have not expired."""
    out = sessions.filter(F.col(expires) > as_of)
    return out.filter(F.col(accepted).isNull()) if accepted else out


def audit_with_users(feed: DataFrame, users: DataFrame, key: str = "user_id") -> DataFrame:
    """A feed, streaming or not, with the static user's name."""
    return feed.join(users.select(F.col("id").alias(key), F.col("name").alias("user_name")), key, "left")


def replay(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", name: str | None = None):
    """Run a stream over what is there, into files (append) or a memory table (any mode)."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (w.format("memory").queryName(name) if name else w.format("parquet").option("path", sink)).start()
