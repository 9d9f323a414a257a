"""Flows that need timers: retries that come due and sessions that expire.  Each has its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import BACKOFF_MS, RETRY_LIMIT, event_time

#: Configuration that these flows need.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _millis(column: pd.Series) -> list[int]:
    return [int(x.value // 1_000_000) for x in pd.to_datetime(column, utc=True)]


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms", tz="UTC")


class RetryTimers(StatefulProcessor):
    """Events of a key in event order; each failure's timer emits its retry when it is due.

    Rows of a key are held until they are final: up to the watermark their order can no longer change.  A failure's number
    counts the failures since the last success or since the limit was passed.  Numbers up to the limit emit ``retry`` at
    their due time, unless a success comes first; the next one emits ``failed`` at its own time, which ends the series.
    State is removed when no row waits and no series is open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "ms long, event_id long, status string, told boolean")
        self.open = handle.getValueState("open", "failures int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, have, new = timerValues.getCurrentWatermarkInMs(), set(), []
        for ms, event_id, _, _ in self.events.get():
            have.add((ms, event_id))
        for batch in rows:
            for ms, event_id, status in zip(_millis(batch["ts"]), batch["event_id"], batch["status"], strict=True):
                if ms >= mark and (ms, int(event_id)) not in have and status in ("failed", "completed"):
                    have.add((ms, int(event_id)))
                    new.append((ms, int(event_id), status, False))
        for row in new:
            self.events.appendValue(row)
            self.handle.registerTimer(row[0] + 1)  # fires when nothing can come before the row any more
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.events.get())
        n = int(self.open.get()[0]) if self.open.exists() else 0
        before, settled, kept, out = n, True, [], []
        for at, (ms, event_id, status, told) in enumerate(rows):
            due = ms
            if status == "completed":
                n = 0
            else:
                n += 1
                due = ms + BACKOFF_MS * 2 ** (n - 1) if n <= RETRY_LIMIT else ms
                if ms < mark and not told:
                    if due < mark:
                        cancelled = n <= RETRY_LIMIT and any(s == "completed" and t <= due for t, _, s, _ in rows[at + 1 :])
                        if not cancelled:
                            out.append((key[0], n, "retry" if n <= RETRY_LIMIT else "failed", _time(due)))
                        told = True
                    else:
                        self.handle.registerTimer(due + 1)
                if n > RETRY_LIMIT:
                    n = 0
            settled = settled and ms < mark and (told or status == "completed")
            if settled:
                before = n
            else:
                kept.append((ms, event_id, status, told))
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        if before:
            self.open.update((before,))
        elif self.open.exists():
            self.open.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "retries", "outcome", "due"])

    def close(self) -> None:
        pass


def retry_timers(stream: DataFrame, key: str = "file_id", ts: str = "ts", order: str = "event_id", delay: str = "1 minute") -> DataFrame:
    """(key, retries, outcome, due) of a stream of (key, ts, order, status); events may be late by ``delay``."""
    rows = event_time(stream, ts).withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).cast("long").alias("event_id"), "status")
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithStateInPandas(RetryTimers(), f"key {kind}, retries int, outcome string, due timestamp", "Append", "EventTime")
    return out.withColumnRenamed("key", key)


def retry_timers_batch(events: DataFrame, key: str = "file_id", ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The same over all events of a table."""
    rows = events.filter(F.col("status").isin("failed", "completed")).select(key, F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("o"), "status")
    ended = Window.partitionBy(key).orderBy("ts", "o")
    rows = rows.withColumn("series", F.count_if(F.col("status") == "completed").over(ended.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("success", F.min(F.when(F.col("status") == "completed", F.col("ts"))).over(ended.rowsBetween(1, Window.unboundedFollowing)))
    failed = rows.filter("status = 'failed'").withColumn("n", F.row_number().over(Window.partitionBy(key, "series").orderBy("ts", "o")))
    failed = failed.withColumn("retries", (F.col("n") - 1) % (RETRY_LIMIT + 1) + 1)
    again = F.col("retries") <= RETRY_LIMIT
    wait = F.make_dt_interval(secs=F.lit(BACKOFF_MS / 1000) * F.pow(F.lit(2.0), F.col("retries") - 1))
    due = F.when(again, F.col("ts") + wait).otherwise(F.col("ts"))
    return failed.withColumn("due", due).filter(~again | F.col("success").isNull() | (F.col("success") > F.col("due"))).select(key, "retries", F.when(again, "retry").otherwise("failed").alias("outcome"), "due")


class Sessions(StatefulProcessor):
    """Sessions by token.  A login starts one, a refresh or another login lengthens it, a logout or the end of its time ends it.

    Rows are held until the watermark has passed them, so they count in event order.  A session lives ``ttl`` from its last
    login or refresh (both ends count); its state goes with it.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, event_id long, kind string")
        self.live = handle.getValueState("live", "started long, seen long, refreshes int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        have = {(ms, event_id) for ms, event_id, _ in self.waiting.get()}
        for batch in rows:
            for ms, event_id, kind in zip(_millis(batch["ts"]), batch["event_id"], batch["kind"], strict=True):
                if ms >= mark and (ms, int(event_id)) not in have:
                    have.add((ms, int(event_id)))
                    self.waiting.appendValue((ms, int(event_id), kind))
                    self.handle.registerTimer(ms + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        live = tuple(self.live.get()) if self.live.exists() else None
        out, later = [], []
        for ms, event_id, kind in rows:
            if ms >= mark:
                later.append((ms, event_id, kind))
                continue
            if live and ms > live[1] + self.ttl:
                out.append((key[0], _time(live[0]), _time(live[1] + self.ttl), live[2], "expired"))
                live = None
            if kind == "logout":
                if live:
                    out.append((key[0], _time(live[0]), _time(ms), live[2], "logout"))
                live = None
            elif live:
                live = (live[0], ms, live[2] + 1)
            elif kind == "login":
                live = (ms, ms, 0)
        if live and live[1] + self.ttl < mark:
            out.append((key[0], _time(live[0]), _time(live[1] + self.ttl), live[2], "expired"))
            live = None
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if live:
            self.live.update(live)
            self.handle.registerTimer(live[1] + self.ttl + 1)
        elif self.live.exists():
            self.live.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "started", "ended", "refreshes", "reason"])

    def close(self) -> None:
        pass


def ended_sessions(stream: DataFrame, ttl_ms: int, key: str = "token", ts: str = "ts", order: str = "event_id", delay: str = "1 minute") -> DataFrame:
    """Sessions as they end, of a stream of (key, ts, order, kind: login, refresh or logout)."""
    rows = event_time(stream, ts).withWatermark(ts, delay).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).cast("long").alias("event_id"), "kind")
    schema = f"key {dict(rows.dtypes)['key']}, started timestamp, ended timestamp, refreshes int, reason string"
    return rows.groupBy("key").transformWithStateInPandas(Sessions(ttl_ms), schema, "Append", "EventTime").withColumnRenamed("key", key)


def sessions_batch(events: DataFrame, ttl_ms: int, key: str = "token", ts: str = "ts", order: str = "event_id", as_of=None) -> DataFrame:
    """All sessions of a table: (key, started, ended, refreshes, reason).  With ``as_of`` a session that lives then has
    neither an end nor a reason."""
    ttl = F.make_dt_interval(secs=F.lit(ttl_ms / 1000))
    w = Window.partitionBy(key).orderBy("ts", "o")
    rows = events.select(key, F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("o"), "kind")
    rows = rows.withColumn("before", F.lag("ts").over(w)).withColumn("was", F.lag("kind").over(w))
    opens = F.col("before").isNull() | (F.col("was") == "logout") | (F.col("before") + ttl < F.col("ts"))
    rows = rows.withColumn("run", F.count_if(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seen = F.col("kind") != "logout"
    started = F.min(F.when(F.col("kind") == "login", F.struct("ts", "o"))).over(Window.partitionBy(key, "run"))
    rows = rows.withColumn("first", started).filter(F.col("first").isNotNull() & (F.struct("ts", "o") >= F.col("first")))
    found = rows.groupBy(key, "run").agg(F.min("ts").alias("started"), F.max(F.when(seen, F.col("ts"))).alias("seen"), F.max(F.when(~seen, F.col("ts"))).alias("left"), (F.count_if(seen) - 1).cast("int").alias("refreshes"))
    ended = F.coalesce("left", F.col("seen") + ttl)
    out = found.select(key, "started", ended.alias("ended"), "refreshes", F.when(F.col("left").isNotNull(), "logout").otherwise("expired").alias("reason"))
    if as_of is None:
        return out
    done = (F.col("ended") <= as_of) | (F.col("reason") == "logout")
    return out.select(key, "started", F.when(done, F.col("ended")).alias("ended"), "refreshes", F.when(done, F.col("reason")).alias("reason"))
