"""Streaming forms: keyed token buckets, incremental manifests, windowed counts.

Watermarks and windows are extensions for event analytics; the bucket's state and rules are those of the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.control import RESERVATIONS, Account, Bucket


def _decided(bucket: Bucket, now: int, cost: float) -> tuple:
    if cost >= 0:
        return bucket.take(now, cost)
    bucket.give(-cost)  # as in the batch form
    return True, bucket.tokens, 0


def rate_limit_stream(events: DataFrame, capacity: float, per_ms: float, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, allowed, remaining, retry_after_ms) for a stream of (key, event_id, ts_ms, cost).

    Everything goes by the events' own clock: a bucket's state goes when the watermark (``late`` behind the newest event)
    has passed the time at which it would be full again, so that replayed events find the bucket they left, and no
    decision depends on when they are processed. Events beyond the watermark are not judged.
    """
    idle = int(capacity / per_ms) + 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        p = pd.concat(list(batches)).sort_values(["ts_ms", "event_id"])
        tokens, at = state.get if state.exists else (capacity, int(p["ts_ms"].iloc[0]))
        bucket = Bucket(capacity, per_ms, at, tokens)
        rows = [(key[0], e, *_decided(bucket, int(t), float(c))) for e, t, c in zip(p["event_id"], p["ts_ms"], p["cost"], strict=True)]
        state.update((bucket.tokens, bucket.at))
        state.setTimeoutTimestamp(max(bucket.at + idle + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "event_id", "allowed", "remaining", "retry_after_ms"]).astype({"retry_after_ms": "Int64"})

    # the first watermark is the epoch, at which an event would be late
    timed = events.withColumn("ts", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(
        step, "key bigint, event_id bigint, allowed boolean, remaining double, retry_after_ms bigint", "tokens double, at bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


class Reservations(StatefulProcessor):
    """Accounts on state that outlives a run: a value for the bucket, whose capacity and rate are fixed when it is made, a map of
    open reservations by number, and a timer by the events' clock that sweeps an account when it has been idle for as
    long as its bucket takes to fill."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, at bigint, last bigint, capacity double, per_ms double")
        self.open = handle.getMapState("open", "number bigint", "cost double")

    def _load(self) -> Account:
        account = Account()
        if self.bucket.exists():
            tokens, at, account.last, capacity, per_ms = self.bucket.get()
            account.bucket = Bucket(capacity, per_ms, at, tokens)
            account.open = {k[0]: v[0] for k, v in self.open.iterator()}
        return account

    def _store(self, before: dict, account: Account) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if account.bucket is None:
            self.bucket.clear()
            self.open.clear()
            return
        b = account.bucket
        self.bucket.update((b.tokens, b.at, account.last, b.capacity, b.per_ms))
        for number in before.keys() - account.open.keys():
            self.open.removeKey((number,))
        for number, cost in account.open.items():
            if before.get(number) != cost:
                self.open.updateValue((number,), (cost,))
        self.handle.registerTimer(account.last + account.idle_ms())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat(list(rows)).sort_values(["ts_ms", "event_id"])
        account = self._load()
        before = dict(account.open)
        columns = [p[c].tolist() for c in ("event_id", "kind", "ts_ms", "number", "cost", "capacity", "per_ms")]
        out = [(key[0], event, *account.act(*rest)) for event, *rest in zip(*columns, strict=True)]
        self._store(before, account)
        yield pd.DataFrame(out, columns=["key", "event_id", "outcome", "remaining"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        account = self._load()
        before = dict(account.open)
        account.sweep(expiredTimerInfo.getExpiryTimeInMs())
        if account.bucket is None:
            self._store(before, account)
        return iter(())

    def close(self) -> None:
        pass


def reservation_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream form of ``token_reservations``: each micro-batch's events are decided in order of their time, on the accounts that
    those before left. Needs the RocksDB state store."""
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Reservations(), RESERVATIONS, "Append", "EventTime")


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(event_type, start, n) of tumbling windows; repeats of an event within the watermark count once."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    w = e.groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.col("w.start").alias("start"), "n")


def incremental_index(changes: DataFrame, path: str, checkpoint: str, key: str = "source_file"):
    """Start a query that adds each micro-batch's files to a table at ``path`` as a part of its own, named by the
    batch, so that a repeated batch replaces itself; readers take the latest version of a key."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, key: str = "source_file") -> DataFrame:
    """The newest row of each key of an incremental table."""
    rest = [c for c in table.columns if c not in (key, "version", "batch")]
    newest = table.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("r"))
    return newest.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
