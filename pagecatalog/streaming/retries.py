"""Retry standing of URLs as keyed state with timers: what is due again says so, what is
finished is forgotten.

Each URL has one small value: attempts, whether one succeeded, the last error and when it
came. Two event-time timers go with it. One fires when a failed URL is due again and emits
``due``; the other fires ``horizon`` after the last attempt and clears the value, whatever
its standing, so state holds the URLs of one horizon, not of all time. A URL that returns
after that starts anew. A URL has few rows in a batch, so they are handed over as rows: a pandas
frame per URL, in and out, would cost more than the work on it.

State needs the RocksDB provider (``streams.with_rocksdb``); it lies on the executors' disks
and in the checkpoint. ``streams.track_retries`` is the form without timers: a plain
aggregation that never forgets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagecatalog import defaults as D

STATE = "standing"
_VALUE = "attempts int, done boolean, error string, last_us bigint"
_OUT = "url string, attempts bigint, state string, error string, retry_at_us bigint"
_US = 1_000_000


class RetryStanding(StatefulProcessor):
    """Rows ``(url, ok, error, at_us)`` in; one standing per URL and batch out, and ``due``."""

    def __init__(self, max_attempts: int, delay: float, horizon_seconds: float):
        self.max_attempts, self.delay = max_attempts, delay
        self.horizon_us = int(horizon_seconds * _US)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState(STATE, _VALUE)

    def due_us(self, attempts: int, last_us: int) -> int:
        return last_us + int(self.delay * 2 ** (attempts - 1) * _US)

    def timers(self, attempts: int, done: bool, last_us: int) -> set[int]:
        """In milliseconds, never before what they stand for."""
        ends = -(-(last_us + self.horizon_us) // 1000)
        if done or attempts >= self.max_attempts:
            return {ends}
        return {ends, -(-self.due_us(attempts, last_us) // 1000)}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.standing.get()
        # a batch hands over rows before it fires timers
        ended = kept and timerValues.getCurrentWatermarkInMs() * 1000 >= kept[3] + self.horizon_us
        set_before = self.timers(kept[0], kept[1], kept[3]) if kept else set()
        attempts, done, error, last_us = kept if kept and not ended else (0, False, None, None)
        newest = None
        for row in rows:
            attempts, done = attempts + 1, done or bool(row["ok"])
            if newest is None or row["at_us"] > newest["at_us"]:
                newest = row
        if last_us is None or newest["at_us"] >= last_us:
            last_us, error = newest["at_us"], newest["error"]
        wanted = self.timers(attempts, done, last_us)
        for timer in set_before - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - set_before:
            self.handle.registerTimer(timer)
        self.standing.update((attempts, done, error, last_us))
        yield self.row(key[0], attempts, done, error, last_us)

    def row(self, url: str, attempts: int, done: bool, error: str | None, last_us: int, due: bool = False) -> Row:
        dead = not done and attempts >= self.max_attempts
        state = "done" if done else "dead" if dead else "due" if due else "retry"
        return Row(url=url, attempts=attempts, state=state, error=error if dead else None,
                   retry_at_us=None if done or dead else self.due_us(attempts, last_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.standing.get()
        if kept is None:
            return
        attempts, done, error, last_us = kept
        if expiredTimerInfo.getExpiryTimeInMs() * 1000 >= last_us + self.horizon_us:
            self.standing.clear()
        else:
            yield self.row(key[0], attempts, done, error, last_us, due=True)

    def close(self) -> None:
        pass


def retry_standing(log: DataFrame, horizon: str, late: str, max_attempts: int = D.MAX_ATTEMPTS,
                   delay: float = D.REQUEST_DELAY) -> DataFrame:
    """Standing of each URL that a batch of the streamed log ``(url, ok, error, ts)`` touched, as
    ``streams.track_retries`` gives it, and a row ``due`` when a retry's time has come. Use
    update mode.

    Rows later than ``late`` are dropped; both times are intervals such as ``"2 hours"``.
    """
    start = "timestamp '2000-01-01 00:00:00'"  # in whatever zone the session has
    seconds = log.sparkSession.sql(f"SELECT (unix_micros({start} + interval {horizon}) - unix_micros({start})) / 1e6").first()[0]
    rows = log.withWatermark("ts", late).select("url", "ok", "error", F.unix_micros("ts").alias("at_us"), "ts")
    return rows.groupBy("url").transformWithState(
        statefulProcessor=RetryStanding(max_attempts, delay, float(seconds)), outputStructType=_OUT,
        outputMode="Update", timeMode="EventTime")


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The URLs a stopped query still holds, ``(url, attempts, done, error, last_us)``."""
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return state.select("key.url", "value.*")
