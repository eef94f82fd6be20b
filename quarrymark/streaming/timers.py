"""Keyed state with event-time timers: page entries that expire one by one, runs that end at their deadline.

Each entry or run holds a few numbers, never a page; a timer frees them. Rows of a key that come in one
micro-batch are taken in the order of their time; rows behind the watermark don't count. Timers fire once
the watermark has passed them, so what a run returns follows from the rows and the last watermark alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

EXPIRED = "url string, fetched_at timestamp, expires_at timestamp"
ENDED = "run_id string, processed long, failed long, deadline_reached boolean"
#: Buckets that runs are dealt to; a bucket's open runs are held at once.
BUCKETS = 512
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class PageExpiry(StatefulProcessor):
    """One entry per URL with an expiry of its own; a row when it ends without a newer fetch before."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "fetched long, expires long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(pair for part in rows for pair in zip(part["fetched"].tolist(), part["expires"].tolist(), strict=True))
        held = self.entry.get() if self.entry.exists() else None
        before, ended = held, []
        for fetched, expires in arrived:
            if held is not None and fetched < held[0]:
                continue  # an older fetch than the one held, from a later micro-batch
            if held is not None and held[1] <= fetched:
                ended.append(held)
            held = (fetched, expires)
        if held is not None and (before is None or tuple(before) != tuple(held)):
            if before is not None:
                self.handle.deleteTimer(_fire_at(before[1]))
            self.entry.update(held)
            self.handle.registerTimer(_fire_at(held[1]))
        if ended:
            yield _expired(key[0], ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and _fire_at(held[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield _expired(key[0], [held])

    def close(self) -> None:
        pass


def _fire_at(micros: int) -> int:
    """The millisecond of a timer that never fires before the time."""
    return -(-micros // 1000)


def _expired(url: str, entries: list[tuple[int, int]]) -> pd.DataFrame:
    kinds = {"url": "object", "fetched_at": "datetime64[us]", "expires_at": "datetime64[us]"}
    return pd.DataFrame({"url": [url] * len(entries), "fetched_at": [_stamp(e[0]) for e in entries], "expires_at": [_stamp(e[1]) for e in entries]}).astype(kinds)


class RunDeadline(StatefulProcessor):
    """Runs by buckets: each ends whole with its last expected page, else with what it has at its deadline.

    State and timers are asked for once per bucket and micro-batch, as a call to the state store costs far more
    than a page does. A bucket holds its open runs and one timer, for the next deadline among them.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, runs string")

    def _held(self) -> tuple[int | None, dict[str, list]]:
        """The timer set and the bucket's runs: expected, deadline, processed, failed, done."""
        timer, runs = self.open.get() if self.open.exists() else (None, "{}")
        return timer, json.loads(runs)

    def _keep(self, timer: int | None, runs: dict[str, list]) -> None:
        following = min((_fire_at(run[1]) for run in runs.values()), default=None)
        if following != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if following is not None:
                self.handle.registerTimer(following)
        if runs:
            self.open.update((following, json.dumps(runs)))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ("run_id", "finished", "url", "failed", "expected", "deadline")
        timer, runs = self._held()
        ended = []
        for run_id, finished, _, bad, *plan in sorted(row for part in rows for row in zip(*(part[n].tolist() for n in names), strict=True)):
            run = runs.setdefault(run_id, [*plan, 0, 0, False])
            if run[4] or finished > run[1]:
                continue
            run[2], run[3] = run[2] + 1, run[3] + int(bad)
            if run[2] >= run[0]:
                run[4] = True
                ended.append((run_id, run[2], run[3], False))
        self._keep(timer, runs)
        if ended:
            yield _ended(ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        _, runs = self._held()
        over = {run_id: run for run_id, run in runs.items() if _fire_at(run[1]) <= now}
        self._keep(None, {run_id: run for run_id, run in runs.items() if run_id not in over})  # this timer is gone as it fired
        partial = [(run_id, run[2], run[3], True) for run_id, run in over.items() if not run[4]]
        if partial:
            yield _ended(partial)

    def close(self) -> None:
        pass


def _ended(rows: list[tuple[str, int, int, bool]]) -> pd.DataFrame:
    kinds = {"run_id": "object", "processed": "int64", "failed": "int64", "deadline_reached": "bool"}
    return pd.DataFrame(rows, columns=list(kinds)).astype(kinds)


def expired_entries(entries: DataFrame, late: str) -> DataFrame:
    """A row per cache entry (url, fetched_at, expires_at) of a stream whose time ran out: at its expiry, or found
    expired by the next fetch of the URL. Entries without URL or times are left out."""
    micros = lambda c: F.unix_micros(F.col(c))
    keyed = entries.where("url is not null and fetched_at is not null and expires_at is not null").withWatermark("fetched_at", late)
    rows = keyed.select("url", "fetched_at", micros("fetched_at").alias("fetched"), micros("expires_at").alias("expires"))
    return rows.groupBy("url").transformWithStateInPandas(PageExpiry(), EXPIRED, "Append", "EventTime")


def ended_runs(pages: DataFrame, late: str) -> DataFrame:
    """A row per run of a stream of pages (run_id, url, finished_at, failed, expected, deadline): complete with the expected
    page, in the order of time and URL, else partial at the deadline with the pages finished until then."""
    micros = lambda c: F.unix_micros(F.col(c))
    keyed = pages.where("run_id is not null and finished_at is not null and deadline is not null").withWatermark("finished_at", late)
    rows = keyed.select("run_id", "finished_at", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("failed", F.lit(False)).alias("failed"), F.col("expected").cast("long").alias("expected"), micros("finished_at").alias("finished"), micros("deadline").alias("deadline"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(RunDeadline(), ENDED, "Append", "EventTime")


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream with timers over all that is there, into a Parquet folder."""
    spark: SparkSession = stream.sparkSession
    former = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(_PROVIDER, former) if former is not None else spark.conf.unset(_PROVIDER)
