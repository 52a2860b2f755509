"""Keyed state with timers: spans of beats that end by a timer, and per-key state that expires when its key is silent.

Needs the RocksDB state store. State of a key is small values, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import DEAD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DEAD = "user_id long, first_beat timestamp, last_beat timestamp, beats long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def merge_spans(spans: list[tuple[int, int, int]], times: list[int], gap: int) -> list[tuple[int, int, int]]:
    """spans: (first, last, beats), apart by ``gap`` at least; with more times, in any order, merged where they are closer."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted([*spans, *((t, t, 1) for t in times)]):
        if out and first - out[-1][1] < gap:
            a, b, k = out[-1]
            out[-1] = (a, max(b, last), k + n)
        else:
            out.append((first, last, n))
    return out


class Heartbeats(StatefulProcessor):
    """Open spans of a key, and one timer, ``gap_ms`` after the last beat of the span that ends first; when it fires, the spans that are over tell that the key was dead."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, beats long")

    def _due(self, last: int) -> int:
        """The span is over once the watermark is here, in milliseconds."""
        return -(-(last + self.gap) // 1000)

    def _next(self, spans: list[tuple[int, int, int]]) -> int:
        """The timer of the key: spans are in order of time."""
        return self._due(spans[0][1])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = [tuple(s) for s in self.open.get()]
        spans = merge_spans(before, [t for frame in rows for t in frame["at"].tolist()], self.gap)
        if not before or self._next(before) != self._next(spans):
            if before:
                self.handle.deleteTimer(self._next(before))
            self.handle.registerTimer(self._next(spans))
        self.open.put(spans)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        over, left = [], []
        for s in self.open.get():
            at = self._due(s[1])
            (over if at <= due or at < now else left).append(tuple(s))
        if left:
            self.open.put(left)
            self.handle.registerTimer(self._next(left))
        else:
            self.open.clear()
        stamp = lambda k: pd.to_datetime([s[k] for s in over], unit="us", utc=True)
        yield pd.DataFrame({"user_id": [key[0]] * len(over), "first_beat": stamp(0), "last_beat": stamp(1), "beats": [s[2] for s in over]})

    def close(self) -> None:
        pass


#: Keys share so many states: one call into the state store serves all keys of a crowd, and a crowd's spans are arrays.
CROWDS = 1024


def merge_crowd(spans: np.ndarray, keys: np.ndarray, times: np.ndarray, gap: int) -> np.ndarray:
    """``merge_spans`` of many keys at once. spans: rows of key, first, last, beats; with a beat at each of ``times`` of ``keys``. The result is in order of key and time."""
    n, m = len(spans), len(times)
    key = np.concatenate([spans[:, 0], spans[:, 0], keys])
    at = np.concatenate([spans[:, 1], spans[:, 2], times])
    beats = np.concatenate([spans[:, 3], np.zeros(n, np.int64), np.ones(m, np.int64)])
    opens = np.repeat([1, -1, 0], [n, n, m])  # a span begins, and ends; beats within it belong to it
    order = np.lexsort((-opens, at, key))
    key, at, beats = key[order], at[order], beats[order]
    if not len(key):
        return spans
    within = np.cumsum(opens[order])[:-1] > 0
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (~within & (at[1:] - at[:-1] >= gap))]))
    last = np.append(first[1:], len(key)) - 1
    return np.stack([key[first], at[first], at[last], np.add.reduceat(beats, first)], 1)


class Crowd(StatefulProcessor):
    """The rule of ``Heartbeats`` for many keys in one state: the open spans of all, packed, and one timer, for the span of them that ends first."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "spans binary")

    def _spans(self) -> np.ndarray:
        state = self.open.get()
        return np.frombuffer(bytes(state[0]) if state else b"", np.int64).reshape(-1, 4)

    def _due(self, last: np.ndarray) -> np.ndarray:
        """Spans are over once the watermark is here, in milliseconds."""
        return -(-(last + self.gap) // 1000)

    def _next(self, spans: np.ndarray) -> int:
        return int(self._due(spans[:, 2].min()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, frames = self._spans(), list(rows)
        keys, times = (np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("user_id", "at"))
        spans = merge_crowd(before, keys, times, self.gap)
        if not len(before) or self._next(before) != self._next(spans):
            if len(before):
                self.handle.deleteTimer(self._next(before))
            self.handle.registerTimer(self._next(spans))
        self.open.update((spans.tobytes(),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = self._spans()
        at = self._due(spans[:, 2])
        over = (at <= expiredTimerInfo.getExpiryTimeInMs()) | (at < timerValues.getCurrentWatermarkInMs())
        left = spans[~over]
        if len(left):
            self.open.update((left.tobytes(),))
            self.handle.registerTimer(self._next(left))
        else:
            self.open.clear()
        stamp = lambda k: pd.to_datetime(spans[over, k], unit="us", utc=True)
        told = spans[over, 0] if key[0] >= 0 else [None] * np.count_nonzero(over)
        yield pd.DataFrame({"user_id": told, "first_beat": stamp(1), "last_beat": stamp(2), "beats": spans[over, 3]})

    def close(self) -> None:
        pass


def dead_keys(events: DataFrame, dead_after: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """One row each time a key has been silent for ``dead_after``, told by a timer: when the watermark passes, not when the next beat comes."""
    crowd = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(CROWDS)))  # rows without a key are one key
    beats = events.where("ts IS NOT NULL").withWatermark("ts", late).select(F.coalesce("user_id", F.lit(0)).alias("user_id"), "ts", F.unix_micros("ts").alias("at"), crowd.alias("crowd"))
    gap_ms = int(pd.Timedelta(dead_after).total_seconds() * 1000)
    return beats.groupBy("crowd").transformWithStateInPandas(Crowd(gap_ms), _DEAD, "append", "EventTime")


class Sessions(StatefulProcessor):
    """The rule of operators.runs.session_fold on one value of state, which a timer drops ``ttl_ms`` after its key's last probe."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "status string, failures long, notified boolean, notices long, backoff double, drop_at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, failures, notified, notices, backoff, due = self.state.get() or ("unknown", 0, False, 0, 1.0, 0)
        if due:
            self.handle.deleteTimer(due)
        probes = sorted((t, e, s) for frame in rows for t, e, s in zip(frame["at"], frame["event_id"], frame["status"], strict=True))
        for _, _, seen in probes:
            if seen == "live":
                failures, notified = 0, False
            elif seen in DEAD:
                failures += 1
                notices += status == "live"
                notified = notified or status == "live"
            elif seen == "rate_limited":
                backoff = min(64.0, backoff * 2)
            status = seen
        due = max(due, probes[-1][0] // 1000 + self.ttl)
        self.handle.registerTimer(due)
        self.state.update((status, int(failures), bool(notified), int(notices), float(backoff), int(due)))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "failures": [failures], "notified": [notified], "notices": [notices], "backoff": [int(backoff)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, status: Column, ttl: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Each session's state after the rows so far. A session of which no probe comes for ``ttl``, by the watermark, is forgotten: it begins anew."""
    rows = events.withWatermark("ts", late).select("user_id", "ts", "event_id", status.alias("status"), F.unix_micros("ts").alias("at"))
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(ttl_ms), "user_id long, status string, failures long, notified boolean, notices long, backoff long", "update", "EventTime")
