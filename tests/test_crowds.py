"""Keys that share a state: the spans of each are those of the rule for one key, and calls into the state store do not grow with the keys."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from support import DATA

from postlake.plans import streams
from postlake.sources.store import shared
from postlake.streaming import jobs, timers


def test_a_crowd_has_the_spans_of_its_keys():
    rng = random.Random(4)
    for _ in range(200):
        beats = [(rng.randrange(4), rng.randrange(200)) for _ in range(rng.randrange(40))]
        crowd, each = np.empty((0, 4), np.int64), {}
        for a, b in ((0, 10), (10, 25), (25, 40)):  # as they come, batch by batch
            keys, times = (np.array([x[k] for x in beats[a:b]], np.int64) for k in (0, 1))
            crowd = timers.merge_crowd(crowd, keys, times, 10)
            each = {k: timers.merge_spans(each.get(k, []), [t for j, t in beats[a:b] if j == k], 10) for k in range(4)}
        assert [tuple(r) for r in crowd.tolist()] == [(k, *s) for k in range(4) for s in each[k]]


class _Handle:
    """One value of state, timers, and the number of calls."""

    def __init__(self):
        self.state, self.timers, self.calls = None, set(), 0

    getValueState = lambda self, *a: self
    get = lambda self: self.state

    def update(self, state):
        self.state, self.calls = state, self.calls + 1

    def clear(self):
        self.state = None

    def registerTimer(self, t):
        self.timers.add(t)
        self.calls += 1

    def deleteTimer(self, t):
        self.timers.remove(t)


def test_a_crowd_has_one_state_and_one_timer():
    """A thousand keys: one value and one timer; what is over is told when it fires, the rest waits. Rows without a key are one key."""

    class Fired:
        def __init__(self, t):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: t

    h, p = _Handle(), timers.Crowd(10)
    p.init(h)
    keys = np.arange(1000)
    list(p.handleInputRows((1,), iter([pd.DataFrame({"user_id": keys, "at": keys * 1000})]), None))
    assert h.calls == 2 and h.timers == {10}
    h.timers.remove(10)  # as Spark does with one that fires
    told = pd.concat(p.handleExpiredTimer((1,), Fired(500), Fired(10)))
    assert sorted(told["user_id"]) == list(range(490)) and h.timers == {500}
    assert pd.concat(p.handleExpiredTimer((-1,), Fired(5000), Fired(500)))["user_id"].isna().sum() == 510 and h.state is None


def test_batches_of_several_files(spark, tmp_path, monkeypatch):
    """A batch of many rows is several files, as many as every other batch, so that no row is late: the spans are the same."""
    events = spark.read.parquet(f"{DATA}/events.parquet")
    more = events.crossJoin(spark.range(10).withColumnRenamed("id", "k")).withColumns({"event_id": F.col("event_id") + F.col("k") * 1_000_000, "user_id": F.col("user_id") + F.col("k") * 1_000_000}).drop("k")
    more.write.parquet(f"{tmp_path}/events.parquet")
    read, files = jobs.read, []
    monkeypatch.setattr(jobs, "read", lambda spark, path, n: files.append((n, len(spark.read.parquet(path).inputFiles()))) or read(spark, path, n))
    timers.use_rocksdb(spark)
    one, two = (jobs.to_table(timers.dead_keys(streams.in_batches(spark, str(tmp_path), rows_a_file=n)), shared(spark), "append").drop("batch") for n in (1_000_000, 1500))
    assert files == [(1, 4), (2, 8)]
    assert one.count() > 0 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
