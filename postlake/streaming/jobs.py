"""Streaming forms of the time-based operators. Each takes and gives a streaming DataFrame; ``to_table`` runs one to its end.

A table that is being written is published batch by batch, each batch under its own folder, which a batch that runs
again overwrites: no row is lost or doubled when executors or the driver are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import DEAD


def read(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files; event times get a zone."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, it may be one file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "40 days") -> DataFrame:
    """Rows of each key in sliding five-minute windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def first_per_key(events: DataFrame, keys: list[str], shelf_life: str = "40 days") -> DataFrame:
    """Each key once within the shelf life, however often it comes."""
    return events.withWatermark("ts", shelf_life).dropDuplicatesWithinWatermark(keys)


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session's probes of a batch, in order of time: the rule of operators.runs.session_fold."""
    status, failures, notified, notices, backoff = state.get if state.exists else ("unknown", 0, False, 0, 1.0)
    own = pd.concat(frames).sort_values(["ts", "event_id"])["status"]
    dead, live = own.isin(DEAD), own == "live"
    told = dead & (own.shift(fill_value=status) == "live")
    last = live.to_numpy().nonzero()[0]
    since = last[-1] if len(last) else 0
    failures = int(dead.iloc[since:].sum()) + (0 if len(last) else failures)
    notified = bool(told.iloc[since:].any()) or (notified and not len(last))
    notices, backoff, status = notices + int(told.sum()), min(64.0, backoff * 2.0 ** min(int((own == "rate_limited").sum()), 7)), own.iloc[-1]
    state.update((status, failures, notified, notices, backoff))
    yield pd.DataFrame({"user_id": [key[0]], "status": [status], "failures": [failures], "notified": [notified], "notices": [notices], "backoff": [int(backoff)]})


def session_fold(events: DataFrame, status: Column) -> DataFrame:
    """Each session's state after the rows so far: keyed state, updated by batch."""
    rows = events.select("user_id", "ts", "event_id", status.alias("status"))
    shape = "status string, failures long, notified boolean, notices long"
    return rows.groupBy("user_id").applyInPandasWithState(_fold, f"user_id long, {shape}, backoff long", f"{shape}, backoff double", "update", GroupStateTimeout.NoTimeout)


def latest_progress(events: DataFrame, every: str = "10 seconds") -> DataFrame:
    """The last counter of each key in each span: what a mirror that writes at most once a span would write."""
    spans = events.withWatermark("ts", "40 days").groupBy(F.window("ts", every).alias("w"), "user_id")
    return spans.agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count(F.lit(1)).alias("n"))


def heartbeats(events: DataFrame, dead_after: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Spans of each key's beats; a span ends, and its key counts as dead, when no beat comes for ``dead_after``. Append mode gives closed spans."""
    w = F.session_window("ts", dead_after)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("beats"), F.max("ts").alias("last_beat"))


def without_known(events: DataFrame, keys: list[str], history: DataFrame, known: list[str], shelf_life: str = "40 days") -> DataFrame:
    """Each key once within the shelf life, and none whose ``known`` columns history has: a stream joined to a table."""
    return first_per_key(events, keys, shelf_life).join(history.select(*known), known, "left_anti")


def is_late(now: Column, shelf_life_days: int) -> Column:
    """Past the shelf life: such rows go to a side output."""
    return F.col("ts") < now - F.make_dt_interval(F.lit(shelf_life_days))


def _locked(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, applied, ignored = state.get if state.exists else (None, 0, 0)
    own = pd.concat(frames).sort_values(["ts", "event_id"])["status"]
    before = own.ffill().shift().fillna(now if now is not None else "")
    locked = own.isna() & (before == "completed")
    told = own.dropna()
    now, applied, ignored = told.iloc[-1] if len(told) else now, applied + int((~locked).sum()), ignored + int(locked.sum())
    state.update((now, applied, ignored))
    yield pd.DataFrame({"user_id": [key[0]], "applied": [applied], "ignored": [ignored]})


def terminal_lock(events: DataFrame, status: Column) -> DataFrame:
    """Updates of each run that apply and that are ignored, since the run is completed and they bring no status."""
    rows = events.select("user_id", "ts", "event_id", status.alias("status"))
    return rows.groupBy("user_id").applyInPandasWithState(_locked, "user_id long, applied long, ignored long", "now string, applied long, ignored long", "update", GroupStateTimeout.NoTimeout)


def cooled_down(stops: DataFrame, triggers: DataFrame, key: str, seconds: int = 5) -> DataFrame:
    """Triggers that come within ``seconds`` after a stop of their key: two streams joined by key and interval.

    The join's key has the span of ``seconds`` too, and a stop stands in its own span and the next, so that a trigger meets
    the stops near it and each once, not all of its key.
    """
    span = F.floor(F.unix_micros("ts") / F.lit(seconds * 1_000_000))
    a = stops.withWatermark("ts", "1 hour").withColumn("_near", F.explode(F.array(span, span + 1))).withColumnsRenamed({key: "_key", "ts": "_stopped"})
    b = triggers.withWatermark("ts", "1 hour").withColumn("_span", span)
    near = (F.col(key) == F.col("_key")) & (F.col("_span") == F.col("_near"))
    return b.join(a, near & (F.col("ts") > F.col("_stopped")) & (F.col("ts") <= F.col("_stopped") + F.expr(f"INTERVAL {seconds} SECONDS"))).drop("_near", "_span")


def to_table(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs the stream over all that is there and returns what it wrote, with the batch of each row."""
    spark = stream.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}"

    def publish(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(publish).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows")


def to_tables(stream: DataFrame, folder: str, sinks: dict[str, Column]) -> dict[str, DataFrame]:
    """Runs the stream to its end and writes each batch to several tables, to each the rows of its condition: the input is read once.

    A batch is kept while its tables are written; a batch that runs again overwrites what it wrote.
    """
    spark = stream.sparkSession
    path = f"{folder}/{uuid.uuid4().hex}"

    def publish(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for name, cond in sinks.items():
                df.where(cond).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        finally:
            df.unpersist()

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(publish).start().awaitTermination()
    return {name: spark.read.parquet(f"{path}/{name}") for name in sinks}


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update-mode table, each key's row of its last batch."""
    cols = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("_last")).select(*keys, "_last.*")
