"""Queries: streams run over the events table to its end; each equals its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.store import shared
from ..streaming import jobs as S
from ..streaming import timers
from .registry import ORACLE_SQL, query, table
from .runs import FOLD_SQL, LOCK_SQL, LOCK_STATUS, PROBE


@query("SELECT strftime(date_trunc('minute', ts) - k * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest(range(5)) AS k) GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    out = S.to_table(S.windowed_counts(S.read(spark, f"{sf_dir}/events.parquet")), shared(spark), "update")
    rows = S.latest(out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "batch"), ["window_start", "event_type"])
    return rows.select("window_start", "event_type", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_per_key(spark, sf_dir):
    return S.to_table(S.first_per_key(S.read(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"]), shared(spark), "append").select("user_id", "event_type")


@query(FOLD_SQL)
def stream_session_fold(spark, sf_dir):
    out = S.to_table(S.session_fold(S.read(spark, f"{sf_dir}/events.parquet"), F.expr(PROBE)), shared(spark), "update")
    return S.latest(out, ["user_id"]).select("user_id", "status", "failures", "notified", "notices", "backoff")


@query(LOCK_SQL)
def stream_terminal_lock(spark, sf_dir):
    out = S.to_table(S.terminal_lock(S.read(spark, f"{sf_dir}/events.parquet"), F.expr(LOCK_STATUS)), shared(spark), "update")
    return S.latest(out, ["user_id"]).select("user_id", "applied", "ignored")


@query("""SELECT user_id, strftime(time_bucket(INTERVAL 10 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS span, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY ALL""")
def stream_progress(spark, sf_dir):
    out = S.to_table(S.latest_progress(S.read(spark, f"{sf_dir}/events.parquet")), shared(spark), "update")
    return S.latest(out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("span"), "value", "n", "batch"), ["user_id", "span"]).select("user_id", "span", "value", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS first FROM events), g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_beat, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_beat, count(*) AS beats FROM g GROUP BY user_id, g HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_heartbeats(spark, sf_dir):
    """Only spans that are closed when the stream ends: those whose end the watermark has passed."""
    out = S.to_table(S.heartbeats(S.read(spark, f"{sf_dir}/events.parquet")), shared(spark), "append")
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("first_beat"), F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"), "beats")


@query("SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id)")
def stream_without_known(spark, sf_dir):
    history = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    events = S.read(spark, f"{sf_dir}/events.parquet")
    return S.to_table(S.without_known(events, ["user_id", "event_type"], history, ["user_id"]), shared(spark), "append").select("user_id", "event_type")


@query("SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-22' - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-22' - INTERVAL 7 DAY) AS late FROM events GROUP BY ALL")
def stream_split_late(spark, sf_dir):
    """Two tables of one stream: what is late goes to the side output."""
    late = S.is_late(F.to_timestamp(F.lit("2024-01-22")), 7)
    tables = S.to_tables(S.read(spark, f"{sf_dir}/events.parquet").select("ts", "event_type"), shared(spark), {"kept": ~late, "late": late})
    kept, side = (df.groupBy("event_type").agg(F.count(F.lit(1)).alias(n)) for n, df in tables.items())
    return kept.join(side, "event_type", "full").select("event_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "late")])


def in_batches(spark, sf_dir, files=4, rows_a_file=1_000_000):
    """The users' beats as a stream of several micro-batches in order of time, where every tenth row comes fifty minutes late. A batch of many rows is as many files, written at once."""
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("user_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 10 == 0, 3_000_000_000).otherwise(0)).alias("seen"))
    low, high, n = rows.agg(F.min("seen"), F.max("seen"), F.count("seen")).first()
    batch = F.floor((F.col("seen") - low) * files / (high - low + 1))
    each = {r["k"]: r["n"] for r in rows.groupBy(batch.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # no more than files
    wide = -(-max(each.get(k, 0) for k in range(files)) // rows_a_file)
    wide = wide if min(each.get(k, 0) for k in range(files)) >= 1000 * wide else 1  # no file is empty: a batch is just so many
    for k in range(files):  # one after the other: a stream takes files in the order in which they were written
        own = rows.where(batch == k).drop("seen")
        (own.repartition(wide) if wide > 1 else own.coalesce(1)).write.mode("append").parquet(path)
    return S.read(spark, path, wide)


@query(ORACLE_SQL["stream_heartbeats"])
def stream_dead_by_timer(spark, sf_dir):
    """Dead keys told by timers, over several micro-batches, some rows of which come late: the spans of the batch form."""
    timers.use_rocksdb(spark)
    out = S.to_table(timers.dead_keys(in_batches(spark, sf_dir)), shared(spark), "append")
    return out.select("user_id", F.date_format("first_beat", "yyyy-MM-dd HH:mm:ss").alias("first_beat"), F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss").alias("last_beat"), "beats")


@query(FOLD_SQL)
def stream_session_state_ttl(spark, sf_dir):
    """The session rule on a value of state that a timer drops once its key has been silent for sixty days."""
    timers.use_rocksdb(spark)
    out = S.to_table(timers.sessions(S.read(spark, f"{sf_dir}/events.parquet"), F.expr(PROBE), "60 days"), shared(spark), "update")
    return S.latest(out, ["user_id"]).select("user_id", "status", "failures", "notified", "notices", "backoff")


@query("""SELECT t.event_id AS trigger_id, s.event_id AS stop_id FROM events t JOIN events s ON t.user_id % 20 = s.user_id % 20 AND t.event_type = 'click' AND s.event_type = 'error' AND t.ts > s.ts AND t.ts <= s.ts + INTERVAL 300 SECOND""")
def stream_cooldown(spark, sf_dir):
    """Stops and triggers of twenty sites within five minutes."""
    e = S.read(spark, f"{sf_dir}/events.parquet").withColumn("site", F.col("user_id") % 20)
    stops = e.where("event_type = 'error'").select("site", "ts", F.col("event_id").alias("stop_id"))
    triggers = e.where("event_type = 'click'").select("site", "ts", F.col("event_id").alias("trigger_id"))
    return S.to_table(S.cooled_down(stops, triggers, "site", 300), shared(spark), "append").select("trigger_id", "stop_id")
