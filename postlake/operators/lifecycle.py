"""Shelf life, claims, guarded state changes, reapers, admission and configuration rules. The clock is a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .ingest import ordered


def _cutoff(now: str, days: int) -> Column:
    return F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))


def unexpired(df: DataFrame, now: str, days: int, at: str = "scrape_time") -> DataFrame:
    """What a purge leaves: a row goes when it is older than the shelf life, claimed or not."""
    return df.where(F.col(at) >= _cutoff(now, days))


def write_by_day(df: DataFrame, path: str, at: str = "scrape_time") -> None:
    """df as a table with a folder a day."""
    df.withColumn("day", F.to_date(at)).write.mode("overwrite").partitionBy("day").parquet(path)


def purge_days(spark: SparkSession, path: str, now: str, days: int, at: str = "scrape_time") -> DataFrame:
    """Purges a table with a folder a day, and returns day, deleted: whole days older than the shelf life go with their folder,
    and only the day in which the cutoff lies is written anew.

    Rows of whole days are counted from files' footers. The boundary day is replaced in one step, after it is written; to
    purge again after a failure deletes what is left of it.
    """
    rows, cutoff = spark.read.parquet(path), _cutoff(now, days)
    limit = spark.range(1).select(F.date_format(F.to_date(cutoff), "yyyy-MM-dd")).first()[0]
    gone = rows.where(F.col("day") < F.lit(limit).cast("date")).groupBy("day").agg(F.count(F.lit(1)).alias("deleted"))
    edge = rows.where(F.col("day") == F.lit(limit).cast("date"))
    cut = edge.where(F.col(at) < cutoff).groupBy("day").agg(F.count(F.lit(1)).alias("deleted"))
    deleted = stored(gone.unionByName(cut))
    kept = edge.where(F.col(at) >= cutoff)
    if deleted.where(F.col("day") == F.lit(limit).cast("date")).count() and kept.count():
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        limit_too = False
    else:
        limit_too = bool(deleted.where(F.col("day") == F.lit(limit).cast("date")).count())
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(fs_path(path)):
        name = status.getPath().getName()
        if name.startswith("day=") and (name[4:] < limit or (limit_too and name[4:] == limit)):
            fs.delete(status.getPath(), True)
    return deleted


def expired_counts(tables: dict[str, DataFrame], now: str, days: int, at: str = "scrape_time") -> DataFrame:
    """name, deleted: one aggregation per table, united."""
    parts = [df.where(F.col(at) < _cutoff(now, days)).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(k).alias("name"), "deleted") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(rows: DataFrame, parents: DataFrame, key: str = "source_row_id") -> DataFrame:
    return rows.join(parents, key, "left_anti")


def orphans_of(rows: DataFrame, parents: dict[str, DataFrame], site: str = "source_site", key: str = "source_row_id") -> DataFrame:
    """Rows whose parent is in none of the sources' tables: a key counts in its own site's table only."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(s).alias(site), key) for s, df in parents.items()])
    return rows.join(every, [site, key], "left_anti")


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of a whose column differs from b's; nulls agree with nulls only."""
    return a.join(b.select(*keys, F.col(column).alias("_other")), keys).where(~F.col(column).eqNullSafe(F.col("_other"))).drop("_other")


def claim(df: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows claimed, oldest first; the table afterwards). Only unclaimed rows are claimed, so a second run claims none."""
    todo = df.where(~F.col("matched"))
    claimed = todo if limit is None else todo.orderBy("scrape_time", "id").limit(limit)
    if limit is None:
        return claimed, df.withColumn("matched", F.lit(True))
    marked = claimed.select("id", F.lit(True).alias("_now"))
    return claimed, df.join(marked, "id", "left").withColumn("matched", F.coalesce("_now", "matched")).drop("_now")


def transition(now: Column, wanted: Column, allowed: list[tuple[str, str]]) -> Column:
    """applied, idempotent, conflict or not_found for a wanted change of state; a null state is a missing row."""
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((now == a) & (wanted == b))
    return ordered([("not_found", now.isNull()), ("idempotent", now == wanted), ("applied", ok)], "conflict")


def reap(df: DataFrame, stale: Column, message: str) -> DataFrame:
    """Stale rows become failed, with a message; all others stay."""
    hit = F.coalesce(stale, F.lit(False))
    return df.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "error": F.when(hit, message).otherwise(F.col("error"))})


def stale_heartbeat(beat: Column, started: Column, now: Column, beat_minutes: int = 10, start_minutes: int = 5) -> Column:
    old = lambda c, minutes: c < now - F.make_dt_interval(mins=F.lit(minutes))
    return old(beat, beat_minutes) | (beat.isNull() & old(started, start_minutes))


def admission(pending: Column, stopped_ago_s: Column, running: Column, cooldown_s: float = 5.0) -> Column:
    """May a scan start? The first obstacle, or accepted."""
    return ordered([("scan_pending", pending), ("stop_cooldown", stopped_ago_s < cooldown_s), ("scan_in_progress", running)], "accepted")


def precheck(backend_up: Column, config: Column, live_sites: Column) -> Column:
    return ordered([("backend_down", ~backend_up), ("config_unavailable", ~config), ("all_sessions_dead", live_sites == 0)], "ok")


def abort_reason(exit_: Column, stop: Column, backend_down: Column, watchdog: Column, config_changed: Column) -> Column:
    return ordered([("exit", exit_), ("user_stop", stop), ("backend_down", backend_down), ("watchdog", watchdog), ("config_change", config_changed)])


def failed_in_a_row(df: DataFrame, key: str, order: list[str], ok: Column) -> DataFrame:
    """Adds streak: failures since the last success of the key, in order."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_run", F.sum(F.col("_ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("streak", F.sum((~F.col("_ok")).cast("int")).over(Window.partitionBy(key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_ok", "_run")


def config_errors(c: dict[str, Column]) -> Column:
    """Errors of a scan configuration, in order; c: enabled_sites, keywords (arrays), min_interval, inter_scan_delay, scan_timeout."""
    cells = F.size(c["enabled_sites"]) * F.size(c["keywords"])
    rules = [
        ("sites_empty", F.size(c["enabled_sites"]) == 0), ("keywords_empty", F.size(c["keywords"]) == 0), ("too_many_keywords", F.size(c["keywords"]) > 10),
        ("too_many_scans", cells > 30), ("interval_out_of_range", ~c["min_interval"].between(1, 1440)), ("delay_out_of_range", ~c["inter_scan_delay"].between(0, 600)), ("timeout_out_of_range", ~c["scan_timeout"].between(1, 60)),
    ]
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))


def config_warnings(c: dict[str, Column]) -> Column:
    cells = F.size(c["enabled_sites"]) * F.size(c["keywords"])
    return F.array_compact(F.array(F.when(cells.between(15, 30), "many_scans")))


def scoring_errors(nth: Column, strong: Column, binary: Column) -> Column:
    rules = [("nth_weight", ~nth.between(0, 1)), ("strong", (strong <= 0) | (strong > 1)), ("binary", (binary <= 0) | (binary >= strong))]
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules]))


def reset_counters(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.when(k.startswith("consecutive_"), 0).otherwise(v))


def next_sleep_minutes(min_interval: Column, elapsed: Column, succeeded: Column, elapsed_s: Column) -> Column:
    left = F.greatest(F.lit(0.0), min_interval - elapsed)
    return F.when((succeeded == 0) & (elapsed_s < 30), F.greatest(left, F.lit(5.0))).otherwise(left)


def latest_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The last row of each key in the given order, combined in map tasks."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")).select(*keys, "_last.*")
