"""Cycles and runs over their life: claims, finishing, the reapers' rules, merged updates, mailboxes, and lookups by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .ingest import ordered


def claim_cycles(cycles: DataFrame, now: Column) -> DataFrame:
    """Adds claimed. Every cycle whose scrape is complete moves on to its second phase, with a first heartbeat."""
    hit = F.col("status") == "scrape_complete"
    return cycles.withColumns({"claimed": hit, "status": F.when(hit, "postscrape_running").otherwise(F.col("status")), "phase_heartbeat_at": F.when(hit, now).otherwise(F.col("phase_heartbeat_at"))})


def finish_cycles(cycles: DataFrame, error: Column, now: Column) -> DataFrame:
    """Ends the second phase. A cycle that failed keeps its cleanup results, if it came so far, and gets no claim marker."""
    hit = F.col("status") == "postscrape_running"
    failed = hit & error.isNotNull()
    return cycles.withColumns(
        {
            "status": F.when(failed, "failed").when(hit, "post_scrape_complete").otherwise(F.col("status")),
            "error_message": F.when(failed, F.concat(F.lit("Post-scrape phase failed: "), error)).otherwise(F.col("error_message")),
            "match_results": F.when(hit & ~failed, '{"claim_summary":null,"claim_retired":true}').otherwise(F.col("match_results")),
            "completed_at": F.when(hit, now).otherwise(F.col("completed_at")),
        }
    )


@dataclass(frozen=True)
class Reaper:
    """Rows in one of the states, started over so many minutes ago (0: all), become failed with these values."""

    states: tuple[str, ...]
    minutes: int
    error_message: str | None = None
    session_error: str | None = None
    failure_reason: str | None = None
    failure_category: str | None = None


# What each reaper takes, and what it writes.
REAPERS = {
    "runs_at_startup": Reaper(("running",), 120, session_error="Auto-cleaned: stale on startup"),
    "cycles_at_startup": Reaper(("scrape_running", "postscrape_running"), 120, "Interrupted by backend restart or shutdown"),
    "runs_at_trigger": Reaper(("running",), 60, "Scan exceeded 60 minutes without completion; backend likely lost contact during scan. Please retry."),
    "lazy_cleanup": Reaper(("running",), 10, "Marked failed by cleanup-invalid-entries (>10 min stale)", failure_reason="lazy_cleanup_timeout", failure_category="transient"),
    "orphan_cycles": Reaper(("scrape_running",), 0, "Orphan cycle: extension instance mismatch"),
    "stop": Reaper(("running",), 0, "Stopped by user"),
}


def reap_by(df: DataFrame, rule: Reaper, now: Column, applies: Column | None = None) -> DataFrame:
    """Adds reaped. applies: a condition on the whole call, such as that the instances differ."""
    hit = F.col("status").isin(*rule.states)
    if rule.minutes:
        hit = hit & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(rule.minutes)))
    hit = F.coalesce(hit if applies is None else hit & applies, F.lit(False))
    values = {k: getattr(rule, k) for k in ("error_message", "session_error", "failure_reason", "failure_category")}
    change = {k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items() if v}
    return df.withColumns(change | {"reaped": hit, "status": F.when(hit, "failed").otherwise(F.col("status")), "completed_at": F.when(hit, now).otherwise(F.col("completed_at"))})


def phase_after(phase: Column, cycles_reaped: Column) -> Column:
    """The state's phase is idle again once any cycle was reaped at startup."""
    return F.when(cycles_reaped > 0, "idle").otherwise(phase)


def cleanup_counts(reaped: DataFrame) -> DataFrame:
    """One row: what the lazy cleanup answers; four of its counters are retired and stay 0."""
    retired = ("deleted_jobs_empty_core", "deleted_jobs_empty_jd", "deleted_jobs_mismatched_website")
    return reaped.agg(*[F.lit(0).cast("long").alias(k) for k in retired], F.count_if("reaped").alias("marked_failed_run_logs"), F.lit(0).cast("long").alias("marked_failed_dedup_tasks"))


def merged_updates(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """updates: status and error_message, null where one does not bring them. Each run's state after all of them.

    An update without a status does nothing to a completed run; the update that completes a run clears its error.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = updates.withColumn("_now", F.last("status", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where(F.col("status").isNotNull() | ~F.coalesce(F.col("_now") == "completed", F.lit(False)))
    clears = (F.col("status") == "completed") & ~F.coalesce(F.col("_now") == "completed", F.lit(False))
    place = F.struct(*order)
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, place))
    told = F.col("error_message").isNotNull() & ~F.coalesce(clears, F.lit(False))
    state = rows.groupBy(key).agg(
        last(F.col("status"), F.col("status").isNotNull()).alias("status"), last(F.col("error_message"), told).alias("_error"), F.max(F.when(told, place)).alias("_told"), F.max(F.when(clears, place)).alias("_cleared"),
        F.count(F.lit(1)).alias("applied"),
    )
    kept = F.col("_cleared").isNull() | (F.col("_told") > F.col("_cleared"))
    return state.select(key, "status", F.when(kept, F.col("_error")).alias("error_message"), "applied")


def mailbox_reads(events: DataFrame, key: str, order: list[str], put: Column, read: Column, value: str) -> DataFrame:
    """One row for each read: the value of the last put since the read before, null if there was none; a read empties the box."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumns({"_put": put, "_read": read}).where("_put OR _read")
    rows = rows.withColumn("_turn", F.count_if("_read").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_read").cast("int"))
    place = F.struct(*order)
    turns = rows.groupBy(key, "_turn").agg(F.max(F.when(F.col("_read"), place)).alias("_at"), F.max_by(F.when(F.col("_put"), F.col(value)), F.when(F.col("_put"), place)).alias("got"))
    return turns.where("_at IS NOT NULL").select(key, "_at.*", "got")


def next_ids(rows: DataFrame, order: list[str], last: int) -> DataFrame:
    """Adds id: the numbers after ``last``, in order; rows that tie keep to one of their orders.

    Rows are range-partitioned and sorted, and written, with each row's place in its partition; an id is that place and
    the sizes of all partitions before, a sum over a row a partition.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a partition
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_place") + F.col("_before") + last + 1).alias("id"))


def may_bootstrap(enabled: Column, test_pending: Column, exit_requested: Column, phase: Column, alarm: Column) -> Column:
    """Whether an instance schedules the next cycle itself: wanted, not told to leave, no cycle active, no alarm set."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (yes(enabled) | yes(test_pending)) & ~yes(exit_requested) & ~yes(phase.isin("scrape_running", "postscrape_running")) & ~yes(alarm)


def newest_running(runs: DataFrame, by: list[str]) -> DataFrame:
    """The running run of each group that started last."""
    cols = [c for c in runs.columns if c not in by]
    return runs.where("status = 'running'").groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct("started_at", "run_id")).alias("_last")).select(*by, "_last.*")


def newest(df: DataFrame, at: str, key: str, limit: int, most: int = 100) -> DataFrame:
    """The latest rows, a top-k."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return df.orderBy(F.desc(at), F.desc(key)).limit(limit)


def traces_of(wanted: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """wanted's rows with the trace of that very run, null if there is none: by id, never by position."""
    return wanted.join(traces, key, "left")


def with_runs(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """Postings with the search of the run that brought them; every posting has a run."""
    return postings.join(runs, "scan_run_id")


def has_partial_results(status: Column, succeeded: Column, cleanup: Column, matches: Column, run_ids: Column) -> Column:
    """A cycle that failed, but not before some work was done."""
    return (status == "failed") & ((succeeded > 0) | cleanup.isNotNull() | matches.isNotNull() | (F.coalesce(F.size(run_ids), F.lit(0)) > 0))


def next_cycle_at(c: Column) -> Column:
    """Epoch milliseconds as text; null, zero, negative or unreadable is no time."""
    ms = c.try_cast("long")
    return F.when(ms > 0, F.timestamp_millis(ms))


# How each state is shown.
TONES = {
    "probe": {"live": "success", "expired": "danger", "captcha": "danger", "rate_limited": "warning", "unknown": "neutral"},
    "run": {"running": "info", "completed": "success", "failed": "danger"},
    "cycle": {"scrape_running": "info", "scrape_complete": "success", "postscrape_running": "info", "post_scrape_complete": "success", "failed": "danger"},
    "heartbeat": {"fresh": "success", "aging": "warning", "stale": "danger", "never": "neutral"},
}


def tone(kind: str, c: Column) -> Column:
    return ordered([(t, c.isin(*[s for s, own in TONES[kind].items() if own == t])) for t in ("success", "danger", "warning", "info")], "neutral")
