"""Runs, cycles and traces: counters, histograms, ring buffers, state folds and run lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_map(df: DataFrame, key: str, reason: Column, failed: Column) -> DataFrame:
    """key, failures_by_reason (map): counts of failed runs, unknown where no reason is given."""
    counts = df.where(failed).groupBy(key, F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("failures_by_reason"))


def counters(df: DataFrame, keys: list[str], named: dict[str, Column]) -> DataFrame:
    """All counters of a key in one pass."""
    return df.groupBy(*keys).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in named.items()])


def ring(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """The last ``size`` rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= size).drop("_place")


def ring_of(array: Column, size: int) -> Column:
    """The last ``size`` items of an array."""
    return F.slice(array, F.greatest(F.size(array) - size + 1, F.lit(1)), F.lit(size))


def elapsed(df: DataFrame, key: str, at: str) -> DataFrame:
    """Adds dt: time since the key's first row. The first is found by an aggregation, which hot keys pass combined."""
    first = df.groupBy(key).agg(F.min(at).alias("_first"))
    return df.join(first, key).withColumn("dt", F.col(at) - F.col("_first")).drop("_first")


#: Probes that find a session dead.
DEAD = ("expired", "captcha")


def session_fold(df: DataFrame, key: str, order: list[str], status: Column) -> DataFrame:
    """Each key's state after all its probes (live, expired, captcha, rate_limited, unknown).

    Failures count dead probes since the last live one. A dead probe right after a live one gives a notice, one at most
    until the next live. The back-off doubles with each rate_limited probe, up to 64, and nothing resets it.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_status", status).withColumn("_before", F.lag("_status").over(w))
    rows = rows.withColumn("_lives", F.count_if(F.col("_status") == "live").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dead = F.col("_status").isin(*DEAD)
    since = rows.groupBy(key, "_lives").agg(
        F.count_if(dead).alias("failures"), F.count_if(dead & (F.col("_before") == "live")).alias("notices"), F.count_if(F.col("_status") == "rate_limited").alias("limited"),
        F.max_by("_status", F.struct(*order)).alias("status"),
    )
    return since.groupBy(key).agg(
        F.max_by("status", "_lives").alias("status"), F.max_by("failures", "_lives").alias("failures"), F.max_by(F.col("notices") > 0, "_lives").alias("notified"), F.sum("notices").alias("notices"),
        F.least(F.lit(64.0), F.pow(F.lit(2.0), F.sum("limited"))).cast("long").alias("backoff"),
    )


def terminal_lock(df: DataFrame, key: str, order: list[str], status: Column) -> DataFrame:
    """Adds applied: an update without a status is ignored while its run is completed."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_status", status).withColumn("_now", F.last("_status", ignorenulls=True).over(w))
    return rows.withColumn("applied", ~(F.col("_status").isNull() & F.coalesce(F.col("_now") == "completed", F.lit(False)))).drop("_now")


def newest_match(triggers: DataFrame, runs: DataFrame, site: str, at: str, run_at: str, newest: int, slack_s: int) -> DataFrame:
    """For each trigger the newest of the ``newest`` latest runs that is its site's and began at most slack_s before it."""
    latest = F.broadcast(runs.orderBy(F.desc(run_at), F.desc("run_id")).limit(newest).select(F.col(site).alias("_site"), F.col(run_at).alias("_run_at"), F.col("run_id")))
    fits = (F.col(site) == F.col("_site")) & (F.col("_run_at") >= F.col(at) - F.make_dt_interval(secs=F.lit(slack_s)))
    best = triggers.join(latest, fits, "left").groupBy("trigger_id").agg(F.max(F.struct("_run_at", "run_id")).alias("_best"))
    return best.select("trigger_id", F.col("_best.run_id").alias("run_id"))


def matrix(sites: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every enabled site with every keyword, in the order of a scan: by site, then by keyword. sites: site, place; keywords: keyword, place.

    Both are settings that validation bounds (30 scans at most), so each is one row with an array.
    """
    listed = lambda df, c: df.agg(F.transform(F.array_sort(F.collect_set(F.struct("place", c))), lambda x: x[c]).alias(f"{c}s"))
    one = listed(sites, "site").join(F.broadcast(listed(keywords, "keyword")))  # a row each
    return one.select("keywords", F.posexplode("sites").alias("site_idx", "site")).select("site_idx", "site", F.posexplode("keywords").alias("kw_idx", "keyword")).select("site_idx", "kw_idx", "site", "keyword")


def eligible(sites: DataFrame, states: DataFrame, most_failures: int) -> DataFrame:
    """Sites not suspended; one without a state is eligible."""
    suspended = states.where((F.col("failures") >= most_failures) | (F.col("status") == "captcha")).select("site")
    return sites.join(suspended, "site", "left_anti")


def viewport(df: DataFrame, order: list[str], start: int, end: int, overscan: int = 8) -> DataFrame:
    """Rows start to end of an ordered list, with some more at both sides."""
    return df.orderBy(*order).offset(max(0, start - overscan)).limit(end + overscan - max(0, start - overscan))
