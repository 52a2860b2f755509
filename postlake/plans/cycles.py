"""Queries: cycles and runs over their life, over orders, events and the canonical table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles as C
from .canonical import canon
from .expected import CANON
from .registry import query, table
from .runs import SITE, events, orders

_STATES = "['scrape_running', 'scrape_complete', 'postscrape_running', 'post_scrape_complete', 'failed']"
_CYCLES = f"c AS (SELECT o_orderkey AS id, ({_STATES})[o_custkey % 5 + 1] AS status, o_orderdate AS started_at, o_custkey % 3 AS instance FROM orders)"
NOW, _NOW = "2001-07-01 00:00:00", "TIMESTAMP '2001-07-01'"


def cycles(spark, sf_dir):
    """Orders as cycles."""
    states = F.array(*[F.lit(s) for s in ("scrape_running", "scrape_complete", "postscrape_running", "post_scrape_complete", "failed")])
    none = lambda kind: F.lit(None).cast(kind)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.element_at(states, (F.col("o_custkey") % 5 + 1).cast("int")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_custkey") % 3).alias("instance"),
        none("timestamp").alias("phase_heartbeat_at"), none("timestamp").alias("completed_at"), none("string").alias("error_message"), none("string").alias("match_results"),
        F.when(F.col("o_orderkey") % 4 > 0, '{"expired":1}').alias("cleanup_results"),
    )


def now():
    return F.to_timestamp(F.lit(NOW))


@query(f"WITH {_CYCLES} SELECT CASE status WHEN 'scrape_complete' THEN 'postscrape_running' ELSE status END AS status, status = 'scrape_complete' AS claimed, status = 'scrape_complete' AS has_beat, count(*) AS n FROM c GROUP BY ALL")
def cycle_claim(spark, sf_dir):
    out = C.claim_cycles(cycles(spark, sf_dir), now())
    return out.groupBy("status", "claimed", F.col("phase_heartbeat_at").isNotNull().alias("has_beat")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_CYCLES} SELECT id, CASE WHEN status <> 'postscrape_running' THEN status WHEN id % 3 = 0 THEN 'failed' ELSE 'post_scrape_complete' END AS status, CASE WHEN status = 'postscrape_running' AND id % 3 = 0 THEN 'Post-scrape phase failed: E' || id END AS error_message,
    CASE WHEN status = 'postscrape_running' AND id % 3 <> 0 THEN '{{"claim_summary":null,"claim_retired":true}}' END AS match_results, id % 4 > 0 AS cleaned FROM c""")
def cycle_finish(spark, sf_dir):
    out = C.finish_cycles(cycles(spark, sf_dir), F.when(F.col("id") % 3 == 0, F.concat(F.lit("E"), F.col("id"))), now())
    return out.select("id", "status", "error_message", "match_results", F.col("cleanup_results").isNotNull().alias("cleaned"))


_RULES = (
    ("runs_at_startup", "status = 'running'", 120, "NULL", "'Auto-cleaned: stale on startup'", "NULL", "NULL"),
    ("cycles_at_startup", "status IN ('scrape_running', 'postscrape_running')", 120, "'Interrupted by backend restart or shutdown'", "NULL", "NULL", "NULL"),
    ("runs_at_trigger", "status = 'running'", 60, "'Scan exceeded 60 minutes without completion; backend likely lost contact during scan. Please retry.'", "NULL", "NULL", "NULL"),
    ("lazy_cleanup", "status = 'running'", 10, "'Marked failed by cleanup-invalid-entries (>10 min stale)'", "NULL", "'lazy_cleanup_timeout'", "'transient'"),
    ("orphan_cycles", "status = 'scrape_running' AND id % 3 <> 1", 0, "'Orphan cycle: extension instance mismatch'", "NULL", "NULL", "NULL"),
    ("stop", "status = 'running'", 0, "'Stopped by user'", "NULL", "NULL", "NULL"),
)
_AGED = f"r AS (SELECT o_orderkey AS id, (['running', 'scrape_running', 'postscrape_running', 'completed'])[o_custkey % 4 + 1] AS status, {_NOW} - CAST(o_orderkey % 200 AS INTEGER) * INTERVAL 1 MINUTE AS started_at FROM orders)"


@query(f"WITH {_AGED} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, CASE WHEN h THEN 'failed' ELSE status END AS status, CASE WHEN h THEN {e} END AS error_message, CASE WHEN h THEN {x} END AS session_error, CASE WHEN h THEN {f} END AS failure_reason, CASE WHEN h THEN {g} END AS failure_category, count(*) AS n FROM (SELECT *, {cond}{f' AND started_at < {_NOW} - INTERVAL {m} MINUTE' if m else ''} AS h FROM r) GROUP BY ALL" for k, cond, m, e, x, f, g in _RULES))
def reaper_rules(spark, sf_dir):
    """Each reaper over the same runs and cycles; every third cycle belongs to the instance that asks."""
    o = table(spark, sf_dir, "orders")
    none = lambda k: F.lit(None).cast("string").alias(k)
    states = F.array(*map(F.lit, ("running", "scrape_running", "postscrape_running", "completed")))
    rows = o.select(F.col("o_orderkey").alias("id"), F.element_at(states, (F.col("o_custkey") % 4 + 1).cast("int")).alias("status"), (now() - F.make_dt_interval(mins=(F.col("o_orderkey") % 200).cast("int"))).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), *map(none, ("error_message", "session_error", "failure_reason", "failure_category")))
    out = None
    for name, rule in C.REAPERS.items():
        own = C.reap_by(rows, rule, now(), F.col("id") % 3 != 1 if name == "orphan_cycles" else None)
        own = own.groupBy(F.lit(name).alias("rule"), "status", "error_message", "session_error", "failure_reason", "failure_category").agg(F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT 0::BIGINT AS deleted_jobs_empty_core, 0::BIGINT AS deleted_jobs_empty_jd, 0::BIGINT AS deleted_jobs_mismatched_website, count(*) FILTER (o_custkey % 4 = 0 AND o_orderkey % 200 > 10) AS marked_failed_run_logs, 0::BIGINT AS marked_failed_dedup_tasks FROM orders")
def lazy_cleanup_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.when(F.col("o_custkey") % 4 == 0, "running").otherwise("completed").alias("status"), (now() - F.make_dt_interval(mins=(F.col("o_orderkey") % 200).cast("int"))).alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"), *[F.lit(None).cast("string").alias(k) for k in ("error_message", "failure_reason", "failure_category")])
    return C.cleanup_counts(C.reap_by(rows, C.REAPERS["lazy_cleanup"], now()))


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'running' END AS s, CASE event_type WHEN 'error' THEN 'e' || event_id END AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS error_message, CAST(0 AS BIGINT) AS applied FROM e UNION ALL
      SELECT e.user_id, e.k, CASE WHEN locked THEN f.status ELSE coalesce(e.s, f.status) END, CASE WHEN locked THEN f.error_message WHEN e.s = 'completed' AND f.status IS DISTINCT FROM 'completed' THEN NULL ELSE coalesce(e.m, f.error_message) END, applied + CASE WHEN locked THEN 0 ELSE 1 END
      FROM (SELECT f.*, f.status = 'completed' AS done FROM f) f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1, LATERAL (SELECT coalesce(f.done, FALSE) AND e.s IS NULL AS locked))
    SELECT user_id, status, error_message, applied FROM f QUALIFY k = max(k) OVER (PARTITION BY user_id)""")
def run_log_merge(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"status": F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'running' END"), "error_message": F.expr("CASE event_type WHEN 'error' THEN concat('e', event_id) END")})
    return C.merged_updates(e, "user_id", ["at", "event_id"])


@query("""WITH e AS (SELECT * FROM events WHERE event_type IN ('purchase', 'view')), r AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_id FROM e WHERE event_type = 'view')
    SELECT r.user_id, r.event_id, arg_max(p.event_id, (p.ts, p.event_id)) AS got FROM r LEFT JOIN e p ON p.event_type = 'purchase' AND p.user_id = r.user_id AND (p.ts, p.event_id) < (r.ts, r.event_id) AND (r.before IS NULL OR (p.ts, p.event_id) > (r.before, r.before_id)) GROUP BY ALL""")
def mailbox_read_and_clear(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("own", F.col("event_id"))
    return C.mailbox_reads(e, "user_id", ["at", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view", "own").select("user_id", "event_id", "got")


@query("SELECT o_orderkey AS run_id, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def cycle_id_sequence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderdate")
    return C.next_ids(o, ["o_orderdate", "run_id"], 1000).select("run_id", "id")


@query("""SELECT o_orderkey AS id, (coalesce(o_orderkey % 3 = 0, FALSE) OR o_orderkey % 5 = 0) AND o_custkey % 7 <> 0 AND o_orderstatus <> 'P' AND o_custkey % 4 <> 1 AS may FROM orders""")
def bootstrap_guard(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    phase = F.when(F.col("o_orderstatus") == "P", F.when(k % 2 == 0, "scrape_running").otherwise("postscrape_running")).when(k % 2 == 0, "idle")
    return table(spark, sf_dir, "orders").select(k.alias("id"), C.may_bootstrap(F.when(k % 3 == 0, True), k % 5 == 0, F.when(c % 7 == 0, True), phase, c % 4 == 1).alias("may"))


@query(f"SELECT {SITE} AS site, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL")
def newest_running_run(spark, sf_dir):
    return C.newest_running(orders(spark, sf_dir).select("site", "status", "started_at", "run_id"), ["site"]).select("site", "run_id")


@query(f"WITH {_CYCLES} SELECT id, status, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at FROM c ORDER BY c.started_at DESC, id DESC LIMIT 100")
def cycle_listing(spark, sf_dir):
    return C.newest(cycles(spark, sf_dir), "started_at", "id", 100).select("id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("SELECT s_suppkey AS site_key, 's' || s_suppkey AS site, s_nationkey % 5 AS failures FROM supplier ORDER BY site")
def session_listing(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_key"), F.concat(F.lit("s"), "s_suppkey").alias("site"), (F.col("s_nationkey") % 5).alias("failures"))
    return rows.orderBy("site")


@query("SELECT c_custkey * 3 AS run_id, o_totalprice AS trace FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 3 AND o_orderstatus <> 'P'")
def run_trace_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("run_id"))
    traces = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run_id"), F.col("o_totalprice").alias("trace"))
    return C.traces_of(wanted, traces, "run_id")


@query(f"WITH {CANON} SELECT 'word ' || (CAST(substr(scan_run_id, 5) AS INTEGER) % 6) AS keyword, source_site, count(*) AS n FROM canon GROUP BY ALL")
def postings_by_search(spark, sf_dir):
    runs = spark.range(40).select(F.concat(F.lit("run-"), "id").alias("scan_run_id"), F.concat(F.lit("word "), F.col("id") % 6).alias("keyword"))
    return C.with_runs(canon(spark, sf_dir), runs).groupBy("keyword", "source_site").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, o_orderstatus = 'F' AND (o_custkey % 4 > 1 OR o_custkey % 5 = 0 OR o_custkey % 7 = 0 OR o_custkey % 3 = 0) AS partial FROM orders""")
def partial_results(spark, sf_dir):
    c = F.col("o_custkey")
    ids = F.when(c % 3 == 0, F.array(F.lit("x"))).when(c % 3 == 1, F.array().cast("array<string>"))
    out = C.has_partial_results(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok"), F.when(c % 4 > 1, 2).otherwise(0), F.when(c % 5 == 0, "{}"), F.when(c % 7 == 0, "{}"), ids)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), out.alias("partial"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN strftime(make_timestamp(1704067200000000 + event_id * 1000000), '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def next_cycle_estimate(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, "0").when(k % 5 == 1, "soon").when(k % 5 == 2, "-5").when(k % 5 == 4, (F.lit(1704067200000) + k * 1000).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(C.next_cycle_at(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT probe, run, cycle, heartbeat, count(*) AS n FROM (SELECT (['success', 'danger', 'danger', 'warning', 'neutral', 'neutral'])[o_orderkey % 6 + 1] AS probe, (['info', 'success', 'danger', 'neutral'])[o_orderkey % 4 + 1] AS run, (['info', 'success', 'info', 'success', 'danger'])[o_custkey % 5 + 1] AS cycle, (['success', 'warning', 'danger', 'neutral'])[o_custkey % 4 + 1] AS heartbeat FROM orders) GROUP BY ALL""")
def status_tones(spark, sf_dir):
    pick = lambda k, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(k) % len(v) + 1).cast("int"))
    kinds = {
        "probe": pick("o_orderkey", "live", "expired", "captcha", "rate_limited", "unknown", None), "run": pick("o_orderkey", "running", "completed", "failed", "odd"),
        "cycle": pick("o_custkey", "scrape_running", "scrape_complete", "postscrape_running", "post_scrape_complete", "failed"), "heartbeat": pick("o_custkey", "fresh", "aging", "stale", "never"),
    }
    return table(spark, sf_dir, "orders").groupBy(*[C.tone(k, c).alias(k) for k, c in kinds.items()]).agg(F.count(F.lit(1)).alias("n"))
