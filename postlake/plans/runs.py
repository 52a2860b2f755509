"""Queries: runs, cycles, traces and state machines, over orders, lineitem, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import format as D
from ..operators import lifecycle as L
from ..operators import runs as R
from .registry import query, table

SITE = "CASE o_custkey % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' ELSE 'glassdoor' END"
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'running' ELSE 'completed' END"


def orders(spark, sf_dir):
    """Orders as runs: run_id, site, status, started_at, reason, cycle."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.expr(SITE).alias("site"), F.expr(STATUS).alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_orderpriority").alias("reason"), F.date_format("o_orderdate", "yyyy-MM").alias("cycle"))


def events(spark, sf_dir):
    """Events as traces and probes: user_id is the run or instance, at is epoch milliseconds."""
    return table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))


@query("SELECT c AS cycle, string_agg(r, ';' ORDER BY r) AS failures FROM (SELECT strftime(o_orderdate, '%Y-%m') AS c, o_orderpriority || '=' || count(*) AS r FROM orders WHERE o_orderstatus = 'F' GROUP BY c, o_orderpriority) GROUP BY ALL")
def failures_by_reason(spark, sf_dir):
    m = R.failure_map(orders(spark, sf_dir), "cycle", F.col("reason"), F.col("status") == "failed")
    return m.select("cycle", F.array_join(F.array_sort(F.transform(F.map_entries("failures_by_reason"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("failures"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS cycle, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'O') AS succeeded, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY ALL")
def scan_counters(spark, sf_dir):
    return R.counters(orders(spark, sf_dir), ["cycle"], {"attempted": F.lit(True), "succeeded": F.col("status") == "completed", "failed": F.col("status") == "failed"})


@query("""SELECT l_orderkey AS run_id, count(*) FILTER (k = 'new') AS new_jobs, count(*) FILTER (k = 'existing') AS existing, count(*) FILTER (k = 'rejected') AS rejected, count(*) FILTER (k = 'content_duplicate') AS duplicates
    FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'rejected' WHEN l_returnflag = 'A' THEN 'existing' WHEN l_linestatus = 'F' THEN 'content_duplicate' ELSE 'new' END AS k FROM lineitem) GROUP BY ALL""")
def card_result_counters(spark, sf_dir):
    kind = D.card_result(F.lit(True), F.lit(False), F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), kind.alias("k"))
    return R.counters(cards, ["run_id"], {n: F.col("k") == k for n, k in (("new_jobs", "new"), ("existing", "existing"), ("rejected", "rejected"), ("duplicates", "content_duplicate"))})


_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END"


@query(f"SELECT {_LEVEL} AS level, event_type AS phase, count(*) AS n FROM events GROUP BY ALL")
def trace_level_histogram(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.expr(_LEVEL).alias("level"), F.col("event_type").alias("phase")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10000")
def trace_ring_buffer(spark, sf_dir):
    return R.ring(events(spark, sf_dir), "user_id", ["at", "event_id"], 10000).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10000) GROUP BY ALL")
def message_ring_in_row(spark, sf_dir):
    logs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("log"))
    return logs.select("conv_id", F.array_join(F.transform(R.ring_of(F.col("log"), 10000), lambda e: e["role"]), ",").alias("roles"))


@query("SELECT event_id, user_id, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS dt FROM events")
def run_elapsed(spark, sf_dir):
    return R.elapsed(events(spark, sf_dir), "user_id", "at").select("event_id", "user_id", "dt")


PROBE = "CASE event_type WHEN 'click' THEN 'live' WHEN 'error' THEN 'expired' WHEN 'signup' THEN 'captcha' WHEN 'purchase' THEN 'rate_limited' ELSE 'unknown' END"
#: The rule as it is stated, one probe after the other.
FOLD_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, {PROBE} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 'unknown' AS status, CAST(0 AS BIGINT) AS failures, FALSE AS notified, CAST(0 AS HUGEINT) AS notices, 1.0::DOUBLE AS backoff FROM e
      UNION ALL SELECT e.user_id, e.k, e.s, CASE WHEN e.s = 'live' THEN 0 WHEN e.s IN ('expired', 'captcha') THEN failures + 1 ELSE failures END,
        CASE WHEN e.s = 'live' THEN FALSE WHEN e.s IN ('expired', 'captcha') AND status = 'live' THEN TRUE ELSE notified END,
        CASE WHEN e.s IN ('expired', 'captcha') AND status = 'live' AND NOT notified THEN notices + 1 ELSE notices END, CASE WHEN e.s = 'rate_limited' THEN least(backoff * 2, 64.0) ELSE backoff END
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, status, failures, notified, CAST(notices AS BIGINT) AS notices, CAST(backoff AS BIGINT) AS backoff FROM f QUALIFY k = max(k) OVER (PARTITION BY user_id)"""


@query(FOLD_SQL)
def session_state_fold(spark, sf_dir):
    return R.session_fold(events(spark, sf_dir), "user_id", ["at", "event_id"], F.expr(PROBE))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
    s AS (SELECT user_id, g, count(*) FILTER (event_type = 'error') AS k FROM e GROUP BY ALL) SELECT user_id, max(k) AS longest, max(k) >= 3 AS paused FROM s GROUP BY ALL""")
def precheck_autopause(spark, sf_dir):
    rows = L.failed_in_a_row(events(spark, sf_dir), "user_id", ["at", "event_id"], F.col("event_type") != "error")
    return rows.groupBy("user_id").agg(F.max("streak").alias("longest")).select("user_id", "longest", (F.col("longest") >= 3).alias("paused"))


@query("""WITH w AS (SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS start, user_id FROM events, (SELECT unnest(range(5)) AS k))
    SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, count(DISTINCT user_id) AS instances, count(DISTINCT user_id) > 1 AS warning FROM w GROUP BY ALL""")
def fresh_instances(spark, sf_dir):
    w = events(spark, sf_dir).groupBy(F.window("ts", "5 minutes", "1 minute")).agg(F.count_distinct("user_id").alias("instances"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "instances", (F.col("instances") > 1).alias("warning"))


@query("SELECT conv_id, arg_max(role, turn) AS role, sha256(arg_max(text, turn)) AS text_sha256, max(turn) AS turn FROM conversations GROUP BY ALL")
def last_write_wins(spark, sf_dir):
    return L.latest_per_key(table(spark, sf_dir, "conversations"), ["conv_id"], "turn").select("conv_id", "role", F.sha2("text", 256).alias("text_sha256"), "turn")


@query(f"SELECT {SITE} AS site, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS completed_at FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def latest_completed_per_site(spark, sf_dir):
    last = L.latest_per_key(orders(spark, sf_dir).where("status = 'completed'").select("site", "run_id", "started_at"), ["site"], "started_at", "run_id")
    return last.select("site", "run_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN b > 0 THEN 'r' || CAST(CASE WHEN h IS NULL THEN b * 3600 ELSE greatest(round(CASE WHEN h < 0.5 THEN b ELSE least(h, b) END * 3600), 3600) END AS BIGINT) END AS look_back
    FROM (SELECT o_orderkey, CAST(o_orderkey % 30 - 2 AS BIGINT) AS b, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 97 AS DOUBLE) / 4 END AS h FROM orders)""")
def search_window_seconds(spark, sf_dir):
    k = F.col("run_id")
    return orders(spark, sf_dir).select("run_id", D.window_seconds(F.when(k % 7 != 0, (k % 97).cast("double") / 4), k % 30 - 2).alias("look_back"))


@query(f"""WITH r AS (SELECT o_orderkey AS run_id, {SITE} AS site, o_orderdate AS at FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10),
    t AS (SELECT o_orderkey AS trigger_id, {SITE} AS site, o_orderdate AS at FROM orders WHERE o_orderstatus = 'F')
    SELECT trigger_id, arg_max(r.run_id, (r.at, r.run_id)) AS run_id FROM t LEFT JOIN r ON t.site = r.site AND r.at >= t.at - INTERVAL 5 SECOND GROUP BY ALL""")
def trigger_run_match(spark, sf_dir):
    o = orders(spark, sf_dir)
    triggers = o.where("status = 'failed'").select(F.col("run_id").alias("trigger_id"), "site", F.col("started_at").alias("at"))
    return R.newest_match(triggers, o.where("status = 'completed'"), "site", "at", "started_at", 10, 5)


@query("""WITH s AS (SELECT r_name AS site, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region WHERE r_regionkey < 3), k AS (SELECT c_mktsegment AS keyword, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS j FROM customer GROUP BY c_mktsegment)
    SELECT CAST(i AS INTEGER) AS site_idx, CAST(j AS INTEGER) AS kw_idx, site, keyword FROM s, k""")
def site_keyword_matrix(spark, sf_dir):
    """Enabled sites and keywords from tables, each in its table's order."""
    sites = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_name").alias("site"), F.col("r_regionkey").alias("place"))
    keywords = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("keyword")).agg(F.min("c_custkey").alias("place"))
    return R.matrix(sites, keywords)


@query("SELECT 's' || s_suppkey AS site FROM supplier WHERE s_suppkey % 5 = 0 OR (s_suppkey % 6 < 3 AND s_nationkey % 7 <> 0)")
def eligible_sites(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("s"), "s_suppkey").alias("site")
    states = s.where("s_suppkey % 5 <> 0").select(name, (F.col("s_suppkey") % 6).alias("failures"), F.when(F.col("s_nationkey") % 7 == 0, "captcha").otherwise("live").alias("status"))
    return R.eligible(s.select(name), states, 3)


@query("""SELECT k AS outcome, count(*) AS n FROM (SELECT CASE WHEN n IS NULL THEN 'not_found' WHEN n = w THEN 'idempotent' WHEN n = 'scrape_running' AND w IN ('scrape_complete', 'failed') THEN 'applied' WHEN n = 'scrape_complete' AND w = 'postscrape_running' THEN 'applied' ELSE 'conflict' END AS k
    FROM (SELECT (['scrape_running', 'scrape_complete', 'postscrape_running', NULL])[o_orderkey % 4 + 1] AS n, (['scrape_complete', 'postscrape_running', 'failed'])[o_custkey % 3 + 1] AS w FROM orders)) GROUP BY ALL""")
def cycle_transition_guard(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    now = pick(("scrape_running", "scrape_complete", "postscrape_running", None), F.col("o_orderkey"))
    wanted = pick(("scrape_complete", "postscrape_running", "failed"), F.col("o_custkey"))
    out = L.transition(now, wanted, [("scrape_running", "scrape_complete"), ("scrape_running", "failed"), ("scrape_complete", "postscrape_running")])
    return table(spark, sf_dir, "orders").groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT status, error, count(*) AS n FROM (SELECT CASE WHEN hit THEN 'failed' ELSE s END AS status, CASE WHEN hit THEN 'no heartbeat' END AS error FROM (
    SELECT CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'done' END AS s, o_orderstatus = 'P' AND CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 11 > 5 ELSE o_orderkey % 25 > 10 END AS hit FROM orders)) GROUP BY ALL""")
def stale_reapers(spark, sf_dir):
    now, minutes = F.to_timestamp(F.lit("2024-01-01 12:00:00")), lambda c: F.make_dt_interval(mins=c.cast("int"))
    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("o_orderkey") % 3 != 0, now - minutes(F.col("o_orderkey") % 25)).alias("beat"), (now - minutes(F.col("o_custkey") % 11)).alias("started"),
    )
    stale = (F.col("status") == "running") & L.stale_heartbeat(F.col("beat"), F.col("started"), now)
    return L.reap(o, stale, "no heartbeat").groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT k AS decision, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'scan_pending' WHEN o_orderkey % 13 < 5 THEN 'stop_cooldown' WHEN o_orderstatus = 'P' THEN 'scan_in_progress' ELSE 'accepted' END AS k FROM orders) GROUP BY ALL""")
def scan_admission(spark, sf_dir):
    k = F.col("o_orderkey")
    out = L.admission(k % 7 == 0, (k % 13).cast("double"), F.col("o_orderstatus") == "P")
    return table(spark, sf_dir, "orders").groupBy(out.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


LOCK_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"
LOCK_SQL = f"""WITH e AS (SELECT user_id, {LOCK_STATUS} AS s, last_value({LOCK_STATUS} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, ts, event_id FROM events)
    SELECT user_id, count(*) FILTER (NOT (s IS NULL AND coalesce(p = 'completed', FALSE))) AS applied, count(*) FILTER (s IS NULL AND coalesce(p = 'completed', FALSE)) AS ignored FROM e GROUP BY ALL"""


@query(LOCK_SQL)
def run_log_terminal_lock(spark, sf_dir):
    rows = R.terminal_lock(events(spark, sf_dir), "user_id", ["at", "event_id"], F.expr(LOCK_STATUS))
    return R.counters(rows, ["user_id"], {"applied": F.col("applied"), "ignored": ~F.col("applied")})


@query(f"SELECT o_orderkey AS run_id, {SITE} AS site, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def run_listing(spark, sf_dir):
    top = orders(spark, sf_dir).where("status = 'failed'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(20)
    return top.select("run_id", "site", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"))


@query("SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderkey LIMIT 46 OFFSET 92")
def row_window(spark, sf_dir):
    return R.viewport(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id")), ["run_id"], 100, 130)


@query("""SELECT n_nationkey AS id, array_to_string(list_filter([CASE WHEN s = 0 THEN 'sites_empty' END, CASE WHEN k = 0 THEN 'keywords_empty' END, CASE WHEN k > 10 THEN 'too_many_keywords' END, CASE WHEN s * k > 30 THEN 'too_many_scans' END,
    CASE WHEN n_nationkey * 90 NOT BETWEEN 1 AND 1440 THEN 'interval_out_of_range' END, CASE WHEN n_nationkey * 40 NOT BETWEEN 0 AND 600 THEN 'delay_out_of_range' END, CASE WHEN n_nationkey * 3 NOT BETWEEN 1 AND 60 THEN 'timeout_out_of_range' END], lambda x: x IS NOT NULL), ',') AS errors,
    CASE WHEN s * k BETWEEN 15 AND 30 THEN 'many_scans' ELSE '' END AS warnings FROM (SELECT *, n_nationkey % 4 AS s, n_nationkey % 13 AS k FROM nation)""")
def config_validation(spark, sf_dir):
    n = F.col("n_nationkey")
    c = {"enabled_sites": F.array_repeat(F.lit("s"), n % 4), "keywords": F.array_repeat(F.lit("k"), n % 13), "min_interval": n * 90, "inter_scan_delay": n * 40, "scan_timeout": n * 3}
    return table(spark, sf_dir, "nation").select(n.alias("id"), F.array_join(L.config_errors(c), ",").alias("errors"), F.array_join(L.config_warnings(c), ",").alias("warnings"))


@query("SELECT c_custkey AS id, 0 AS consecutive_a, CAST(c_nationkey AS INTEGER) AS total FROM customer")
def counter_reset(spark, sf_dir):
    m = F.create_map(F.lit("consecutive_a"), (F.col("c_custkey") % 5).cast("int"), F.lit("total"), F.col("c_nationkey").cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), L.reset_counters(m).alias("m")).select("id", F.col("m")["consecutive_a"].alias("consecutive_a"), F.col("m")["total"].alias("total"))


@query("""SELECT n_nationkey AS id, array_to_string(list_filter([CASE WHEN n NOT BETWEEN 0 AND 1 THEN 'nth_weight' END, CASE WHEN s <= 0 OR s > 1 THEN 'strong' END, CASE WHEN b <= 0 OR b >= s THEN 'binary' END], lambda x: x IS NOT NULL), ',') AS errors
    FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / 20 AS n, CAST(n_nationkey AS DOUBLE) / 16 AS s, CAST(n_nationkey % 7 AS DOUBLE) / 8 AS b FROM nation)""")
def scoring_validation(spark, sf_dir):
    n = F.col("n_nationkey").cast("double")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array_join(L.scoring_errors(n / 20, n / 16, n % 7 / 8), ",").alias("errors"))


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 4 = 0 AND o_orderkey % 90 < 30 THEN greatest(greatest(0, CAST(o_orderkey % 60 - o_custkey % 45 AS DOUBLE)), 5) ELSE greatest(0, CAST(o_orderkey % 60 - o_custkey % 45 AS DOUBLE)) END AS sleep_minutes FROM orders""")
def next_cycle_sleep(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), L.next_sleep_minutes((k % 60).cast("double"), (c % 45).cast("double"), c % 4, k % 90).alias("sleep_minutes"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'never' WHEN v < 90 THEN 'fresh' WHEN v < 300 THEN 'aging' ELSE 'stale' END AS grade FROM (SELECT event_id, event_id % 700 - 50 AS v FROM events)""")
def heartbeat_grade(spark, sf_dir):
    k = F.col("event_id")
    return events(spark, sf_dir).select("event_id", D.heartbeat(F.when(k % 11 != 0, k % 700 - 50)).alias("grade"))


@query("""SELECT event_id, CASE WHEN v < 0 THEN '—' WHEN v < 1000 THEN v || 'ms' WHEN v // 3600000 > 0 THEN (v // 3600000) || 'h ' || lpad(CAST(v // 60000 % 60 AS VARCHAR), 2, '0') || 'm' WHEN v // 60000 > 0 THEN (v // 60000) || 'm ' || lpad(CAST(v // 1000 % 60 AS VARCHAR), 2, '0') || 's' ELSE (v // 1000) || 's' END AS shown,
    CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' ELSE (a // 86400) || 'd ago' END AS age
    FROM (SELECT event_id, event_id * 977 % 9000000 - 200 AS v, event_id * 31 % 400000 AS a FROM events)""")
def format_duration(spark, sf_dir):
    k = F.col("event_id")
    return events(spark, sf_dir).select("event_id", D.duration(k * 977 % 9000000 - 200).alias("shown"), D.age(k * 31 % 400000).alias("age"))


@query("""SELECT v.k AS reason, count(*) AS n, CASE WHEN any_value(r) IS NULL THEN 'completed' ELSE 'failed' END AS status, any_value(r) AS failure_reason, any_value(c) AS failure_category FROM (SELECT (['backend_unavailable', 'sw_died', 'stop_requested', 'session', 'captcha', 'rate_limited', 'odd', 'none'])[o_orderkey % 8 + 1] AS k,
    (['backend_unavailable', 'sw_died', 'user_stopped', 'session_expired', 'captcha', 'rate_limited', NULL, NULL])[o_orderkey % 8 + 1] AS r, (['transient', 'transient', 'coordination', 'persistent', 'persistent', 'transient', NULL, NULL])[o_orderkey % 8 + 1] AS c FROM orders) v GROUP BY ALL""")
def scan_outcome(spark, sf_dir):
    reasons = F.array(*map(F.lit, ("backend_unavailable", "sw_died", "stop_requested", "session", "captcha", "rate_limited", "odd", "none")))
    o = table(spark, sf_dir, "orders").select(F.element_at(reasons, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("reason"))
    out = D.scan_outcome(F.col("reason"))
    return o.select("reason", *[out[c].alias(c) for c in ("status", "failure_reason", "failure_category")]).groupBy("reason", "status", "failure_reason", "failure_category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS run_id, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey % 9 + o_custkey % 4) || ' claimed' WHEN 1 THEN 'claim retired' WHEN 2 THEN 'note' ELSE '—' END AS shown FROM orders""")
def match_results_decode(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    results = F.when(k % 5 == 0, F.concat(F.lit('{"claim_summary":{"a":'), c % 9, F.lit(',"b":'), c % 4, F.lit("}}"))).when(k % 5 == 1, '{"claim_summary":null,"claim_retired":true}')
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), D.match_results(results, F.when(k % 5 == 2, "note").when(k % 5 == 3, "")).alias("shown"))


@query("""SELECT CASE o_orderkey % 8 WHEN 0 THEN 'captcha' WHEN 1 THEN 'expired' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'captcha' WHEN 4 THEN 'expired' WHEN 5 THEN 'live' WHEN 6 THEN 'unknown_treat_as_live' ELSE 'unknown' END AS probe, count(*) AS n FROM orders GROUP BY ALL""")
def session_probe(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    url = pick("https://x.com/challenge", "https://x.com/Login?a", *["https://x.com/jobs"] * 6)
    out = D.session_probe(url, pick(200, 200, 429, 403, 403, 200, 503, 404), pick("", "", "", "please CAPTCHA", "no", "ok", "", ""))
    return table(spark, sf_dir, "orders").groupBy(out.alias("probe")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE o_orderkey % 6 WHEN 0 THEN 'exit' WHEN 1 THEN 'user_stop' WHEN 2 THEN 'backend_down' WHEN 3 THEN 'watchdog' WHEN 4 THEN 'config_change' END AS abort, CASE WHEN o_custkey % 5 = 0 THEN 'backend_down' WHEN o_custkey % 7 = 0 THEN 'config_unavailable' WHEN o_custkey % 3 = 0 THEN 'all_sessions_dead' ELSE 'ok' END AS precheck, count(*) AS n FROM orders GROUP BY ALL""")
def abort_and_precheck(spark, sf_dir):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    abort = L.abort_reason(k == 0, k < 2, k < 3, k < 4, k < 5)
    return table(spark, sf_dir, "orders").groupBy(abort.alias("abort"), L.precheck(c % 5 != 0, c % 7 != 0, c % 3).alias("precheck")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (['config', 'popup', 'timeout', 'permission', 'run_log_update', 'unknown'])[o_orderkey % 6 + 1] AS setup_error, (['text', 'a; b', 'm', 'unexpected response'])[o_custkey % 4 + 1] AS message, count(*) AS n FROM orders GROUP BY ALL""")
def error_normalizers(spark, sf_dir):
    pick = lambda k, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(k) % len(v) + 1).cast("int"))
    setup = D.setup_error(pick("o_orderkey", "Config timeout", "popup closed", "Timeout x", "no permission", "run_log_update failed", "other"))
    message = D.error_text(pick("o_custkey", '{"detail":"text"}', '{"detail":[{"msg":"a"},{"msg":"b"}]}', '{"detail":{"message":"m"}}', "{}"))
    return table(spark, sf_dir, "orders").groupBy(setup.alias("setup_error"), message.alias("message")).agg(F.count(F.lit(1)).alias("n"))
