"""Queries: issue reports, counters of stages, and the cycle's aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as P
from ..operators import runs as R
from .match import _ROUTED, routed
from .registry import query, table

_KINDS = "['missing_skills', 'false_skills', 'match_level', 'yoe', 'wrong_gate', 'salary', 'other', 'odd']"
KINDS = ("missing_skills", "false_skills", "match_level", "yoe", "wrong_gate", "salary", "other", "odd")
_REPORTS = f"rep AS (SELECT o_orderkey AS report_id, o_custkey AS job_id, ({_KINDS})[o_orderkey % 7 + 1] AS report_type, CASE o_orderstatus WHEN 'F' THEN 'actioned' WHEN 'P' THEN 'dismissed' ELSE 'pending' END AS status, o_orderdate AS created_at FROM orders)"


def pick(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def reports(spark, sf_dir):
    """Orders as reports on customers as postings."""
    o = table(spark, sf_dir, "orders")
    kind = pick(KINDS[:7], F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "actioned").when(F.col("o_orderstatus") == "P", "dismissed").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("job_id"), kind.alias("report_type"), status.alias("status"), F.concat(F.lit("d"), "o_orderkey").alias("detail"), F.col("o_orderdate").alias("created_at"))


DETAILS = ("{}", '{"note":"n"}', '{"skills":["a","b"]}', '{"suggested_level":"weak_match"}', '{"suggested_level":"best"}', '{"actual_yoe":3}', '{"actual_yoe":"3"}', '{"gate_name":"visa_gate"}', '{"gate_name":"x"}', '{"else":1}', '{"skills":"a"}')


@query(f"""SELECT error, count(*) AS n FROM (SELECT CASE WHEN k = 'odd' THEN 'bad_type' WHEN k = 'wrong_gate' AND o_custkey % 2 = 0 THEN 'not_gated' WHEN d IN (0, 1) THEN NULL WHEN d = 9 THEN 'unknown_key' WHEN d IN (2, 10) AND k NOT IN ('missing_skills', 'false_skills') THEN 'unknown_key' WHEN d IN (3, 4) AND k <> 'match_level' THEN 'unknown_key'
    WHEN d IN (5, 6) AND k <> 'yoe' THEN 'unknown_key' WHEN d IN (7, 8) AND k <> 'wrong_gate' THEN 'unknown_key' WHEN d = 10 THEN 'bad_skills' WHEN d = 4 THEN 'bad_level' WHEN d = 6 THEN 'bad_yoe' WHEN d = 8 THEN 'bad_gate' END AS error
    FROM (SELECT o_custkey, ({_KINDS})[o_orderkey % 8 + 1] AS k, o_custkey % 11 AS d FROM orders)) GROUP BY ALL""")
def report_validation(spark, sf_dir):
    error = P.report_error(pick(KINDS, F.col("o_orderkey")), pick(DETAILS, F.col("o_custkey")), F.col("o_custkey") % 2 == 1)
    return table(spark, sf_dir, "orders").groupBy(error.alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REPORTS}, p AS (SELECT * FROM rep WHERE status = 'pending' AND report_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY job_id, report_type ORDER BY created_at, report_id) = 1), w AS (SELECT * FROM rep WHERE status = 'pending' AND report_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY job_id, report_type ORDER BY created_at DESC, report_id DESC) = 1)
    SELECT report_id, job_id, report_type, status, 'd' || report_id AS detail FROM rep WHERE status <> 'pending' AND report_id % 3 = 0 UNION ALL SELECT coalesce(p.report_id, w.report_id), coalesce(p.job_id, w.job_id), coalesce(p.report_type, w.report_type), 'pending', 'd' || coalesce(w.report_id, p.report_id) FROM p FULL JOIN w ON p.job_id = w.job_id AND p.report_type = w.report_type""")
def report_upsert(spark, sf_dir):
    r = reports(spark, sf_dir)
    old = r.where("report_id % 3 = 0")
    pending = old.where("status = 'pending'").groupBy("job_id", "report_type").agg(F.min_by(F.struct("report_id", "status", "detail", "created_at"), F.struct("created_at", "report_id")).alias("one")).select("one.report_id", "job_id", "report_type", "one.status", "one.detail", "one.created_at")
    stored = old.where("status <> 'pending'").unionByName(pending)
    return P.upsert_reports(stored, r.where("status = 'pending' AND report_id % 3 <> 0")).drop("created_at")


@query(f"WITH {_REPORTS} SELECT report_id, job_id, c_name AS title, report_type FROM rep JOIN customer ON c_custkey = job_id WHERE status = 'pending' AND report_type = 'yoe'")
def report_listing(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("title"))
    return P.report_listing(reports(spark, sf_dir), jobs, "pending", "yoe").select("report_id", "job_id", "title", "report_type")


@query(f"WITH {_REPORTS} SELECT k AS report_type, count(report_id) AS pending FROM (SELECT unnest(({_KINDS})[1:7]) AS k) LEFT JOIN rep ON report_type = k AND status = 'pending' AND k <> 'salary' GROUP BY ALL")
def report_stats(spark, sf_dir):
    """Without the reports on pay, whose count is then 0."""
    return P.report_stats(reports(spark, sf_dir).where("report_type <> 'salary'"))


_JOBS = "j AS (SELECT c_custkey AS job_id, CASE WHEN c_nationkey % 4 = 0 THEN 'agency' END AS skip_reason, CASE WHEN c_nationkey % 5 = 0 THEN 'visa_gate' END AS match_skip_reason, c_custkey % 7 = 0 AS dismissed, 'run-' || (c_custkey % 10) AS scan_run_id, c_acctbal AS created_at FROM customer)"


def jobs(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("job_id"), k.alias("id"), F.when(F.col("c_nationkey") % 4 == 0, "agency").alias("skip_reason"), F.when(F.col("c_nationkey") % 5 == 0, "visa_gate").alias("match_skip_reason"), (k % 7 == 0).alias("dismissed"),
        F.concat(F.lit("run-"), k % 10).alias("scan_run_id"), F.col("c_acctbal").alias("created_at"),
    )


@query(f"WITH {_JOBS}, {_REPORTS} SELECT v AS asked, EXISTS (SELECT 1 FROM rep WHERE rep.job_id = j.job_id AND status = 'pending') AS has_report, count(*) AS n FROM j, (SELECT unnest(['default', 'passed', 'removed', 'all']) AS v) WHERE CASE v WHEN 'default' THEN skip_reason IS NULL WHEN 'passed' THEN skip_reason IS NULL AND match_skip_reason IS NULL AND NOT dismissed WHEN 'removed' THEN skip_reason IS NOT NULL OR match_skip_reason IS NOT NULL OR dismissed ELSE TRUE END GROUP BY ALL")
def jobs_by_dedup_status(spark, sf_dir):
    rows, out = P.with_report_flag(jobs(spark, sf_dir), reports(spark, sf_dir)), None
    for asked in ("default", "passed", "removed", "all"):
        own = P.dedup_status(rows, asked).groupBy(F.lit(asked).alias("asked"), "has_report").agg(F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


@query(f"WITH {_JOBS} SELECT job_id, skip_reason FROM j WHERE scan_run_id = 'run-3' AND skip_reason IS NOT NULL ORDER BY created_at DESC, job_id LIMIT 25")
def jobs_skipped_of_run(spark, sf_dir):
    return P.skipped_of_run(jobs(spark, sf_dir), "run-3").select("job_id", "skip_reason")


def stage(spark, sf_dir):
    """Routed postings as rows of a matching stage."""
    N, v = F.col("doc_id"), F.col("verdict")
    r = routed(spark, sf_dir)
    return r.select("doc_id", "gate", F.when(v == "matched", "strong_match").otherwise("weak_match").alias("level"), F.when(N % 3 == 0, "llm").otherwise("cpu").alias("mode"), (N % 13 == 0).alias("failed"), (N % 8 == 0).alias("fallback"), "verdict")


def _listed(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query(f"""{_ROUTED} SELECT count(*) AS total_processed, count(gate) AS total_gate_skipped, count(*) FILTER (gate IS NULL AND doc_id % 3 <> 0 AND doc_id % 13 <> 0) AS total_cpu_decided, count(*) FILTER (gate IS NULL AND doc_id % 3 = 0 AND doc_id % 13 <> 0) AS total_llm_scored, count(*) FILTER (doc_id % 13 = 0) AS total_failed, count(*) FILTER (doc_id % 8 = 0) AS total_cpu_fallback,
    (SELECT string_agg(l || '=' || n, ';' ORDER BY l) FROM (SELECT CASE verdict WHEN 'matched' THEN 'strong_match' ELSE 'weak_match' END AS l, count(*) AS n FROM r WHERE gate IS NULL GROUP BY ALL)) AS match_level_counts, (SELECT string_agg(gate || '=' || n, ';' ORDER BY gate) FROM (SELECT gate, count(*) AS n FROM r WHERE gate IS NOT NULL GROUP BY ALL)) AS gate_skip_counts FROM r""")
def match_stage_report(spark, sf_dir):
    return P.match_report(stage(spark, sf_dir)).withColumns({c: _listed(c) for c in ("match_level_counts", "gate_skip_counts")})


@query(f"{_ROUTED}, t AS (SELECT CASE WHEN gate IS NOT NULL THEN 'cpu_gate' WHEN verdict = 'low_coverage' THEN 'coverage' ELSE 'field_gate' END AS kind, verdict AS reason, count(*) AS n FROM r WHERE verdict <> 'matched' GROUP BY ALL) SELECT kind, string_agg(reason || '=' || n, ';' ORDER BY reason) AS reasons FROM t GROUP BY ALL")
def cycle_aggregate(spark, sf_dir):
    rows = routed(spark, sf_dir).where("verdict <> 'matched'").select(F.when(F.col("gate").isNotNull(), "cpu_gate").when(F.col("verdict") == "low_coverage", "coverage").otherwise("field_gate").alias("kind"), F.col("verdict").alias("reason"))
    return P.named_counts(rows, "kind", "reason").select(F.explode("counts").alias("kind", "own")).select("kind", _listed("own").alias("reasons"))


_CARD = "(['new', 'existing', 'stale', 'jd_failed', 'id_skipped', 'rate_limited', 'content_duplicate', 'rejected'])[(l_partkey + l_linenumber) % 8 + 1]"


@query(f"""SELECT l_orderkey AS run_id, count(*) FILTER (k IN ('new', 'existing', 'content_duplicate')) AS scraped, count(*) FILTER (k = 'new') AS new_jobs, count(*) FILTER (k = 'existing') AS existing, count(*) FILTER (k = 'stale') AS stale_skipped, count(*) FILTER (k = 'jd_failed') AS jd_failed,
    count(*) FILTER (k = 'id_skipped') AS id_skipped, count(*) FILTER (k = 'rate_limited') AS rate_limited FROM (SELECT l_orderkey, {_CARD} AS k FROM lineitem) GROUP BY ALL""")
def card_counters_of_run(spark, sf_dir):
    kind = pick(("new", "existing", "stale", "jd_failed", "id_skipped", "rate_limited", "content_duplicate", "rejected"), F.col("l_partkey") + F.col("l_linenumber"))
    cards = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), kind.alias("k"))
    own = {n: F.col("k") == k for n, k in (("new_jobs", "new"), ("existing", "existing"), ("stale_skipped", "stale"), ("jd_failed", "jd_failed"), ("id_skipped", "id_skipped"), ("rate_limited", "rate_limited"))}
    return R.counters(cards, ["run_id"], {"scraped": F.col("k").isin("new", "existing", "content_duplicate"), **own})
