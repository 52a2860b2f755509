"""Queries: payload flattening, canonical projection, ingest, listings, shelf life and claims."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, lifecycle, listing, project
from ..sources import adapter, versions
from ..sources.store import shared
from ..sources.store import stored as stored_table
from .expected import CANON, EMP, stored
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss"
DUCK_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells an input from what it was before: its files with their sizes and times."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))


@lru_cache(maxsize=8)
def _flat_tables(spark: SparkSession, sf_dir: str, stamp: tuple) -> dict[str, DataFrame]:
    return {site: stored_table(df.drop("source_raw", "site")) for site, df in project.flat_rows(adapter.payloads(spark, sf_dir)).items()}


@lru_cache(maxsize=8)  # of plans, not rows: building one takes seconds
def _canon(spark: SparkSession, sf_dir: str, stamp: tuple) -> DataFrame:
    return project.canonical_of(_flat_tables(spark, sf_dir, stamp))


def flat_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The flat tables as ingest leaves them, written once for each state of an input in a session."""
    return _flat_tables(spark, sf_dir, _stamp(spark, sf_dir))


def canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canon(spark, sf_dir, _stamp(spark, sf_dir))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table, some rows of it claimed and some dismissed."""
    n = F.col("site_job_id").cast("long")
    return project.complete(canon(spark, sf_dir)).withColumns({"matched": n % 11 == 4, "dismissed": n % 7 == 3})


@query(
    f"""WITH {CANON} SELECT source_site, sha256('row:' || source_site || ':' || job_url) AS source_row_id, site_job_id, scan_run_id, job_url, strftime(scrape_time, {DUCK_STAMP}) AS scrape_time, title, company,
    location_text, sha256(description) AS description_sha256, remote, apply_url, experience_level, industry, salary_min, salary_max, salary_currency, salary_period,
    strftime(posted_at, {DUCK_STAMP}) AS posted_at, employment_type, workplace_type, language, education_requirements, salary_disclosed FROM canon"""
)
def canonical_projection(spark, sf_dir):
    rows = canon(spark, sf_dir)
    change = {"scrape_time": F.date_format("scrape_time", STAMP), "posted_at": F.date_format("posted_at", STAMP)}
    return rows.withColumns(change).withColumn("description_sha256", F.sha2("description", 256)).drop("warnings", "description")


@query(
    f"""WITH b AS (SELECT doc_id AS n, doc_id // 3 AS m, doc_id % 3 AS s FROM documents), w AS (
    SELECT 'unknown_salary_period' AS event, ['linkedin','indeed','glassdoor'][s + 1] AS site, 'salary_period' AS field, 'FORTNIGHTLY' AS raw FROM b WHERE m % 8 = 5 AND NOT (s = 0 AND m % 5 = 4)
    UNION ALL SELECT 'bad_posted_at', ['linkedin','indeed'][s + 1], ['listed_at','pub_date'][s + 1], CAST(1704067200 + n AS VARCHAR) FROM b WHERE s < 2 AND m % 17 = 0
    UNION ALL SELECT 'unknown_employment_type', ['linkedin','indeed','glassdoor'][s + 1], 'employment_type', x FROM (
       SELECT s, unnest(CASE s WHEN 0 THEN [({EMP})[m % 13 + 1]] WHEN 1 THEN CASE m % 4 WHEN 0 THEN [] WHEN 2 THEN [({EMP})[m % 13 + 1], ({EMP})[(m + 5) % 13 + 1]] ELSE [({EMP})[m % 13 + 1]] END
       ELSE CASE m % 5 WHEN 1 THEN [] WHEN 0 THEN [({EMP})[(m + 3) % 13 + 1]] ELSE [({EMP})[m % 13 + 1]] END END) AS x FROM b) WHERE x = 'Freelance'
    UNION ALL SELECT 'unknown_workplace_type', 'linkedin', 'workplace_type', 'Moon base' FROM b WHERE s = 0 AND m % 9 = 7 AND m % 2 = 1
    UNION ALL SELECT 'bad_value_shape', 'linkedin', 'workplace_type', '{{"odd":1}}' FROM b WHERE s = 0 AND m % 9 = 7 AND m % 2 = 0
    UNION ALL SELECT 'ingest_iso_date_parse_failed', 'glassdoor', 'date_posted', 'not a date' FROM b WHERE s = 2 AND m % 19 = 0
    UNION ALL SELECT 'workplace_remote_conflict', 'linkedin', 'workplace_type', p FROM (SELECT m, ['ONSITE','REMOTE','HYBRID','REMOTE','HYBRID','ONSITE','ONSITE',NULL,NULL][m % 9 + 1] AS p FROM b WHERE s = 0) WHERE p IS NOT NULL AND m % 3 < 2 AND (p = 'REMOTE') <> (m % 3 = 0)
    UNION ALL SELECT 'unknown_salary_source', ['', 'indeed','glassdoor'][s + 1], 'salary_source', 'MYSTERY' FROM b WHERE s > 0 AND m % 6 = 4
    UNION ALL SELECT 'bad_language', 'indeed', 'language', 'english' FROM b WHERE s = 1 AND m % 11 = 0)
    SELECT event, site, field, raw, count(*) AS n FROM w GROUP BY ALL"""
)
def projection_warnings(spark, sf_dir):
    return project.warning_counts(canon(spark, sf_dir))


def _field(column: str, sql: str):
    def run(spark, sf_dir):
        return canon(spark, sf_dir).groupBy("source_site", column).agg(F.count(F.lit(1)).alias("n"))

    run.__name__ = sql
    return query(f"WITH {CANON} SELECT source_site, {column}, count(*) AS n FROM canon GROUP BY ALL")(run)


for _column, _name in (
    ("employment_type", "employment_precedence"), ("workplace_type", "workplace_precedence"), ("salary_period", "salary_period_vocab"), ("salary_disclosed", "salary_disclosed"),
    ("language", "language_base"), ("education_requirements", "education_join"), ("industry", "first_industry"), ("company", "company_precedence"), ("remote", "remote_tri_state"),
):
    _field(_column, _name)


@query(f"WITH {CANON} SELECT source_site, workplace_type, remote, count(*) AS n FROM canon WHERE source_site = 'linkedin' AND (workplace_type = 'REMOTE') <> remote GROUP BY ALL")
def workplace_remote_conflict(spark, sf_dir):
    rows = canon(spark, sf_dir).where(F.exists("warnings", lambda w: w["event"] == "workplace_remote_conflict"))
    return rows.groupBy("source_site", "workplace_type", "remote").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANON} SELECT source_site, count(*) AS n, count(posted_at) AS n_posted, strftime(min(posted_at), {DUCK_STAMP}) AS first_posted, strftime(max(posted_at), {DUCK_STAMP}) AS last_posted FROM canon GROUP BY ALL")
def posted_at_unified(spark, sf_dir):
    return canon(spark, sf_dir).groupBy("source_site").agg(F.count(F.lit(1)).alias("n"), F.count("posted_at").alias("n_posted"), F.date_format(F.min("posted_at"), STAMP).alias("first_posted"), F.date_format(F.max("posted_at"), STAMP).alias("last_posted"))


@query("SELECT doc_id AS site_job_id, 'OffsiteApply' AS apply_method_type, CASE WHEN doc_id // 3 % 23 <> 0 THEN source END AS company_name, CASE WHEN doc_id // 3 % 9 <> 8 THEN 1 ELSE 0 END AS n_labels FROM documents WHERE doc_id % 3 = 0")
def flatten_linkedin(spark, sf_dir):
    flat = flat_tables(spark, sf_dir)["linkedin"]
    return flat.select(F.col("job_posting_id").cast("long").alias("site_job_id"), "apply_method_type", "company_name", F.when(F.col("workplace_types_labels").isNull(), 0).otherwise(1).alias("n_labels"))


@query("SELECT CAST(doc_id AS VARCHAR) AS jobkey, 'https://ca.indeed.com/viewjob?jk=' || doc_id AS job_url, TRUE AS mosaic_present, TRUE AS graphql_present, CAST([3, 12, NULL][doc_id // 3 % 3 + 1] AS BIGINT) AS num_hires, doc_id // 3 % 9 AS location_count, doc_id // 3 % 4 <> 0 AS has_types FROM documents WHERE doc_id % 3 = 1")
def flatten_indeed(spark, sf_dir):
    flat = flat_tables(spark, sf_dir)["indeed"]
    return flat.select("jobkey", "job_url", "mosaic_present", "graphql_present", "num_hires", "location_count", F.col("job_types").isNotNull().alias("has_types"))


@query("SELECT CAST(doc_id AS VARCHAR) AS listing_id, doc_id // 3 % 900 AS goc_id, CASE doc_id // 3 % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_easy_apply, strftime(CASE WHEN doc_id // 3 % 19 <> 0 THEN CAST(epoch_ms(1704067200000 + doc_id * 3600000) AS DATE) END, '%Y-%m-%d') AS date_posted, doc_id // 3 % 4 < 2 AS has_remote FROM documents WHERE doc_id % 3 = 2")
def flatten_glassdoor(spark, sf_dir):
    flat = flat_tables(spark, sf_dir)["glassdoor"]
    return flat.select("listing_id", "goc_id", "is_easy_apply", F.date_format("date_posted", "yyyy-MM-dd").alias("date_posted"), F.col("remote_work_types").isNotNull().alias("has_remote"))


_ROUTED = """WITH e AS (SELECT doc_id AS n, unnest([0, 1]) AS round FROM documents), r AS (SELECT *, CASE
    WHEN n % 29 = 0 THEN 'skipped' WHEN n % 31 = 3 THEN 'no_source_raw' WHEN n % 37 = 5 THEN 'unknown_site' WHEN n % 41 = 7 THEN 'no_scan_run_id'
    WHEN n % 43 = 9 THEN ['no_job_url', 'no_surface', 'no_listing_id'][n % 3 + 1] ELSE 'accepted' END AS outcome FROM e)"""


@query(f"{_ROUTED} SELECT outcome, CASE WHEN n % 37 = 5 THEN 'monster' ELSE ['linkedin', 'indeed', 'glassdoor'][n % 3 + 1] END AS site, count(*) AS n FROM r GROUP BY ALL")
def ingest_reject_routing(spark, sf_dir):
    return ingest.route(sent(spark, sf_dir)).groupBy("outcome", "site").agg(F.count(F.lit(1)).alias("n"))


def sent(spark, sf_dir):
    """What arrives, written: a table of raw payloads, as a crawler leaves it."""
    return stored_table(adapter.envelopes(spark, sf_dir))


def arrived(spark, sf_dir):
    """The keys of accepted envelopes."""
    return stored_table(ingest.keyed(ingest.route(sent(spark, sf_dir))).select("site", "job_url", "doc_id", "arrival", "outcome")).where("outcome = 'accepted'").drop("outcome")


def known(spark, sf_dir):
    """Keys of every second posting, as the flat tables have them."""
    parts = [df.where(F.col("job_url").isNotNull()).select(F.lit(site).alias("site"), "job_url", F.col(key).alias("site_job_id")) for (site, df), key in zip(flat_tables(spark, sf_dir).items(), ("job_posting_id", "jobkey", "listing_id"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("site_job_id").cast("long") % 2 == 0).select("site", "job_url")


@query(f"{_ROUTED} SELECT ['linkedin', 'indeed', 'glassdoor'][n % 3 + 1] AS site, n AS doc_id, min(n + round * 1000000000) AS arrival FROM r WHERE outcome = 'accepted' GROUP BY ALL")
def ingest_dedup_first_wins(spark, sf_dir):
    rows = arrived(spark, sf_dir)
    return ingest.first_wins(rows, ["site", "job_url"], "arrival").select("site", "doc_id", "arrival")


@query(f"{_ROUTED} SELECT ['linkedin', 'indeed', 'glassdoor'][n % 3 + 1] AS site, round = 1 OR n % 2 = 0 AS already_exists, count(*) AS n FROM r WHERE outcome = 'accepted' GROUP BY ALL")
def ingest_already_exists(spark, sf_dir):
    rows = arrived(spark, sf_dir)
    target = known(spark, sf_dir)
    return ingest.outcome_of_insert(rows, target, ["site", "job_url"], "arrival").groupBy("site", "already_exists").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ROUTED} SELECT ['linkedin', 'indeed', 'glassdoor'][n % 3 + 1] AS site, count(*) AS n FROM r WHERE outcome = 'accepted' AND round = 0 AND n % 2 = 1 GROUP BY ALL")
def ingest_insert_if_absent(spark, sf_dir):
    rows = arrived(spark, sf_dir)
    target = known(spark, sf_dir)
    new = ingest.insert_if_absent(ingest.first_wins(rows, ["site", "job_url"], "arrival"), target, ["site", "job_url"])
    return new.groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ROUTED}, k AS (SELECT DISTINCT n, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS batch FROM r WHERE outcome = 'accepted') SELECT batch, ['linkedin', 'indeed', 'glassdoor'][n % 3 + 1] AS site, count(*) AS n FROM k GROUP BY ALL")
def ingest_across_batches(spark, sf_dir):
    """Two of the sites arrive in a first batch, and all of them again in a second: it adds the third site's postings only."""
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    every = sent(spark, sf_dir)
    ingest.write_batch(ingest.route(every.where("doc_id % 3 > 0")), path, 1)
    ingest.write_batch(ingest.route(every), path, 2)
    version = versions.current(spark, path)
    parts = [spark.read.parquet(f"{path}/{version.batches[str(b)]}/canonical").select(F.lit(b).alias("batch"), F.col("source_site").alias("site")) for b in (1, 2)]
    return parts[0].unionByName(parts[1]).groupBy("batch", "site").agg(F.count(F.lit(1)).alias("n"))


@query(
    stored(f"""SELECT id, source_site, source_row_id, site_job_id, scan_run_id, job_url, strftime(scrape_time, {DUCK_STAMP}) AS scrape_time, matched, dismissed, title, company, location_text, sha256(description) AS description,
    remote, apply_url, experience_level, industry, CAST(CAST(salary_min AS BIGINT) AS VARCHAR) AS salary_min, CAST(CAST(salary_max AS BIGINT) AS VARCHAR) AS salary_max, salary_currency, salary_period,
    strftime(posted_at, {DUCK_STAMP}) AS posted_at FROM stored WHERE NOT dismissed ORDER BY stored.scrape_time DESC, id LIMIT 25 OFFSET 50""")
)
def jobs_listing_page(spark, sf_dir):
    rows = listing.read_model(listing.page(table(spark, sf_dir).where(listing.conditions()), 25, 50))
    return rows.withColumns({"scrape_time": F.date_format("scrape_time", STAMP), "posted_at": F.date_format("posted_at", STAMP), "description": F.sha2("description", 256)})


@query(stored("SELECT count(*) AS total FROM stored WHERE NOT dismissed AND source_site = 'indeed'"))
def jobs_listing_total(spark, sf_dir):
    return table(spark, sf_dir).where(listing.conditions(source_site="indeed")).agg(F.count(F.lit(1)).alias("total"))


@query(stored("SELECT source_site, count(*) AS n FROM stored WHERE NOT dismissed AND posted_at >= TIMESTAMP '2024-01-03' AND posted_at <= TIMESTAMP '2024-01-06' GROUP BY ALL"))
def jobs_posted_range_trap(spark, sf_dir):
    return listing.facets(table(spark, sf_dir).where(listing.conditions(posted_from="2024-01-03", posted_to="2024-01-06")))


@query(stored("SELECT source_site, count(*) AS n FROM stored WHERE NOT dismissed AND scrape_time >= TIMESTAMP '2024-01-01' AND scrape_time < TIMESTAMP '2024-01-02' GROUP BY ALL"))
def jobs_scraped_range(spark, sf_dir):
    return listing.facets(table(spark, sf_dir).where(listing.conditions(scraped_from="2024-01-01", scraped_to="2024-01-01")))


@query(stored("SELECT id, source_site, job_url, title FROM stored WHERE id = sha256('job:linkedin:https://www.linkedin.com/jobs/view/42')"))
def jobs_point_lookup(spark, sf_dir):
    return listing.lookup(table(spark, sf_dir), "id", F.sha2(F.lit("job:linkedin:https://www.linkedin.com/jobs/view/42"), 256)).select("id", "source_site", "job_url", "title")


@query(stored("SELECT id, source_site, CASE WHEN doc_id % 10 = 0 THEN TRUE WHEN doc_id % 10 = 1 THEN FALSE ELSE dismissed END AS dismissed FROM stored"))
def jobs_dismiss_overlay(spark, sf_dir):
    rows = table(spark, sf_dir)
    n = F.col("site_job_id").cast("long")
    updates = rows.where(n % 10 < 3).select("id", F.when(n % 10 == 0, True).when(n % 10 == 1, False).alias("dismissed"))
    return listing.overlay(rows.select("id", "source_site", "dismissed"), updates, ["id"])


@query(stored("SELECT source_site, count(*) AS n FROM stored WHERE NOT dismissed GROUP BY ALL"))
def source_facets(spark, sf_dir):
    return listing.facets(table(spark, sf_dir).where(listing.conditions()))


@query(stored("SELECT scan_run_id, source_site, count(*) AS n FROM stored WHERE dismissed AND scan_run_id = 'run-3' GROUP BY ALL"))
def jobs_dismissed_of_run(spark, sf_dir):
    return table(spark, sf_dir).where(listing.conditions(dismissed=True, scan_run_id="run-3")).groupBy("scan_run_id", "source_site").agg(F.count(F.lit(1)).alias("n"))


@query(stored("SELECT id, company, title FROM stored ORDER BY CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 97 END DESC NULLS LAST, scrape_time DESC, id LIMIT 50"))
def jobs_by_score_nulls_last(spark, sf_dir):
    n = F.col("site_job_id").cast("long")
    score = F.when(n % 5 != 0, n % 97)
    return table(spark, sf_dir).orderBy(score.desc_nulls_last(), F.desc("scrape_time"), "id").limit(50).select("id", "company", "title")


_NOW = "TIMESTAMP '2024-01-08 08:00:00'"


@query(stored(f"SELECT source_site, matched, count(*) AS n FROM stored WHERE scrape_time >= {_NOW} - INTERVAL 7 DAY GROUP BY ALL"))
def expire_shelf_life(spark, sf_dir):
    return lifecycle.unexpired(table(spark, sf_dir), "2024-01-08 08:00:00", 7).groupBy("source_site", "matched").agg(F.count(F.lit(1)).alias("n"))


@query(stored(f"SELECT 'scraped_jobs' AS name, count(*) AS deleted FROM stored WHERE scrape_time < {_NOW} - INTERVAL 7 DAY UNION ALL SELECT v || '_jobs', (SELECT count(*) FROM stored WHERE source_site = v AND scrape_time < {_NOW} - INTERVAL 7 DAY) FROM (SELECT unnest(['linkedin', 'indeed', 'glassdoor']) AS v)"))
def expire_counts_by_table(spark, sf_dir):
    flat = flat_tables(spark, sf_dir)
    tables = {f"{k}_jobs": df for k, df in flat.items()} | {"scraped_jobs": table(spark, sf_dir)}
    return lifecycle.expired_counts(tables, "2024-01-08 08:00:00", 7)


@query(stored("SELECT id, source_site FROM stored WHERE doc_id % 50 = 17"))
def orphan_check(spark, sf_dir):
    rows = table(spark, sf_dir)
    parents = rows.where(F.col("site_job_id").cast("long") % 50 != 17).select("source_row_id")
    return lifecycle.orphans(rows, parents).select("id", "source_site")


@query(stored("SELECT source_site, count(*) AS n FROM stored WHERE (doc_id % 3 = 0 AND doc_id % 50 = 17) OR (doc_id % 3 = 1 AND doc_id % 40 = 9) GROUP BY ALL"))
def orphans_of_three_tables(spark, sf_dir):
    """Canonical rows against the three flat tables, of which two lack some rows; a row of another site's table is no parent."""
    flat = flat_tables(spark, sf_dir)
    row_id = lambda site: F.sha2(F.concat(F.lit(f"row:{site}:"), "job_url"), 256).alias("source_row_id")
    key = {"linkedin": "job_posting_id", "indeed": "jobkey", "glassdoor": "listing_id"}
    gone = {"linkedin": "% 50 = 17", "indeed": "% 40 = 9", "glassdoor": "< 0"}
    parents = {site: df.where(f"NOT cast({key[site]} AS BIGINT) {gone[site]}").select(row_id(site)) for site, df in flat.items()}
    return lifecycle.orphans_of(table(spark, sf_dir), parents).groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


@query(stored("SELECT source_site, count(*) AS n FROM stored WHERE (doc_id % 11 = 4) IS DISTINCT FROM (doc_id % 22 = 4) GROUP BY ALL"))
def agreement_check(spark, sf_dir):
    rows = table(spark, sf_dir)
    other = rows.select("source_site", "source_row_id", (F.col("site_job_id").cast("long") % 22 == 4).alias("matched"))
    return lifecycle.disagreements(rows, other, ["source_site", "source_row_id"], "matched").groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


@query(stored("SELECT id, source_site FROM stored WHERE NOT matched ORDER BY scrape_time, id LIMIT 500"))
def claim_batch(spark, sf_dir):
    return lifecycle.claim(table(spark, sf_dir), 500)[0].select("id", "source_site")


@query(stored("SELECT count(*) AS claimed_twice FROM stored WHERE FALSE"))
def claim_idempotent(spark, sf_dir):
    rows = table(spark, sf_dir).select("id", "source_site", "scrape_time", "matched")
    _, after = lifecycle.claim(rows, None)
    again, _ = lifecycle.claim(after, None)
    return again.agg(F.count(F.lit(1)).alias("claimed_twice"))


@query(stored("SELECT source_site, count(*) AS claimed, (SELECT count(*) FROM stored WHERE NOT matched) AS total FROM stored WHERE NOT matched GROUP BY ALL"))
def claim_summary(spark, sf_dir):
    claimed, _ = lifecycle.claim(table(spark, sf_dir), None)
    by_site = claimed.groupBy("source_site").agg(F.count(F.lit(1)).alias("claimed"))
    return by_site.crossJoin(F.broadcast(by_site.agg(F.sum("claimed").alias("total"))))  # one row
