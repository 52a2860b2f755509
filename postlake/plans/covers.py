"""Queries: display strings, fallbacks within payloads, small rings, flat rows column by column, settings and published updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import format as D
from ..functions import settings
from ..functions import text as X
from ..operators import flatten
from ..operators import runs as R
from ..sources.store import shared
from .canonical import flat_tables
from .registry import query, table
from .runs import events


@query(
    r"""SELECT doc_id, (['Remote', 'On-site', '—'])[doc_id % 3 + 1] AS remote, CASE WHEN doc_id % 5 = 0 THEN doc_id % 1000 || 'ms' WHEN doc_id % 5 = 1 THEN printf('%.1fs', (1000 + doc_id % 59 * 1000) / 1000.0) ELSE (1 + doc_id % 7) || 'm ' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || 's' END AS dt,
    sha256(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS stripped, CASE WHEN doc_id % 4 = 0 THEN '(setup pending)' WHEN doc_id % 4 = 1 THEN '(setup pending)' WHEN doc_id % 4 = 2 THEN '(setup pending)' ELSE 'k' || doc_id END AS shown, least(1000.0 * 2 ** (doc_id % 9), 30000.0)::DOUBLE AS wait_ms,
    CASE doc_id % 5 WHEN 0 THEN 'never' WHEN 1 THEN doc_id % 60 || 's ago' WHEN 2 THEN (1 + doc_id % 59) || 'm ago' WHEN 3 THEN (1 + doc_id % 23) || 'h ago' ELSE (1 + doc_id % 30) || 'd ago' END AS age FROM documents"""
)
def display_strings(spark, sf_dir):
    N = F.col("doc_id")
    ms = F.when(N % 5 == 0, N % 1000).when(N % 5 == 1, 1000 + N % 59 * 1000).otherwise(60000 * (1 + N % 7) + 1000 * (N % 60))
    text = F.when(N % 4 == 1, "").when(N % 4 == 2, " \t ").when(N % 4 == 3, F.concat(F.lit("k"), N))
    seconds = F.when(N % 5 == 1, N % 60).when(N % 5 == 2, 60 * (1 + N % 59)).when(N % 5 == 3, 3600 * (1 + N % 23)).when(N % 5 == 4, 86400 * (1 + N % 30))
    return table(spark, sf_dir, "documents").select(
        "doc_id", D.remote(F.when(N % 3 == 0, True).when(N % 3 == 1, False)).alias("remote"), D.since_start(ms).alias("dt"), X.stripped_hash(F.col("text")).alias("stripped"),
        D.placeholder(text).alias("shown"), D.backoff_ms(N % 9 + 1).alias("wait_ms"), D.age(seconds).alias("age"),
    )


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'm' || o_orderkey WHEN 1 THEN 'K' || o_orderkey ELSE 'k' || o_orderkey END AS jobkey, CASE o_orderkey % 3 WHEN 0 THEN 'text ' || o_orderkey WHEN 1 THEN 'plain ' || o_orderkey END AS skills,
    CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey END AS employees FROM orders"""
)
def payload_fallbacks(spark, sf_dir):
    """A key from any of three places, the empty one skipped; a description that is an object or a text; an object kept as text, if it has anything."""
    k = F.col("o_orderkey")
    key = F.when(k % 4 == 0, F.concat(F.lit('"mosaic":{"jobkey":"m'), k, F.lit('"},"graphql":{"jobKey":"no"}'))).when(k % 4 == 1, F.concat(F.lit('"graphql":{"jobKey":"K'), k, F.lit('","jobkey":"no"}'))).when(k % 4 == 2, F.concat(F.lit('"mosaic":{},"graphql":{"jobKey":"","jobkey":"k'), k, F.lit('"}'))).otherwise(F.concat(F.lit('"graphql":{"jobkey":"k'), k, F.lit('"}')))
    skills = F.when(k % 3 == 0, F.concat(F.lit('"data":{"jobPostingUrl":"u","skillsDescription":{"text":"text '), k, F.lit('"}}'))).when(k % 3 == 1, F.concat(F.lit('"data":{"jobPostingUrl":"u","skillsDescription":"plain '), k, F.lit('"}'))).otherwise('"data":{"jobPostingUrl":"u"}')
    overview = F.when(k % 5 < 3, F.concat(F.lit('{"size":{"n":'), k, F.lit("}}"))).when(k % 5 == 3, "{}").otherwise("null")
    listing = F.concat(F.lit('"jobListing":{"jobDetailsData":{"listingId":1,"employerOverview":'), overview, F.lit("}}"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.try_parse_json(F.concat(F.lit("{"), F.concat_ws(",", key, skills, listing), F.lit("}"))).alias("v"))
    indeed, linkedin, glassdoor = (f(rows) for f in (flatten.indeed, flatten.linkedin, flatten.glassdoor))
    out = indeed.select("id", "jobkey").join(linkedin.select("id", F.col("skills_description").alias("skills")), "id")
    return out.join(glassdoor.select("id", F.get_json_object("employer_overview", "$.size.n").cast("long").alias("employees")), "id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def trace_ring_of_ten(spark, sf_dir):
    """A ring that is smaller than what most runs have told: the oldest rows go."""
    return R.ring(events(spark, sf_dir), "user_id", ["at", "event_id"], 10).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY ALL")
def message_ring_of_two(spark, sf_dir):
    logs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("log"))
    return logs.select("conv_id", F.array_join(F.transform(R.ring_of(F.col("log"), 2), lambda e: e["role"]), ",").alias("roles"))


_EMP = "(['Full-time', 'full time', 'FULL_TIME', 'Part-time', 'Contractor', 'temp', 'Intern', 'Permanent', 'Volunteer', 'Other', 'Freelance', '  ', NULL])"
_PAY = "(['YEARLY', 'per hour', 'Monthly', 'week', 'DAILY', 'FORTNIGHTLY', NULL, 'Hourly-rate'])[m % 8 + 1]"
_BASE = "WITH b AS (SELECT doc_id AS n, doc_id // 3 AS m, text, source, lang, n_name FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25)"
_MS = "CASE WHEN m % 17 = 0 THEN 1704067200 + n ELSE 1704067200000 + n * 3600000 END"
_THIRD = "CASE m % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"


def _hashed(df, columns, hashed):
    return df.select(*columns, *[F.sha2(c, 256).alias(c) for c in hashed])


@query(
    f"""{_BASE} SELECT CAST(n AS VARCHAR) AS job_posting_id, 'https://www.linkedin.com/jobs/view/' || n AS job_url, 'https://www.linkedin.com/jobs/view/' || n AS job_posting_url, 'run-' || n % 40 AS scan_run_id, 'Role ' || n % 37 AS title, n_name AS formatted_location, {_MS} AS listed_at, {_THIRD} AS work_remote_allowed,
    {_EMP}[m % 13 + 1] AS formatted_employment_status, 'Level ' || m % 4 AS formatted_experience_level, CASE WHEN m % 5 <> 4 THEN CAST(50000 + m % 100 * 1000 AS DOUBLE) END AS salary_min, CASE WHEN m % 5 <> 4 THEN CAST(70000 + m % 100 * 1000 AS DOUBLE) END AS salary_max, CASE WHEN m % 5 <> 4 THEN (['CAD', 'USD', 'EUR'])[m % 3 + 1] END AS salary_currency,
    CASE WHEN m % 5 <> 4 THEN {_PAY} END AS salary_period, {_THIRD} AS salary_provided_by_employer, 'https://apply.example.com/' || n AS company_apply_url, CASE WHEN m % 23 <> 0 THEN source END AS company_name, sha256(text) AS description_text FROM b WHERE n % 3 = 0"""
)
def flatten_linkedin_columns(spark, sf_dir):
    cols = "job_posting_id job_url job_posting_url scan_run_id title formatted_location listed_at work_remote_allowed formatted_employment_status formatted_experience_level salary_min salary_max salary_currency salary_period salary_provided_by_employer company_apply_url company_name".split()
    return _hashed(flat_tables(spark, sf_dir)["linkedin"], cols, ["description_text"])


@query(
    f"""{_BASE} SELECT CAST(n AS VARCHAR) AS jobkey, 'https://ca.indeed.com/viewjob?jk=' || n AS job_url, 'Role ' || n % 37 AS title, n_name AS formatted_location, CASE WHEN m % 5 = 1 THEN '' WHEN m % 5 <> 0 THEN source END AS company, 'https://apply.example.com/' || n AS third_party_apply_url, {_MS} AS pub_date, {_THIRD} AS remote_location,
    CAST(20 + m % 60 AS DOUBLE) AS salary_min, CAST(35 + m % 60 AS DOUBLE) AS salary_max, {_PAY} AS salary_period, (['CAD', 'USD', 'EUR'])[m % 3 + 1] AS salary_currency, (['EXTRACTION', 'Employer provided', 'INDEED_ESTIMATE', 'estimate', 'MYSTERY', NULL])[m % 6 + 1] AS salary_snippet_source, CAST([3, 12, NULL][m % 3 + 1] AS BIGINT) AS num_hires, m % 9 AS location_count,
    'Employer ' || source AS employer_name, CASE WHEN m % 11 = 0 THEN 'english' WHEN m % 13 = 0 THEN '' WHEN m % 4 = 0 THEN lang WHEN m % 4 = 1 THEN lang || '-CA' WHEN m % 4 = 2 THEN lang || '_US' ELSE upper(lang) END AS language, sha256(text) AS description_text FROM b WHERE n % 3 = 1"""
)
def flatten_indeed_columns(spark, sf_dir):
    cols = "jobkey job_url title formatted_location company third_party_apply_url pub_date remote_location salary_min salary_max salary_period salary_currency salary_snippet_source num_hires location_count employer_name language".split()
    return _hashed(flat_tables(spark, sf_dir)["indeed"], cols, ["description_text"])


@query(
    f"""{_BASE} SELECT CAST(n AS VARCHAR) AS listing_id, 'https://www.glassdoor.ca/job-listing/listing-' || n || '.htm?jl=' || n AS job_url, 'Role ' || n % 37 AS title, n_name AS location_name, source AS employer_name, {_PAY} AS salary_period, (['EXTRACTION', 'Employer provided', 'INDEED_ESTIMATE', 'estimate', 'MYSTERY', NULL])[m % 6 + 1] AS salary_source, m % 900 AS goc_id, {_THIRD} AS is_easy_apply,
    'Industry ' || m % 7 AS industry, (['CAD', 'USD', 'EUR'])[m % 3 + 1] AS jsonld_salary_currency_top, CAST(60000 + m % 100 * 500 AS DOUBLE) AS jsonld_salary_min, CAST(90000 + m % 100 * 500 AS DOUBLE) AS jsonld_salary_max, CASE WHEN m % 3 = 0 THEN '5+ years ' WHEN m % 3 = 1 THEN '  ' END AS experience_requirements_description, 'https://apply.example.com/' || n AS header_apply_url,
    sha256(text) AS description FROM b WHERE n % 3 = 2"""
)
def flatten_glassdoor_columns(spark, sf_dir):
    cols = "listing_id job_url title location_name employer_name salary_period salary_source goc_id is_easy_apply industry jsonld_salary_currency_top jsonld_salary_min jsonld_salary_max experience_requirements_description header_apply_url".split()
    return _hashed(flat_tables(spark, sf_dir)["glassdoor"], cols, ["description"])


@query("SELECT r_name AS name, CAST(r_regionkey * 2 AS BIGINT) AS value, 2 AS settings FROM region")
def config_from_files(spark, sf_dir):
    """A settings file for each region: absent at first, written, then changed by one key; a legacy key goes."""
    out, folder = [], f"{shared(spark)}/{uuid.uuid4().hex}"
    for r in table(spark, sf_dir, "region").collect():  # five rows by definition: a file each
        path = f"{folder}/{r.r_regionkey}.json"
        before = settings.read_config(spark, path)
        settings.update_config(spark, path, before | {"name": r.r_name, "value": r.r_regionkey, "fit_score_req_weight": 1})
        settings.update_config(spark, path, {"value": r.r_regionkey * 2})
        now = settings.read_config(spark, path)
        out.append((now["name"], now["value"], len(now)))
    return spark.createDataFrame(out, "name string, value long, settings int")


@query("SELECT o_orderstatus AS status, count(*) AS n, 3 AS columns FROM orders GROUP BY ALL")
def run_log_published(spark, sf_dir):
    """Updates of run logs as a stream, published for listeners without the large trace."""
    folder = f"{shared(spark)}/{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.repeat(F.lit("x"), 99).alias("debug_log")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("id long, status string, debug_log string").parquet(f"{folder}/in")
    settings.publish_updates(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    told = spark.read.json(f"{folder}/out")
    return told.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(len(told.columns)))
