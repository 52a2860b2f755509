"""What the canonical table is to be, as DuckDB SQL straight from documents: it never looks at a payload."""

#: The rank of each employment spelling of the adapter (1 first), and the tokens by rank.
RANK = "[1, 1, 1, 2, 3, 4, 5, 6, 7, NULL, NULL, NULL, NULL]"
TOKEN = "['FULL_TIME', 'PART_TIME', 'CONTRACT', 'TEMPORARY', 'INTERNSHIP', 'PERMANENT', 'VOLUNTEER']"
EMP = "['Full-time', 'full time', 'FULL_TIME', 'Part-time', 'Contractor', 'temp', 'Intern', 'Permanent', 'Volunteer', 'Other', 'Freelance', '  ', NULL]"
PLACE = "['ONSITE', 'REMOTE', 'HYBRID', 'REMOTE', 'HYBRID', 'ONSITE', 'ONSITE', NULL, NULL]"
PERIOD = "['ANNUAL', 'HOURLY', 'MONTHLY', 'WEEKLY', 'DAILY', NULL, NULL, 'HOURLY']"
SOURCE = "[TRUE, TRUE, FALSE, FALSE, NULL, NULL]"
CURRENCY = "['CAD', 'USD', 'EUR']"

CANON = f"""
b AS (SELECT *, doc_id AS n, doc_id // 3 AS m, doc_id % 3 AS s FROM documents LEFT JOIN nation ON doc_id % 25 = n_nationkey),
canon AS (
 SELECT n AS doc_id, lang, source, CASE s WHEN 0 THEN 'linkedin' WHEN 1 THEN 'indeed' ELSE 'glassdoor' END AS source_site, CAST(n AS VARCHAR) AS site_job_id,
  'run-' || (n % 40) AS scan_run_id,
  CASE s WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || n WHEN 1 THEN 'https://ca.indeed.com/viewjob?jk=' || n ELSE 'https://www.glassdoor.ca/job-listing/listing-' || n || '.htm?jl=' || n END AS job_url,
  epoch_ms(1704067200000 + n * 60000) AS scrape_time, 'Role ' || (n % 37) AS title,
  CASE s WHEN 0 THEN CASE WHEN m % 23 <> 0 THEN source END WHEN 1 THEN CASE m % 5 WHEN 1 THEN '' WHEN 0 THEN 'Employer ' || source ELSE source END ELSE source END AS company,
  n_name AS location_text, text AS description,
  CASE s WHEN 2 THEN CASE WHEN m % 4 < 2 THEN TRUE END ELSE CASE m % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END END AS remote,
  'https://apply.example.com/' || n AS apply_url,
  CASE s WHEN 0 THEN 'Level ' || (m % 4) WHEN 2 THEN CASE m % 3 WHEN 0 THEN '5+ years ' WHEN 1 THEN '  ' END END AS experience_level,
  CASE s WHEN 0 THEN CASE WHEN m % 6 <> 0 THEN 'Industry ' || (m % 7) END WHEN 2 THEN 'Industry ' || (m % 7) END AS industry,
  CAST(CASE s WHEN 0 THEN CASE WHEN m % 5 <> 4 THEN 50000 + m % 100 * 1000 END WHEN 1 THEN 20 + m % 60 ELSE 60000 + m % 100 * 500 END AS DOUBLE) AS salary_min,
  CAST(CASE s WHEN 0 THEN CASE WHEN m % 5 <> 4 THEN 70000 + m % 100 * 1000 END WHEN 1 THEN 35 + m % 60 ELSE 90000 + m % 100 * 500 END AS DOUBLE) AS salary_max,
  CASE WHEN s = 0 AND m % 5 = 4 THEN NULL ELSE ({CURRENCY})[m % 3 + 1] END AS salary_currency,
  CASE WHEN s = 0 AND m % 5 = 4 THEN NULL ELSE ({PERIOD})[m % 8 + 1] END AS salary_period,
  CASE s WHEN 2 THEN CASE WHEN m % 19 <> 0 THEN CAST(CAST(epoch_ms(1704067200000 + n * 3600000) AS DATE) AS TIMESTAMP) END ELSE CASE WHEN m % 17 <> 0 THEN epoch_ms(1704067200000 + n * 3600000) END END AS posted_at,
  CASE s WHEN 0 THEN ({TOKEN})[({RANK})[m % 13 + 1]]
   WHEN 1 THEN ({TOKEN})[CASE m % 4 WHEN 1 THEN ({RANK})[m % 13 + 1] WHEN 2 THEN least(({RANK})[m % 13 + 1], ({RANK})[(m + 5) % 13 + 1]) WHEN 3 THEN least(6, ({RANK})[m % 13 + 1]) END]
   ELSE ({TOKEN})[CASE m % 5 WHEN 1 THEN NULL WHEN 0 THEN ({RANK})[(m + 3) % 13 + 1] ELSE ({RANK})[m % 13 + 1] END] END AS employment_type,
  CASE s WHEN 0 THEN ({PLACE})[m % 9 + 1] WHEN 1 THEN CASE m % 3 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'ONSITE' END ELSE CASE m % 4 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'HYBRID' END END AS workplace_type,
  CASE WHEN s = 1 AND m % 11 <> 0 AND m % 13 <> 0 THEN lang END AS language,
  CASE WHEN s = 2 THEN CASE WHEN m % 4 = 0 THEN 'Bachelor''s degree; Master''s degree' WHEN m % 3 = 0 THEN '5+ years ' END END AS education_requirements,
  CASE WHEN s = 0 THEN CASE m % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END ELSE ({SOURCE})[m % 6 + 1] END AS salary_disclosed
 FROM b)
"""
STORED = f"WITH {CANON}, stored AS (SELECT sha256('job:' || source_site || ':' || job_url) AS id, sha256('row:' || source_site || ':' || job_url) AS source_row_id, *, doc_id % 11 = 4 AS matched, doc_id % 7 = 3 AS dismissed FROM canon)"


def stored(select: str) -> str:
    return f"{STORED} {select}"
