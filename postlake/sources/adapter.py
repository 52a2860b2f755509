"""Posting payloads over the documents table, in each source's nested shape.

Every value is a function of a row's doc_id, text, lang and source, chosen so that all spellings, blanks, absences,
multiple values and wrong units occur. The SQL twins of the queries derive what is to be expected from doc_id directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import quoted

EMPLOYMENT = ("Full-time", "full time", "FULL_TIME", "Part-time", "Contractor", "temp", "Intern", "Permanent", "Volunteer", "Other", "Freelance", "  ", None)
WORKPLACE = ("urn:li:fs_workplaceType:1", "urn:li:fs_workplaceType:2", "urn:li:fs_workplaceType:3", "Remote", "Hybrid", "On-site", "In person", "Moon base", None)
PERIOD = ("YEARLY", "per hour", "Monthly", "week", "DAILY", "FORTNIGHTLY", None, "Hourly-rate")
SOURCE = ("EXTRACTION", "Employer provided", "INDEED_ESTIMATE", "estimate", "MYSTERY", None)
CURRENCY = ("CAD", "USD", "EUR")
BASE_MS = 1704067200000


def pick(values: tuple, k: Column) -> Column:
    return F.element_at(F.expr(f"array({', '.join(map(quoted, values))})"), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, site, scan_run_id, scrape_time, raw (JSON text)."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("nk"), "n_name")  # 25 rows by definition
    n, m = F.col("doc_id"), F.floor(F.col("doc_id") / 3)
    is_, text = (lambda c, v: F.when(c, v)), F.col("text")
    third = lambda: F.when(m % 3 == 0, True).when(m % 3 == 1, False)
    ms = F.when(m % 17 == 0, F.lit(BASE_MS // 1000) + n).otherwise(F.lit(BASE_MS) + n * 3600000)
    urn = F.concat(F.lit("urn:li:fsd_company:"), (n % 50).cast("string"))
    emp = lambda k: pick(EMPLOYMENT, m + k)
    linkedin = F.struct(
        F.struct(
            F.concat(F.lit("https://www.linkedin.com/jobs/view/"), n).alias("jobPostingUrl"), n.alias("jobPostingId"), F.concat(F.lit("Role "), n % 37).alias("title"),
            F.col("n_name").alias("formattedLocation"), ms.alias("listedAt"), third().alias("workRemoteAllowed"),
            is_(m % 9 != 8, F.create_map(F.lit("*k"), pick(WORKPLACE, m))).alias("workplaceTypesResolutionResults"),
            emp(0).alias("formattedEmploymentStatus"), F.concat(F.lit("Level "), m % 4).alias("formattedExperienceLevel"),
            is_(m % 6 != 0, F.array(F.lit("  "), F.concat(F.lit("Industry "), m % 7))).alias("formattedIndustries"),
            F.struct(text.alias("text")).alias("description"),
            F.struct(F.lit("com.linkedin.voyager.jobs.OffsiteApply").alias("$type"), F.concat(F.lit("https://apply.example.com/"), n).alias("companyApplyUrl")).alias("applyMethod"),
            F.struct(is_(m % 5 != 4, F.array(F.struct((F.lit(50000) + m % 100 * 1000).alias("minSalary"), (F.lit(70000) + m % 100 * 1000).alias("maxSalary"), pick(CURRENCY, m).alias("currencyCode"), pick(PERIOD, m).alias("payPeriod")))).alias("compensationBreakdown"), third().alias("providedByEmployer")).alias("salaryInsights"),
            F.struct(is_(m % 2 == 0, urn).alias("company"), is_(m % 2 == 1, F.struct(urn.alias("company"))).alias("x")).alias("companyDetails"),
        ).alias("data"),
        F.array(F.struct(F.lit("urn:li:fsd_company:none").alias("entityUrn"), F.lit("Nobody").alias("name")), F.struct(is_(m % 23 != 0, urn).alias("entityUrn"), F.col("source").alias("name"))).alias("included"),
    )
    types = F.when(m % 4 == 0, F.array().cast("array<string>")).when(m % 4 == 1, F.array(emp(0))).when(m % 4 == 2, F.array(emp(0), emp(5))).otherwise(F.array(F.lit("Permanent"), emp(0)))
    language = F.when(m % 11 == 0, "english").when(m % 13 == 0, "").when(m % 4 == 0, F.col("lang")).when(m % 4 == 1, F.concat("lang", F.lit("-CA"))).when(m % 4 == 2, F.concat("lang", F.lit("_US"))).otherwise(F.upper("lang"))
    indeed = F.struct(
        F.struct(
            n.cast("string").alias("jobkey"), F.concat(F.lit("Role "), n % 37).alias("title"), F.col("n_name").alias("formattedLocation"),
            F.when(m % 5 == 1, "").when(m % 5 != 0, F.col("source")).alias("company"), F.concat(F.lit("https://apply.example.com/"), n).alias("thirdPartyApplyUrl"), ms.alias("pubDate"),
            third().alias("remoteLocation"), F.struct((F.lit(20) + m % 60).alias("min"), (F.lit(35) + m % 60).alias("max"), pick(PERIOD, m).alias("type")).alias("extractedSalary"),
            F.struct(pick(CURRENCY, m).alias("currency"), pick(SOURCE, m).alias("source")).alias("salarySnippet"), types.alias("jobTypes"),
            F.when(m % 3 == 0, "3.7").when(m % 3 == 1, "12").otherwise("many").alias("numHires"), (m % 9).alias("locationCount"),
        ).alias("mosaic"),
        F.struct(F.struct(text.alias("text")).alias("description"), F.struct(F.concat(F.lit("Employer "), F.col("source")).alias("name")).alias("employer"), language.alias("language")).alias("graphql"),
    )
    day = F.date_format(F.timestamp_millis(F.lit(BASE_MS) + n * 3600000), "yyyy-MM-dd")
    glassdoor = F.struct(
        F.struct(
            F.struct(n.alias("listingId"), F.col("n_name").alias("locationName"), F.col("source").alias("employerName"), pick(PERIOD, m).alias("payPeriod"), pick(SOURCE, m).alias("salarySource"), (m % 900).alias("gocId"), third().alias("isEasyApply")).alias("jobDetailsData"),
            F.struct(F.struct(F.struct(
                F.concat(F.lit("https://apply.example.com/"), n).alias("applyUrl"),
                F.when(m % 4 == 0, F.array(F.lit("REMOTE"))).when(m % 4 == 1, F.array(F.lit("HYBRID"))).when(m % 4 == 2, F.array().cast("array<string>")).alias("remoteWorkTypes"),
                F.array(emp(3)).alias("jobType"),
                F.struct(F.when(m % 4 == 0, F.array(F.lit(" Bachelor's degree "), F.lit(""), F.lit("Master's degree"))).when(m % 4 == 1, F.array().cast("array<string>")).when(m % 4 == 3, F.array(F.lit("  "))).alias("educationLabel")).alias("indeedJobAttribute"),
            ).alias("header")).alias("jobview")).alias("jobDetailsRawData"),
        ).alias("jobListing"),
        F.struct(
            F.concat(F.lit("Role "), n % 37).alias("title"), F.when(m % 19 == 0, "not a date").when(m % 7 == 0, F.concat(day, F.lit("T00:00:00"))).otherwise(day).alias("datePosted"), text.alias("description"),
            F.concat(F.lit("Industry "), m % 7).alias("industry"), pick(CURRENCY, m).alias("salaryCurrency"), F.struct(F.struct((F.lit(60000) + m % 100 * 500).alias("minValue"), (F.lit(90000) + m % 100 * 500).alias("maxValue")).alias("value")).alias("baseSalary"),
            F.struct(F.when(m % 3 == 0, "5+ years ").when(m % 3 == 1, "  ").alias("description")).alias("experienceRequirements"),
            F.when(m % 5 == 1, F.array(F.lit("OTHER"))).when(m % 5 != 0, F.array(emp(0))).alias("employmentType"),
        ).alias("json_ld"),
    )
    rows = documents(spark, sf_dir).join(F.broadcast(nation), F.col("doc_id") % 25 == F.col("nk"), "left")
    site = F.when(n % 3 == 0, "linkedin").when(n % 3 == 1, "indeed").otherwise("glassdoor")
    raw = F.when(n % 3 == 0, F.to_json(linkedin)).when(n % 3 == 1, F.to_json(indeed)).otherwise(F.to_json(glassdoor))
    raw = F.when((m % 2 == 0) & (m % 9 == 7), F.replace(raw, F.lit('"Moon base"'), F.lit('{"odd":1}'))).otherwise(raw)  # a label that is no text
    when = F.timestamp_millis(F.lit(BASE_MS) + n * 60000)
    return rows.select("doc_id", site.alias("site"), F.concat(F.lit("run-"), n % 40).alias("scan_run_id"), when.alias("scrape_time"), raw.alias("raw"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arrives: payloads with untidy sites, skips, missing parts and repeats of earlier postings. arrival orders them."""
    n = F.col("doc_id")
    base = payloads(spark, sf_dir)
    first = base.select(
        n.alias("arrival"), "doc_id", "scrape_time",
        F.when(n % 37 == 5, "monster").when(n % 2 == 0, F.concat(F.lit(" "), F.initcap("site"), F.lit(" "))).otherwise(F.col("site")).alias("website"),
        F.when(n % 41 != 7, F.col("scan_run_id")).alias("scan_run_id"),
        F.when(n % 31 == 3, None).when(n % 43 == 9, F.when(n % 3 == 0, '{"data":{"title":"x"}}').when(n % 3 == 1, '{"mosaic":{},"graphql":null}').otherwise('{"jobListing":{"jobDetailsData":{}}}')).otherwise(F.col("raw")).alias("source_raw"),
        F.when(n % 29 == 0, "no_response").when(n % 29 == 1, "").alias("skip_reason"),
    )
    again = first.select((n + 1000000000).alias("arrival"), *first.columns[1:])
    return first.unionByName(again)
