"""Payload flattening: nested JSON of each source to its flat row. One parse per row; every column is a path into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P

#: Where each source keeps what (fixed values): columns of the flat rows and paths of the payloads.
LINKEDIN_TEXT = {
    "job_url": "jobPostingUrl", "job_posting_id": "jobPostingId", "job_posting_url": "jobPostingUrl", "formatted_location": "formattedLocation", "country_urn": "country",
    "location_urn": "locationUrn", "location_visibility": "locationVisibility", "formatted_employment_status": "formattedEmploymentStatus", "employment_status_urn": "employmentStatus",
    "title": "title", "formatted_experience_level": "formattedExperienceLevel", "applicant_tracking_system": "applicantTrackingSystem",
}
LINKEDIN_NESTED = {
    "workplace_types_urns": "workplaceTypes", "workplace_types_labels": "workplaceTypesResolutionResults", "formatted_industries": "formattedIndustries",
    "formatted_job_functions": "formattedJobFunctions", "inferred_benefits": "inferredBenefits",
}
INDEED_TEXT = {
    "link": "link", "view_job_link": "viewJobLink", "third_party_apply_url": "thirdPartyApplyUrl", "title": "title", "norm_title": "normTitle", "formatted_location": "formattedLocation",
    "job_location_city": "jobLocationCity", "job_location_state": "jobLocationState", "job_location_postal": "jobLocationPostal", "additional_location_link": "additionalLocationLink",
    "company": "company", "screener_questions_url": "screenerQuestionsURL", "salary_period": "extractedSalary.type", "salary_currency": "salarySnippet.currency", "salary_snippet_source": "salarySnippet.source",
}
INDEED_GRAPHQL = {
    "employer_canonical_url": "url", "graphql_normalized_title": "normalizedTitle", "location_formatted_long": "location.formatted.long", "graphql_location_street_address": "location.streetAddress",
    "graphql_location_country_code": "location.countryCode", "description_text": "description.text", "language": "language", "employer_name": "employer.name",
    "employer_company_page_url": "employer.relativeCompanyPageUrl", "source_name": "source.name",
}
GLASSDOOR_DETAILS = {
    "normalized_job_title": "normalizedJobTitle", "job_link": "jobLink", "seo_job_link": "seoJobLink", "salary_period": "payPeriod", "salary_source": "salarySource", "location_name": "locationName",
    "employer_name": "employerName", "employer_benefits_overview": "employerBenefitsOverview",
}
GLASSDOOR_LD = {
    "title": "title", "description": "description", "experience_requirements_description": "experienceRequirements.description", "jsonld_salary_currency_top": "salaryCurrency",
    "job_location_type": "jobLocationType", "industry": "industry", "job_benefits": "jobBenefits",
}


EVENTS = "array<struct<event: string, site: string, field: string, raw: string>>"


def no_events() -> Column:
    return F.array().cast(EVENTS)


def _entity(urn: str) -> Column:
    """The first of the included entities with the given name: a join within the row. urn: SQL."""
    return F.expr(f"try_element_at(filter(try_cast({P.get('v', '$.included')} AS ARRAY<VARIANT>), e -> try_variant_get(e, '$.entityUrn', 'string') = {urn}), 1)")


def company_urn() -> str:
    """SQL of the company's name: the one given, or the first nested one."""
    own = P.text_sql("v", "$.data.companyDetails.company")
    inner = f"map_values(try_cast({P.get('v', '$.data.companyDetails')} AS MAP<STRING, VARIANT>))"
    return f"CASE WHEN startswith({own}, 'urn:li:') THEN {own} ELSE try_element_at(filter(transform({inner}, x -> try_variant_get(x, '$.company', 'string')), u -> startswith(u, 'urn:li:')), 1) END"


def linkedin(df: DataFrame) -> DataFrame:
    """36 columns and ingest_events; df has the parsed payload in column v, and scan_run_id."""
    d = "$.data."
    kept = [c for c in df.columns if c != "v"]
    df = df.withColumns({"_company": _entity(company_urn()), "_title": _entity(P.text_sql("v", d + "standardizedTitle"))})
    pay = d + "salaryInsights.compensationBreakdown[0]."
    cols = {k: P.text("v", d + p) for k, p in LINKEDIN_TEXT.items()} | {k: P.nested("v", d + p) for k, p in LINKEDIN_NESTED.items()}
    cols |= {
        "listed_at": P.long("v", d + "listedAt"), "original_listed_at": P.long("v", d + "originalListedAt"),
        "work_remote_allowed": P.flag("v", d + "workRemoteAllowed"), "standardized_title": P.text("_title", "$.localizedName"),
        "skills_description": P.text("v", d + "skillsDescription.text", d + "skillsDescription"), "apply_method_type": F.substring_index(P.string("v", d + "applyMethod['$type']"), ".", -1),
        "company_apply_url": P.text("v", d + "applyMethod.companyApplyUrl"), "salary_min": P.number("v", pay + "minSalary"), "salary_max": P.number("v", pay + "maxSalary"),
        "salary_currency": P.text("v", pay + "currencyCode"), "salary_period": P.text("v", pay + "payPeriod"), "salary_provided_by_employer": P.flag("v", d + "salaryInsights.providedByEmployer"),
        "description_text": P.text("v", d + "description.text"), "company_name": P.text("_company", "$.name"), "company_universal_name": P.text("_company", "$.universalName"),
        "company_url": F.coalesce(F.nullif(P.text("_company", "$.url"), F.lit("")), P.text("_company", "$.companyPageUrl")), "company_description": P.text("_company", "$.description"),
    }
    return df.select(*kept, *[c.alias(k) for k, c in cols.items()], F.col("v").alias("source_raw"), no_events().alias("ingest_events"))


def indeed_key() -> Column:
    return F.coalesce(P.text("v", "$.mosaic.jobkey"), F.nullif(P.text("v", "$.graphql.jobKey"), F.lit("")), P.text("v", "$.graphql.jobkey"))


def indeed(df: DataFrame) -> DataFrame:
    """42 columns and ingest_events."""
    kept = [c for c in df.columns if c != "v"]
    key = indeed_key()
    m, g = "$.mosaic.", "$.graphql."
    cols = {k: P.text("v", m + p) for k, p in INDEED_TEXT.items()} | {k: P.text("v", g + p) for k, p in INDEED_GRAPHQL.items()}
    cols |= {
        "job_url": F.concat(F.lit("https://ca.indeed.com/viewjob?jk="), key), "jobkey": key, "mosaic_present": P.has_block("v", "$.mosaic"), "graphql_present": P.has_block("v", "$.graphql"),
        "pub_date": P.long("v", m + "pubDate"), "expiration_date": P.long("v", m + "expirationDate"), "job_types": P.nested("v", m + "jobTypes"),
        "taxonomy_attributes": P.nested("v", m + "taxonomyAttributes"), "location_count": P.whole("v", m + "locationCount"), "remote_location": P.flag("v", m + "remoteLocation"),
        "salary_min": P.number("v", m + "extractedSalary.min"), "salary_max": P.number("v", m + "extractedSalary.max"), "indeed_apply_enabled": P.flag("v", m + "indeedApplyEnabled"),
        "num_hires": P.whole("v", m + "numHires"), "attributes": P.nested("v", g + "attributes"),
    }
    return df.select(*kept, *[c.alias(k) for k, c in cols.items()], F.col("v").alias("source_raw"), no_events().alias("ingest_events"))


def pair_surfaces(cards: DataFrame, details: DataFrame) -> DataFrame:
    """cards, details: jobkey, scan_run_id, scrape_time, surface (JSON). One row a key with the payload raw that holds both surfaces, or the one there is.

    A key of several cards has its last one, as a page's map does; so have details. Keys without a value pair with none.
    """
    last = lambda df, name: df.where("jobkey <> ''").groupBy("jobkey").agg(F.max_by(F.struct("scan_run_id", "scrape_time", "surface"), F.struct("scrape_time", "surface")).alias(name))
    both = last(cards, "c").join(last(details, "d"), "jobkey", "full")
    parts = [F.when(F.col(f"{k}.surface").isNotNull(), F.concat(F.lit(f'"{name}":'), F.col(f"{k}.surface"))) for k, name in (("c", "mosaic"), ("d", "graphql"))]
    raw = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return both.select("jobkey", F.coalesce("d.scan_run_id", "c.scan_run_id").alias("scan_run_id"), F.greatest("d.scrape_time", "c.scrape_time").alias("scrape_time"), raw.alias("raw"))


def listing_id() -> Column:
    return P.text("v", "$.jobListing.jobDetailsData.listingId")


def glassdoor(df: DataFrame) -> DataFrame:
    """45 columns and ingest_events: a date that is there but can't be read is told."""
    kept = [c for c in df.columns if c != "v"]
    key = listing_id()
    d, ld, h, mp = "$.jobListing.jobDetailsData.", "$.json_ld.", "$.jobListing.jobDetailsRawData.jobview.header.", "$.jobListing.jobDetailsRawData.jobview.map."
    cols = {k: P.text("v", d + p) for k, p in GLASSDOOR_DETAILS.items()} | {k: P.text("v", ld + p) for k, p in GLASSDOOR_LD.items()}
    cols |= {
        "job_url": F.concat(F.lit("https://www.glassdoor.ca/job-listing/listing-"), key, F.lit(".htm?jl="), key), "listing_id": key, "goc_id": P.whole("v", d + "gocId"),
        "job_country_id": P.whole("v", d + "jobCountryId"), "is_easy_apply": P.flag("v", d + "isEasyApply"), "pay_period_adjusted_pay": P.nested("v", d + "payPeriodAdjustedPay"),
        "location": P.nested("v", d + "location"), "employer_overview": F.to_json(P.nested("v", d + "employerOverview")), "employer_benefits_reviews": P.nested("v", d + "employerBenefitsReviews"),
        "indeed_job_attribute": P.nested("v", h + "indeedJobAttribute"), "skills_labels": P.nested("v", h + "indeedJobAttribute.skillsLabel"), "education_labels": P.nested("v", h + "indeedJobAttribute.educationLabel"),
        "date_posted": P.iso_date(P.text("v", ld + "datePosted")), "employment_type": P.nested("v", ld + "employmentType"), "jsonld_salary_min": P.number("v", ld + "baseSalary.value.minValue"),
        "jsonld_salary_max": P.number("v", ld + "baseSalary.value.maxValue"), "job_location": P.nested("v", ld + "jobLocation"), "hiring_organization": P.nested("v", ld + "hiringOrganization"),
        "direct_apply": P.flag("v", ld + "directApply"), "header_goc": P.text("v", h + "goc"), "job_type": P.nested("v", h + "jobType"), "job_type_keys": P.nested("v", h + "jobTypeKeys"),
        "remote_work_types": P.nested("v", h + "remoteWorkTypes"), "header_apply_url": P.text("v", h + "applyUrl"), "header_employer": P.nested("v", h + "employer"),
        "map_city_name": P.text("v", mp + "cityName"), "map_country": P.text("v", mp + "country"), "map_state_name": P.text("v", mp + "stateName"),
    }
    given = P.text("v", ld + "datePosted")
    bad = F.struct(F.lit("ingest_iso_date_parse_failed").alias("event"), F.lit("glassdoor").alias("site"), F.lit("date_posted").alias("field"), F.substring(given, 1, 64).alias("raw"))
    unread = F.when(F.coalesce(F.trim(given) != "", F.lit(False)) & cols["date_posted"].isNull(), F.array(bad)).otherwise(no_events())
    return df.select(*kept, *[c.alias(k) for k, c in cols.items()], F.col("v").alias("source_raw"), unread.alias("ingest_events"))
