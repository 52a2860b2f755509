"""Projection of the three flat rows onto the canonical table, with an event for every value that could not be mapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import tokens as T
from ..functions import vocab
from . import flatten

#: The canonical columns that ingest writes, in order (fixed values).
CANONICAL = (
    "source_site", "source_row_id", "site_job_id", "scan_run_id", "job_url", "scrape_time", "title", "company", "location_text", "description", "remote", "apply_url",
    "experience_level", "industry", "salary_min", "salary_max", "salary_currency", "salary_period", "posted_at", "employment_type", "workplace_type", "language",
    "education_requirements", "salary_disclosed",
)


def _none() -> Column:
    return F.lit(None).cast("string")


def _event(cond: Column, event: str, site: str, field: str, raw: Column) -> Column:
    one = F.struct(F.lit(event).alias("event"), F.lit(site).alias("site"), F.lit(field).alias("field"), F.substring(raw.cast("string"), 1, 64).alias("raw"))
    return F.when(F.coalesce(cond, F.lit(False)), F.array(one)).otherwise(flatten.no_events())


def _unknown(values: Column, table: dict[str, str], event: str, site: str, field: str) -> Column:
    return F.transform(T.unknown_values(values, table), lambda v: F.struct(F.lit(event).alias("event"), F.lit(site).alias("site"), F.lit(field).alias("field"), F.substring(v, 1, 64).alias("raw")))


def _odd(v: str, site: str, field: str) -> Column:
    """Values that are no text at all: the source has changed its shape, and nothing else would tell."""
    return F.transform(P.odd_values(v), lambda x: F.struct(F.lit("bad_value_shape").alias("event"), F.lit(site).alias("site"), F.lit(field).alias("field"), F.substring(x, 1, 64).alias("raw")))


def _period_events(site: str) -> Column:
    c = F.col("salary_period")
    return _event(T.present(c) & T.salary_period(c).isNull(), "unknown_salary_period", site, "salary_period", c)


def _source_events(c: Column, site: str) -> Column:
    return _event(T.present(c) & T.salary_disclosed(c).isNull(), "unknown_salary_source", site, "salary_source", c)


def _epoch_events(c: Column, site: str, field: str) -> Column:
    return _event(c.isNotNull() & T.epoch_ms(c).isNull(), "bad_posted_at", site, field, c)


def _finish(df: DataFrame, site: str, cols: dict[str, Column], events: list[Column]) -> DataFrame:
    fixed = {"source_site": F.lit(site), "source_row_id": F.sha2(F.concat(F.lit(f"row:{site}:"), "job_url"), 256), "scan_run_id": F.col("scan_run_id"), "job_url": F.col("job_url"), "scrape_time": F.col("scrape_time")}
    if set(cols) | set(fixed) != set(CANONICAL):
        raise ValueError("a projection must have exactly the canonical columns")
    return df.select(*[(cols | fixed)[c].alias(c) for c in CANONICAL], F.concat("ingest_events", *events).alias("warnings"))


def linkedin(df: DataFrame) -> DataFrame:
    labels, status = P.values("workplace_types_labels"), F.array(F.col("formatted_employment_status"))
    place, remote = T.workplace_type(labels), F.col("work_remote_allowed")
    cols = {
        "site_job_id": F.col("job_posting_id"), "title": F.col("title"), "company": F.col("company_name"), "location_text": F.col("formatted_location"), "description": F.col("description_text"),
        "remote": remote, "apply_url": F.col("company_apply_url"), "experience_level": F.col("formatted_experience_level"), "industry": T.first_text(P.values("formatted_industries")),
        "salary_min": F.col("salary_min"), "salary_max": F.col("salary_max"), "salary_currency": F.col("salary_currency"), "salary_period": T.salary_period(F.col("salary_period")),
        "posted_at": T.epoch_ms(F.col("listed_at")), "employment_type": T.employment_type(status), "workplace_type": place, "language": _none(), "education_requirements": _none(),
        "salary_disclosed": F.col("salary_provided_by_employer"),
    }
    events = [
        _period_events("linkedin"), _epoch_events(F.col("listed_at"), "linkedin", "listed_at"), _unknown(status, vocab.EMPLOYMENT, "unknown_employment_type", "linkedin", "employment_type"),
        _unknown(labels, vocab.WORKPLACE, "unknown_workplace_type", "linkedin", "workplace_type"),
        _odd("workplace_types_labels", "linkedin", "workplace_type"), _event((place == "REMOTE") != remote, "workplace_remote_conflict", "linkedin", "workplace_type", place),
    ]
    return _finish(df, "linkedin", cols, events)


def indeed(df: DataFrame) -> DataFrame:
    types, language, remote = P.values("job_types"), F.col("language"), F.col("remote_location")
    cols = {
        "site_job_id": F.col("jobkey"), "title": F.col("title"), "company": F.coalesce("company", "employer_name"), "location_text": F.col("formatted_location"), "description": F.col("description_text"),
        "remote": remote, "apply_url": F.col("third_party_apply_url"), "experience_level": _none(), "industry": _none(), "salary_min": F.col("salary_min"), "salary_max": F.col("salary_max"),
        "salary_currency": F.col("salary_currency"), "salary_period": T.salary_period(F.col("salary_period")), "posted_at": T.epoch_ms(F.col("pub_date")), "employment_type": T.employment_type(types),
        "workplace_type": F.when(remote, "REMOTE").when(~remote, "ONSITE"), "language": T.language_base(language), "education_requirements": _none(),
        "salary_disclosed": T.salary_disclosed(F.col("salary_snippet_source")),
    }
    events = [
        _period_events("indeed"), _epoch_events(F.col("pub_date"), "indeed", "pub_date"), _unknown(types, vocab.EMPLOYMENT, "unknown_employment_type", "indeed", "employment_type"),
        _odd("job_types", "indeed", "employment_type"), _source_events(F.col("salary_snippet_source"), "indeed"), _event(T.present(language) & T.language_base(language).isNull(), "bad_language", "indeed", "language", language),
    ]
    return _finish(df, "indeed", cols, events)


def glassdoor(df: DataFrame) -> DataFrame:
    own, header, work = P.values("employment_type"), P.values("job_type"), P.values("remote_work_types")
    types = F.when(F.size(own) > 0, own).otherwise(header)
    prose = F.col("experience_requirements_description")
    cols = {
        "site_job_id": F.col("listing_id"), "title": F.col("title"), "company": F.col("employer_name"), "location_text": F.col("location_name"), "description": F.col("description"),
        "remote": F.when(F.col("remote_work_types").isNotNull(), True), "apply_url": F.col("header_apply_url"), "experience_level": prose, "industry": F.col("industry"),
        "salary_min": F.col("jsonld_salary_min"), "salary_max": F.col("jsonld_salary_max"), "salary_currency": F.col("jsonld_salary_currency_top"),
        "salary_period": T.salary_period(F.col("salary_period")), "posted_at": F.col("date_posted").cast("timestamp"), "employment_type": T.employment_type(types), "workplace_type": T.workplace_type(work),
        "language": _none(), "education_requirements": F.coalesce(T.joined_labels(P.values("education_labels")), F.when(T.present(prose), prose)),
        "salary_disclosed": T.salary_disclosed(F.col("salary_source")),
    }
    events = [
        _period_events("glassdoor"), _unknown(types, vocab.EMPLOYMENT, "unknown_employment_type", "glassdoor", "employment_type"),
        _unknown(work, vocab.WORKPLACE, "unknown_workplace_type", "glassdoor", "workplace_type"), F.when(F.size(own) > 0, _odd("employment_type", "glassdoor", "employment_type")).otherwise(F.concat(_odd("employment_type", "glassdoor", "employment_type"), _odd("job_type", "glassdoor", "employment_type"))), _odd("remote_work_types", "glassdoor", "workplace_type"), _source_events(F.col("salary_source"), "glassdoor"),
    ]
    return _finish(df, "glassdoor", cols, events)


def flat_rows(payloads: DataFrame) -> dict[str, DataFrame]:
    """payloads: site, scan_run_id, scrape_time, raw. The flat rows of each source; all three read the same scan."""
    parsed = payloads.withColumn("v", F.try_parse_json("raw")).drop("raw")
    return {site: fn(parsed.where(F.col("site") == site)) for site, fn in (("linkedin", flatten.linkedin), ("indeed", flatten.indeed), ("glassdoor", flatten.glassdoor))}


def canonical(payloads: DataFrame) -> DataFrame:
    """One canonical row per payload, with its warnings."""
    return canonical_of(flat_rows(payloads))


def canonical_of(flat: dict[str, DataFrame]) -> DataFrame:
    """From flat rows. Those are best tables: of columns that are paths into a payload, each use is one more evaluation."""
    return linkedin(flat["linkedin"]).unionByName(indeed(flat["indeed"])).unionByName(glassdoor(flat["glassdoor"]))


def complete(df: DataFrame, keep_warnings: bool = False) -> DataFrame:
    """The stored table: id and the two flags that ingest leaves false."""
    return df.select(F.sha2(F.concat(F.lit("job:"), "source_site", F.lit(":"), "job_url"), 256).alias("id"), *CANONICAL, F.lit(False).alias("matched"), F.lit(False).alias("dismissed"), *[c for c in ("warnings",) if keep_warnings])


def warning_counts(canonical_rows: DataFrame) -> DataFrame:
    return canonical_rows.select(F.explode("warnings").alias("w")).groupBy("w.event", "w.site", "w.field", "w.raw").agg(F.count(F.lit(1)).alias("n"))
