"""Listings over the canonical table: optional filters, count, page, facets, lookup, and partial updates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a listing shows: all but the five filter attributes (fixed values).
SHOWN = (
    "id", "source_site", "source_row_id", "site_job_id", "scan_run_id", "job_url", "scrape_time", "matched", "dismissed", "title", "company", "location_text", "description", "remote",
    "apply_url", "experience_level", "industry", "salary_min", "salary_max", "salary_currency", "salary_period", "posted_at",
)


def midnight(day: str) -> Column:
    return F.to_timestamp(F.lit(day), "yyyy-MM-dd")


def conditions(source_site: str | None = None, scan_run_id: str | None = None, dismissed: bool | None = None, posted_from: str | None = None, posted_to: str | None = None, scraped_from: str | None = None, scraped_to: str | None = None) -> Column:
    """Conjunction of the filters given. Dismissed rows are hidden unless asked for.

    The end day of the posted range is its midnight, so that day is nearly left out; that of the scraped range counts whole.
    """
    parts = [F.col("dismissed") == F.lit(bool(dismissed))]
    if source_site:
        parts.append(F.col("source_site") == source_site)
    if scan_run_id is not None:
        parts.append(F.col("scan_run_id") == scan_run_id)
    if posted_from:
        parts.append(F.col("posted_at") >= midnight(posted_from))
    if posted_to:
        parts.append(F.col("posted_at") <= midnight(posted_to))
    if scraped_from:
        parts.append(F.col("scrape_time") >= midnight(scraped_from))
    if scraped_to:
        parts.append(F.col("scrape_time") < midnight(scraped_to) + F.expr("INTERVAL 1 DAY"))
    return reduce(and_, parts)


def page(df: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    """Newest first, ties by id: a top-k, not a full sort."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500, offset 0 or more")
    return df.orderBy(F.desc("scrape_time"), "id").offset(offset).limit(limit)


def envelope(total: int, limit: int, offset: int) -> dict[str, int]:
    return {"total": total, "limit": limit, "offset": offset, "page": offset // limit + 1, "pages": max(1, -(-total // limit))}


def facets(df: DataFrame, by: str = "source_site") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, key: str, value: Column | str) -> DataFrame:
    return df.where(F.col(key) == value)


def overlay(df: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """df with the non-null values of updates in place of its own; rows that updates lacks stay as they are."""
    new = [c for c in updates.columns if c not in keys]
    marked = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new])
    return df.join(marked, keys, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in df.columns])


def plain_number(c: Column) -> Column:
    """Decimal text without exponent or trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(38,9)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def read_model(df: DataFrame) -> DataFrame:
    return df.select(*[plain_number(F.col(c)).alias(c) if c.startswith("salary_m") else F.col(c) for c in SHOWN])
