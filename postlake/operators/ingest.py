"""Ingest: validation with reject routing, first-wins within a batch, insert-if-absent, and the dual write."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import vocab
from ..sources import versions
from ..sources.versions import Version
from . import flatten, project


def ordered(gates: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first gate whose condition holds; a null condition does not hold."""
    out = F
    for name, cond in gates:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out.otherwise(F.lit(otherwise))


def route(envelopes: DataFrame) -> DataFrame:
    """envelopes: website, scan_run_id, source_raw, skip_reason, any others. Adds site, v (the payload), outcome.

    outcome is accepted, skipped (acknowledged, nothing written; looked at before all else), or the reason of a reject.
    """
    df = envelopes.withColumn("site", F.lower(F.trim("website"))).withColumn("v", F.try_parse_json("source_raw"))
    v, site = F.col("v"), F.col("site")
    gates = [
        ("skipped", F.col("skip_reason") != ""),
        ("no_source_raw", F.col("source_raw").isNull()),
        ("malformed", v.isNull() | ~P.is_object("v")),
        ("unknown_site", ~F.coalesce(site.isin(*vocab.SITES), F.lit(False))),
        ("no_scan_run_id", F.coalesce(F.col("scan_run_id"), F.lit("")) == ""),
        ("no_job_url", (site == "linkedin") & (F.coalesce(P.text("v", "$.data.jobPostingUrl"), F.lit("")) == "")),
        ("no_surface", (site == "indeed") & ~P.has_block("v", "$.mosaic") & ~P.has_block("v", "$.graphql")),
        ("no_jobkey", (site == "indeed") & (F.coalesce(flatten.indeed_key(), F.lit("")) == "")),
        ("no_listing_id", (site == "glassdoor") & (F.coalesce(flatten.listing_id(), F.lit("")) == "")),
    ]
    return df.withColumn("outcome", ordered(gates, "accepted"))


def job_url(site: Column) -> Column:
    key = flatten.listing_id()
    return (
        F.when(site == "linkedin", P.text("v", "$.data.jobPostingUrl"))
        .when(site == "indeed", F.concat(F.lit("https://ca.indeed.com/viewjob?jk="), flatten.indeed_key()))
        .when(site == "glassdoor", F.concat(F.lit("https://www.glassdoor.ca/job-listing/listing-"), key, F.lit(".htm?jl="), key))
    )


def accepted(routed: DataFrame) -> DataFrame:
    return routed.where("outcome = 'accepted'").withColumn("job_url", job_url(F.col("site")))


def keyed(routed: DataFrame) -> DataFrame:
    """routed with job_url, without the parsed payload. To be written before it is filtered or joined: each payload is parsed once then."""
    return routed.withColumn("job_url", job_url(F.col("site"))).drop("v")


def first_wins(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """Of the rows of a key, the first in the given order.

    min_by is combined in map tasks, so a key that many rows share is a few rows after the shuffle, not a sorted window.
    """
    cols = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def insert_if_absent(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose key target lacks: what an append would add."""
    return batch.join(target.select(*keys), keys, "left_anti")


def outcome_of_insert(batch: DataFrame, target: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each row of batch with already_exists: an earlier row of the batch, or target, has its key.

    The first row of a key is a minimum that map tasks combine, so a key that many rows share is no one task's sort.
    """
    there = target.select(*keys).distinct().withColumn("_there", F.lit(True))
    first = batch.groupBy(*keys).agg(F.min(order).alias("_first")).join(there, keys, "left")
    return batch.join(first, keys).withColumn("already_exists", F.col("_there").isNotNull() | (F.col(order) > F.col("_first"))).drop("_first", "_there")


KEY_BUCKETS = 64


def key_table(spark: SparkSession, path: str, buckets: int = KEY_BUCKETS) -> str:
    """The name of the table of stored keys: bucketed and sorted by key, so a join on the key does not shuffle it."""
    name = "postlake_keys_" + hashlib.sha256(path.encode()).hexdigest()[:16]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (site STRING, job_url STRING, token STRING) USING parquet CLUSTERED BY (site, job_url) SORTED BY (site, job_url) INTO {buckets} BUCKETS LOCATION '{path}/keys'")
    spark.catalog.refreshTable(name)
    return name


def unstored(rows: DataFrame, path: str, version: Version) -> DataFrame:
    """Rows whose key no batch of the version has. Keys of batches that were never published do not count."""
    spark = rows.sparkSession
    tokens = spark.createDataFrame([(f.rsplit("/", 1)[-1],) for f in version.batches.values()], "token string")
    stored = spark.table(key_table(spark, path)).join(F.broadcast(tokens), "token", "left_semi")  # a row a batch
    return rows.join(stored.select("site", "job_url"), ["site", "job_url"], "left_anti")


def write_batch(routed: DataFrame, path: str, batch_id: int, tries: int = 3) -> str:
    """Adds a batch to the table at path, and returns the folder of its rows: those whose key is not stored yet, in all parts.

    Parts: arrivals with their outcome, payloads, a flat table by source, canonical rows with their warnings, rejects. A posting that an earlier batch
    has adds nothing and changes nothing. Parts and keys are written first, under a name of their own; the version that
    has them is published last. A batch that is published already is not written again, so a retry after any failure
    leaves each posting once.
    """
    spark = routed.sparkSession
    for _ in range(tries):
        version = versions.current(spark, path)
        if str(batch_id) in version.batches:
            return f"{path}/{version.batches[str(batch_id)]}"
        token = f"{batch_id}-{uuid.uuid4().hex}"
        _write_parts(routed, path, f"data/{token}", version, token)
        try:
            versions.publish(spark, path, version, str(batch_id), f"data/{token}")
        except versions.Conflict:
            continue  # what another writer has stored must be looked at
        return f"{path}/data/{token}"
    raise versions.Conflict(f"batch {batch_id} of {path} met another writer {tries} times")


def _write_parts(routed: DataFrame, path: str, folder: str, version: Version, token: str) -> None:
    spark = routed.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{folder}/{name}", compression="zstd")
        return spark.read.schema(df.schema).parquet(f"{path}/{folder}/{name}")

    arrived = kept(keyed(routed), "arrivals")
    good = arrived.where("outcome = 'accepted'")
    first = unstored(first_wins(good.select("site", "job_url", "arrival"), ["site", "job_url"], "arrival"), path, version)
    payloads = kept(good.join(first, ["site", "job_url", "arrival"], "left_semi").select("site", "job_url", "scan_run_id", "scrape_time", F.col("source_raw").alias("raw")), "payloads")
    flat = {site: kept(df.drop("site"), f"{site}_jobs") for site, df in project.flat_rows(payloads.drop("job_url")).items()}
    kept(project.complete(project.canonical_of(flat), keep_warnings=True), "canonical")
    kept(arrived.where("outcome NOT IN ('accepted', 'skipped')").select("website", "scan_run_id", "source_raw", "outcome"), "rejects")
    payloads.select("site", "job_url", F.lit(token).alias("token")).write.insertInto(key_table(spark, path))
