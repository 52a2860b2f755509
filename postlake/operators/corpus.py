"""The corpus that postings are compared with, decisions on duplicates over stored rows, and their repair and reset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from . import dedup

# Reasons that dedup itself gives, and so may take back.
DEDUP_REASONS = (
    "blacklisted_company", "blacklisted_location", "title_blacklisted", "job_type", "agency", "title_mismatch", "contract_mismatch", "remote_mismatch", "sponsorship", "already_scraped", "language",
)
_SUFFIXES = r"\s+(inc|incorporated|ltd|limited|llc|corp|corporation|co|company|gmbh|ag|plc|sa)$"


def candidates(rows: DataFrame) -> DataFrame:
    return rows.where("skip_reason IS NULL")


def company_key(c: Column) -> Column:
    """Our own rule: lower case, letters and digits, one legal form at the end left out."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.nullif(F.regexp_replace(words, _SUFFIXES, ""), F.lit(""))


def region_key(location: Column, remote: Column) -> Column:
    """Remote postings are a bucket of their own; else what stands before the first comma."""
    return F.when(remote, "remote").otherwise(F.nullif(F.lower(F.trim(F.split_part(location, F.lit(","), F.lit(1)))), F.lit("")))


def bucketed(rows: DataFrame, company: str = "company", location: str = "location_text", remote: str = "remote") -> DataFrame:
    """Adds bucket: company and region. Null where either is not known: such postings are compared with none, since a wrong drop hides a posting."""
    return rows.withColumn("bucket", F.concat(company_key(F.col(company)), F.lit("|"), region_key(F.col(location), F.coalesce(remote, F.lit(False)))))


def audit(flags: DataFrame, rows: DataFrame) -> DataFrame:
    """flags: id, original, score. Adds kind: repost where both are of one site, else cross_post."""
    site = lambda k, name: rows.select(F.col("id").alias(k), F.col("source_site").alias(name))
    both = flags.join(site("id", "_own"), "id").join(site("original", "_other"), "original")
    return both.select("id", "original", "score", F.when(F.col("_own") == F.col("_other"), "repost").otherwise("cross_post").alias("kind"))


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prior_corpus(parts: list[DataFrame], current: DataFrame, matched: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """All sources' postings but those of the current batch, and matched ones that have not expired."""
    return united(parts).join(current.select(*keys), keys, "left_anti").unionByName(matched.where(F.col("expires_at") > now).drop("expires_at"))


def swept(audit_rows: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Audit rows whose posting is still there."""
    return audit_rows.join(jobs.select(key), key, "left_semi")


def snapshots(postings: DataFrame, extracted: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row with all that is known of each matched posting."""
    return postings.join(extracted, keys).join(scored, keys)


def similar_to_corpus(queries: DataFrame, others: DataFrame, percent: int, features: int = 10000) -> DataFrame:
    """queries, others: id, text, bucket, created_at. Flags (id, original, score) of queries only; their originals may be any.

    Nothing is flagged where the rule says that it can't be told: no queries, a threshold of 0, under 10 rows, under 2 texts.
    """
    rows = united([queries.withColumn("asks", F.lit(True)), others.select(*queries.columns).withColumn("asks", F.lit(False))])
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("texts"), F.count_if("asks").alias("asks")).first()
    if not percent or not n["asks"] or n["rows"] < 10 or n["texts"] < 2:
        return rows.where("false").select("id", F.col("id").alias("original"), F.lit(0.0).alias("score"))
    texts = stored(dedup.bags(rows, "id", "bucket", "created_at", "asks"))
    return dedup.similar_flags(dedup.counts(texts, dedup.vocabulary(texts, features)), None, percent / 100, F.col("asks"))


def decide(rows: DataFrame, same: DataFrame, similar: DataFrame) -> DataFrame:
    """rows: id, pass0, pass1; same: id, original; similar: id, original, score. Adds reason, original, score: gates first, then equal texts, then similar ones."""
    found = rows.join(same.withColumnRenamed("original", "_same"), "id", "left").join(similar.select("id", F.col("original").alias("_like"), "score"), "id", "left")
    gate, like = F.coalesce("pass0", "pass1"), F.coalesce("_same", "_like")
    dup = gate.isNull() & like.isNotNull()
    reason = F.coalesce(gate, F.when(dup, "already_scraped"))
    return found.select("id", reason.alias("reason"), F.when(dup, like).alias("original"), F.when(dup & F.col("_same").isNull(), F.col("score")).alias("score"))


def apply_decisions(stored: DataFrame, decided: DataFrame) -> DataFrame:
    """stored: id, skip_reason, original, score, any others. Only rows without a reason take one."""
    new = decided.where("reason IS NOT NULL").select("id", F.col("reason").alias("_reason"), F.col("original").alias("_original"), F.col("score").alias("_score"))
    hit = F.col("skip_reason").isNull() & F.col("_reason").isNotNull()
    change = {"skip_reason": F.when(hit, F.col("_reason")).otherwise(F.col("skip_reason")), **{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("original", "score")}}
    return stored.join(new, "id", "left").withColumns(change).select(*stored.columns)


def repair_chains(stored: DataFrame, most: int = 20) -> DataFrame:
    """Removed rows whose original is itself removed point to the nearest ancestor that is not; flat chains stay as they are."""
    removed = stored.where("skip_reason IS NOT NULL")
    roots = dedup.resolve_chains(removed.where("original IS NOT NULL").select("id", "original"), most)
    alive = stored.where("skip_reason IS NULL").select(F.col("id").alias("root"))
    found = roots.join(alive, "root", "left_semi").select("id", F.col("root").alias("_root"))
    return stored.join(found, "id", "left").withColumn("original", F.coalesce("_root", "original")).select(*stored.columns)


def reset(stored: DataFrame) -> DataFrame:
    """Takes back what dedup decided; reasons given at ingest stay."""
    own = F.coalesce(F.col("skip_reason").isin(*DEDUP_REASONS), F.lit(False))
    return stored.withColumns({c: F.when(~own, F.col(c)) for c in ("skip_reason", "original", "score")})


def legacy_ingest(arrivals: DataFrame, order: str = "id") -> DataFrame:
    """arrivals: id, job_url (may be null), hash. Adds written, existing_id, original_id, skip_reason.

    A url that came before is not written again; a text that came before is, with the first row that has it.
    """
    first = arrivals.where("job_url IS NOT NULL").groupBy("job_url").agg(F.min(order).alias("_first"))
    rows = arrivals.join(first, "job_url", "left").withColumn("written", F.col("job_url").isNull() | (F.col("_first") == F.col(order)))
    origin = rows.where("written").groupBy("hash").agg(F.min(order).alias("_origin"))
    rows = rows.join(origin, "hash", "left")
    copy = F.col("written") & (F.col("_origin") < F.col(order))
    return rows.select("id", "written", F.when(~F.col("written"), F.col("_first")).alias("existing_id"), F.when(copy, F.col("_origin")).alias("original_id"), F.when(~F.col("written"), "url_duplicate").when(copy, "content_duplicate").alias("skip_reason"))


def reentry(rows: DataFrame, blacklisted: Column) -> DataFrame:
    """Adds reentered, a flag of our own: postings that a blacklist drops may be looked at again; the stored claim is not touched."""
    return rows.withColumn("reentered", F.col("matched") & F.coalesce(blacklisted, F.lit(False)))


def ranked(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Adds place within key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
