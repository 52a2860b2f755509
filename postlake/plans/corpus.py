"""Queries: the comparison corpus, decisions on stored rows, their repair and reset, and buckets by company and region."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import dedup as D
from ..operators import reports as P
from ..sources.store import stored as kept_table
from .canonical import canon
from .dedup import _DECIDED, _EQUAL, _GATE0, _GATE1, _HEAD, _PAIRS, _TEXT, GATES, aged, flags, gated, greedy, survivors
from .expected import CANON
from .registry import query, table

_DUPS = f"""{_PAIRS}, k AS (SELECT CASE WHEN x.created_at > y.created_at THEN a ELSE b END AS id, CASE WHEN x.created_at > y.created_at THEN b ELSE a END AS original, score FROM pairs JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE x.created_at <> y.created_at),
    f AS (SELECT id, arg_max(original, (score, -original)) AS original, max(score) AS score FROM k GROUP BY ALL), h AS ({_HEAD}),
    d AS (SELECT h.doc_id AS id, coalesce({_GATE0}, {_GATE1}) AS gate, CASE WHEN o.id <> o.o THEN o.o END AS same, f.original AS alike, f.score FROM h JOIN o ON o.id = h.doc_id LEFT JOIN f ON f.id = h.doc_id),
    decided AS (SELECT id, CASE WHEN gate IS NOT NULL THEN gate WHEN same IS NOT NULL OR alike IS NOT NULL THEN 'already_scraped' END AS reason, CASE WHEN gate IS NULL THEN coalesce(same, alike) END AS original, CASE WHEN gate IS NULL AND same IS NULL THEN score END AS score FROM d)"""


def decided(spark, sf_dir):
    """Gates, equal texts and similar texts of all postings, each in the place that the rule gives it."""
    same = D.oldest_of_equal(aged(spark, sf_dir), X.content_hash(F.col("text"))).where("original IS NOT NULL").select("id", "original")
    return C.decide(gated(spark, sf_dir).select(F.col("doc_id").alias("id"), "pass0", "pass1"), same, flags(spark, sf_dir))


@query(f"{_DUPS} SELECT id, reason, original, score FROM decided")
def dedup_decided_with_scores(spark, sf_dir):
    return decided(spark, sf_dir)


@query(
    f"""{_EQUAL}, g AS (SELECT {_GATE0} AS p0, {_TEXT} AS p1, trim(coalesce(jd, '')) = '' AS blank, o.id <> o.o AS same FROM ({_HEAD}) h JOIN o ON o.id = h.doc_id), t AS (SELECT *, list_position(['title_mismatch', 'contract_mismatch', 'remote_mismatch', 'sponsorship', 'agency_jd'], p1) AS k FROM g)
    SELECT 'pass_0' AS gate, count(*) AS checked, count(p0) AS flagged FROM t UNION ALL SELECT 'title_mismatch', count(*) FILTER (p0 IS NULL AND NOT blank), count(*) FILTER (p0 IS NULL AND k = 1) FROM t
    UNION ALL SELECT 'contract_mismatch', count(*) FILTER (p0 IS NULL AND NOT blank AND (k IS NULL OR k >= 2)), count(*) FILTER (p0 IS NULL AND k = 2) FROM t UNION ALL SELECT 'remote_mismatch', count(*) FILTER (p0 IS NULL AND NOT blank AND (k IS NULL OR k >= 3)), count(*) FILTER (p0 IS NULL AND k = 3) FROM t
    UNION ALL SELECT 'sponsorship', 0, 0 UNION ALL SELECT 'agency_jd', count(*) FILTER (p0 IS NULL AND NOT blank AND (k IS NULL OR k = 5)), count(*) FILTER (p0 IS NULL AND k = 5) FROM t
    UNION ALL SELECT 'hash_exact', count(*) FILTER (p0 IS NULL AND p1 IS NULL), count(*) FILTER (p0 IS NULL AND p1 IS NULL AND same) FROM t UNION ALL SELECT 'cosine', count(*) FILTER (p0 IS NULL AND p1 IS NULL AND NOT same AND NOT blank), 0 FROM t"""
)
def dedup_gate_metrics(spark, sf_dir):
    """A gate that is off checks none, rows without text are checked by no gate of texts; here similar texts are not looked for."""
    same = D.oldest_of_equal(aged(spark, sf_dir), X.content_hash(F.col("text"))).select(F.col("id").alias("doc_id"), F.col("original").isNotNull().alias("same"))
    rows = gated(spark, sf_dir).join(same, "doc_id").select("pass0", F.col("gate1").alias("pass1"), D.is_blank(F.col("jd")).alias("blank"), "same", F.lit(False).alias("similar"))
    return P.gate_metrics(rows, D.TEXT_GATES, GATES.enabled)


@query(f"{_DECIDED} SELECT count(*) AS rows, count(*) FILTER (doc_id % 10 = 9) AS ingest_reasons, 0 AS dedup_reasons, count(*) FILTER (reason IS NOT NULL AND doc_id % 10 <> 9) AS decided FROM d")
def dedup_reset_after_decide(spark, sf_dir):
    """What dedup decided on stored rows is taken back whole; a reason given at ingest stays."""
    stored = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 9, "no_response").alias("skip_reason"), F.lit(None).cast("long").alias("original"), F.lit(None).cast("double").alias("score"))
    same = D.oldest_of_equal(aged(spark, sf_dir), X.content_hash(F.col("text"))).where("original IS NOT NULL").select("id", "original")
    rows = gated(spark, sf_dir).select(F.col("doc_id").alias("id"), "pass0", "pass1")
    after = C.apply_decisions(stored, C.decide(rows, same, same.where("false").withColumn("score", F.lit(0.0)))).select("*", F.col("skip_reason").alias("before"))
    reset = C.reset(after)
    return reset.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("skip_reason") == "no_response").alias("ingest_reasons"), F.count_if(F.col("skip_reason") != "no_response").cast("int").alias("dedup_reasons"), F.count_if(F.col("before") != "no_response").alias("decided"))


@query(f"{_EQUAL}, z AS (SELECT id, id % 2 = 0 AS asks FROM aged) SELECT count(*) AS flags FROM z WHERE FALSE")
def dedup_threshold_zero(spark, sf_dir):
    """A threshold of 0 flags nothing."""
    rows = aged(spark, sf_dir).select("id", "text", "bucket", "created_at")
    return C.similar_to_corpus(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 0).agg(F.count(F.lit(1)).alias("flags"))


@query(f"{_PAIRS}, k AS (SELECT CASE WHEN x.created_at > y.created_at THEN a ELSE b END AS id, CASE WHEN x.created_at > y.created_at THEN b ELSE a END AS original, score FROM pairs JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE x.created_at <> y.created_at) SELECT id, arg_max(original, (score, -original)) AS original, max(score) AS score FROM k WHERE id % 2 = 0 GROUP BY ALL")
def dedup_wider_corpus(spark, sf_dir):
    """A batch, the even postings, against all survivors: only its own rows are flagged."""
    rows = survivors(spark, sf_dir).select("id", "text", "bucket", "created_at")
    return C.similar_to_corpus(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 85)


_STORED = "st AS (SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 5 THEN 'no_response' ELSE 'already_scraped' END AS skip_reason, CASE WHEN doc_id % 6 BETWEEN 1 AND 4 THEN doc_id - 1 END AS original, doc_id % 6 / 10.0 AS score FROM documents)"


def stored(spark, sf_dir):
    """Chains of up to four removed rows that end in one that stays; each sixth was skipped at ingest."""
    N = F.col("doc_id")
    reason = F.when(N % 6 == 5, "no_response").when(N % 6 > 0, "already_scraped")
    return table(spark, sf_dir, "documents").select(N.alias("id"), reason.alias("skip_reason"), F.when((N % 6).between(1, 4), N - 1).alias("original"), ((N % 6) / 10.0).alias("score"))


@query(f"WITH {_STORED} SELECT id, skip_reason, CASE WHEN id % 6 BETWEEN 1 AND 4 THEN id - id % 6 END AS original FROM st")
def dedup_chain_repair(spark, sf_dir):
    """Repaired twice: the second time changes nothing."""
    return C.repair_chains(C.repair_chains(stored(spark, sf_dir))).select("id", "skip_reason", "original")


@query(f"WITH {_STORED} SELECT id, CASE WHEN skip_reason = 'no_response' THEN skip_reason END AS skip_reason, CASE WHEN skip_reason = 'no_response' OR skip_reason IS NULL THEN original END AS original FROM st")
def dedup_reset(spark, sf_dir):
    return C.reset(stored(spark, sf_dir)).select("id", "skip_reason", "original")


@query(f"WITH {_STORED} SELECT count(*) AS n FROM st WHERE skip_reason IS NULL")
def dedup_candidates(spark, sf_dir):
    return C.candidates(stored(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STORED} SELECT id, coalesce(skip_reason, CASE WHEN id % 4 = 0 THEN 'agency' END) AS skip_reason, original FROM st")
def dedup_guarded_write(spark, sf_dir):
    """Decisions on every fourth row; only rows without a reason take theirs."""
    s = stored(spark, sf_dir)
    own = s.where("id % 4 = 0").select("id", F.lit("agency").alias("reason"), F.lit(None).cast("long").alias("original"), F.lit(None).cast("double").alias("score"))
    return C.apply_decisions(s, own).select("id", "skip_reason", "original")


@query("""WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 > 0 THEN 'u' || (doc_id // 2) END AS job_url, sha256(lower(trim(coalesce(text, '')))) AS hash FROM documents), u AS (SELECT *, CASE WHEN job_url IS NULL THEN id ELSE min(id) OVER (PARTITION BY job_url) END AS first FROM a),
    w AS (SELECT *, min(CASE WHEN first = id THEN id END) OVER (PARTITION BY hash) AS origin FROM u) SELECT id, first = id AS written, CASE WHEN first <> id THEN first END AS existing_id, CASE WHEN first = id AND origin < id THEN origin END AS original_id, CASE WHEN first <> id THEN 'url_duplicate' WHEN origin < id THEN 'content_duplicate' END AS skip_reason FROM w""")
def legacy_ingest(spark, sf_dir):
    N = F.col("doc_id")
    a = table(spark, sf_dir, "documents").select(N.alias("id"), F.when(N % 9 > 0, F.concat(F.lit("u"), F.floor(N / 2))).alias("job_url"), X.content_hash(F.col("text")).alias("hash"))
    return C.legacy_ingest(a)


@query(f"WITH {CANON} SELECT source_site, count(*) AS n FROM (SELECT source_site FROM canon WHERE doc_id % 5 <> 0 UNION ALL SELECT 'matched' FROM canon WHERE doc_id % 7 = 0 AND doc_id % 40 > 9) GROUP BY ALL")
def prior_corpus(spark, sf_dir):
    rows = canon(spark, sf_dir).select("source_site", "site_job_id", "description")
    n = F.col("site_job_id").cast("long")
    start = F.to_timestamp(F.lit("2024-01-01"))
    matched = rows.where(n % 7 == 0).select(F.lit("matched").alias("source_site"), "site_job_id", "description", (start + F.make_dt_interval((n % 40).cast("int"))).alias("expires_at"))
    parts = [rows.where(F.col("source_site") == s) for s in ("linkedin", "indeed", "glassdoor")]
    out = C.prior_corpus(parts, rows.where(n % 5 == 0), matched, ["source_site", "site_job_id"], F.to_timestamp(F.lit("2024-01-10")))
    return out.groupBy("source_site").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS audit_id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def audit_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("job"))
    return C.swept(rows, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("job")), "job").select("audit_id")


@query(f"WITH {CANON} SELECT source_site, site_job_id, title, doc_id % 4 AS yoe, doc_id % 10 / 10.0 AS fit FROM canon WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")
def matched_snapshots(spark, sf_dir):
    rows, n, keys = canon(spark, sf_dir), F.col("site_job_id").cast("long"), ["source_site", "site_job_id"]
    extracted = rows.where(n % 3 == 0).select(*keys, (n % 4).alias("yoe"))
    scored = rows.where(n % 2 == 0).select(*keys, (n % 10 / 10.0).alias("fit"))
    return C.snapshots(rows.select(*keys, "title"), extracted, scored, keys)


_BUCKET = """bk AS (SELECT doc_id AS id, source_site, scrape_time, description AS text, CASE WHEN company IS NULL OR company = '' THEN NULL ELSE regexp_replace(trim(regexp_replace(lower(company), '[^\\p{L}\\p{N}]+', ' ', 'g')), '\\s+(inc|incorporated|ltd|limited|llc|corp|corporation|co|company|gmbh|ag|plc|sa)$', '') || '|' || CASE WHEN remote THEN 'remote' ELSE lower(trim(split_part(location_text, ',', 1))) END END AS bucket FROM canon)"""


@query(f"WITH {CANON}, {_BUCKET} SELECT bucket, count(*) AS n FROM bk GROUP BY ALL")
def company_region_buckets(spark, sf_dir):
    return C.bucketed(canon(spark, sf_dir)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CANON}, {_BUCKET}, q AS (SELECT *, first_value(id) OVER (PARTITION BY bucket, trim(text) ORDER BY scrape_time, id) AS o FROM bk WHERE bucket IS NOT NULL) SELECT CASE WHEN a.source_site = b.source_site THEN 'repost' ELSE 'cross_post' END AS kind, count(*) AS n FROM q a JOIN bk b ON b.id = a.o WHERE a.id <> a.o GROUP BY ALL""")
def bucket_exact_audit(spark, sf_dir):
    """Equal texts of one company in one region: the earliest stays, the others are recorded."""
    rows = C.bucketed(canon(spark, sf_dir)).select(F.col("site_job_id").cast("long").alias("id"), "source_site", "scrape_time", "description", "bucket").where("bucket IS NOT NULL")
    flags = D.oldest_of_equal(rows, F.concat("bucket", F.lit("|"), F.sha2(F.trim("description"), 256)), "scrape_time").where("original IS NOT NULL")
    return C.audit(flags.select("id", "original", F.lit(1.0).alias("score")), rows).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_SAME_BUCKET = """rows0 AS (SELECT id, source_site, text, bucket, created_at FROM (SELECT id, source_site, text, bucket, epoch_us(scrape_time) AS created_at FROM bk UNION ALL SELECT id + 1000000, 'glassdoor', text || ' again ' || id, bucket, epoch_us(scrape_time) + 3600000000 FROM bk WHERE id % 4 = 1) WHERE bucket IS NOT NULL),
    aged AS (SELECT *, first_value(id) OVER (PARTITION BY bucket, trim(text) ORDER BY created_at, id) AS o FROM rows0), s AS (SELECT * FROM aged WHERE id = o), words AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM s), tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL),
    dims AS (SELECT term, ln((1 + (SELECT count(DISTINCT id) FROM tf)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000), v AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM tf JOIN dims USING (term)),
    pairs AS (SELECT a.id AS a, b.id AS b, round(sum(x.w * y.w), 6) AS score FROM s a JOIN s b ON a.bucket = b.bucket AND a.id < b.id JOIN v x ON x.id = a.id JOIN v y ON y.id = b.id AND y.term = x.term GROUP BY ALL HAVING round(sum(x.w * y.w), 6) >= 0.85)"""


def reposted(spark, sf_dir):
    """Canonical postings with their buckets, and a quarter of them again an hour later, slightly changed, on one of the sites."""
    rows = C.bucketed(canon(spark, sf_dir)).select(F.col("site_job_id").cast("long").alias("id"), "source_site", F.col("description").alias("text"), "bucket", F.unix_micros("scrape_time").alias("created_at"))
    again = rows.where("id % 4 = 1").select((F.col("id") + 1000000).alias("id"), F.lit("glassdoor").alias("source_site"), F.concat("text", F.lit(" again "), "id").alias("text"), "bucket", (F.col("created_at") + 3600000000).alias("created_at"))
    return rows.unionByName(again).where("bucket IS NOT NULL")


_REPOSTS = f"""WITH RECURSIVE {CANON}, {_BUCKET}, {_SAME_BUCKET}, {greedy('pairs', 's')}, f AS (SELECT id, o AS original, 1.0::DOUBLE AS score FROM aged WHERE id <> o UNION ALL SELECT id, original, score FROM gone),
    recorded AS (SELECT f.id, original, score, CASE WHEN a.source_site = b.source_site THEN 'repost' ELSE 'cross_post' END AS kind FROM f JOIN rows0 a ON a.id = f.id JOIN rows0 b ON b.id = original)"""


@query(f"{_REPOSTS} SELECT id, original, score, kind FROM recorded")
def dedup_company_region(spark, sf_dir):
    """Equal, then similar texts of one company in one region: the earliest stays, and every other is recorded with it, its score and kind."""
    every = reposted(spark, sf_dir)
    rows = kept_table(every.select("id", "source_site", "created_at", F.concat("bucket", F.lit("|"), F.sha2(F.trim("text"), 256)).alias("digest")))
    same = kept_table(D.oldest_of_equal(rows, F.col("digest")).where("original IS NOT NULL").select("id", "original", F.lit(1.0).alias("score")))
    left = kept_table(D.bags(D.left_out(every, same.select("id")), "id", "bucket", "created_at"))
    return C.audit(same.unionByName(D.representatives(D.counts(left, D.vocabulary(left)), None, 0.85)), rows).select("id", "original", "score", "kind")


@query(f"{_REPOSTS} SELECT kind, count(*) AS n FROM recorded GROUP BY ALL")
def dedup_bucketed_audit(spark, sf_dir):
    return dedup_company_region(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANON} SELECT count(*) FILTER (doc_id % 11 = 4 AND remote IS NOT TRUE AND remote IS NOT NULL) AS reentered, count(*) FILTER (doc_id % 11 = 4) AS matched FROM canon")
def blacklist_reentry(spark, sf_dir):
    rows = canon(spark, sf_dir).withColumn("matched", F.col("site_job_id").cast("long") % 11 == 4)
    return C.reentry(rows, ~F.col("remote")).agg(F.count_if("reentered").alias("reentered"), F.count_if("matched").alias("matched"))
