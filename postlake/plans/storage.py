"""Queries: pages as a source and a stream, pairing of surfaces, purge by day, sketches, bucketed tables and join strategies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import flatten, lifecycle, sketches
from ..sources import adapter, pages
from ..sources.store import bucketed, shared, stored
from ..streaming import jobs as S
from .registry import query, table


def crawled(spark, sf_dir, stream=False, **options):
    pages.register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("crawled_pages").options(path=f"{sf_dir}/pages.parquet", **options).load()


@query("SELECT page_id, url, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, length(html) AS n_chars, (length(html) - length(replace(html, '<a href=', ''))) // 8 AS links FROM pages")
def pages_source(spark, sf_dir):
    html = F.col("html")
    return crawled(spark, sf_dir).select("page_id", "url", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("lang"), F.length(html).alias("n_chars"), ((F.length(html) - F.length(F.replace(html, F.lit("<a href="), F.lit("")))) / 8).cast("long").alias("links"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL")
def pages_stream(spark, sf_dir):
    """The same source as a stream; html is not read."""
    hosts = crawled(spark, sf_dir, True, columns="page_id,url").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    return S.to_table(hosts, shared(spark), "append").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'p' || page_id WHEN 1 THEN 'n' || page_id END AS listing_id FROM pages")
def page_listing_of_pages(spark, sf_dir):
    """Whole crawled pages, into which a listing is put before their body's end: as pushed data beside a data script, as a script alone, or not at all."""
    N, case = F.col("page_id"), F.col("page_id") % 3
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"jobListing":{"jobDetailsData":{"listingId":"n'), N, F.lit('"}}}}}</script>'))
    pushed = F.concat(F.lit('<script>self.__next_f.push([1,"{\\"jobListing\\":{\\"jobDetailsData\\":{\\"listingId\\":\\"p'), N, F.lit('\\"}}}"])</script>'))
    put = F.when(case == 0, F.concat(script, pushed)).when(case == 1, script).otherwise("")
    html = F.concat(F.regexp_replace("html", "(?s)</body>.*$", ""), put, F.lit("</body></html>"))
    return crawled(spark, sf_dir).select("page_id", F.try_variant_get(X.page_listing(html), "$.jobDetailsData.listingId", "string").alias("listing_id"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS jobkey, doc_id // 3 % 4 > 0 AS mosaic_present, doc_id // 3 % 5 > 0 AS graphql_present, CASE WHEN doc_id // 3 % 4 > 0 THEN CASE WHEN doc_id // 3 % 7 = 0 THEN 'Seen again' ELSE 'Role ' || (doc_id % 37) END END AS title FROM documents WHERE doc_id % 3 = 1 AND (doc_id // 3 % 4 > 0 OR doc_id // 3 % 5 > 0)""")
def indeed_surface_pairs(spark, sf_dir):
    """Cards of result pages and details, each of some postings: paired by key, the last card of a key counting; then flattened."""
    rows = adapter.payloads(spark, sf_dir).where("site = 'indeed'").withColumn("v", F.try_parse_json("raw"))
    m, key = F.floor(F.col("doc_id") / 3), F.try_variant_get("v", "$.mosaic.jobkey", "string")
    part = lambda name: F.to_json(F.try_variant_get("v", f"$.{name}", "variant"))
    cards = rows.where(m % 4 > 0).select(key.alias("jobkey"), "scan_run_id", "scrape_time", part("mosaic").alias("surface"))
    again = cards.where(F.floor(F.col("jobkey").cast("long") / 3) % 7 == 0).select("jobkey", "scan_run_id", (F.col("scrape_time") + F.expr("INTERVAL 1 HOUR")).alias("scrape_time"), F.regexp_replace("surface", '"title":"[^"]*"', '"title":"Seen again"').alias("surface"))
    details = rows.where(m % 5 > 0).select(key.alias("jobkey"), "scan_run_id", "scrape_time", F.concat(F.lit('{"jobkey":"'), key, F.lit('",'), F.substring(part("graphql"), 2, 1_000_000_000)).alias("surface"))
    paired = flatten.pair_surfaces(cards.unionByName(again), details)
    flat = flatten.indeed(paired.drop("jobkey").withColumn("v", F.try_parse_json("raw")).drop("raw"))
    return flat.select("jobkey", "mosaic_present", "graphql_present", "title")


@query("SELECT CAST(d AS VARCHAR) AS day, deleted, remaining FROM (SELECT CAST(ts AS DATE) AS d, count(*) FILTER (ts < TIMESTAMP '2024-01-09 08:30:00') AS deleted, count(*) FILTER (ts >= TIMESTAMP '2024-01-09 08:30:00') AS remaining FROM events GROUP BY ALL)")
def purge_by_day(spark, sf_dir):
    """A purge of a table with a folder a day: whole folders go, one day is written anew."""
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    lifecycle.write_by_day(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), path, "ts")
    deleted = lifecycle.purge_days(spark, path, "2024-01-16 08:30:00", 7, "ts")
    remaining = spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("remaining"))
    out = deleted.join(remaining, "day", "full")
    return out.select(F.col("day").cast("string").alias("day"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("deleted", "remaining")])


@query("""WITH w AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15') SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_within, TRUE AS median_within, TRUE AS p99_within FROM w GROUP BY ALL""")
def sketches_merged(spark, sf_dir):
    """Two weeks of daily sketches merged, against exact counts: whether each estimate lies within its error."""
    rows = table(spark, sf_dir, "events")
    days = stored(sketches.daily(rows, F.to_date("ts"), ["event_type"], "user_id", "value"))
    span = F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-15"))
    merged = sketches.merged(days.where("day < '2024-01-15'"), ["event_type"])
    told = merged.select("event_type", sketches.distinct_of().alias("about"), sketches.quantile_of(0.5).alias("mid"), sketches.quantile_of(0.99).alias("top"))
    below = lambda c: (F.avg((F.col("value") < F.col(c)).cast("int")), F.avg((F.col("value") <= F.col(c)).cast("int")))
    lo50, hi50, lo99, hi99 = (x.alias(k) for x, k in zip((*below("mid"), *below("top")), ("lo50", "hi50", "lo99", "hi99"), strict=True))
    exact = rows.where(span).join(F.broadcast(told), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.first("about").alias("about"), lo50, hi50, lo99, hi99)  # told: a row a type
    e = sketches.RANK_ERROR
    return exact.select(
        "event_type", "n", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), sketches.DISTINCT_ERROR * F.col("users"))).alias("users_within"),
        ((F.col("lo50") <= 0.5 + e) & (F.col("hi50") >= 0.5 - e)).alias("median_within"), ((F.col("lo99") <= 0.99 + e) & (F.col("hi99") >= 0.99 - e)).alias("p99_within"),
    )


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def substrate_bucketed_join(spark, sf_dir):
    """Two tables bucketed by the same key are joined and grouped without a shuffle."""
    o = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 16)
    i = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], 16)
    rows = o.hint("merge").join(i, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))


#: Join hints, and the operator that each asks for.
STRATEGIES = {"broadcast": "BroadcastHashJoin", "merge": "SortMergeJoin", "shuffle_hash": "ShuffledHashJoin", "shuffle_replicate_nl": "CartesianProduct"}


def joined_by(spark, sf_dir, hint):
    """Suppliers and nations, a table of 25 rows, by one of the strategies."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n.hint(hint), F.col("s_nationkey") == F.col("n_nationkey")).select(F.lit(hint).alias("strategy"), "n_name", "s_suppkey")


@query(f"SELECT strategy, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey, (SELECT unnest({list(STRATEGIES)}) AS strategy) GROUP BY ALL")
def substrate_join_strategies(spark, sf_dir):
    out = None
    for hint in STRATEGIES:
        own = joined_by(spark, sf_dir, hint).groupBy("strategy", "n_name").agg(F.count(F.lit(1)).alias("n"))
        out = own if out is None else out.unionByName(own)
    return out
