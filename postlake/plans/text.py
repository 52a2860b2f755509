"""Queries: text, HTML, JSON-LD and URL functions, and display strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import format as D
from ..functions import text as X
from .registry import query, table

_TRIM = r"'^\s+|\s+$', '', 'g')"


def _chain(first: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        first = f"regexp_replace({first}, {a}, {b}, 'g')"
    return first


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")



_TEXT = _chain("html", (r"'(?i)<br\s*/?>'", "chr(10)"), ("'(?i)</p>'", "chr(10) || chr(10)"), ("'(?i)</li>'", "chr(10)"), ("'(?i)<li[^>]*>'", "'• '"), ("'(?i)</h[1-6]>'", "chr(10) || chr(10)"), ("'<[^>]+>'", "''"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'"), ("'&nbsp;'", "' '"), (r"'\n{3,}'", "chr(10) || chr(10)"))


@query(f"SELECT page_id, sha256(regexp_replace({_TEXT}, {_TRIM}) AS text_sha256 FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.html_to_text(F.col("html")), 256).alias("text_sha256"))


_STRIP = _chain("html", (r"'(?is)<script\b[^>]*>.*?</script>'", "''"), (r"'(?is)<style\b[^>]*>.*?</style>'", "''"), ("'<[^>]+>'", "' '"), ("'(?i)&nbsp;'", "' '"), ("'(?i)&amp;'", "'&'"), ("'(?i)&lt;'", "'<'"), ("'(?i)&gt;'", "'>'"), ("'(?i)&#x27;|&apos;'", "chr(39)"), ("'(?i)&quot;'", "'\"'"), (r"'[ \t]+'", "' '"), (r"'\s*\n\s*'", "chr(10)"))


@query(f"SELECT page_id, sha256(regexp_replace({_STRIP}, {_TRIM}) AS text_sha256, regexp_matches(html, '(?is)<[a-z].*>') AS is_html FROM pages")
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.strip_tags(F.col("html")), 256).alias("text_sha256"), X.looks_like_html(F.col("html")).alias("is_html"))


@query()
def sanitize_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.sanitize_html("html").alias("html"))


_CITY, _REGION = "(['Toronto', 'Remote', NULL, 'Laval'])[doc_id % 4 + 1]", "(['Ontario', 'Quebec', 'Canada', NULL, 'Texas'])[doc_id % 5 + 1]"


@query(f"""SELECT doc_id, n AS postings, CASE WHEN n = 0 THEN NULL ELSE 'Role ' || doc_id END AS title, CASE WHEN n = 0 THEN NULL WHEN c = 'Remote' THEN 'Remote' WHEN c IS NOT NULL AND r IS NOT NULL AND r <> 'Canada' THEN c || ', ' || s WHEN c IS NOT NULL THEN c
    WHEN r IS NOT NULL AND r <> 'Canada' THEN s WHEN doc_id % 2 = 0 THEN 'Remote' END AS location FROM (SELECT *, CASE r WHEN 'Ontario' THEN 'ON' WHEN 'Quebec' THEN 'QC' ELSE r END AS s, CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n FROM (SELECT doc_id, {_CITY} AS c, {_REGION} AS r FROM documents))""")
def jsonld_postings(spark, sf_dir):
    """Pages made around documents: none, one, or a graph of two postings, with a broken script before them."""
    N = F.col("doc_id")
    pick = lambda v, k: F.element_at(F.array(*[F.lit(x) for x in v]), (N % k + 1).cast("int"))
    address = F.struct(pick(("Toronto", "Remote", None, "Laval"), 4).alias("addressLocality"), pick(("Ontario", "Quebec", "Canada", None, "Texas"), 5).alias("addressRegion"))
    posting = F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("Role "), N).alias("title"), F.struct(address.alias("address")).alias("jobLocation"), F.when(N % 2 == 0, "TELECOMMUTE").alias("jobLocationType"))
    listed = F.struct(F.array(F.lit("Thing"), F.lit("JobPosting")).alias("@type"), F.lit("second").alias("title"))
    body = F.when(N % 7 == 0, '{"@type":"Organization"}').when(N % 7 == 1, F.concat(F.lit('{"@graph":['), F.to_json(posting), F.lit(","), F.to_json(listed), F.lit("]}"))).otherwise(F.to_json(posting))
    script = '<script type="application/ld+json">'
    html = F.concat(F.lit(f"<html>{script}{{broken</script>{script}"), body, F.lit("</script></html>"))
    rows = docs(spark, sf_dir).select("doc_id", X.job_postings(html).alias("found"))
    first = F.try_element_at("found", F.lit(1))
    return rows.select("doc_id", F.size("found").alias("postings"), F.try_variant_get(first, "$.title", "string").alias("title"), X.posting_location(first).alias("location"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS listing_id, CASE WHEN doc_id % 3 < 2 THEN regexp_replace(doc_id || CASE doc_id % 3 WHEN 1 THEN 'x' ELSE '' END, '[^0-9]', '') END AS card_id,
    'https://www.glassdoor.ca/p?' || CASE doc_id % 3 WHEN 2 THEN 'q=1' ELSE 'jl=' || doc_id || CASE doc_id % 3 WHEN 1 THEN 'x' ELSE '' END END AS own, 'https://h.example.com/p' AS bare, 'data-engineer-' || doc_id AS slug, 'Acme ' || doc_id AS company, 'First' AS line FROM documents""")
def listing_urls(spark, sf_dir):
    N = F.col("doc_id")
    url = F.concat(F.lit("https://h.example.com/p?"), F.when(N % 3 == 2, "q=1").otherwise(F.concat(F.lit("jl="), N, F.when(N % 3 == 1, "x").otherwise(""))))
    return docs(spark, sf_dir).select(
        "doc_id", X.listing_id_of_url(url).alias("listing_id"), X.card_listing_id(url).alias("card_id"), X.same_origin(url, "www.glassdoor.ca").alias("own"), X.posting_url(url).alias("bare"),
        X.slug(F.concat(F.lit("Data \t Engineer "), N)).alias("slug"), X.without_rating(F.concat(F.lit("Acme "), N, F.lit(" 4.3 "))).alias("company"), X.first_line(F.lit(" First \nSecond")).alias("line"),
    )


@query("""SELECT c_custkey AS id, 'https://www.linkedin.com/jobs/search?keywords=data+engineer+' || c_custkey || '&location=Canada' || CASE WHEN c_custkey % 3 = 0 THEN '&f_TPR=r' || (c_custkey % 50 + 1) * 3600 WHEN c_custkey % 3 = 1 THEN '&f_TPR=r86400' ELSE '' END || CASE WHEN c_custkey % 5 > 0 THEN '&start=' || (c_custkey % 5) * 25 ELSE '' END AS linkedin,
    'https://ca.indeed.com/jobs?q=' || CASE WHEN c_custkey % 4 = 0 THEN 'software+engineer' ELSE 'analyst' END || '&l=Canada&sort=relevance' || CASE WHEN c_custkey % 2 = 0 THEN '&remotejob=1' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '&jt=internship' WHEN c_custkey % 3 = 1 THEN '&jt=fulltime' ELSE '' END AS indeed,
    'https://www.glassdoor.ca/Job/canada-analyst-' || c_custkey || '-jobs-SRCH_IL.0,6_IN3_KO7,' || (7 + length('analyst-' || c_custkey)) || '.htm?fromAge=' || c_custkey % 4 || '&sortBy=date_desc' AS glassdoor FROM customer""")
def search_urls(spark, sf_dir):
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    a = X.linkedin_search({"keyword": F.concat(F.lit("data engineer "), k), "location": F.lit("Canada"), "hours": F.when(k % 3 == 0, (k % 50 + 1).cast("string")), "window": F.when(k % 3 == 1, "r86400").otherwise(""), "experience": none, "job_type": F.lit(""), "remote": none, "start": k % 5 * 25})
    b = X.indeed_search({"keyword": F.when(k % 4 == 0, "").otherwise("analyst"), "location": none, "days": none, "remote": k % 2 == 0, "internship": k % 3 == 0, "job_type": F.when(k % 3 == 1, " fulltime "), "level": none, "lang": none, "start": F.lit(0)})
    c = X.glassdoor_search({"location_slug": F.lit("canada"), "keyword_slug": X.slug(F.concat(F.lit("Analyst "), k)), "from_age": k % 4, "min_salary": F.lit(None).cast("int"), "min_rating": F.lit(None).cast("double"), "job_type": F.lit("")})
    return table(spark, sf_dir, "customer").select(k.alias("id"), a.alias("linkedin"), b.alias("indeed"), c.alias("glassdoor"))


_SYM, _SUF = "(['$', '€', 'CHF ', '', ''])[doc_id % 5 + 1]", "(['/hr', '/yr', ''])[doc_id % 3 + 1]"


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {_SYM} || (doc_id % 90 + 10) || '–' || {_SYM} || (doc_id % 90 + 20) || '.50' || {_SUF} WHEN 1 THEN 'From ' || {_SYM} || (doc_id % 90 + 10) || {_SUF} WHEN 2 THEN 'Up to ' || {_SYM} || (doc_id % 90 + 20) || '.50' || {_SUF} ELSE '—' END AS salary,
    (['Remote', 'On-site', '—'])[doc_id % 3 + 1] AS remote FROM documents""")
def format_salary(spark, sf_dir):
    N = F.col("doc_id")
    low = F.when(N % 4 < 2, (N % 90 + 10).cast("string")).otherwise(" ")
    high = F.when(N % 2 == 0, F.concat(N % 90 + 20, F.lit(".5"))).when(N % 4 == 3, "NaN")
    code, period = F.expr("element_at(array('CAD', 'EUR', 'CHF', '', NULL), cast(doc_id % 5 + 1 AS INT))"), F.expr("element_at(array('HOURLY', 'ANNUAL', NULL), cast(doc_id % 3 + 1 AS INT))")
    return docs(spark, sf_dir).select("doc_id", D.salary(low, high, code, period).alias("salary"), D.remote(F.when(N % 3 == 0, True).when(N % 3 == 1, False)).alias("remote"))


@query("SELECT sha256(lower(trim(coalesce(text, '')))) AS content_hash, count(*) AS n FROM documents GROUP BY ALL")
def content_hashes(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(X.content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, '[redacted]' AS token, '[redacted]' AS api_key, 'v' || user_id AS auth_token, user_id || '' AS page, '[redacted]' AS loose, 'x token=[redacted] y' AS message FROM events""")
def redact_trace(spark, sf_dir):
    u = F.col("user_id").cast("string")
    m = F.create_map(F.lit("token"), u, F.lit("api-key"), u, F.lit("auth_token"), F.concat(F.lit("v"), u), F.lit("Email"), u, F.lit("page"), u)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", X.redacted(m).alias("m"), X.redacted_loosely(m).alias("l"))
    return rows.select("event_id", F.col("m")["token"].alias("token"), F.col("m")["api-key"].alias("api_key"), F.col("m")["auth_token"].alias("auth_token"), F.concat(F.col("m")["page"], F.coalesce(F.col("m")["Email"], F.lit(""))).alias("page"), F.col("l")["auth_token"].alias("loose"), X.scrubbed(F.concat(F.lit("x token: "), u, F.lit(" y"))).alias("message"))


@query("""SELECT doc_id, 'Role ' || doc_id AS title, '{"a":{"b":"}"},"n":' || doc_id || '}' AS fragment, 'say "hi" ' || doc_id AS pushed FROM documents""")
def embedded_page_data(spark, sf_dir):
    N = F.col("doc_id")
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"title":"Role '), N, F.lit('"}</script> var x = {"job":{"a":{"b":"}"},"n":'), N, F.lit('}}; self.__next_f.push([1,"say \\"hi\\" "])self.__next_f.push([1, "'), N, F.lit('"])'))
    return docs(spark, sf_dir).select("doc_id", F.try_variant_get(X.next_data(html), "$.title", "string").alias("title"), X.object_after_key(html, "job").alias("fragment"), X.pushed_strings(html).alias("pushed"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1704067200000 WHEN 1 THEN 1704067200000 - (doc_id % 28) * 86400000 WHEN 2 THEN 1704067200000 - (doc_id % 23) * 3600000 WHEN 3 THEN 1704067200000 - 60000 * 30 END AS posted_at FROM documents")
def posted_snippets(spark, sf_dir):
    N = F.col("doc_id")
    s = F.when(N % 5 == 0, "Just posted").when(N % 5 == 1, F.concat(F.lit("Posted "), N % 28, F.lit(" days ago"))).when(N % 5 == 2, F.concat(F.lit("Active "), N % 23, F.lit(" hours ago"))).when(N % 5 == 3, "posted 30 minutes ago").otherwise("Hiring")
    return docs(spark, sf_dir).select("doc_id", X.posted_ms(s, F.lit(1704067200000)).alias("posted_at"))
