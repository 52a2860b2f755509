"""Queries: settings, embedded listings, languages, stages and resets of matching, and joins of the substrate."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import settings as S
from ..functions import text as X
from ..operators import language as L
from ..operators import listing
from ..operators import match as M
from ..sources.store import stored
from .canonical import canon
from .expected import CANON
from .match import _ROUTED, _X, HAVE, extracted, routed
from .registry import query, table


def pick(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


@query("SELECT c_custkey AS id, ([7, 30, 7, 7, 7, 12, 7])[c_custkey % 7 + 1] AS days FROM customer")
def shelf_life_setting(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), S.shelf_life_days(pick((None, "30", "0", "-3", "soon", " 12 ", "7.5"), k)).alias("days"))


@query("SELECT c_custkey AS id, 'b' || c_custkey AS kept, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'new' END AS changed, FALSE AS legacy, 3 AS n FROM customer")
def config_merge(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.concat(F.lit("b"), k), F.lit("fit_score_req_weight"), F.lit("1"))
    new = F.create_map(F.lit("a"), F.when(F.col("c_custkey") % 3 != 0, "new"), F.lit("c"), F.lit("3"))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.merged(old, new).alias("m"))
    return m.select("id", F.col("m")["b"].alias("kept"), F.col("m")["a"].alias("changed"), F.map_contains_key("m", "fit_score_req_weight").alias("legacy"), F.size("m").alias("n"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'n' || c_custkey ELSE '' END AS name FROM customer")
def profile_defaults(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit('{"personal":{"name":"n'), k, F.lit('"}}'))).when(k % 4 == 1, "[1]").when(k % 4 == 2, "{broken")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.get_json_object(S.profile_or_empty(raw), "$.personal.name").alias("name"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'd' || doc_id WHEN 1 THEN 'j' || doc_id WHEN 2 THEN CAST(doc_id AS VARCHAR) WHEN 3 THEN CAST(doc_id AS VARCHAR) END AS listing_id, doc_id % 6 < 4 AS sent, doc_id % 6 IN (1) AS hoisted FROM documents""")
def glassdoor_listing_source(spark, sf_dir):
    """An id in the details, in hoisted raw data, in the address, a stub of address and JSON-LD, and twice none."""
    N, case = F.col("doc_id"), F.col("doc_id") % 6
    raw = (
        F.when(case == 0, F.concat(F.lit('{"jobDetailsData":{"listingId":"d'), N, F.lit('"}}'))).when(case == 1, F.concat(F.lit('{"jobDetailsData":{"jobDetailsRawData":{"jobview":{"job":{"listingId":"j'), N, F.lit('"}}}}}')))
        .when(case == 2, '{"jobDetailsData":{"x":1}}').when(case == 4, '{"jobDetailsData":{"x":1}}')
    )
    url = F.concat(F.lit("https://h.example.com/p?"), F.when(case.isin(2, 3), F.concat(F.lit("jl="), N)).otherwise("q=1"))
    v, ld = F.try_parse_json(raw), F.when(case == 3, F.try_parse_json(F.lit('{"title":"t"}')))
    sent = F.try_parse_json(X.listing_source(v, ld, url))
    text = lambda p: F.try_variant_get(sent, p, "string")
    rows = table(spark, sf_dir, "documents").select("doc_id", sent.isNotNull().alias("sent"), F.coalesce(text("$.jobListing.listingId"), text("$.jobListing.jobDetailsData.listingId")).alias("listing_id"), F.coalesce(F.try_variant_get(sent, "$.jobListing.jobDetailsRawData.jobview.job.listingId", "string").isNotNull(), F.lit(False)).alias("hoisted"))
    return rows.select("doc_id", "listing_id", "sent", "hoisted")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'p' || doc_id WHEN 1 THEN 'n' || doc_id END AS listing_id FROM documents")
def page_listing_cascade(spark, sf_dir):
    """Pushed page data before the data script; a page may have neither."""
    N, case = F.col("doc_id"), F.col("doc_id") % 3
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"jobListing":{"jobDetailsData":{"listingId":"n'), N, F.lit('"}}}}}</script>'))
    pushed = F.concat(F.lit('self.__next_f.push([1,"{\\"jobListing\\":{\\"jobDetailsData\\":{\\"listingId\\":\\"p'), N, F.lit('\\"}}}"])'))
    html = F.when(case == 0, F.concat(script, pushed)).when(case == 1, script).otherwise("<html></html>")
    return table(spark, sf_dir, "documents").select("doc_id", F.try_variant_get(X.page_listing(html), "$.jobDetailsData.listingId", "string").alias("listing_id"))


@query("SELECT doc_id, doc_id % 3 = 2 AS easy_apply, CASE WHEN doc_id % 3 > 0 THEN 'Laval' ELSE 'Toronto' END AS location FROM documents")
def posting_meta_last_wins(spark, sf_dir):
    N = F.col("doc_id")
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    first = F.lit('{"@type":"JobPosting","directApply":true,"jobLocation":{"address":{"addressLocality":"Toronto"}}}')
    second = F.concat(F.lit('{"@type":"JobPosting","directApply":'), F.when(N % 3 == 2, "true").otherwise("false"), F.when(N % 3 > 0, ',"jobLocation":{"address":{"addressLocality":"Laval"}}').otherwise(""), F.lit("}"))
    meta = X.posting_meta(F.concat(script(first), F.lit("<p>"), script(second)))
    return table(spark, sf_dir, "documents").select("doc_id", meta["easy_apply"].alias("easy_apply"), meta["location"].alias("location"))


_LANG = r"""tw AS (SELECT doc_id, lang AS told, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS word FROM documents), dw AS (SELECT doc_id, any_value(told) AS told, word, count(*) AS n FROM tw GROUP BY doc_id, word), tri AS (SELECT DISTINCT word, unnest(list_transform(range(1, length(word) + 1), lambda i: (' ' || word || ' ')[i:i + 2])) AS gram, unnest(range(length(word))) AS at FROM dw),
    lg AS (SELECT told AS lang, gram, sum(n) AS n FROM dw JOIN tri USING (word) WHERE doc_id % 5 > 0 AND told IS NOT NULL GROUP BY ALL), tot AS (SELECT lang, sum(n) AS every, (SELECT count(DISTINCT gram) FROM lg) AS kinds FROM lg GROUP BY ALL), pr AS (SELECT g.gram, t.lang, ln((coalesce(l.n, 0) + 1) / (every + kinds)) AS logp FROM (SELECT DISTINCT gram FROM lg) g CROSS JOIN tot t LEFT JOIN lg l ON l.gram = g.gram AND l.lang = t.lang),
    wsc AS (SELECT word, lang, sum(logp) AS logp FROM tri JOIN pr USING (gram) GROUP BY ALL), sc AS (SELECT doc_id, lang, round(sum(n * logp), 6) AS score FROM dw JOIN wsc USING (word) GROUP BY ALL), best AS (SELECT doc_id, arg_min(lang, (-score, lang)) AS lang FROM sc GROUP BY doc_id)"""


def languages(spark, sf_dir):
    """doc_id, lang as a model tells it that has learned from four fifths of the labelled documents; null where a text tells none."""
    docs = table(spark, sf_dir, "documents")
    texts = stored(L.bags(docs.select("doc_id", F.col("lang").alias("told"), "text"), "doc_id", "told"))
    own = L.each_word(texts)
    model = stored(L.profiles(own.where("doc_id % 5 > 0"), "told"))
    return texts.select("doc_id", "told").join(L.predict(own.drop("told"), model, "doc_id"), "doc_id", "left")


@query(f"WITH {_LANG} SELECT doc_id, best.lang AS lang, CASE WHEN best.lang <> 'en' THEN 'language' END AS gate FROM documents LEFT JOIN best USING (doc_id)")
def language_gate(spark, sf_dir):
    return languages(spark, sf_dir).select("doc_id", "lang", L.gate(F.col("lang")).alias("gate"))


@query("SELECT TRUE AS accurate, count(*) AS held_out FROM documents WHERE doc_id % 5 = 0 AND lang IS NOT NULL")
def language_accuracy(spark, sf_dir):
    """Over 95 % right on the documents that the model has not seen."""
    rows = languages(spark, sf_dir).where("doc_id % 5 = 0 AND told IS NOT NULL")
    return rows.agg((F.avg((F.col("lang").eqNullSafe(F.col("told"))).cast("int")) > 0.95).alias("accurate"), F.count(F.lit(1)).alias("held_out"))


@query("SELECT event_id, '{\"a\":[{\"token\":\"[redacted]\",\"auth_token\":\"' || user_id || '\"}],\"deep\":{\"b\":{\"c\":{\"d\":{\"e\":{\"f\":{\"g\":\"[max_depth]\"}}}}}}}' AS shown FROM events")
def redact_nested_trace(spark, sf_dir):
    raw = F.concat(F.lit('{"a":[{"token":"x","Email":"y","auth_token":"'), F.col("user_id"), F.lit('"}],"deep":{"b":{"c":{"d":{"e":{"f":{"g":{"h":1}}}}}}}}'))
    return table(spark, sf_dir, "events").select("event_id", X.redacted_json(raw).alias("shown"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 <> 2 AS same FROM orders")
def same_card_sets(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = F.array(k, k + 1, k), F.when(k % 3 == 0, F.array(k + 1, k)).when(k % 3 == 1, F.array(k, k + 1, k + 1)).otherwise(F.array(k))
    return table(spark, sf_dir, "orders").select(k.alias("id"), X.same_set(a, b).alias("same"))


@query(f"WITH {_X} SELECT doc_id, array_to_string(list_sort(list_filter(required, lambda s: s NOT IN ('python', 'spark', 'sql'))), ',') AS gap FROM x")
def skill_gap(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(M.gap(F.col("required"), HAVE)), ",").alias("gap"))


@query(f"WITH {_X}, p AS (SELECT doc_id, cover AS required_coverage, CASE WHEN len(preferred) > 0 THEN len(list_filter(preferred, lambda s: s IN ('python', 'spark', 'sql'))) / len(preferred) END AS preferred_coverage FROM x) SELECT * FROM p ORDER BY required_coverage DESC NULLS LAST, preferred_coverage DESC NULLS LAST, doc_id LIMIT 100")
def shortlist_by_both_coverages(spark, sf_dir):
    rows = extracted(spark, sf_dir).select("doc_id", M.coverage(F.col("required"), HAVE).alias("required_coverage"), M.coverage(F.col("preferred"), HAVE).alias("preferred_coverage"))
    return rows.orderBy(F.desc_nulls_last("required_coverage"), F.desc_nulls_last("preferred_coverage"), "doc_id").limit(100)


_TYPES = "CASE WHEN verdict IN ('title', 'industry') THEN 'field_gate' WHEN verdict IN ('cross_post', 'repost') THEN 'dedup' WHEN verdict = 'llm_visa_gate' THEN 'llm_gate' WHEN verdict = 'llm_no' THEN 'llm_reject' WHEN verdict IN ('low_coverage', 'no_required_skills', 'cpu_only_unresolved') THEN 'coverage' WHEN verdict <> 'matched' THEN 'cpu_gate' END"


@query(
    f"""{_ROUTED}, v AS (SELECT doc_id, cover, required, CASE WHEN doc_id % 19 = 0 THEN 'title' WHEN doc_id % 19 = 1 THEN 'industry' WHEN doc_id % 19 = 2 THEN 'cross_post' WHEN doc_id % 19 = 3 THEN 'repost' WHEN doc_id % 19 = 4 AND NOT z THEN 'llm_visa_gate' WHEN doc_id % 19 = 5 AND verdict = 'cpu_only_unresolved' THEN 'llm_no' ELSE verdict END AS verdict FROM r)
    SELECT verdict = 'matched' AS matched, {_TYPES} AS filter_type, verdict AS reason, CASE WHEN verdict IN ('cross_post', 'repost') THEN doc_id - 1 END AS kept, CASE WHEN {_TYPES} = 'coverage' THEN array_to_string(list_sort(list_filter(required, lambda s: s NOT IN ('python', 'spark', 'sql'))), ',') END AS missing, count(*) AS n FROM v GROUP BY ALL"""
)
def verdict_tables(spark, sf_dir):
    """Six types of filtered rows, with the detail of those that have one."""
    N = F.col("doc_id")
    rows = routed(spark, sf_dir)
    verdict = (
        F.when(N % 19 == 0, "title").when(N % 19 == 1, "industry").when(N % 19 == 2, "cross_post").when(N % 19 == 3, "repost")
        .when((N % 19 == 4) & ~F.col("incomplete"), "llm_visa_gate").when((N % 19 == 5) & (F.col("verdict") == "cpu_only_unresolved"), "llm_no").otherwise(F.col("verdict"))
    )
    rows = rows.select(
        "doc_id", verdict.alias("verdict"), M.coverage(F.col("required"), HAVE).alias("required_coverage"), F.array_sort(M.gap(F.col("required"), HAVE)).alias("missing_required"),
        F.when((N % 19).isin(2, 3), N - 1).alias("original"), F.when((N % 19).isin(2, 3), 0.9).alias("score"),
    )
    matched, filtered = M.routed_tables(rows, ["doc_id"], "2024-01-10", 30)
    told = F.from_json("detail", "kept_scraped_job_id long, missing_required array<string>")
    shown = filtered.select(F.lit(False).alias("matched"), "filter_type", "reason", told["kept_scraped_job_id"].alias("kept"), F.array_join(told["missing_required"], ",").alias("missing"))
    one = matched.select(F.lit(True).alias("matched"), F.lit(None).cast("string").alias("filter_type"), F.lit("matched").alias("reason"), F.lit(None).cast("long").alias("kept"), F.lit(None).cast("string").alias("missing"))
    return one.unionByName(shown).groupBy(*shown.columns).agg(F.count(F.lit(1)).alias("n"))


_STATE = "s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'agency' END AS skip, CASE WHEN o_orderkey % 7 = 0 THEN 'visa_gate' END AS gate, o_orderkey % 2 = 0 AS done, CASE WHEN o_custkey % 3 > 0 THEN CASE WHEN o_custkey % 3 = 1 THEN 'stretch_match' ELSE 'strong_match' END END AS lvl, CASE WHEN o_custkey % 4 = 0 THEN 'high' END AS conf, (o_custkey % 10) / 10.0 AS fit, o_custkey % 11 = 0 AS inc, o_custkey % 13 = 0 AS dis FROM orders)"


@query(f"""WITH {_STATE} SELECT count(*) FILTER (skip IS NULL AND NOT dis AND NOT done) AS cpu_work, count(*) FILTER (skip IS NULL AND NOT dis AND done AND gate IS NULL AND lvl IS NULL) AS llm_extraction, count(*) FILTER (skip IS NULL AND NOT dis AND done AND gate IS NULL) AS cpu_score,
    count(*) FILTER (skip IS NULL AND NOT dis AND done AND gate IS NULL AND lvl IS NOT NULL AND conf IS NULL AND ((lvl = 'stretch_match' AND fit > 0 AND fit < 0.85) OR inc)) AS llm_score, count(*) FILTER (skip IS NULL) AS extraction_only FROM s""")
def matching_stages(spark, sf_dir):
    s = matching_state(spark, sf_dir)
    return s.agg(*[F.count_if(c).alias(k) for k, c in M.stage_of({c: F.col(c) for c in s.columns}).items()])


def matching_state(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, "agency").alias("skip_reason"), F.when(k % 7 == 0, "visa_gate").alias("match_skip_reason"), F.when(k % 2 == 0, F.col("o_orderdate")).alias("matched_at"),
        F.when(c % 3 == 1, "stretch_match").when(c % 3 == 2, "strong_match").alias("match_level"), F.when(c % 4 == 0, "high").alias("confidence"), (c % 10 / 10.0).alias("fit_score"), (c % 11 == 0).alias("jd_incomplete"), (c % 13 == 0).alias("dismissed"),
    )


@query(
    """WITH k AS (SELECT unnest(['gates', 'score', 'undo_button1', 'undo_button2', 'undo_button3', 'undo_button4', 'all']) AS kind), s AS (SELECT o_orderkey AS i, o_custkey AS c, o_orderkey % 7 = 0 AS gate, o_custkey % 4 = 0 AS conf, o_custkey % 3 > 0 AS lvl, o_orderkey % 5 = 0 AS skip, o_orderkey % 2 = 0 AS done FROM orders)
    SELECT kind, count(*) FILTER (CASE kind WHEN 'gates' THEN gate WHEN 'undo_button4' THEN conf WHEN 'undo_button2' THEN TRUE ELSE TRUE END) AS reset_count, count(*) FILTER (gate AND kind NOT IN ('gates', 'all', 'undo_button1', 'undo_button2')) AS gates_left,
    count(*) FILTER (conf AND kind NOT IN ('score', 'all', 'undo_button1', 'undo_button2', 'undo_button4')) AS confident_left, count(*) FILTER (lvl AND kind IN ('gates', 'undo_button4')) AS levels_left, count(*) FILTER (skip AND kind <> 'undo_button1') AS skipped_left, count(*) FILTER (done AND kind NOT IN ('all', 'undo_button1')) AS done_left
    FROM s, k GROUP BY ALL"""
)
def matching_resets(spark, sf_dir):
    out = None
    for kind in M.RESETS:
        left = {"gates_left": "match_skip_reason", "confident_left": "confidence", "levels_left": "match_level", "skipped_left": "skip_reason", "done_left": "matched_at"}
        own = M.reset(matching_state(spark, sf_dir), kind).agg(F.count_if("reset").alias("reset_count"), *[F.count(c).alias(k) for k, c in left.items()]).withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT outcome, count(*) AS n, count(*) FILTER (outcome = 'dismissed' AND o_custkey % 3 > 0 AND o_orderkey % 7 > 0) AS cleared FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 7 > 0 THEN 'not_decided' ELSE 'dismissed' END AS outcome FROM orders) GROUP BY ALL")
def match_dismissals(spark, sf_dir):
    """What may be dismissed; and, taken back, whose scores are cleared."""
    s = matching_state(spark, sf_dir)
    rows = s.withColumn("outcome", M.may_dismiss({c: F.col(c) for c in s.columns})).withColumns({"dismissed": F.col("outcome") == "dismissed", "before": F.col("match_level")})
    return M.undismiss(rows).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("before").isNotNull() & F.col("match_level").isNull()).alias("cleared"))


@query(f"""WITH {CANON} SELECT CASE WHEN NOT regexp_matches(lower(title), 'role 1|role 2') THEN 'title' WHEN regexp_matches(lower(industry), 'industry 3') THEN 'industry' WHEN regexp_matches(lower(experience_level), '5\\+ years') THEN 'experience' WHEN language NOT IN ('en', 'fr') THEN 'language' WHEN regexp_matches(lower(education_requirements), 'master') THEN 'education' END AS gate, count(*) AS n FROM canon GROUP BY ALL""")
def field_gates(spark, sf_dir):
    rows = canon(spark, sf_dir)
    gate = M.field_gates({c: F.col(c) for c in rows.columns}, ("role 1", "role 2"), ("industry 3",), ("en", "fr"), ("master",))
    return rows.groupBy(gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CANON} SELECT count(*) AS total, 25 AS \"limit\", 50 AS \"offset\", 3 AS page, greatest(1, CAST(ceil(count(*) / 25.0) AS INTEGER)) AS pages FROM canon WHERE source_site = 'indeed'")
def listing_envelope(spark, sf_dir):
    total = canon(spark, sf_dir).where("source_site = 'indeed'").count()
    e = listing.envelope(total, 25, 50)
    return spark.createDataFrame([tuple(e.values())], "total long, limit int, offset int, page int, pages int")


@query("SELECT e.event_id, arg_max(o.event_id, (o.ts, o.event_id)) AS probe_id FROM events e LEFT JOIN events o ON o.event_type = 'error' AND o.user_id = e.user_id AND o.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY ALL")
def substrate_as_of(spark, sf_dir):
    """Each purchase with the last error of its user before it: both sides in one ordered window, no range join."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = e.withColumn("probe_id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", "probe_id")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR")
def substrate_interval_join(spark, sf_dir):
    """By hour buckets, each error in its own and the next: an equi-join, whose condition is then exact."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000))
    a = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("at"), F.explode(F.array("hour", F.col("hour") + 1)).alias("hour"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b"), "ts", "hour")
    return a.join(b, ["user_id", "hour"]).where("ts BETWEEN at AND at + INTERVAL 1 HOUR").select("a", "b")


@query("SELECT c_custkey, k, c_custkey % 7 * k AS v FROM customer, LATERAL (SELECT unnest(range(1, 1 + c_custkey % 3)) AS k)")
def substrate_lateral(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("_substrate_customer")
    return spark.sql("SELECT c_custkey, k, c_custkey % 7 * k AS v FROM _substrate_customer, LATERAL (SELECT explode(filter(sequence(1L, 3L), x -> x <= c_custkey % 3)) AS k)")


@query("SELECT n_name, count(*) AS n, sum(c_acctbal) > 0 AS positive FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL HAVING count(*) > 1")
def substrate_sql_view(spark, sf_dir):
    for t in ("customer", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"_substrate_{t}")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW _substrate_by_nation AS SELECT n_name, count(*) AS n, sum(c_acctbal) > 0 AS positive FROM _substrate_customer JOIN _substrate_nation ON n_nationkey = c_nationkey GROUP BY n_name")
    return spark.sql("SELECT * FROM _substrate_by_nation WHERE n > 1")


@query("SELECT s_suppkey, part FROM supplier, LATERAL (SELECT unnest(string_split(s_name, '#')) AS part)")
def substrate_table_function(spark, sf_dir):
    @udtf(returnType="part string")
    class Parts:
        def eval(self, name: str):
            for p in (name or "").split("#"):
                yield (p,)

    spark.udtf.register("_substrate_parts", Parts)
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_substrate_supplier")
    return spark.sql("SELECT s_suppkey, part FROM _substrate_supplier, LATERAL _substrate_parts(s_name)")
