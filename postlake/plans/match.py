"""Queries: extraction, gates, coverage, bands, blacklist, routing and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match as M
from ..operators import skills as K
from .canonical import canon
from .expected import CANON
from .registry import query, table

HAVE = ("python", "spark", "sql")
PROFILE = {"yoe": 4.0, "salary_min": 60000.0, "degree": "bachelor", "fields": ("computer science", "statistics"), "needs_sponsorship": True}
#: Configured rows of the skills table; the rest of it is grown from data.
SKILLS = (("python", "py"), ("spark", "pyspark"), ("spark", "apache spark"), ("sql", "postgres"), ("java", None), ("scala", None), ("airflow", None), ("kafka", None), ("docker", "k8s"), ("machine learning", "ml"), ("machine", None))


def texts(spark, sf_dir):
    """Postings' texts: lines made from doc_id (years, pay, degree, visa, required and nice skills, each sometimes left out), then the whole document. Some pages did not load."""
    N = F.col("doc_id")
    word = lambda k, *v: F.expr(f"element_at(array({', '.join(repr(x) for x in v)}), cast(doc_id % {k} + 1 AS INT))")
    body = F.concat(
        F.lit("About us\n"), F.when(N % 4 == 1, F.concat(N % 9, F.lit("+ Years of work\n"))).when(N % 4 == 2, F.concat(N % 9, F.lit(" - "), N % 9 + 2, F.lit(" yrs\n"))).when(N % 4 == 3, word(10, *[f"At least {w} years\n" for w in M.NUMBERS])).otherwise(""),
        F.when(N % 3 == 1, F.concat(F.lit("Pay $"), N % 50 + 30, F.lit(",000 - $"), N % 50 + 40, F.lit(",000\n"))).when(N % 6 == 2, F.concat(F.lit("Pay $"), N % 50 + 30, F.lit("k to "), N % 50 + 40, F.lit("k\n"))).when(N % 6 == 5, F.concat(F.lit("$"), N % 20 + 15, F.lit(".50-$"), N % 20 + 25, F.lit(" per hour\n"))).otherwise(""),
        word(5, "", "Bachelor degree in statistics\n", "Master degree\n", "PhD\n", "B.Sc, any degree in fine arts\n"), word(7, "No visa sponsorship\n", "Sponsorship offered\n", "We are unable to sponsor\n", "", "", "", ""),
        word(6, "Required: Python, PySpark and SQL\n", "Requirements:\nMachine learning, py\n* Kafka\n\n", "Required: java, scala\n", "Required: nothing\n", "Must have: Apache Spark, sql; docker, py\n", ""), word(2, "Nice to have: SQL, k8s\n", "Nice: none, a machine\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.when(N % 23 == 0, "short").otherwise(F.concat(body, F.coalesce("text", F.lit("")))).alias("jd"))


_COVER = "CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda s: s IN ('python', 'spark', 'sql'))) / len({0}) END"
_NL = "' || chr(10) || '"
_X = rf"""jds AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'short' ELSE 'About us' || chr(10) || CASE doc_id % 4 WHEN 1 THEN (doc_id % 9) || '+ Years of work' || chr(10) WHEN 2 THEN (doc_id % 9) || ' - ' || (doc_id % 9 + 2) || ' yrs' || chr(10) WHEN 3 THEN 'At least ' || (['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'])[doc_id % 10 + 1] || ' years' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 3 = 1 THEN 'Pay $' || (doc_id % 50 + 30) || ',000 - $' || (doc_id % 50 + 40) || ',000' || chr(10) WHEN doc_id % 6 = 2 THEN 'Pay $' || (doc_id % 50 + 30) || 'k to ' || (doc_id % 50 + 40) || 'k' || chr(10) WHEN doc_id % 6 = 5 THEN '$' || (doc_id % 20 + 15) || '.50-$' || (doc_id % 20 + 25) || ' per hour' || chr(10) ELSE '' END
    || (['', 'Bachelor degree in statistics' || chr(10), 'Master degree' || chr(10), 'PhD' || chr(10), 'B.Sc, any degree in fine arts' || chr(10)])[doc_id % 5 + 1] || (['No visa sponsorship' || chr(10), 'Sponsorship offered' || chr(10), 'We are unable to sponsor' || chr(10), '', '', '', ''])[doc_id % 7 + 1]
    || (['Required: Python, PySpark and SQL' || chr(10), 'Requirements:{_NL}Machine learning, py{_NL}* Kafka{_NL}' || chr(10), 'Required: java, scala' || chr(10), 'Required: nothing' || chr(10), 'Must have: Apache Spark, sql; docker, py' || chr(10), ''])[doc_id % 6 + 1] || (['Nice to have: SQL, k8s' || chr(10), 'Nice: none, a machine' || chr(10)])[doc_id % 2 + 1] || coalesce(text, '') END AS jd FROM documents),
    low AS (SELECT doc_id, lower(jd) AS low FROM jds),
    pay AS (SELECT *, regexp_extract(low, '\b([0-9]{{1,2}}|one|two|three|four|five|six|seven|eight|nine|ten)\s*(\+|(-|to)\s*[0-9]{{1,2}})?\s*(years|yrs)\b', 1) AS yrs, regexp_extract(low, '\$\s?([0-9][0-9,]*(\.[0-9]+)?)(k?)\s*(-|to)\s*\$?\s?([0-9][0-9,]*(\.[0-9]+)?)(k?)([^\n]{{0,20}})', ['a', 'x', 'ak', 'y', 'b', 'z', 'bk', 'rest']) AS p FROM low),
    asks AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN [] ELSE ([['python', 'spark', 'sql'], ['kafka', 'machine learning', 'python'], ['java', 'scala'], [], ['docker', 'python', 'spark', 'sql'], []])[doc_id % 6 + 1] END AS required, CASE WHEN doc_id % 23 = 0 THEN [] ELSE ([['docker', 'sql'], ['machine']])[doc_id % 2 + 1] END AS nice FROM documents),
    y AS (SELECT doc_id, length(trim(low)) < 20 AS z, coalesce(TRY_CAST(yrs AS DOUBLE), list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], yrs)) AS yoe, TRY_CAST(replace(p.a, ',', '') AS DOUBLE) * CASE p.ak WHEN 'k' THEN 1000 ELSE 1 END AS salary_min, TRY_CAST(replace(p.b, ',', '') AS DOUBLE) * CASE p.bk WHEN 'k' THEN 1000 ELSE 1 END AS salary_max,
    CASE WHEN p.a = '' THEN NULL WHEN regexp_matches(p.rest, '(per|an|/) ?(hour|hr)\b|hourly') THEN 'HOURLY' WHEN regexp_matches(p.rest, '(per|a|/) ?day\b') THEN 'DAILY' WHEN regexp_matches(p.rest, '(per|a|/) ?week\b') THEN 'WEEKLY' WHEN regexp_matches(p.rest, '(per|a|/) ?month\b') THEN 'MONTHLY' ELSE 'ANNUAL' END AS salary_period,
    CASE WHEN regexp_matches(low, '\b(phd|ph\.d|doctorate|doctoral)\b') THEN 'phd' WHEN regexp_matches(low, '\b(masters?|master''s|m\.?sc|mba)\b') THEN 'master' WHEN regexp_matches(low, '\b(bachelors?|bachelor''s|b\.?sc|b\.?eng|undergraduate degree)\b') THEN 'bachelor' ELSE 'none' END AS degree, nullif(regexp_extract(low, '\b(degree|bachelor''s|master''s|phd|doctorate) in ([a-z]+( [a-z]+)?)', 2), '') AS field,
    CASE WHEN regexp_matches(low, 'no (visa )?sponsorship|(unable|not able) to sponsor|without sponsorship|must be (a )?citizen|sponsorship is not') THEN 'false' WHEN regexp_matches(low, 'sponsorship|will sponsor|visa support') THEN 'true' ELSE 'unknown' END AS visa, required, nice FROM pay JOIN asks USING (doc_id)),
    x AS (SELECT *, list_filter(nice, lambda s: NOT list_contains(required, s)) AS preferred, {_COVER.format('required')} AS cover FROM y),
    g AS (SELECT *, CASE WHEN yoe > 5 THEN 'yoe_gate' WHEN coalesce(salary_max, salary_min) * CASE salary_period WHEN 'HOURLY' THEN 2080 WHEN 'DAILY' THEN 260 WHEN 'WEEKLY' THEN 52 WHEN 'MONTHLY' THEN 12 ELSE 1 END < 60000 THEN 'salary_gate' WHEN degree IN ('master', 'phd') OR field NOT IN ('computer science', 'statistics') THEN 'education_gate' WHEN visa = 'false' THEN 'visa_gate' END AS gate, coalesce({_COVER.format('preferred')}, 0.0) * 0.1 AS extra FROM x)"""


def skill_rows(spark, sf_dir):
    """The skills table: configured rows, and what benchmark passages name: long words, and each two of them in a row."""
    w = K.words_of(F.col("text"))
    passages = table(spark, sf_dir, "benchmark").select(w.alias("w")).where("size(w) > 1")
    pairs = F.expr("filter(transform(sequence(1, size(w) - 1), i -> slice(w, i, 2)), p -> length(p[0]) > 3 AND length(p[1]) > 3)")
    found = passages.select(F.explode(F.concat(F.expr("transform(filter(w, x -> length(x) > 7), x -> array(x))"), pairs)).alias("a")).select(F.array_join("a", " ").alias("skill")).distinct()
    own = spark.createDataFrame(list(SKILLS), "skill string, alias string")
    return own.unionByName(found.select("skill", F.lit(None).cast("string").alias("alias")))


def extracted(spark, sf_dir):
    t = texts(spark, sf_dir)
    asked = K.asked(t, K.vocabulary(skill_rows(spark, sf_dir)), "doc_id", "jd")
    return t.select("doc_id", *[c.alias(k) for k, c in M.extract(F.col("jd")).items()]).join(asked, "doc_id")


def gated(spark, sf_dir):
    rows = extracted(spark, sf_dir)
    return rows.withColumn("gate", M.hard_gates({c: F.col(c) for c in rows.columns}, PROFILE))


@query(f"WITH {_X} SELECT doc_id, yoe, salary_min, salary_max, salary_period, degree, field, visa, array_to_string(required, ',') AS required, array_to_string(preferred, ',') AS preferred, z AS incomplete FROM x")
def extract_skills(spark, sf_dir):
    return extracted(spark, sf_dir).withColumns({c: F.array_join(c, ",") for c in ("required", "preferred")})


@query(f"WITH {_X} SELECT gate, count(*) AS n FROM g GROUP BY ALL")
def hard_gates(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


_FIT = "CAST(round(cover + extra, 6) AS DOUBLE)"
_LEVEL = f"CASE WHEN cover IS NULL THEN 'stretch_match' WHEN cover = 0 THEN 'weak_match' WHEN {_FIT} >= 0.85 THEN 'strong_match' WHEN {_FIT}   >= 0.5 THEN 'stretch_match' ELSE 'weak_match' END"


@query(f"WITH {_X} SELECT doc_id, round(cover, 6) AS req_coverage, {_FIT} AS fit_score, {_LEVEL} AS level FROM g")
def cpu_prescore(spark, sf_dir):
    return extracted(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in M.prescore(F.col("required"), F.col("preferred"), HAVE).items()])


_BAND = "CASE WHEN cover IS NULL THEN 'no_required_skills' WHEN cover >= 0.85 THEN 'matched' WHEN cover < 0.5 THEN 'low_coverage' ELSE 'cpu_only_unresolved' END"


def routed(spark, sf_dir):
    """Each posting's verdict: incomplete, a gate, or its band."""
    verdict = F.when(F.col("incomplete"), "jd_incomplete").otherwise(F.coalesce("gate", M.band(M.coverage(F.col("required"), HAVE))))
    return gated(spark, sf_dir).withColumn("verdict", verdict)


_ROUTED = f"WITH {_X}, r AS (SELECT *, CASE WHEN z THEN 'jd_incomplete' ELSE coalesce(gate, {_BAND}) END AS verdict FROM g)"


_VOCAB = r"""bw AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}+#]+') AS w FROM benchmark), names AS (SELECT DISTINCT a AS alias, a AS skill FROM (SELECT unnest(list_concat(list_filter(w, lambda x: length(x) > 7), list_transform(list_filter(range(1, len(w)), lambda i: length(w[i]) > 3 AND length(w[i + 1]) > 3), lambda i: w[i] || ' ' || w[i + 1]))) AS a FROM bw WHERE len(w) > 1)),
    own AS (SELECT * FROM (VALUES ('python', 'python'), ('py', 'python'), ('spark', 'spark'), ('pyspark', 'spark'), ('apache spark', 'spark'), ('sql', 'sql'), ('postgres', 'sql'), ('java', 'java'), ('scala', 'scala'), ('airflow', 'airflow'), ('kafka', 'kafka'), ('docker', 'docker'), ('k8s', 'docker'), ('machine learning', 'machine learning'), ('ml', 'machine learning'), ('machine', 'machine')) t(alias, skill)),
    vocab AS (SELECT alias, min(skill) AS skill FROM (SELECT alias, skill FROM own UNION ALL SELECT alias, skill FROM names) GROUP BY alias)"""
_MENTIONS = r"""ls AS (SELECT doc_id, unnest(string_split(jd, chr(10))) AS raw, unnest(range(len(string_split(jd, chr(10))))) AS line FROM jds), ws AS (SELECT doc_id, line, regexp_extract_all(lower(regexp_replace(raw, '(?i)^\s*(required|requirements|required skills|must have|must haves|qualifications|what you need|nice|nice to have|preferred|preferred skills|bonus|assets|pluses|about|about us|benefits|responsibilities|what we offer|how to apply)\s*:\s*', '')), '[\p{L}\p{N}+#]+') AS w FROM ls),
    gr AS (SELECT doc_id, line, k AS n, unnest(range(len(w) - k + 1)) AS start, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS alias FROM ws, (SELECT unnest([1, 2]) AS k) WHERE len(w) >= k),
    hit AS (SELECT doc_id, line, start, n, skill FROM gr JOIN vocab USING (alias)), kept AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.line = h.line AND o.n > h.n AND o.start <= h.start AND o.start + o.n >= h.start + h.n))"""


@query(f"WITH {_VOCAB} SELECT count(*) AS aliases, count(DISTINCT skill) AS skills, count(*) FILTER (contains(alias, ' ')) AS of_two_words FROM vocab")
def skill_vocabulary(spark, sf_dir):
    return K.vocabulary(skill_rows(spark, sf_dir)).agg(F.count(F.lit(1)).alias("aliases"), F.count_distinct("skill").alias("skills"), F.count_if(F.col("n") == 2).alias("of_two_words"))


@query(f"WITH {_X}, {_VOCAB}, {_MENTIONS} SELECT doc_id, skill, count(*) AS n, string_agg(line || ':' || start || '+' || n, ',' ORDER BY line, start, n) AS evidence FROM kept GROUP BY ALL")
def skill_evidence(spark, sf_dir):
    """Every skill that a posting names, in whole texts, with the words that name it."""
    found = K.matches(K.lines(texts(spark, sf_dir), "doc_id", "jd"), K.vocabulary(skill_rows(spark, sf_dir)), "doc_id")
    spans = F.transform("evidence", lambda e: F.concat(e["line"], F.lit(":"), e["start"], F.lit("+"), e["n"]))
    return K.evidence(found, "doc_id").select("doc_id", "skill", "n", F.array_join(spans, ",").alias("evidence"))


@query(f"WITH {_VOCAB}, c AS (SELECT w AS skill, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}+#]+')) AS w FROM documents) WHERE length(w) > 7 GROUP BY ALL) SELECT skill, n FROM c WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM vocab v WHERE v.alias = c.skill)")
def skill_vocabulary_growth(spark, sf_dir):
    """Words that five postings or more have become skills, unless an alias knows them."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(K.words_of(F.col("text")))).alias("skill")).where("length(skill) > 7")
    counts = words.groupBy("skill").agg(F.count_distinct("doc_id").alias("n"))
    rows = skill_rows(spark, sf_dir)
    new = K.grown(rows, counts, 5).join(rows.select("skill"), "skill", "left_anti")
    return new.join(counts, "skill").select("skill", "n")


@query(f"WITH {_X} SELECT {_BAND} AS band, count(*) AS n FROM g GROUP BY ALL")
def coverage_banding(spark, sf_dir):
    return extracted(spark, sf_dir).groupBy(M.band(M.coverage(F.col("required"), HAVE)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ROUTED} SELECT doc_id, verdict, verdict = 'matched' AS matched FROM r")
def verdict_routing(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "verdict", (F.col("verdict") == "matched").alias("matched"))


@query("SELECT TRUE AS reconciled, count(*) AS claimed FROM documents")
def reconcile_counts(spark, sf_dir):
    """What was claimed is what was matched and what was filtered, reason by reason."""
    by = routed(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("parts"))
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("claimed")).crossJoin(F.broadcast(by)).select((F.col("claimed") == F.col("parts")).alias("reconciled"), "claimed")  # one row each


@query(f"WITH {_X}, e AS (SELECT unnest(required) AS skill, 1 AS r FROM x UNION ALL SELECT unnest(preferred), 0 FROM x) SELECT skill, count(*) AS n, CAST(sum(r) AS BIGINT) AS n_required, CAST(sum(1 - r) AS BIGINT) AS n_preferred FROM e GROUP BY ALL")
def skill_candidates(spark, sf_dir):
    return M.skill_counts(extracted(spark, sf_dir))


@query(f"""WITH {CANON} SELECT CASE WHEN company = 'Employer x' THEN 'company' WHEN regexp_matches(lower(location_text), 'france|japan') THEN 'location' WHEN NOT remote THEN 'remote_only' WHEN employment_type IN ('CONTRACT', 'TEMPORARY') THEN 'no_contract'
    WHEN salary_disclosed AND salary_max * CASE salary_period WHEN 'HOURLY' THEN 2080 WHEN 'DAILY' THEN 260 WHEN 'WEEKLY' THEN 52 WHEN 'MONTHLY' THEN 12 WHEN 'ANNUAL' THEN 1 END < 100000 THEN 'salary_floor' END AS reason, count(*) AS n FROM canon GROUP BY ALL""")
def blacklist(spark, sf_dir):
    rows = canon(spark, sf_dir)
    return rows.groupBy(M.blacklist(rows, ("Employer x",), ("france", "japan"), True, True, 100000.0).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_ROUTED}, old AS (SELECT doc_id, 'old' AS verdict, TIMESTAMP '2024-01-01' + CAST(doc_id % 40 AS INTEGER) * INTERVAL 1 DAY AS expires_at FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id, verdict FROM r WHERE doc_id % 5 = 0)
    SELECT doc_id, verdict, strftime(expires_at, '%Y-%m-%d') AS expires FROM old WHERE expires_at > TIMESTAMP '2024-01-10' AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, verdict, '2024-02-09' FROM new WHERE verdict = 'matched'""")
def shortlist_upsert(spark, sf_dir):
    N = F.col("doc_id")
    old = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("verdict"), (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((N % 40).cast("int"))).alias("expires_at"))
    new = routed(spark, sf_dir).where("doc_id % 5 = 0").select("doc_id", "verdict")
    out = M.upsert_expiring(old, new, ["doc_id"], "2024-01-10", 30, F.col("verdict") != "matched")
    return out.select("doc_id", "verdict", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@query(f"WITH {_X} SELECT doc_id, cover AS required_coverage FROM x ORDER BY cover DESC NULLS LAST, doc_id LIMIT 30")
def shortlist_order(spark, sf_dir):
    rows = extracted(spark, sf_dir).select("doc_id", M.coverage(F.col("required"), HAVE).alias("required_coverage"))
    return rows.orderBy(F.desc_nulls_last("required_coverage"), "doc_id").limit(30)
