"""Representatives against brute force, skills and languages on literal texts, timers, purge by day, join plans, sketches, pages."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from support import DATA

from postlake.operators import cycles, language, lifecycle, project
from postlake.operators import dedup as D
from postlake.operators import match as M
from postlake.operators import skills as K
from postlake.plans import storage, streams
from postlake.sources import pages
from postlake.sources.store import shared, stored
from postlake.streaming import jobs, timers


def cosines(texts):
    """Of every two texts, by the definition of the weights."""
    tf = [Counter(t.lower().split()) for t in texts]
    df = Counter(w for c in tf for w in c)
    n = sum(1 for c in tf if c)
    vectors = [{w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items()} for c in tf]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    return lambda a, b: round(sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items()) / (norms[a] * norms[b]), 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_representatives(spark, seed):
    """Near copies, chains of which only neighbours are similar, equal ages, rows without a bucket."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(30)] for _ in range(6)]
    rows = []
    for k in range(140):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 3, 6))):
            words[rng.randrange(30)] = f"w{rng.randrange(60)}"
        rows.append((k, " ".join(words), rng.choice(("a", "b", None)), rng.randrange(90)))
    cosine = cosines([r[1] for r in rows])
    kept, want = [], {}
    for i, _, bucket, at in sorted((r for r in rows if r[2]), key=lambda r: (r[3], r[0])):
        like = [(cosine(i, j), -j) for j, b, t in kept if b == bucket and t < at and cosine(i, j) >= 0.85]
        if like:
            want[i] = (-max(like)[1], max(like)[0])
        else:
            kept.append((i, bucket, at))
    df = spark.createDataFrame(rows, "id long, text string, bucket string, created_at long")
    for share in (0.0, 0.2, 1.0):  # by rounds alone, by both, along pairs after one round
        got = {r.id: (r.original, r.score) for r in D.representatives(stored(D.weights(df)), df, 0.85, share).collect()}
        assert got == want and len(want) > 10


def test_representatives_of_very_many_near_copies(spark):
    """10,000 near copies of one bucket are a row each, not fifty million pairs."""
    text = " ".join(f"w{k}" for k in range(400))
    df = spark.range(10_000).select("id", F.concat(F.lit(text + " x"), F.col("id") % 500).alias("text"), F.lit("b").alias("bucket"), F.col("id").alias("created_at"))
    got = D.representatives(stored(D.weights(df)), df, 0.85).groupBy("original").count().collect()
    assert [tuple(r) for r in got] == [(0, 9_999)]


def test_skills(spark):
    vocab = K.vocabulary(spark.createDataFrame([("machine learning", "ml"), ("machine", None), ("sql", "structured query language"), ("c++", "cpp")], "skill string, alias string"))
    text = "About us: machine\nRequirements:\n* Machine Learning, ML\n* structured query language\n\nC++ here\nNice to have: a machine"
    texts = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    found = K.matches(K.lines(texts), vocab)
    got = sorted((r.id, r.line, r.section, r.skill, r.start, r.n) for r in found.collect())
    assert got == [(1, 0, "other", "machine", 0, 1), (1, 2, "required", "machine learning", 0, 2), (1, 2, "required", "machine learning", 2, 1), (1, 3, "required", "sql", 0, 3), (1, 5, "other", "c++", 0, 1), (1, 6, "preferred", "machine", 1, 1)]
    told = {r.id: (r.required, r.preferred) for r in K.asked(texts, vocab).collect()}
    assert told == {1: (["machine learning", "sql"], ["machine"]), 2: ([], []), 3: ([], [])}
    more = K.grown(spark.createDataFrame([("sql", None)], "skill string, alias string"), spark.createDataFrame([("SQL", 9), ("rust", 5), ("go", 4)], "skill string, n long"), 5)
    assert sorted(r.skill for r in more.collect()) == ["rust", "sql"]


def test_patterns_of_postings(spark):
    given = ["Minimum of six years; $60,000.50 - $80,000 per year", "3-5 yrs, $90k to $120k", "10+ years, $45/hour", "$20 - $30 / hr, B.Sc", "Master's in computer science, will sponsor", "PhD; must be a citizen", "2 to 4 years", None]
    df = spark.createDataFrame(list(enumerate(given)), "k int, t string")
    rows = df.select("k", *[c.alias(k) for k, c in M.extract(F.col("t")).items()]).orderBy("k").collect()
    assert [r.yoe for r in rows] == [6, 3, 10, None, None, None, 2, None]
    assert [(r.salary_min, r.salary_max, r.salary_period) for r in rows[:4]] == [(60000.5, 80000, "ANNUAL"), (90000, 120000, "ANNUAL"), (None, None, None), (20, 30, "HOURLY")]
    assert [r.degree for r in rows] == ["none", "none", "none", "bachelor", "master", "phd", "none", "none"] and rows[4].field == "computer science"
    assert [r.visa for r in rows] == ["unknown"] * 4 + ["true", "false", "unknown", "unknown"]


def test_blacklisted_places_are_words_not_patterns(spark):
    df = spark.createDataFrame([("St. John's + (Remote)",), ("Stx Johns",)], "location_text string").withColumns({c: F.lit(None).cast("string") for c in ("company", "employment_type", "salary_period")} | {"remote": F.lit(None).cast("boolean"), "salary_disclosed": F.lit(None).cast("boolean"), "salary_max": F.lit(None).cast("double")})
    got = df.select(M.blacklist(df, (), ("st. john's +", "(remote)"), False, False, None).alias("r")).collect()
    assert [r.r for r in got] == ["location", None]


def test_languages(spark):
    told = [(1, "der hund und die katze sind im haus", "de"), (2, "the dog and the cat are in the house", "en"), (3, "le chien et le chat sont dans la maison", "fr")]
    df = spark.createDataFrame(told, "id long, text string, lang string")
    model = language.profiles(language.words(df, "id").join(df.select("id", "lang"), "id"))
    new = spark.createDataFrame([(7, "die katze und der hund"), (8, "the house and the dog"), (9, "le chat et la maison"), (10, ""), (11, None), (12, "12 !")], "id long, text string")
    assert {r.id: r.lang for r in language.predict(language.words(new, "id"), model, "id").collect()} == {7: "de", 8: "en", 9: "fr"}


def test_merged_spans_do_not_depend_on_order():
    rng = random.Random(4)
    for _ in range(200):
        times = [rng.randrange(200) for _ in range(rng.randint(1, 30))]
        whole = timers.merge_spans([], times, 10)
        cut = rng.randint(0, len(times))
        assert timers.merge_spans(timers.merge_spans([], times[:cut], 10), times[cut:], 10) == whole
        assert sum(s[2] for s in whole) == len(times) and all(b[0] - a[1] >= 10 for a, b in zip(whole, whole[1:]))


def test_session_state_expires(spark, tmp_path):
    """A session that has been silent for longer than its state lives begins anew."""
    timers.use_rocksdb(spark)
    path = str(tmp_path / "in")
    seen = [(1, 0, "expired"), (1, 60, "expired"), (2, 90_000, "live"), (2, 180_000, "live"), (1, 180_060, "expired"), (2, 260_000, "live")]
    rows = spark.createDataFrame([(u, k, s, p) for k, (u, s, p) in enumerate(seen)], "user_id long, event_id long, at long, status string")
    for k in range(len(seen)):
        rows.where(F.col("event_id") == k).select("user_id", "event_id", F.timestamp_seconds(F.col("at") + 1704067200).alias("ts"), "status").coalesce(1).write.mode("append").parquet(path)
    out = jobs.to_table(timers.sessions(jobs.read(spark, path, 1), F.col("status"), "1 day", "1 minute"), shared(spark), "update")
    got = [r.failures for r in out.where("user_id = 1").orderBy("batch").collect()]
    assert got == [1, 2, 1]


def test_purge_rewrites_one_day(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.range(240).select("id", F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("scrape_time"))
    lifecycle.write_by_day(df, path)
    files = lambda: {d.name: sorted(f.name for f in d.glob("*.parquet")) for d in (tmp_path / "t").glob("day=*")}
    before = files()
    gone = {str(r.day): r.deleted for r in lifecycle.purge_days(spark, path, "2024-01-10 06:00:00", 7).collect()}
    after = files()
    assert gone == {"2024-01-01": 24, "2024-01-02": 24, "2024-01-03": 6} and sorted(after) == [f"day=2024-01-{d:02d}" for d in range(3, 11)]
    assert [d for d in after if after[d] != before[d]] == ["day=2024-01-03"]
    left = spark.read.parquet(path)
    assert left.count() == 240 - 54 and left.agg(F.min("scrape_time").cast("string")).first()[0] == "2024-01-03 06:00:00"
    assert lifecycle.purge_days(spark, path, "2024-01-10 06:00:00", 7).count() == 0
    assert sum(r.deleted for r in lifecycle.purge_days(spark, path, "2024-01-11 00:00:00", 7).collect()) == 18 and "day=2024-01-03" not in files()


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hint", storage.STRATEGIES)
def test_join_strategies(spark, hint):
    assert storage.STRATEGIES[hint] in plan_of(storage.joined_by(spark, str(DATA), hint))


def test_bucketed_tables_join_without_exchange(spark):
    df = storage.substrate_bucketed_join(spark, str(DATA))
    assert "SortMergeJoin" in plan_of(df) and "Exchange" not in plan_of(df)


def test_numbering_has_no_python(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"), F.lit("x").alias("other")).repartition(7)
    out = cycles.next_ids(rows, ["k"], 41)
    assert "Python" not in plan_of(out) and "ExistingRDD" not in plan_of(out)
    assert [r.id for r in out.orderBy("k").collect()] == list(range(42, 1042))
    assert cycles.next_ids(rows.limit(0), ["k"], 1).count() == 0


def test_pages_stream_goes_on_where_it_was(spark, tmp_path):
    pages.register(spark)
    rows = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    stream = lambda: spark.readStream.format("crawled_pages").options(path=str(tmp_path / "in"), columns="page_id").load()
    seen = []
    for part in (rows.where("page_id < 20"), rows.where("page_id >= 20")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for f in list((tmp_path / "in").glob("part-*.parquet")):  # offsets count row groups in order of names, so names must grow
            f.rename(tmp_path / "in" / f"{len(list((tmp_path / 'in').glob('0*.parquet'))):05d}.parquet")
        stream().writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, batch: seen.append(sorted(r.page_id for r in df.collect()))).start().awaitTermination()
    assert [k for k in seen if k] == [list(range(20)), list(range(20, rows.count()))]


def test_header_labels_that_are_no_text(spark):
    """The list that is used when the structured one is empty tells its odd shapes too."""
    import datetime
    import json

    raw = {"jobListing": {"jobDetailsData": {"listingId": 3}, "jobDetailsRawData": {"jobview": {"header": {"jobType": ["FULL_TIME", {"a": 1}]}}}}, "json_ld": {"employmentType": []}}
    df = spark.createDataFrame([("glassdoor", "run", datetime.datetime(2024, 1, 1), json.dumps(raw))], "site string, scan_run_id string, scrape_time timestamp, raw string")
    r = project.canonical(df).first()
    assert r.employment_type == "FULL_TIME" and [(w.event, w.field, w.raw) for w in r.warnings] == [("bad_value_shape", "employment_type", '{"a":1}')]


def test_side_output_reads_its_input_once(spark):
    """Both tables come from one stream: each row is in one of them."""
    counts = streams.stream_split_late(spark, str(DATA)).agg(F.sum("kept"), F.sum("late")).first()
    assert sum(counts) == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_tiles_find_what_brute_force_finds(spark, monkeypatch):
    """Blocks of few terms and parts of few rows: all pairs, and the best older row, across blocks, parts and buckets."""
    from postlake.operators import similar

    monkeypatch.setattr(similar, "BLOCK", 300)
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(80)}" for _ in range(n)] for n in (3, 12, 30)]
    rows = []
    for k in range(120):
        words = list(rng.choice(bases))
        words[rng.randrange(len(words))] = f"w{rng.randrange(80)}"
        rows.append((k, " ".join(words), rng.choice(("a", "a", "b", None)), rng.choice((None, *range(40)))))
    cosine = cosines([r[1] for r in rows])
    pairs = {(a, b): cosine(a, b) for a, _, p, _ in rows for b, _, q, _ in rows if a < b and p and p == q and cosine(a, b) >= 0.85}
    df = stored(spark.createDataFrame(rows, "id long, text string, bucket string, created_at long"))
    vectors = stored(D.weights(df))
    assert {(r.a, r.b): r.score for r in D.similar_pairs(vectors, df, 0.85).collect()} == pairs and len(pairs) > 50
    ages, both = {r[0]: r[3] for r in rows}, [(*p, s) for p, s in pairs.items()] + [(b, a, s) for (a, b), s in pairs.items()]
    for asks, least in ((None, 1), (F.col("id") % 3 == 0, 3)):
        want = {}
        for a, b, s in both:
            if a % least == 0 and None not in (ages[a], ages[b]) and ages[b] < ages[a]:
                want[a] = max(want.get(a, (0, 0)), (s, -b))
        got = {r.id: (r.score, -r.original) for r in D.similar_flags(vectors, df, 0.85, asks).collect()}
        assert got == want and got


def test_flags_do_not_list_pairs(spark):
    """Near copies of one bucket: tiles give at most a row for each row and block, here two, not its pairs."""
    from postlake.operators import similar

    text = " ".join(f"w{k}" for k in range(400))
    df = stored(spark.range(2000).select("id", F.concat(F.lit(text + " x"), F.col("id") % 50).alias("text"), F.lit("b").alias("bucket"), F.col("id").alias("created_at")))
    rows = similar.packed(D.weights(df), df)
    assert similar._compared(rows, None, 0.85, True).count() <= 4000
    assert similar.best_older(rows, 0.85).count() == 1999


def test_a_key_has_one_timer(spark):
    """Spans apart wait for one timer of their key; it tells all that are over and is set again for the rest."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.spans, self.timers = [], set()

        getListState = lambda self, *a: self
        get = lambda self: iter(self.spans)

        def put(self, spans):
            self.spans = list(spans)

        def clear(self):
            self.spans = []

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Fired:
        def __init__(self, t):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: t

    h, p = Handle(), timers.Heartbeats(10)
    p.init(h)
    list(p.handleInputRows((1,), iter([pd.DataFrame({"at": [0, 50_000, 100_000, 900_000]})]), None))
    assert len(h.spans) == 4 and h.timers == {10}
    list(p.handleInputRows((1,), iter([pd.DataFrame({"at": [5_000]})]), None))
    assert h.timers == {15}
    h.timers.remove(15)  # as Spark does with one that fires
    first = pd.concat(p.handleExpiredTimer((1,), Fired(200), Fired(15)))
    assert first["beats"].tolist() == [2, 1, 1] and h.timers == {910} and len(h.spans) == 1
    h.timers.remove(910)
    assert pd.concat(p.handleExpiredTimer((1,), Fired(1000), Fired(910)))["beats"].tolist() == [1] and not h.spans and not h.timers


def test_cooldown_joins_by_spans_of_time(spark, tmp_path):
    """On the edges of spans of time, with the time in the key of the join: a site's rows are not each compared with each."""
    rows = [(k, f"2024-01-01 00:{m:02d}:{s:02d}", "error" if k % 2 else "click") for k, (m, s) in enumerate([(4, 59), (5, 0), (5, 0), (0, 0), (10, 0), (10, 0), (10, 1), (9, 59), (15, 0), (4, 58)])]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "event_type", "1L AS site").write.parquet(f"{tmp_path}/in")
    e = jobs.read(spark, f"{tmp_path}/in")
    stream = jobs.cooled_down(e.where("event_type = 'error'").select("site", "ts", F.col("event_id").alias("s")), e.where("event_type = 'click'").select("site", "ts", F.col("event_id").alias("t")), "site", 300)
    at = {k: (lambda m, s: int(m) * 60 + int(s))(*t[14:].split(":")) for k, t, _ in rows}
    want = sorted((t, s) for t in at for s in at if t % 2 == 0 and s % 2 and 0 < at[t] - at[s] <= 300)
    assert sorted((r.t, r.s) for r in jobs.to_table(stream, shared(spark), "append").collect()) == want and len(want) > 5
    assert "_span" in stream._jdf.queryExecution().analyzed().toString()  # from the plan


def shuffled(spark, run) -> int:
    """Rows that the shuffles of run() wrote."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteRecords() for s in _listed(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))
    before = written()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return written() - before


def _listed(seq):
    return [seq.apply(k) for k in range(seq.size())]


def test_words_of_postings_are_not_shuffled(spark):
    """300 texts of 500 words of their own: 150,000 rows of words, of which a shuffle sees no more than the terms' totals, and the vectors no row a word."""
    from postlake.operators import bags

    words = F.expr("transform(sequence(1, 500), k -> concat('w', id, '_', k))")
    df = stored(spark.range(300).select("id", F.array_join(words, " ").alias("text"), F.lit("b").alias("bucket"), F.col("id").alias("created_at")))
    texts = D.bags(df, "id", "bucket", "created_at")
    assert shuffled(spark, lambda: texts.write.format("noop").mode("overwrite").save()) == 0
    terms = D.vocabulary(texts)
    assert shuffled(spark, lambda: D.similar_flags(D.vectors(texts, terms), None, 0.85).collect()) < 2_000
    odd = spark.createDataFrame([(1, "b a b"), (2, None), (3, "")], "id long, text string")
    got = {r.id: dict(zip(r.word, r.n, strict=True)) for r in bags.counted(odd, F.split("text", " "), "id").collect()}
    assert got == {1: {"a": 1, "b": 2}, 2: {}, 3: {"": 1}}


def test_words_of_languages_are_not_shuffled(spark):
    """A text's words stay in its task but for rare ones; whatever counts as frequent, texts get the same language."""
    rows = [(k, ("de", "en")[k % 2], " ".join(f"{('ich', 'the')[k % 2]}{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}" for j in range(k % 7, 400))) for k in range(200)]
    df = stored(spark.createDataFrame(rows, "id long, lang string, text string"))
    texts = stored(language.bags(df, "id", "lang"))
    own = language.each_word(texts)
    model = stored(language.profiles(own, "lang"))
    told = [{r.id: r.lang for r in language.predict(own.drop("lang"), model, "id", n).collect()} for n in (1, 100, 1 << 16)]
    assert told == [{r[0]: r[1] for r in rows}] * 3
    assert shuffled(spark, lambda: language.predict(own.drop("lang"), model, "id").collect()) < 40_000  # 80,000 words


def test_lines_and_grams_of_postings_are_not_shuffled(spark):
    """20 texts of 2,000 lines: neither the lines nor their n-grams are shuffled to a small vocabulary; a text's state does not reach the next."""
    body = "Required:\nspark\n\nnothing" + "\nplain words here" * 2_000
    texts = stored(spark.range(20).select("id", F.when(F.col("id") % 2 == 0, F.lit(body)).otherwise(F.lit("spark\nNice:\nspark")).alias("text")).coalesce(1))
    vocab = K.vocabulary(spark.createDataFrame([("spark", None)], "skill string, alias string"))
    got: list = []
    assert shuffled(spark, lambda: got.extend(K.matches(K.lines(texts), vocab).collect())) < 1_000
    assert sorted((r.id % 2, r.line, r.section) for r in got) == sorted([(0, 1, "required"), (1, 0, "other"), (1, 2, "preferred")] * 10)
