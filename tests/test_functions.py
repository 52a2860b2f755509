"""Functions and operators on literal odd inputs, hand-written sequences, and empty tables."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from postlake.functions import settings as S
from postlake.functions import text as X
from postlake.functions import tokens as T
from postlake.operators import corpus as C
from postlake.operators import cycles, ingest, listing, project, runs
from postlake.operators import dedup as D
from postlake.sources import adapter, versions
from postlake.sources.store import stored


def values(spark, fn, given, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(given)], f"k int, v {kind}")
    return [r.out for r in df.select("k", fn(F.col("v")).alias("out")).orderBy("k").collect()]


def test_vocabularies(spark):
    assert values(spark, T.salary_period, ["YEARLY", " per hour ", "fortnightly", "", None]) == ["ANNUAL", "HOURLY", None, None, None]
    assert values(spark, T.language_base, ["en", "EN", "en-US", "en_US", "fil", "zz", "english", "e", "12", "", None]) == ["en", "en", "en", "en", "fil", "zz", None, None, None, None, None]
    assert values(spark, T.salary_disclosed, ["EMPLOYER", "INDEED_ESTIMATE", "mystery", None]) == [True, False, None, None]
    kinds = [["Full-time", "Permanent"], ["Permanent", "Full-time"], ["Other"], ["FREELANCE"], ["PER_DIEM", "temp"], [], [None]]
    assert values(spark, T.employment_type, kinds, "array<string>") == ["FULL_TIME", "FULL_TIME", None, None, "TEMPORARY", None, None]
    assert values(spark, T.workplace_type, [["urn:li:fs_workplaceType:1"], ["URN:LI:FS_WORKPLACETYPE:2"], ["urn:li:fs_workplaceType:3"], ["moon"]], "array<string>") == ["ONSITE", "REMOTE", "HYBRID", None]
    assert values(spark, T.joined_labels, [[" a ", "", "b"], ["  "], []], "array<string>") == ["a; b", None, None]


def test_texts(spark):
    assert values(spark, X.sanitize_html, ['<p onclick="x">a<script>b</script><abbr>c</abbr><a href="javascript:1" title="t">d</a></p>', "a < b &amp; c", None]) == ['<p>ac<a title="t">d</a></p>', "a &lt; b &amp; c", None]
    assert values(spark, X.balanced_fragment, ['x {"a":"}"} y', '[1,{"b":"\\"]"}]z', "none", "{open", '"{" [1]', None, ""]) == ['{"a":"}"}', '[1,{"b":"\\"]"}]', None, None, None, None, None]
    assert values(spark, X.language, ["the cat and the dog", "der Hund und die Katze", "", "12", None]) == ["en", "de", None, None, None]
    deep = json.dumps({"email": "x", "t": "y" * 3000, "l": [{"cookie": 1}], "token_in": 5})
    assert values(spark, X.redacted_json, [deep, "{broken", None])[1:] == [None, None]
    assert json.loads(values(spark, X.redacted_json, [deep])[0]) == {"t": "y" * 2000 + "…[truncated]", "l": [{"cookie": "[redacted]"}], "token_in": 5}
    assert values(spark, C.company_key, ["Acme, Inc.", "ACME", "  ", None, "Über GmbH"]) == ["acme", "acme", None, None, "über"]


def test_payload_shapes(spark):
    from postlake.functions import payload as P

    given = ['{"x":true}', '{"x":1.5}', '{"x":"7"}', '{"x":[1]}', '{"x":{}}', '{"x":null}', "{}", "broken"]
    df = spark.createDataFrame(list(enumerate(given)), "k int, raw string").withColumn("v", F.try_parse_json("raw"))
    rows = df.select("k", P.text("v", "$.x").alias("t"), P.whole("v", "$.x").alias("w"), P.flag("v", "$.x").alias("f"), P.number("v", "$.x").alias("n")).orderBy("k").collect()
    assert [r.t for r in rows] == ["True", "1.5", "7", None, None, None, None, None]
    assert [r.w for r in rows] == [None, 1, 7, None, None, None, None, None]
    assert [r.f for r in rows] == [True] + [None] * 7 and [r.n for r in rows] == [None, 1.5] + [None] * 6
    odd = spark.createDataFrame([('["a",1,{"name":"b"},{"z":1},null,true,[2]]',)], "raw string").withColumn("v", F.try_parse_json("raw"))
    r = odd.select(P.values("v").alias("v"), P.odd_values("v").alias("o")).first()
    assert r.v == ["a", None, "b", None, None, None, None] and r.o == ["1", '{"z":1}', "true", "[2]"]


PROBES = ["unknown", "expired", "live", "expired", "captcha", "rate_limited", "captcha", "live", "captcha", "live", "rate_limited", "unknown"]


@pytest.mark.parametrize(("n", "want"), [(2, ("expired", 1, False, 0, 1)), (4, ("expired", 1, True, 1, 1)), (7, ("captcha", 3, True, 1, 2)), (8, ("live", 0, False, 1, 2)), (9, ("captcha", 1, True, 2, 2)), (12, ("unknown", 0, False, 2, 4))])
def test_session_rule(spark, n, want):
    """Failures reset at live, a notice only right after live, back-off only at rate_limited, never reset."""
    df = spark.createDataFrame([("s", k, p) for k, p in enumerate(PROBES[:n])], "site string, k int, p string").repartition(3)
    r = runs.session_fold(df, "site", ["k"], F.col("p")).first()
    assert (r.status, r.failures, r.notified, r.notices, r.backoff) == want


def test_session_backoff_is_bounded(spark):
    df = spark.createDataFrame([("s", k, "rate_limited") for k in range(20)], "site string, k int, p string")
    assert runs.session_fold(df, "site", ["k"], F.col("p")).first().backoff == 64


def test_stream_session_rule_over_batches():
    """State carried over batches gives what one batch gives."""
    import pandas as pd

    from postlake.streaming import jobs

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rows = pd.DataFrame({"ts": range(len(PROBES)), "event_id": range(len(PROBES)), "status": PROBES})
    for size in (1, 2, 5, 12):
        state = State()
        for a in range(0, len(rows), size):
            out = next(jobs._fold((1,), iter([rows[a : a + size].sample(frac=1, random_state=a)]), state))
        assert out.iloc[0].tolist() == [1, "unknown", 0, False, 2, 4]


PARTS = ("canonical", "payloads", "linkedin_jobs", "indeed_jobs", "glassdoor_jobs")


def test_ingest_across_batches(spark, tmp_path):
    """A posting that an earlier batch has adds nothing, in any part; a batch that is run again changes nothing."""
    path = f"file://{tmp_path}/out"
    sent = stored(adapter.envelopes(spark, "/root/testdata/sf0.001"))
    old, every = ingest.route(sent.where("doc_id < 100")), ingest.route(sent)
    count = lambda: {t: versions.read(spark, path, t).count() for t in PARTS}
    assert versions.read(spark, path, "canonical") is None
    first = ingest.write_batch(old, path, 7)
    before = count()
    assert before["canonical"] == before["payloads"] == sum(before[f"{s}_jobs"] for s in ("linkedin", "indeed", "glassdoor")) > 0
    assert ingest.write_batch(old, path, 7) == first and count() == before
    ingest.write_batch(old, path, 8)
    assert count() == before and versions.current(spark, path).number == 2
    ingest.write_batch(every, path, 9)
    whole = count()
    assert whole["canonical"] == ingest.first_wins(ingest.accepted(every).select("site", "job_url", "arrival"), ["site", "job_url"], "arrival").count() > before["canonical"]
    rows = versions.read(spark, path, "canonical")
    assert rows.select("id").distinct().count() == whole["canonical"] and versions.vacuum(spark, path) == 0


def test_ingest_dies_between_any_two_steps(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/out"
    routed = ingest.route(stored(adapter.envelopes(spark, "/root/testdata/sf0.001").where("doc_id < 40")))
    ingest.write_batch(routed.where("doc_id < 20"), path, 1)
    ids = lambda: sorted(r.id for r in versions.read(spark, path, "canonical").select("id").collect())
    before = ids()

    def fails(*_, **__):
        raise ValueError("no")

    for place, name in ((project, "flat_rows"), (project, "canonical_of"), (project, "complete"), (ingest, "key_table"), (versions, "publish")):
        with monkeypatch.context() as m:
            m.setattr(place, name, fails)
            with pytest.raises(ValueError):
                ingest.write_batch(routed, path, 2)
        assert ids() == before
    publish, met = versions.publish, []

    def late(spark, path, base, batch, folder):
        if not met:  # another writer takes the version first
            met.append(publish(spark, path, base, "other", base.batches["1"]))
        return publish(spark, path, base, batch, folder)

    monkeypatch.setattr(versions, "publish", late)
    ingest.write_batch(routed, path, 2)
    monkeypatch.undo()
    assert len(met) == 1 and versions.current(spark, path).number == 3
    assert versions.vacuum(spark, path) >= 5 and len(set(ids())) == ingest.first_wins(ingest.accepted(routed).select("site", "job_url", "arrival"), ["site", "job_url"], "arrival").count()


def test_stored_keys_are_not_shuffled(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    ingest.write_batch(ingest.route(stored(adapter.envelopes(spark, "/root/testdata/sf0.001").where("doc_id < 20"))), path, 1)
    rows = spark.createDataFrame([("indeed", "u")], "site string, job_url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ingest.unstored(rows, path, versions.current(spark, path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_settings(spark, tmp_path):
    path = f"file://{tmp_path}/config.json"
    assert S.read_config(spark, path) == {} and S.read_profile(spark, path) == S.EMPTY_PROFILE
    assert S.update_config(spark, path, {"a": 1, "fit_score_req_weight": 2}) == {"a": 1}
    assert S.update_config(spark, path, {"b": [1], "a": None}) == {"a": None, "b": [1]} == S.read_config(spark, path)
    (tmp_path / "bad").write_text("{broken")
    with pytest.raises(ValueError):
        S.read_config(spark, f"file://{tmp_path}/bad")
    assert S.read_profile(spark, f"file://{tmp_path}/bad") == S.EMPTY_PROFILE


def test_progress_sink_leaves_the_trace_out(spark, tmp_path):
    spark.createDataFrame([(1, "running", "x" * 99)], "id int, status string, debug_log string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, status string, debug_log string").json(f"{tmp_path}/in")
    S.publish_updates(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").drop("batch").columns == ["id", "status"]


def test_empty_tables(spark):
    none = adapter.payloads(spark, "/root/testdata/sf0.001").limit(0)
    canon = project.canonical(none)
    assert canon.count() == 0 and project.warning_counts(canon).count() == 0
    rows = project.complete(canon)
    assert listing.page(rows.where(listing.conditions())).count() == 0 and listing.facets(rows).count() == 0
    texts = spark.createDataFrame([], "id long, text string, bucket string, created_at long")
    assert D.oldest_of_equal(texts, F.col("text")).count() == 0
    assert C.similar_to_corpus(texts, texts, 85).count() == 0
    events = spark.createDataFrame([], "k long, at long, status string, error_message string")
    assert cycles.merged_updates(events, "k", ["at"]).count() == 0 and runs.session_fold(events, "k", ["at"], F.col("status")).count() == 0


def test_canonical_golden_row(spark):
    """A payload with labels that are no text, a date that can't be read, and a conflict."""
    data = {"jobPostingUrl": "u", "jobPostingId": 1, "workRemoteAllowed": False, "workplaceTypesResolutionResults": {"a": "Remote", "b": {"odd": 1}}, "listedAt": 5, "formattedEmploymentStatus": "Other"}
    raws = [("linkedin", {"data": data}), ("glassdoor", {"jobListing": {"jobDetailsData": {"listingId": 3}}, "json_ld": {"datePosted": "soon", "employmentType": ["FULL_TIME", 7]}})]
    df = spark.createDataFrame([(s, "run", datetime.datetime(2024, 1, 1), json.dumps(r)) for s, r in raws], "site string, scan_run_id string, scrape_time timestamp, raw string")
    got = {r.source_site: r for r in project.canonical(df).collect()}
    events = {s: sorted((w.event, w.field, w.raw) for w in r.warnings) for s, r in got.items()}
    assert (got["linkedin"].workplace_type, got["linkedin"].remote, got["glassdoor"].employment_type, got["glassdoor"].posted_at) == ("REMOTE", False, "FULL_TIME", None)
    assert events["linkedin"] == [("bad_posted_at", "listed_at", "5"), ("bad_value_shape", "workplace_type", '{"odd":1}'), ("workplace_remote_conflict", "workplace_type", "REMOTE")]
    assert events["glassdoor"] == [("bad_value_shape", "employment_type", "7"), ("ingest_iso_date_parse_failed", "date_posted", "soon")]


def test_sanitize_takes_arrow_arrays():
    """No pandas copy of a batch: Arrow in, Arrow out, also of an empty one."""
    import pyarrow as pa

    run = X.sanitize_html.func
    assert run(pa.array(["<p>a</p><script>b</script>", None])).equals(pa.array(["<p>a</p>", None]))
    assert run(pa.array([], pa.string())).equals(pa.array([], pa.string()))
