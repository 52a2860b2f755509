"""Tiles: a vector is shuffled once whatever the number of blocks, and bounds by groups of terms leave out no similar pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_mechanisms import cosines, shuffled

from postlake.operators import dedup as D
from postlake.operators import similar
from postlake.sources.store import stored


def postings(n: int, seed: int = 3):
    """Texts of 3 to 300 words, a third of them near copies of others of the same bucket."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        words = [f"w{int(2000 * rng.random() ** 2)}" for _ in range(rng.choice((3, 20, 60, 120, 300)))]
        if k > 10 and k % 3 == 0:
            words = rows[rng.randrange(k)][1].split()
            for _ in range(rng.choice((0, 1, len(words) // 8, len(words) // 4))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(2000)}"
        rows.append((k, " ".join(words), "small" if k % 10 == 0 else "large", rng.randrange(90)))
    return rows


@pytest.mark.parametrize("readable", [True, False])
def test_bounds_leave_out_no_similar_pair(spark, monkeypatch, readable):
    """Parts and blocks of few rows, so that all steps are taken; shared folders that Arrow can and can't read."""
    monkeypatch.setattr(similar, "PART", 64)
    if not readable:
        monkeypatch.setattr(similar, "arrow_uri", lambda *_: None)
    rows = postings(400)
    cosine, age = cosines([r[1] for r in rows]), {r[0]: r[3] for r in rows}
    pairs = {(a, b): s for a, _, p, _ in rows for b, _, q, _ in rows if a < b and p == q and (s := cosine(a, b)) >= 0.85}
    df = stored(spark.createDataFrame(rows, "id long, text string, bucket string, created_at long"))
    texts = stored(D.bags(df, "id", "bucket", "created_at"))
    terms = D.vocabulary(texts)
    vectors, counts = D.vectors(texts, terms), D.counts(texts, terms)
    want: dict = {}
    for (a, b), s in pairs.items():
        for one, two in ((a, b), (b, a)):
            if age[two] < age[one]:
                want[one] = max(want.get(one, (0, 0)), (s, -two))
    for block in (1 << 20, 5000):
        monkeypatch.setattr(similar, "BLOCK", block)
        assert {(r.a, r.b): r.score for r in D.similar_pairs(vectors, None, 0.85).collect()} == pytest.approx(pairs, abs=1.1e-6) and len(pairs) > 50
        got = {r.id: (r.score, -r.original) for r in D.similar_flags(counts, None, 0.85).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}


def test_a_vector_is_shuffled_once(spark, monkeypatch):
    """1,000 rows of one bucket in some 80 blocks: their vectors are not shuffled to each of its tiles."""
    monkeypatch.setattr(similar, "BLOCK", 500)
    df = stored(spark.range(1000).select("id", F.expr("array_join(transform(sequence(1, 40), k -> concat('w', (id * 7919 + k * 104729) % 3001)), ' ')").alias("text"), F.lit("b").alias("bucket"), F.col("id").alias("created_at")))
    texts = stored(D.bags(df, "id", "bucket", "created_at"))
    vectors = D.vectors(texts, D.vocabulary(texts))
    assert shuffled(spark, lambda: D.similar_flags(vectors, None, 0.85).collect()) < 20_000  # 80,000 of vectors alone, were each sent to each block


def test_texts_are_not_shuffled_to_leave_out_equal_ones(spark, monkeypatch):
    """Few ids are sent to the tasks; more are joined, with the same rows. A row without an id is left out."""
    df = stored(spark.createDataFrame([(k if k != 7 else None, f"text {k}") for k in range(300)], "id long, text string"))
    gone = stored(df.where("id % 3 = 0").select("id"))
    got: list = []
    assert shuffled(spark, lambda: got.extend(D.left_out(df, gone).collect())) < 100
    monkeypatch.setattr(D, "SENT", 10)
    assert sorted(got) == sorted(D.left_out(df, gone).collect()) and sorted(r.id for r in got) == [k for k in range(300) if k % 3 and k != 7]
