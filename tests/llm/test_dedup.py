"""Exact, SimHash, embedding and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import DATA

from postlake.llm import exact_dedup, queries, simhash, substring_dedup, vector_dedup


def keyed(rows):
    return sorted(rows, key=repr)


def classes(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(a) for a in range(n)]


def least(values):
    return min((v for v in values if v is not None), default=None)


def test_exact(both):
    for rows, df in both:
        groups: dict[str, list] = {}
        for r in rows:
            groups.setdefault(r[1] or "", []).append(r[0])
        most = lambda ids: max((i for i in ids if i is not None), default=None)
        want = keyed((r[0], most(g := groups[r[1] or ""]), len(g), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
        got = exact_dedup.label_copies(df).collect()
        assert keyed((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
        stay = exact_dedup.keep_one(df)
        assert stay.columns == df.columns and keyed((r.doc_id, r.text or "") for r in stay.collect()) == keyed((most(g), t) for t, g in groups.items())


def test_exact_colliding_digests(both):
    rows, df = both[0]
    got = exact_dedup.label_copies(df, digest=lambda b: "x").collect()
    assert sum(r.kept for r in got) == len({r[1] or "" for r in rows})


def test_exact_sql(spark, duck):
    from support import compare

    compare(queries.op3_exact_dedup(spark, str(DATA)), duck, queries.ORACLE_SQL["op3_exact_dedup"])


def test_substring_sql(spark, duck):
    from support import compare

    compare(queries.op10_substring_dedup(spark, str(DATA)), duck, queries.ORACLE_SQL["op10_substring_dedup"])


def prints(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(both):
    for rows, df in both:
        fp = [prints(r[1]) for r in rows]
        linked = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4]
        of = classes(len(rows), linked)
        low = {c: least(r[0] for r, k in zip(rows, of, strict=True) if k == c) for c in of}
        want = keyed((r[0], f"{f:016x}", low[c]) for r, f, c in zip(rows, fp, of, strict=True))
        assert keyed(map(tuple, simhash.label_near_copies(df).collect())) == want


def test_simhash_keeps_one_of_each(docs):
    stay = simhash.keep_one(docs)
    labels = simhash.label_near_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted({r.component_id for r in labels.collect()})


@pytest.mark.parametrize("n", [30, 6000])
def test_tiled_links(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)) for _ in range(2)]))
    pairs = [(a, b) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps[:a]) <= 4)]
    assert (simhash.block_forest(fps, 4) == np.array([min(np.flatnonzero(np.array(c) == k)) for c in [classes(len(fps), pairs)] for k in c])).all() if n < 100 else len(set(simhash.block_forest(fps, 4))) == len(set(classes(len(fps), pairs)))


def test_short_blocks():
    rng = np.random.default_rng(5)
    for n in (1, 31, 500, 3000):
        fps = rng.integers(0, 1 << 12, n, dtype=np.uint64)  # few bits: many near pairs and equal counts
        block = np.sort(rng.integers(0, max(1, n // 40), n))
        order = np.lexsort((np.bitwise_count(fps), block))
        block, fps = block[order], fps[order]
        pairs = [(a, b) for a in range(n) for b in np.flatnonzero((np.bitwise_count(fps[a] ^ fps[:a]) <= 2) & (block[:a] == block[a]))]
        lab, of = simhash.short_blocks(block, fps, 2), classes(n, pairs)
        assert len(set(lab)) == len(set(of)) == len(set(zip(lab, of, strict=True)))


@pytest.fixture
def files(spark, docs, tmp_path):
    """The documents in 24 files; how Spark packs them depends on the cores that are there when it plans."""
    docs.repartition(24).write.parquet(f"{tmp_path}/documents")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
    yield spark.read.parquet(f"{tmp_path}/documents")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_rows_stay_the_same_when_cores_change(spark, docs, files):
    from postlake.llm import mixing

    near, mixed, exact = simhash.keep_one(files), mixing.mixed_rows(files), exact_dedup.keep_one(files)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(near) == ids(simhash.label_near_copies(docs).select(F.col("component_id").alias("doc_id")).distinct())
    assert ids(mixed) == sorted(r.doc_id for r in mixing.mix(docs).collect() for _ in range(r.copies))
    assert ids(exact) == ids(exact_dedup.label_copies(docs).where("kept"))


def test_vectors(spark):
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [tuple(r) for r in vectors.collect()]
    v, nan = rows[0][1], float("nan")
    rows += [(9000, v, rows[0][2]), (9001, v, rows[0][2]), (9002, v, None), (9003, None, 1), (9004, [], 1), (9005, [0.0] * 64, 1), (9006, [nan] * 64, 1), (9007, [None] + v[1:], 1), (9008, [math.inf] * 64, 1), (9009, v[:32], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(c is not None and math.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if k else None for r, k in zip(rows, ok, strict=True)]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    of, n = classes(len(rows), linked), [0] * len(rows)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    low = {c: min(r[0] for r, k in zip(rows, of, strict=True) if k == c) for c in of}
    want = {r[0]: (r[0], k, low[c], r[0] == low[c]) for r, k, c in zip(rows, n, of, strict=True)}
    got = {r.vec_id: tuple(r) for r in vector_dedup.label_near_vectors(df, tile=16).collect()}
    assert set(got) == set(want)
    assert sum(g[1] for g in got.values()) >= 0.99 * sum(n) and sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
    assert all(got[k] == want[k] for k in range(9002, 9010))
    assert vector_dedup.label_near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "cosine", "groups"), [(20_000, 0.0, 1), (20_000, 0.9, 1), (20_000, 0.9, 20)])
def test_vectors_clustered_label(spark, n, cosine, groups):
    """One label whose vectors share a direction; queries with one planted partner each, compared with all in blocks."""
    x, queries_ = clustered(n, cosine, groups)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit[queries_] @ unit.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in vector_dedup.label_near_vectors(df).collect()}
    assert want.sum() >= len(queries_) and sum(got[k] for k in queries_) >= 0.93 * want.sum()
    assert all(got[k] <= w for k, w in zip(queries_, want, strict=True))


def clustered(n, cosine, groups, pairs=500, dims=64):
    """n vectors with median cosine near the given one in each of some groups; the last pairs ones are at 0.982 of the first."""
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centres = unit(rng.normal(size=(groups, dims)))
    x = unit(np.sqrt(cosine) * centres[rng.integers(0, groups, n)] + np.sqrt(1 - cosine) * unit(rng.normal(size=(n, dims))))
    a, u = x[:pairs], rng.normal(size=(pairs, dims))
    u = unit(u - (u * a).sum(1, keepdims=True) * a)
    x[n - pairs :] = 0.982 * a + np.sqrt(1 - 0.982**2) * u
    return x.astype(np.float32), list(range(pairs))


def brute_removed(rows, length=50):
    first: dict[tuple, int] = {}
    texts = [(r[1] or "").encode().split() for r in rows]
    ids = [r[0] if r[0] is not None else 1 << 62 for r in rows]
    for i, w in zip(ids, texts, strict=True):
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for r, i, w in zip(rows, ids, texts, strict=True):
        drop = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                drop.update(range(k, k + length))
        out.append((r[0], len(w), len(drop), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in drop)).hexdigest()))
    return keyed(out)


def test_substrings(both):
    for rows, df in both:
        assert keyed(map(tuple, substring_dedup.digests(substring_dedup.remove_repeats(df)).collect())) == brute_removed(rows)


def test_substrings_partial_overlaps(spark):
    rng = np.random.default_rng(3)
    pool = [f"w{k}" for k in rng.integers(0, 400, 600)]
    rows = [(k, " ".join([f"u{k}"] * int(rng.integers(0, 9)) + pool[(a := int(rng.integers(0, 500))) : a + int(rng.integers(30, 200))] + ["the"] * int(rng.integers(0, 120))), "en", "s", 1) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert keyed(map(tuple, substring_dedup.digests(substring_dedup.remove_repeats(df)).collect())) == brute_removed(rows)


def test_empty_and_clashing(none, clashing, odd):
    for f in (exact_dedup.label_copies, simhash.label_near_copies, substring_dedup.remove_repeats):
        assert f(none).count() == 0
        assert f(clashing).count() == len(odd[0])
    for f in (exact_dedup.keep_one, simhash.keep_one):
        assert f(none).count() == 0
        assert f(clashing).columns == clashing.columns and {r._uid for r in f(clashing).collect()} == {1}


def test_substring_rows_of_one_id(spark):
    """Very many rows of one id and text are worked on once."""
    many = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(" ".join(f"w{k}" for k in range(2_000))).alias("text"))
    first = spark.createDataFrame([(3, "new " + " ".join(f"w{k}" for k in range(500, 600)))], "doc_id long, text string")
    rows = substring_dedup.remove_repeats(many.unionByName(first)).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, rows)) == [(3, 0, 1), (7, 100, 10_000)]


def test_substring_colliding_hashes(spark):
    """Two texts of null id with the same Spark hash, as 32-bit keys would have merged them."""
    shared = " ".join(f"w{k}" for k in range(60))
    texts = spark.range(120_000).select(F.concat(F.lit(shared + " a"), "id").alias("a"), F.concat_ws(" ", *[F.concat(F.lit(f"p{j}q"), "id") for j in range(61)]).alias("b"))
    one = texts.select(F.hash("a").alias("h"), "a").join(texts.select(F.hash("b").alias("h"), "b"), "h").select("a", "b").first()
    rows = [(1, shared), (None, one["a"]), (None, one["b"])]
    got = {r.doc_id if r.doc_id else r.kept[:1]: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, "a": 60, "p": 0}
