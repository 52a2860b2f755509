"""Quality scores, source mixing, pieces and the pipeline."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from support import DATA

from postlake.llm import mixing, pieces, quality


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1.0
    pos = np.asarray(label) == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum())


def test_quality_held_out(spark):
    d = str(DATA).replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in got.items())
    held = [(got[k].score, y) for k, y in labels.items() if k in got and got[k].held_out]
    assert auc(*map(np.array, zip(*held, strict=True))) > 0.85
    kept = quality.keep_good(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(k for k, r in got.items() if r.predicted)


def test_quality_odd(spark, odd, none, clashing):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(odd[1], labels).count() == len(odd[0])
    assert quality.score_quality(clashing, labels).count() == len(odd[0])
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd[1], labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(clashing, labels).columns == clashing.columns


def test_quality_is_the_same_however_partitioned(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    one, many = (sorted((r.doc_id, r.score) for r in quality.score_quality(docs.repartition(n, "text"), labels).collect()) for n in (1, 7))
    assert [r[0] for r in one] == [r[0] for r in many] and max(abs(a[1] - b[1]) for a, b in zip(one, many, strict=True)) < 1e-9


def test_quality_repeated_ids(spark):
    """Two texts of one id: any order of rows gives the same scores."""
    rows = [(k // 2, ("good plain words here " if k % 4 < 2 else "BUY NOW !!! ") * (k % 5 + 1)) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    score = lambda own: sorted((r.doc_id, r.score) for r in quality.score_quality(spark.createDataFrame(own, "doc_id long, text string").repartition(3), labels).collect())
    assert np.allclose(score(rows), score(rows[::-1]), atol=1e-9)


def targets(rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(2.0 * size[s] for s in full)
        out = {s: 2.0 * size[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if out[s] > 2 * size[s]}
        if not over:
            return size, out
        full |= over


def test_mixing(both):
    for rows, df in both:
        size, target = targets(rows)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        taken = dict.fromkeys(size, 0)
        for r in got:
            assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and r.taken in (0, r.size, 2 * r.size)
            taken[r.source] += r.taken
        for s in size:
            most = max(r.size for r in got if r.source == s)
            assert abs(taken[s] - target[s]) <= most / 2 + 1e-6
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df).collect()))


def test_mixing_tree(spark):
    rows = [(k, "w " * (k % 17 + 1), "en", "ab"[k % 2], 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = mixing.mix(df, group=8).collect()
    _, target = targets(rows)
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 9


def test_mixing_many_rows_of_one_id(spark):
    """A third of all rows have no id and one size: they are dealt to groups all the same."""
    rows = [(None if k % 3 else k, "w w w" if k % 3 else "w " * (k % 9 + 1), "en", "a" if k % 5 else "b", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = mixing.mix(df, group=16).collect()
    _, target = targets(rows)
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 5
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_mixed_rows(docs, none, clashing):
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, n in copies.items() for _ in range(n))
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    assert mixing.mixed_rows(clashing).columns == clashing.columns and {r._uid for r in mixing.mixed_rows(clashing).collect()} == {1}


def brute_path(word, table):
    """Viterbi's path, every start tried for every end."""
    best = [(0.0, [])] + [None] * len(word)
    for b in range(1, len(word) + 1):
        for a in range(b):
            if best[a] is None:
                continue
            own = table.pieces.get(word[a:b])
            if own is None and b - a > 1:
                continue
            ids = [own[0]] if own else [table.byte_ids[c] for c in word[a].encode()]
            now = best[a][0] + (own[1] if own else table.unknown)
            if best[b] is None or now > best[b][0]:
                best[b] = (now, best[a][1] + ids)
    return best[-1][1]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_pieces_are_the_librarys(spark, both):
    for rows, df in both:
        got = pieces.decode(pieces.encode(df)).collect()
        text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
        assert len(got) == len(rows)
        own = [r for r in got if r.doc_id in text]
        assert [list(r.ids) for r in own] == library().encode([text[r.doc_id] for r in own])
        assert all(r.text == text[r.doc_id].replace("▁", " ") for r in own)


def test_pieces_odd_texts(spark, monkeypatch):
    """Runs of spaces and marks, long runs that nothing cuts, many chunks, few frequent words; equal to the library's ids."""
    monkeypatch.setattr(pieces, "LONGEST", 40)
    texts = [" ", "  ", " " * 50, "a  b   c", " lead", "trail ", "\n\n a\tb", "\u2581x\u2581\u2581y", "x" * 1000, "ab" * 500, "e" * 39 + " " + "e" * 41, "Donaudampfschifffahrtsgesellschaft" * 9, "漢字かな交じり文" * 30, "\U0001f600" * 9, "0123456789abcdef" * 20, "\u00a0\u200b", "é" * 100]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for frequent, chunk in ((1, 100), (20, 1000), (1 << 18, 1 << 23)):
        monkeypatch.setattr(pieces, "CHUNK", chunk)
        monkeypatch.setattr(pieces.frequent_words, "__defaults__", (frequent,))
        got = {r.doc_id: r for r in pieces.decode(pieces.encode(df)).collect()}
        for k, want in enumerate(library().encode(texts)):
            assert list(got[k].ids) == want, texts[k]
            assert got[k].text == texts[k].replace("▁", " ")


def test_pieces_of_a_unigram_table(spark):
    """The fold is Viterbi's where scores are log-probabilities."""
    rng = np.random.default_rng(3)
    table = {c: (256 + k, -9.0 - float(rng.random())) for k, c in enumerate("abcd ")}
    while len(table) < 60:
        p = "".join(rng.choice(list("abcd"), int(rng.integers(2, 7))))
        table.setdefault(p, (256 + len(table), -float(rng.random()) * 12))
    own = pieces.Pieces.of(table, [bytes([k]) for k in range(256)] + [p.encode() for p in table], list(range(256)), False)
    words = ["a", "abcd", "dcbaabcd", "abxcd", "é", "aaaa", *("".join(rng.choice(list("abcd"), 12)) for _ in range(40))]
    got = {r.word: list(r.ids) for r in pieces.encode_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), own).collect()}
    for w in words:
        assert got[w] == brute_path(w, own) == pieces.ids_of(w, own)


def test_pieces_empty(none, clashing, odd):
    assert pieces.decode(pieces.encode(none)).count() == 0
    assert pieces.encode(clashing).count() == len(odd[0])


def test_pieces_read_texts_once(spark, docs, monkeypatch):
    """The plan that returns rows has no scan of texts, and the rows of chunks meet their words without a shuffle; bulk copies are split."""
    from postlake.llm import common

    plan = pieces.round_trip(docs)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan
    of_chunks = plan[plan.rindex("Sort [chunk#") :]
    assert "places" in of_chunks and "Bucketed: true" in of_chunks and "Exchange" not in of_chunks
    monkeypatch.setattr(pieces, "CHUNK", 1000)
    texts = ["The same text. " * 20, None, ""]
    df = spark.createDataFrame([(1, texts[k % 3]) for k in range(60)], "doc_id long, text string").coalesce(2)
    got = pieces.decode(pieces.encode(df)).collect()
    path = common._written[-1]
    name = path.rpartition("/")[2]
    assert spark.table(name).count() > 4 and spark.table(name).select("chunk").distinct().count() == spark.table(name).count()
    want = {t or "": library().encode(t or "") for t in texts}
    assert len(got) == 60 and all(list(r.ids) == want[r.text] for r in got)
    common.remove(spark, path)
    assert not spark.catalog.tableExists(name)
    nothing = pieces.encode(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(map(repr, nothing)) == ["Row(doc_id=1, ids=[])", "Row(doc_id=None, ids=[])"]


def test_words_are_cut_where_no_piece_holds_both():
    table = pieces.Pieces.load()
    texts = ["a  b, c1.", "", "\n\n x\u2581y", "é漢字\U0001f600 end", "x", "\u00a0 1 2", "Straße 10%"]
    words, sizes = pieces.Cutter(table.joined)(texts)
    words = words.to_pylist()
    for text, n in zip(texts, sizes.tolist(), strict=True):
        own, words = words[:n], words[n:]
        whole = (" " + text).replace("\u2581", " ") if text else ""
        want = "".join("|" * (k > 0 and whole[k - 1 : k + 1] not in table.joined) + c for k, c in enumerate(whole))
        assert "|".join(own) == want
    assert words == []


def test_pipeline(spark, docs):
    """Each stage against what its operator says of the same input."""
    import corpus_pipeline as c
    from postlake.llm import exact_dedup, simhash
    from postlake.llm.common import materialize

    at, seen = docs, {}
    for name, f in c.STAGES:
        seen[name] = at
        out = f(spark, at, str(DATA))
        assert name == c.STAGES[-1][0] or out.columns == docs.columns
        at = materialize(out)
        seen[name] = (seen[name], at)
    before, after = seen["exact_dedup"]
    assert after.count() == before.select("text").distinct().count() == exact_dedup.label_copies(before).where("kept").count()
    before, after = seen["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.component_id for r in simhash.label_near_copies(before).select("component_id").distinct().collect())
    before, after = seen["sentencepiece"]
    texts = {r.doc_id: r.text for r in before.collect()}
    import hashlib

    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].replace("▁", " ").encode()).hexdigest() for r in after.collect()) and after.count() == before.count()
