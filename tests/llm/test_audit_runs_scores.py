"""Filter audit, periodic runs and context-tree weighting against brute force."""

from __future__ import annotations

import binascii
import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import DATA, compare

from postlake.llm import ctw, filter_audit, periodic, queries


def keyed(rows):
    return sorted(rows, key=repr)


def hexed(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


# periodic runs


def runs_by_hand(words, power=4, least=6):
    """By the definition: for each period the stretches where words that far apart are equal; the smallest period of a stretch."""
    found = {}
    for q in range(1, len(words) // power + 1):
        k = 0
        while k < len(words) - q:
            e = k
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            if e - k + q >= max(least, power * q):
                found.setdefault((k, e - k + q), q)
            k = max(e, k + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(400):
        group = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.randint(1, 3)
            words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 8)
                words = [words[min(i, a + (i - a) % p)] if i >= a else words[i] for i in range(n)]
            group.append(words)
        assert periodic.find_runs(group) == [runs_by_hand(w) for w in group]
        assert periodic.find_runs(group, 2, 2) == [runs_by_hand(w, 2, 2) for w in group]


def test_runs_of_long_words():
    n = 30_000
    assert periodic.find_runs([[b"a"] * n]) == [[(0, n, 1)]]
    assert periodic.find_runs([[b"a", b"b"] * n]) == [[(0, 2 * n, 2)]]
    block = [b"w%d" % k for k in range(5_000)]
    assert periodic.find_runs([[b"x", *block * 5]]) == [[(1, 25_000, 5_000)]]


def periodic_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h = binascii.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hexed("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), hexed(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11(spark, both):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    for rows, df in both:
        for group_words in (50, 1 << 17):
            got = periodic.digests(periodic.periodic_runs(periodic.planted(df), group_words=group_words))
            small = [r if len(r[1] or "") < 15_000 else (r[0], None) for r in rows]
            want = {r[:2]: periodic_by_hand(*r[:2]) for r in small}
            got = [tuple(r[c] for c in names) for r in got.collect()]
            assert len(got) == len(rows)
            skipped = {r[0] for r in rows if len(r[1] or "") >= 15_000}
            assert keyed(r for r in got if r[0] not in skipped) == keyed(want[r[:2]] for r in small if r[0] not in skipped)
    assert queries.op11_periodic_runs(spark, str(DATA)).where("n_runs > 0").count() > 0


# context-tree weighting


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def ctw_by_hand(rows, depth):
    """(score, base score, tokens known) of each (text, learnt from or not), by recursion over contexts."""
    bodies = [" ".join((t or "").lower().split()).encode() + b"\n" if (t or "").strip() else b"\n" for t, _ in rows]
    counts = defaultdict(lambda: [0, 0])

    def places(body):
        padded = b"\n" * depth + body
        for k, byte in enumerate(body):
            before = padded[k : k + depth][::-1]  # the latest first
            for b in range(8):
                yield before, (1 << b) | byte >> (8 - b), byte >> (7 - b) & 1

    for body, (_, learn) in zip(bodies, rows, strict=True):
        for before, decision, bit in places(body) if learn else ():
            for d in range(depth + 1):
                counts[before[:d], decision][bit] += 1
    children = defaultdict(set)
    for before, decision in list(counts):
        if before:
            children[before[:-1], decision].add((before, decision))
    weighted = {}
    for node in sorted(counts, key=lambda n: -len(n[0])):
        own = kt(*counts[node])
        below = sum(weighted[c] for c in children[node])
        weighted[node] = own if len(node[0]) == depth else math.log(0.5) + max(own, below) + math.log1p(math.exp(min(own, below) - max(own, below)))

    def probability(before, decision, d, bit):
        node = before[:d], decision
        if node not in counts:
            return 0.5
        n = counts[node]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        stay = math.exp(math.log(0.5) + kt(*n) - weighted[node])
        return stay * own + (1 - stay) * probability(before, decision, d + 1, bit)

    seen = Counter(w for body, (_, learn) in zip(bodies, rows, strict=True) if learn for w in (*body.split(), b"\n"))
    under = math.log10(sum(seen.values()) + 0.1 * (len(seen) + 1))
    out = []
    for body in bodies:
        score = sum(math.log10(probability(before, decision, 0, bit)) for before, decision, bit in places(body))
        own = [seen[w] for w in (*body.split(), b"\n")]
        out.append((score, sum(math.log10(c + 0.1) - under for c in own), len(own), sum(c > 0 for c in own), sum(seen.values())))
    return out


@pytest.mark.parametrize("depth,chunk_bytes", [(3, 1 << 25), (1, 2000), (4, 2000)])
def test_op12(odd, depth, chunk_bytes):
    rows = [r for r in odd[0] if len(r[1] or "") < 3000]
    df = odd[1].where("text IS NULL OR length(text) < 3000")
    learn = [r[0] is None or binascii.crc32(str(r[0]).encode()) % 10 != 0 for r in rows]
    assert 0 < sum(learn) < len(rows)
    want = [(r[0], not y, *x) for r, y, x in zip(rows, learn, ctw_by_hand([(r[1], y) for r, y in zip(rows, learn, strict=True)], depth), strict=True)]
    got = ctw.score_texts(df, depth=depth, chunk_bytes=chunk_bytes).collect()
    got = [(r.doc_id, r.held_out, r.score, r.base_score, r.n_tokens, r.n_known, r.train_tokens) for r in got]
    plain = lambda rows: keyed((r[0], r[1], round(r[2], 6), round(r[3], 6), *r[4:]) for r in rows)
    assert plain(got) == plain(want)


def test_op12_learns(spark):
    got = queries.op12_lm_scoring(spark, str(DATA)).cache()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got.count() == docs.count() and got.where("held_out").count() > 0
    bits = got.where("held_out").agg(F.sum("score") / F.sum("n_bytes")).first()[0] / -math.log10(2)
    junk = docs.where("doc_id < 50").select("doc_id", F.expr("reverse(sha2(text, 512))").alias("text")).unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    noise = ctw.score_texts(junk, out_of=F.col("doc_id") < 50).where("held_out").agg(F.sum("score") / F.sum("n_bytes")).first()[0] / -math.log10(2)
    assert bits < 3 and noise > bits + 2


def test_op12_nothing_learnt(odd, none):
    assert ctw.score_texts(none).collect() == []
    got = ctw.score_texts(odd[1].where("doc_id IN (0, 3)"), out_of=F.lit(True)).collect()
    assert {(r.doc_id, round(r.score / math.log10(2), 6), r.base_score, r.n_known) for r in got} == {(0, -8, 0, 0), (3, -32, 0, 0)}


# filter audit


def audit_by_hand(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails, parts = [], defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        words = t.encode().split()
        fails.append(
            {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|"),
                "E": t in least and (i is None or i > least[t]),
            }
        )
        parts[part or ""].append(len(fails) - 1)
    out = []
    for part, members in parts.items():
        steps, total = {}, Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if fails[m][f]]
                left = [m for m in left if not fails[m][f]]
                total[f] += len(gone)
                good, toxic = (sum(labels.get(rows[m][0], (0, 0))[k] == 1 for m in gone) for k in (0, 1))
                steps[order, step] = (len(left), len(gone), sum(fails[m][f] for m in members) - len(gone), sum(fails[m][f] and sum(fails[m].values()) == 1 for m in members), good, toxic)
        out += [(part, o, s, *v, total[o[s - 1]]) for (o, s), v in steps.items()]
    return out


def test_op13(spark, odd, none, clashing):
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(15)] + [(5, 0, 1), (None, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    merged = {}
    for i, q, t in labels:
        if i is not None:
            merged[i] = tuple(map(max, merged.get(i, (0, 0)), (q, t)))
    want = keyed(audit_by_hand([r[:3] for r in odd[0]], merged))
    for df in (odd[1], odd[1].repartition(7), clashing):
        assert keyed(map(tuple, filter_audit.audit(df, told).collect())) == want
    assert filter_audit.audit(none, told).collect() == []
    assert filter_audit.audit(odd[1], told.limit(0)).count() == len(want)


def test_op13_colliding_hashes(odd):
    rows = [(r[0], r[1], r[2]) for r in odd[0]]
    batch = lambda part: pa.record_batch([pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "text", "part"])
    found = [r for k in range(3) for b in filter_audit.combine_locally([batch(rows[k::3][:5]), batch(rows[k::3][5:])]) for r in b.to_pylist()]
    local = [(b"same", (r["body"], r["mask"], [tuple(m.values()) for m in r["members"]])) for r in found]
    got = Counter()
    for i, part, mask, n in filter_audit.mark_copies(local):
        got[i, part, mask] += n
    want = Counter()
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part in rows:
        copy = (t or "") in least and (i is None or i > least[t or ""])
        want[i, part or "", filter_audit.fails((t or "").encode()) | 16 * copy] += 1
    assert got == want


def test_op13_sql(spark, duck):
    assert compare(queries.op13_filter_audit(spark, str(DATA)), duck, queries.ORACLE_SQL["op13_filter_audit"]) % 600 == 0


def test_repeated_rows_and_empty_tables(spark, none):
    assert periodic.digests(periodic.periodic_runs(periodic.planted(none))).collect() == []
    text = " ".join(f"w{k % 7}" for k in range(300))
    many = spark.range(2000).select(F.lit(4).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"))
    rows = periodic.periodic_runs(many).groupBy("n_words", "runs").count().collect()
    assert [(r[0], [tuple(x) for x in r[1]], r[2]) for r in rows] == [(300, [(0, 300, 7)], 2000)]
    rows = ctw.score_texts(many).groupBy(F.round("score", 6), "n_known").count().collect()
    assert len(rows) == 1 and rows[0][2] == 2000
    told = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    first = filter_audit.audit(many, told).where("filter_order = 'ABCDE' AND step = 2").first()
    assert (first.removed, first.good_lost, first.kept) == (2000, 2000, 0)
