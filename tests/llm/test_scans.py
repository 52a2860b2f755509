"""Secret, personal data and license scans against plain regexes over each text."""

from __future__ import annotations

import hashlib
import re

from postlake.llm import licenses, pii, secrets

SECRET = (
    ("assign", re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d // 10 + d % 10 for d in twice)) % 10 == 0


PERSONAL = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)


def found(text, kinds):
    return [(name, *m.span()) for name, pattern, ok in kinds for m in pattern.finditer(text or "") if ok(m)]


def digest(spans) -> str:
    return hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()


def keyed(rows):
    return sorted(rows, key=repr)


def test_secrets_base_spans(both):
    names = [k[0] for k in SECRET]
    for rows, df in both:
        want = []
        for r in rows:
            spans = found(r[1], SECRET)
            own = sorted(spans, key=lambda s: (s[1], names.index(s[0])))
            want.append((r[0], *(sum(s[0] == n for s in spans) for n in names), digest(own)))
        got = secrets.scan_secrets(df).collect()
        assert keyed(tuple(r[:5]) for r in got) == keyed(want)
        for r in got:
            assert digest(tuple((a, int(b), int(c)) for a, b, c in (s.split(":") for s in r.spans.split(",") if s) if a in names)) == r.base_sha256


def test_secrets_ownership(spark):
    shared, own = "ghp_" + "a1B2c3D4e5" * 4, "ghp_" + "z9Y8x7W6v5" * 4
    rows = [(k, f"use {shared} now", "en", f"s{k}", 1) for k in range(5)] + [(9, f"my {own}", "en", "s1", 1)]
    out = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(out[k].n_example == 1 and out[k].n_live == 0 for k in range(5)) and out[9].n_live == 1
    assert out[9].spans == "prefixed:3:47,live:3:47"


def test_personal_base_spans(both):
    for rows, df in both:
        want = [(r[0], *(sum(s[0] == k[0] for s in found(r[1], PERSONAL)) for k in PERSONAL), digest(found(r[1], PERSONAL))) for r in rows]
        assert keyed(tuple(r[:6]) for r in pii.scan_pii(df).collect()) == keyed(want)


def test_personal_context(spark):
    rows = [(k, f"call me at +1 555 010 {1000 + k} today", "en", "s", 1) for k in range(12)] + [(50, "call me at 5550-1987654 today", "en", "s", 1), (51, "page number 123456789 of it", "en", "s", 1)]
    out = {r.doc_id: r for r in pii.scan_pii(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert out[50].spans == "context:11:23" and out[51].n_context == 0


def test_personal_context_of_any_shape(spark):
    ids = ["555 010 9999", "555.010.9999", "(555) 010 9999", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00", "2001:db8::ff00:42:8329", "jane at example dot org", "jane.doe"]
    rows = [(k, f"now call me at +1 555 010 {1000 + k} today", "en", "s", 1) for k in range(60)] + [(100 + k, f"now call me at {i} today", "en", "s", 1) for k, i in enumerate(ids)]
    rows += [(200 + k, f"put the +1 555 010 {2000 + k} here", "en", "s", 1) for k in range(60)] + [(300 + k, f"put the {w}", "en", "s", 1) for k, w in enumerate("abcdefghijklmnopqrstuvwxyz")]
    out = {r.doc_id: r for r in pii.scan_pii(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert [out[100 + k].spans for k in range(len(ids))] == [f"context:15:{15 + len(i)}" for i in ids]
    assert all(out[300 + k].n_context == 0 for k in range(26))


def context_by_brute_force(texts):
    """Spans of the kind context of each text, by dictionaries and one pass from left to right."""
    from math import prod

    letters = lambda t: "".join(c for c in t.lower() if c.isalpha())
    found = [(k, kind, a, b) for k, t in enumerate(texts) for kind, a, b in pii.base_spans(t) + [(4, *s) for s in pii.unseen(t, pii.base_spans(t))]]
    edges = {}
    for k, kind, a, b in found:
        for p in pii.patterns(texts[k], a, b):
            edges[p, texts[k][a:b]] = edges.get((p, texts[k][a:b]), False) or kind < 4
    own = {}
    for _ in range(pii.ROUNDS):
        score, seeds, insts = {}, {}, {}
        for p in {p for p, _ in edges}:
            rates = [(1.0 if seed else own.get(i, 0.0), seed) for (q, i), seed in edges.items() if q == p]
            score[p], seeds[p] = sum(r for r, _ in rates) / (len(rates) + 1), sum(seed for _, seed in rates)
        for (p, i), seed in edges.items():
            if not seed:
                insts.setdefault(i, []).append(score[p])
        own = {i: 1 - prod(1 - x for x in xs) for i, xs in insts.items()}
    sure = {p for p in score if score[p] >= pii.PATTERN_SCORE and seeds[p] >= pii.SEEDS}

    def slots(text, known, apart):
        taken, tokens, k, out = pii.base_spans(text), [m.span() for m in re.finditer(r"\S+", text)], 0, []
        while k < len(tokens):
            one, two = letters(text[slice(*tokens[k - 1])]) if k else "", letters(text[slice(*tokens[k - 2])]) if k > 1 else ""
            end, digit = k, lambda j: re.search("[0-9]", text[slice(*tokens[j])])
            while end + 1 < len(tokens) and tokens[end + 1][0] - tokens[end][1] <= 2 and tokens[end][1] - tokens[k][0] <= 64:
                if digit(end) and digit(end + 1) and text[tokens[end][1] - 1] not in ",;!?":
                    end += 1
                elif end + 2 < len(tokens) and text[slice(*tokens[end + 1])].strip("()[]{}<>").lower() in ("at", "dot"):
                    end += 2
                else:
                    break
            a, b = tokens[k][0], tokens[end][1]
            while a < b and text[a] in "\"'`<[{,;:=":
                a += 1
            while a < b and text[b - 1] in "\"'`>]},;:.!?":
                b -= 1
            after = letters(text[slice(*tokens[end + 1])]) if end + 1 < len(tokens) else ""
            ps = {p for p, ok in ((f"{one} _", one), (f"{two} {one} _", one and two), (f"{one} _ {after}", one and after)) if ok and p in known}
            if ps and a < b and all(y <= a or x >= b for _, x, y in taken):
                out.append((a, b, ps))
                k = end if apart else k
            k += 1
        return out

    every = dict(edges)
    for t in texts:
        for a, b, ps in slots(t, sure, False):
            for p in ps:
                every.setdefault((p, t[a:b]), False)
    part = {p: [seed for (q, _), seed in every.items() if q == p] for p in sure}
    still = {p for p, xs in part.items() if sum(xs) / (len(xs) + 1) >= pii.PATTERN_SCORE}
    out = []
    for k, t in enumerate(texts):
        spans = {(a, b) for j, kind, a, b in found if j == k and kind == 4 and own[t[a:b]] >= pii.PATTERN_SCORE and sure & set(pii.patterns(t, a, b))}
        spans |= {(a, b) for a, b, _ in slots(t, still, True)}
        out.append(sorted(s for s in spans if not any((a <= s[0] and s[1] <= b) and (a, b) != s for a, b in spans)))
    return out


def test_personal_context_against_brute_force(spark):
    import random

    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    shapes = [
        lambda: f"+1 555 {digits(3)} {digits(4)}", lambda: f"+1 555 {digits(3)} {digits(4)}", lambda: f"u{digits(4)}@mail.org", lambda: f"10.{rng.randint(0, 255)}.0.{rng.randint(0, 255)}", lambda: f"ID-{digits(7)}",
        lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"u{digits(2)} at mail dot org", lambda: rng.choice(("the", "later", "at 5", "home:", "(x)")),
    ]
    lead = ("call me at", "reach us on", "dial", "write to", "see page", "host")
    weights = {"call me at": [9, 9, 0, 0, 1, 1, 1, 0], "reach us on": [5, 5, 5, 0, 1, 1, 0, 0], "dial": [9, 9, 0, 0, 0, 2, 0, 1], "write to": [0, 0, 9, 0, 1, 0, 2, 9], "see page": [0, 0, 0, 0, 9, 1, 0, 5], "host": [0, 0, 0, 9, 1, 0, 0, 0]}
    texts = []
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(0, 4)):
            name = rng.choice(lead)
            parts.append(f"{name} {rng.choices(shapes, weights[name])[0]()}{rng.choice(('', ' now', ',', '.'))}")
        texts.append(" ".join(parts))
    texts += ["", "dial " * 200 + "555 010 9999", "call me at dial 555 010 1234 at home dot org now"]
    want = context_by_brute_force(texts)
    got = {r.doc_id: r.spans for r in pii.scan_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = lambda s: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x.startswith("context:")]
    assert [spans(got[k]) for k in range(len(texts))] == want
    assert sum(map(len, want)) > 50


def test_sieve_holds_all_that_was_put_in(spark):
    put = [f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]} _ {'abcdefghij'[k // 100]}x" for k in range(1000)]
    for bits, most in ((23, 0), (10, 5000)):
        sieve = pii.sieve_of(spark.createDataFrame([(p,) for p in put], "pattern string"), bits)
        assert len(sieve.bits) == 2**bits // 8 and all(p in sieve and p.split(" _")[0] in sieve for p in put)
        assert sum(f"no {k} _" in sieve for k in range(5000)) <= most
    assert "x _" not in pii.sieve_of(spark.createDataFrame([], "pattern string"))


PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def test_licenses_base(both):
    for rows, df in both:
        want = []
        for r in rows:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
            hits = [(k, label) for p, label in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
            want.append((r[0], len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({b for _, b in hits}))))
        got = licenses.scan_licenses(df).collect()
        assert keyed(tuple(r[:6]) for r in got) == keyed(want)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def test_licenses_suppress(spark):
    df = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0 and no other", "", "", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = licenses.scan_licenses(df).first()
    assert r.labels == "apache,apache-2.0" and [d.label for d in r.detections] == ["apache-2.0"]
    assert len(licenses.rules()) >= 200


def shortest(tree) -> list[str]:
    """Texts that a parsed pattern matches: optional parts left out, each branch once."""
    out = [""]
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            more = [chr(arg)]
        elif op == "NOT_LITERAL":
            more = ["x"]
        elif op == "IN":
            more = [chr(v) if str(o) == "LITERAL" else "x" for o, v in arg[:1]]
        elif op == "BRANCH":
            more = [t for b in arg[1] for t in shortest(b)]
        elif op == "SUBPATTERN":
            more = shortest(arg[3])
        else:
            assert op == "MAX_REPEAT"
            more = [t * arg[0] for t in shortest(arg[2])] if arg[0] else [""]
        out = [a + b for a in out for b in more]
    return out


def test_license_keywords_are_in_every_match():
    from re import _parser

    for rule in licenses.rules():
        for text in shortest(_parser.parse(rule.pattern)):
            assert re.fullmatch(rule.pattern, text)
            assert all(k in text for k in rule.keywords), (rule, text)


def test_licenses_without_under(spark):
    want = {"GPL v3": "gpl-3", "gnu gpl v3 or later": "gpl-3", "GPL-2.0": "gpl-2", "Apache License, Version 2.0": "apache,apache-2.0", "CC BY-NC 4.0": "cc-by,cc-by-nc-4.0", "CC BY-SA": "cc-by,cc-by-sa", "Creative Commons Attribution 4.0": "cc-by-4.0", "mpl 2.0": "mpl-2.0", "gplvs 3": ""}
    df = spark.createDataFrame([(k, t, "", "", 1) for k, t in enumerate(want)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {list(want)[r.doc_id]: r.labels for r in licenses.scan_licenses(df).collect()} == want


def test_licenses_long_text():
    """A million words with a hundred thousand detections, and intervals that lie within each other in every way."""
    import time

    import numpy as np

    scanner = licenses.Scanner(licenses.rules())
    start = time.time()
    line, n = licenses.normalized(b"some words of no matter and the mit license here " * 100_000)
    assert n == 1_000_000 and len(scanner.detect(line)) == 100_000 and time.time() - start < 30
    rng = np.random.default_rng(1)
    for _ in range(30):
        words = rng.choice("gnu general public license lesser gpl v3 or later apache 2 0 under the terms of licensed mit cc by nc sa 4".split(), 300)
        line, _ = licenses.normalized(" ".join(words).encode())
        seen = scanner.seen(line)
        hits = [(r.priority, m.start() - m.end(), m.start(), m.end(), r.label, r.score) for (r, p), need in zip(scanner.table, scanner.need, strict=True) if need & ~seen == 0 for m in p.finditer(line)]
        kept: list[tuple] = []
        for *_, a, b, label, score in sorted(hits):
            if not any(x <= a and b <= y for x, y, *_ in kept):
                kept.append((a, b, label, score))
        assert scanner.detect(line) == kept


def test_secrets_verdicts(spark):
    """Every candidate's owners, repositories and verdict, counted by hand."""
    rng, values = __import__("random").Random(4), ["ghp_" + "".join(c) for c in ("a1B2c3D4e5" * 4, "z9Y8x7W6v5" * 4, "k1" * 20, "q7R" * 12)]
    rows = [(k, " ".join(f"key {v}" for v in values if rng.random() < 0.3) or None, rng.choice(["en", "de", None]), rng.choice(["en", "s1", "s2", None]), 1) for k in range(60)]
    rows.append((60, "only ghp_" + "m4N5p6Q7r8" * 4, None, None, 1))
    want: dict[str, list] = {}
    for _, text, lang, source, _ in rows:
        for v in re.findall(r"ghp_\w+", text or ""):
            want.setdefault(v, [set(), set()])
            want[v][0].add(source)
            want[v][1].add((source, lang))
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect():
        own = re.findall(r"ghp_\w+", rows[r.doc_id][1] or "")
        found = [c for c in r.found or () if c.kind == "prefixed"]
        assert [(c.n_owners, c.n_repos) for c in found] == [tuple(map(len, want[v])) for v in own]
        verdict = lambda v: "example" if len(want[v][0]) >= 3 else "live" if len(want[v][0]) == 1 and len(want[v][1]) <= 2 and secrets.looks_random(v) else "shared"
        assert [c.verdict for c in found] == list(map(verdict, own)) and r.n_live == sum(verdict(v) == "live" for v in own)


def test_empty_and_clashing(none, clashing, odd):
    for scan in (secrets.scan_secrets, pii.scan_pii, licenses.scan_licenses):
        assert scan(none).count() == 0
        assert scan(clashing).count() == len(odd[0])


def test_web_tokens_are_found_once_and_in_linear_time():
    import random
    import re
    import time

    pattern = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(("eyJ", "eyJabcdefgh", ".", ".", "a", "-", " ", "abcdefgh", "x")) for _ in range(rng.randint(0, 14)))
        assert list(secrets.web_tokens(text)) == [m.span() for m in pattern.finditer(text)], text
    start = time.time()
    assert list(secrets.web_tokens("aeyJ" * 500_000)) == [] and time.time() - start < 5
