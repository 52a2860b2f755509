"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut into words; rules are regexes over its words joined by single spaces, each written
from whole words. Rules are made from families, versions and wordings below, in order of priority: exact identifiers,
then full notices and names with a version, then bare names, then hints. A rule runs only if all its keywords occur in
the text. Detections are ordered by priority, then length; one that lies within the interval of a detection kept before
is suppressed. Base phrases are reported whatever the rules say.

Everything is a map over rows: no shuffle, and memory for one batch.

Defined results: a null text counts as empty (no words, null first and last word, empty labels, score 0); repeated rows
give a row each; other columns are not looked at; a text of any length is scanned whole; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Each byte of a text: word bytes as they are, A-Z lower-cased, all others a space.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


#: Words that no rule is looked up by.
_COMMON = frozenset("a all an and any by for free in is it may not of or the this to use with without you".split())


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    score: float


def _rule(label: str, words: str, priority: int, score: float) -> Rule:
    """Keywords are the pattern's plain words but the commonest; every match has all of them."""
    plain, groups = re.sub(r"\[[^]]*\]\w*", " ", words), 1
    while groups:  # from the innermost outwards
        plain, groups = re.subn(r"\([^()]*\)[?*]?", " ", plain)
    plain = re.sub(r"\w\?", " ", plain)
    return Rule(label, words, tuple(sorted(set(re.findall(r"[a-z0-9]{2,}", plain)) - _COMMON)), priority, score)


def rules() -> list[Rule]:
    """Some hundred rules, in order of priority."""
    out: list[Rule] = []
    license_ = "licen[sc]es?"
    version = "(?:version |v ?)?"
    under = "(?:(?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?)?"
    later = "( or (?:any )?later(?: version)?)?"
    named = {  # family: names, versions
        "gpl": (["gnu general public", "gnu gpl", "gpl"], ["1", "2", "3"]),
        "lgpl": (["gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
        "agpl": (["gnu affero general public", "affero general public", "gnu agpl", "agpl"], ["1", "3"]),
        "gfdl": (["gnu free documentation", "gfdl"], ["1 1", "1 2", "1 3"]),
        "apache": (["apache", "apache software"], ["1 0", "1 1", "2 0"]),
        "mpl": (["mozilla public", "mpl"], ["1 0", "1 1", "2 0"]),
        "epl": (["eclipse public", "epl"], ["1 0", "2 0"]),
        "cddl": (["common development and distribution", "cddl"], ["1 0", "1 1"]),
        "eupl": (["european union public", "eupl"], ["1 1", "1 2"]),
        "osl": (["open software", "osl"], ["1 0", "2 0", "2 1", "3 0"]),
        "afl": (["academic free", "afl"], ["1 1", "2 0", "2 1", "3 0"]),
        "artistic": (["artistic", "perl artistic"], ["1 0", "2 0"]),
        "bsl": (["boost software"], ["1 0"]),
        "odbl": (["open database", "odbl"], ["1 0"]),
        "cpl": (["common public"], ["1 0"]),
        "ms-pl": (["microsoft public", "ms pl"], []),
        "ms-rl": (["microsoft reciprocal", "ms rl"], []),
        "zlib": (["zlib", "zlib libpng"], []),
        "isc": (["isc"], []),
        "mit": (["mit", "expat", "x11", "mit x11"], []),
        "ofl": (["sil open font", "open font"], ["1 0", "1 1"]),
        "python": (["python software foundation", "psf"], ["2"]),
        "unlicense": (["unlicense"], []),
        "wtfpl": (["wtfpl"], ["2"]),
        "upl": (["universal permissive"], ["1 0"]),
        "ncsa": (["university of illinois ncsa open source", "ncsa"], []),
        "postgresql": (["postgresql"], []),
        "ecl": (["educational community"], ["1 0", "2 0"]),
        "sspl": (["server side public", "sspl"], ["1"]),
        "elastic": (["elastic"], ["2 0"]),
        "busl": (["business source", "busl"], ["1 1"]),
    }
    for family, (names, versions) in named.items():
        for v in versions:
            out.append(_rule(f"{family}-{v.replace(' ', '.')}", f"spdx license identifier {family} {v}( 0)?(?: only| or later)?", 0, 1.0))
        out.append(_rule(family, f"spdx license identifier {family}", 1, 0.97))
        for name, v in product(names, versions):
            word = f"(?: {license_})?"
            out.append(_rule(f"{family}-{v.replace(' ', '.')}", f"{under}{name}{word} {version}{v}{later}", 2, 0.95))
        for name in names:
            out.append(_rule(family, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?: {license_})?", 3, 0.9))
            out.append(_rule(family, f"{name} {license_}", 4, 0.8))
    for clauses, word in product(("0", "2", "3", "4"), ("bsd", "clause bsd")):
        out.append(_rule(f"bsd-{clauses}-clause", f"{clauses} clause bsd(?: {license_})?" if word != "bsd" else f"bsd {clauses} clause(?: {license_})?", 2, 0.95))
    for adjective, label in (("new", "bsd-3-clause"), ("modified", "bsd-3-clause"), ("revised", "bsd-3-clause"), ("simplified", "bsd-2-clause"), ("original", "bsd-4-clause")):
        out.append(_rule(label, f"{adjective} bsd(?: {license_})?", 2, 0.9))
    out.append(_rule("bsd", f"bsd {license_}", 4, 0.8))
    parts = {"by": "attribution", "by nc": "attribution non ?commercial", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    for short, words in parts.items():
        label = "cc-" + short.replace(" ", "-")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append(_rule(f"{label}-{v.replace(' ', '.')}", f"{under}cc {short} {v}", 2, 0.95))
            out.append(_rule(f"{label}-{v.replace(' ', '.')}", f"{under}creative commons {words} {v}", 2, 0.95))
            out.append(_rule(f"{label}-{v.replace(' ', '.')}", f"creativecommons org licenses {short} {v}", 1, 0.98))
        out.append(_rule(label, f"{under}cc {short}", 4, 0.8))
        out.append(_rule(label, f"{under}creative commons {words}", 4, 0.85))
    out.append(_rule("cc0-1.0", "cc0 1 0(?: universal)?", 2, 0.95))
    out.append(_rule("cc0", "cc0", 4, 0.8))
    for words, label in (
        ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
        ("permission to use copy modify and or distribute this software for any purpose", "isc"),
        ("redistribution and use in source and binary forms with or without modification", "bsd"),
        ("this is free and unencumbered software released into the public domain", "unlicense"),
        ("you may not use this file except in compliance with the license", "apache"),
        ("this program is free software you can redistribute it and or modify", "gpl"),
        ("this library is free software you can redistribute it and or modify", "lgpl"),
        ("released (?:in)?to the public domain", "public-domain"),
        ("dedicated to the public domain", "public-domain"),
        ("all rights reserved", "proprietary"),
        ("proprietary and confidential", "proprietary"),
        ("unauthorized copying of this file", "proprietary"),
    ):
        out.append(_rule(label, words, 3, 0.9 if label != "proprietary" else 0.6))
    out.append(_rule("public-domain", "public domain", 5, 0.5))
    out.append(_rule("unknown", f"(?:licensed|released|distributed) under (?:the )?(?:[^ ]+ ){{1,4}}{license_}", 6, 0.4))
    out.append(_rule("unknown", "licen[sc]ed under", 7, 0.3))
    return sorted(out, key=lambda r: r.priority)


def normalized(text: bytes) -> tuple[bytes, int]:
    """The text's words with one space before, between and after them; their number."""
    words = text.translate(_WORDS).split()
    return b" " + b" ".join(words) + b" " if words else b" ", len(words)


class Scanner:
    def __init__(self, table: list[Rule]):
        import ahocorasick

        self.table = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )".encode())) for r in table]
        self.of: dict[str, int] = {}
        self.need: list[int] = []
        for r in table:
            need = 0
            for w in r.keywords:
                need |= 1 << self.of.setdefault(w, len(self.of))
            self.need.append(need)
        self.find = ahocorasick.Automaton()
        for w in self.of:
            self.find.add_word(w, self.of[w])
        self.find.make_automaton()

    def seen(self, line: bytes) -> int:
        found = 0
        for _, k in self.find.iter(line.decode("latin-1")):
            found |= 1 << k
        return found

    def detect(self, line: bytes) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) in bytes of line, suppressed ones left out."""
        seen, hits = self.seen(line), []
        for (rule, pattern), need in zip(self.table, self.need, strict=True):
            if need & ~seen == 0:
                hits += [(rule.priority, m.start() - m.end(), m.start(), m.end(), rule) for m in pattern.finditer(line)]
        kept: list[tuple[int, int, str, float]] = []
        starts, ends = [], []  # of the kept intervals that no other kept one contains: both ascend
        for _, _, a, b, rule in sorted(hits, key=lambda h: h[:4] + (h[4].label,)):
            at = bisect_right(starts, a)
            if at and ends[at - 1] >= b:
                continue
            kept.append((a, b, rule.label, rule.score))
            first = at - (at > 0 and starts[at - 1] == a)
            last = bisect_right(ends, b, first)
            starts[first:last], ends[first:last] = [a], [b]
        return kept


def _places(line: bytes, phrase: bytes) -> list[int]:
    out, at = [], line.find(phrase)
    while at >= 0:
        out.append(at)
        at = line.find(phrase, at + 1)
    return out


def _scan(table: list[Rule]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table)
        phrases = [(f" {p} ".encode(), label) for p, label in BASE]
        for batch in batches:
            rows = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            for text in batch.column(1).cast(pa.binary()):
                line, n = normalized(text.as_py() or b"")
                base = [(at, label) for p, label in phrases for at in _places(line, p)]
                hits = scanner.detect(line)
                spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if base or hits else None
                word = lambda at: int(np.searchsorted(spaces, at, "right")) - 1
                rows["n_words"].append(n)
                rows["n_base"].append(len(base))
                rows["first_word"].append(word(min(base)[0]) if base else None)
                rows["last_word"].append(word(max(base)[0]) if base else None)
                rows["base_labels"].append(",".join(sorted({b for _, b in base})))
                rows["labels"].append(",".join(sorted({b for _, b in base} | {h[2] for h in hits})))
                rows["score"].append(max([h[3] for h in hits] + [0.8] * bool(base), default=0.0))
                rows["detections"].append([{"label": h[2], "first": word(h[0] - 1), "last": word(h[1] - 1), "score": h[3]} for h in sorted(hits)])
            kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield pa.record_batch([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], names=["doc_id", *rows])

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, first: long, last: long, score: double>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(table or rules()), schema)
