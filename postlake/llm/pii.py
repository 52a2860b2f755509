"""Personal data by bootstrapped contextual extraction.

Seeds are the matches of four base shapes (email, ip, card, phone). Every seed, and every other token that looks like
an identifier, is an instance; the words around an instance are its patterns. The graph of patterns and instances is
scored in rounds: a pattern's score is the mean score of its distinct instances (with a prior for rare ones), an
unseen instance's score is one minus the product of what its patterns miss. Patterns above a bound then report their
unseen instances as spans of the kind context.

What looks like an identifier only starts this: patterns that are sure of such instances then propose whatever fills
their slots, of any shape, in a second scan. The pattern's score is then taken again over all instances and fillers,
where only seeds count for it, so that a pattern which leads to ordinary words is no longer sure; those still sure
report their fillers. Of fillers that overlap, the leftmost is reported; scores count all.

How many patterns are sure grows with the corpus, so their list goes nowhere whole: tasks get a Bloom filter of fixed
size (``SIEVE``), propose what may fill a slot, and a join with the patterns decides. False positives only add
proposals.

The graph has one edge for each distinct pattern and instance, so it is as small as the vocabulary of contexts; sums by
pattern are combined in map tasks, and scores go back to edges by salted joins, since one pattern may lead to a large
part of all instances. Instances leave the scan as hashes.

Base shapes are found in time linear in the text: an email is looked for around each @, digits from the start of a run.

Defined results: a null text counts as empty; repeated rows give a row each; an empty table gives no row; other
columns are not looked at; a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, salted_lookup, shuffle_partitions

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS = 3
PATTERN_SCORE = 0.8
SEEDS = 5
#: The Bloom filter of sure patterns has 2**SIEVE bits: 1 MB.
SIEVE = 23
_HASHES = 4
#: One document of so many tells first which patterns are unsure for certain.
FIRST = 16
_SEEN = 1 << 16
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LIKE = re.compile(r"[0-9][A-Za-z0-9-]*+")  # from a token's first digit on
_INNER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-")
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_NEAR = 48
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
#: Marks around a filler that are not of it, and the length after which it takes no more tokens.
_BEFORE, _AFTER, _LONGEST = "\"'`<[{,;:=", "\"'`>]},;:.!?", 64


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; ends are exclusive, places are code points."""
    out = [(0, *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def unseen(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens of 6 to 40 letters, digits and hyphens with 4 digits at least, apart from taken."""
    out, spans, k = [], sorted((a, b) for _, a, b in taken), 0
    for m in _LIKE.finditer(text):
        a, b = m.span()
        while a and b - a <= 40 and text[a - 1] in _INNER:
            a -= 1
        if not 6 <= b - a <= 40 or sum("0" <= c <= "9" for c in m[0]) < 4:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k == len(spans) or spans[k][0] >= b:
            out.append((a, b))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The word before, with the one before it, and with the one after: lower case, letters only."""
    word = lambda w: "".join(c for c in w.lower() if c.isalpha())
    left, right = text[max(0, start - _NEAR) : start].split()[-2:], text[end : end + _NEAR].split()[:1]
    one, two = word(left[-1]) if left else "", word(left[-2]) if len(left) > 1 else ""
    after = word(right[0]) if right else ""
    return [p for p, ok in ((f"{one} _", one), (f"{two} {one} _", one and two), (f"{one} _ {after}", one and after)) if ok]


def _letters(token: str) -> str:
    return "".join(c for c in token.lower() if c.isalpha())


class Sieve:
    """Bloom filter of strings: false for one that was not put in, but for false positives."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = bits, len(bits) * 8 - 1
        self.seen: dict[str, bool] = {}
        self.words: dict[str, tuple[str, bool]] = {}

    def word(self, token: str) -> tuple[str, bool]:
        """The token's letters, and whether they stand before a slot."""
        known = self.words.get(token)
        if known is None:
            word = _letters(token)
            known = word, word != "" and word in self
            if len(self.words) < _SEEN:
                self.words[token] = known
        return known

    def __contains__(self, key: str) -> bool:
        known = self.seen.get(key)
        if known is None:
            h = xxhash.xxh64_intdigest(key, 42)
            low, step = h & 0xFFFFFFFF, h >> 32
            places = [(low + k * step) & self.mask for k in range(_HASHES)]
            known = all(self.bits[p >> 3] >> (p & 7) & 1 for p in places)
            if len(self.seen) < _SEEN:
                self.seen[key] = known
        return known


def sieve_of(patterns: DataFrame, bits: int = SIEVE) -> Sieve:
    """patterns: pattern. Filter of 2**bits bits of the patterns and of the words before their slots."""
    before = F.element_at(F.split(F.element_at(F.split("pattern", " _"), 1), " "), -1)
    h = F.xxhash64(F.col("key"))
    low, step = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    place = F.explode(F.array(*((low + k * step).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(_HASHES))))
    keys = patterns.select(F.explode(F.array("pattern", before)).alias("key")).distinct()
    cells = keys.select(place.alias("place")).select(F.shiftright("place", 3).cast("int").alias("cell"), F.expr("shiftleft(1, CAST(place & 7 AS INT))").alias("bit"))
    table = cells.groupBy("cell").agg(F.bit_or("bit").alias("byte")).toArrow()  # at most 2**(bits - 3) rows
    out = np.zeros(1 << bits - 3, np.uint8)
    out[table.column("cell").to_numpy()] = table.column("byte").to_numpy()
    return Sieve(out.tobytes())


def fillers(text: str, sure: Sieve) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, sure patterns) of what fills the slots of sure patterns, apart from base spans; they may overlap.

    A filler is a token between spaces without the marks around it; tokens with digits, and those that "at" or "dot"
    join, are one.
    """
    spans, s = None, 0
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    two, one, leads = "", "", False
    for first, (a, b) in enumerate(tokens):
        if leads:
            if spans is None:
                spans = sorted((x, y) for _, x, y in base_spans(text))
            k = first
            while k + 1 < len(tokens) and tokens[k + 1][0] - b <= 2 and b - a <= _LONGEST:
                c, d = tokens[k + 1]
                if text[b - 1] not in ",;!?" and _DIGIT.search(text, tokens[k][0], b) and _DIGIT.search(text, c, d):
                    k += 1
                elif k + 2 < len(tokens) and text[c:d].strip("()[]{}<>").lower() in ("at", "dot"):
                    k += 2
                else:
                    break
                b = tokens[k][1]
            x, y = a, b
            while x < y and text[x] in _BEFORE:
                x += 1
            while x < y and text[y - 1] in _AFTER:
                y -= 1
            while s < len(spans) and spans[s][1] <= x:
                s += 1
            if x < y and (s == len(spans) or spans[s][0] >= y):
                after = _letters(text[tokens[k + 1][0] : tokens[k + 1][1]]) if k + 1 < len(tokens) else ""
                own = [p for p, ok in ((f"{one} _", True), (f"{two} {one} _", two), (f"{one} _ {after}", after)) if ok and p in sure]
                if own:
                    yield x, y, own
        two, (one, leads) = one, sure.word(text[tokens[first][0] : tokens[first][1]])


def _slots(bits: bytes):
    """(text, uid) -> a row for each thing that may fill a slot."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(bits)
        for batch in batches:
            out = []
            for text, uid in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py() or ""
                out += [(uid, a, b, instance(text[a:b]), own) for a, b, own in fillers(text, sieve)]
            types = [pa.int64()] * 4 + [pa.list_(pa.string())]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [()] * 5, types, strict=True)], names=["uid", "start", "end", "instance", "patterns"])

    return slots


def leftmost(proposed: DataFrame) -> DataFrame:
    """proposed: uid, start, end, instance, pattern. The rows of each uid's spans from left to right that do not begin inside the last one kept."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = uid = None
        for batch in batches:
            rows = []
            for u, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if u != uid or a >= last[1]:
                    uid, last = u, (a, b)
                rows.append((a, b) == last)
            yield batch.filter(pa.array(rows, pa.bool_()))

    by = proposed.select("uid", "start", "end", "instance", "pattern").repartition(shuffle_partitions(proposed.sparkSession), "uid").sortWithinPartitions("uid", "start")
    return by.mapInArrow(keep, by.schema)


def instance(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big", signed=True)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        counts, digests, spans, found = [[], [], [], []], [], [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                counts[k].append(sum(s[0] == k for s in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in base])
            own = base + [(4, *s) for s in unseen(text, base)]
            found.append([{"kind": k, "start": a, "end": b, "instance": instance(text[a:b]), "patterns": patterns(text, a, b)} for k, a, b in own])
        yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(found, kind)], names=["doc_id", "uid", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"])


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """edges: distinct (pattern, instance, seed). Scores of patterns (pattern, score, seeds) and of instances not seeds (instance, score)."""
    edges = materialize(edges)
    rated = edges.withColumn("rate", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for k in range(rounds):
        pats = rated.groupBy("pattern").agg((F.sum("rate") / (F.count(F.lit(1)) + 1.0)).alias("score"), F.count_if("seed").alias("seeds"))
        pats = materialize(pats)
        back = salted_lookup(edges.where("NOT seed"), pats, ["pattern"], "instance")
        insts = back.groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12)))))).alias("score"))
        insts = materialize(insts)
        if k + 1 < rounds:
            rated = salted_lookup(edges, insts.withColumnRenamed("score", "own"), ["instance"], "pattern").withColumn("rate", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0)))).drop("own")
    return pats, insts


def _proposed(texts: DataFrame, sure: DataFrame) -> DataFrame:
    """What may fill the slots of sure patterns: uid, start, end, instance, pattern, sure."""
    slots = texts.select("text", "uid").mapInArrow(_slots(sieve_of(sure).bits), "uid long, start long, end long, instance long, patterns array<string>")
    return salted_lookup(slots.select("uid", "start", "end", "instance", F.explode("patterns").alias("pattern")), sure, ["pattern"], "uid").where("sure")


def _still(edges: DataFrame, sure: DataFrame, proposed: DataFrame, least: float) -> DataFrame:
    """The sure patterns of which seeds are still the share ``least`` of all instances and proposed fillers."""
    every = edges.join(sure, "pattern", "left_semi").unionByName(proposed.select("pattern", "instance", F.lit(False).alias("seed")))
    shares = every.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).groupBy("pattern").agg((F.count_if("seed") / (F.count(F.lit(1)) + 1.0)).alias("score"))
    return shares.where(F.col("score") >= least).select("pattern", F.lit(True).alias("sure"))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, pattern_score: float = PATTERN_SCORE, seeds: int = SEEDS) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context."""
    own = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("uid")))
    each = "array<struct<kind: int, start: long, end: long, instance: long, patterns: array<string>>>"
    scanned = materialize(own.mapInArrow(_scan, f"doc_id long, uid long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind: int, start: long, end: long>>, found {each}"))
    found = scanned.select("uid", F.explode("found").alias("f")).select("uid", "f.*")
    edges = found.select(F.explode("patterns").alias("pattern"), "instance", (F.col("kind") < 4).alias("seed")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = materialize(edges)
    pats, insts = score_graph(edges, rounds)
    led_by = materialize(pats.where((F.col("score") >= pattern_score) & (F.col("seeds") >= seeds)).select("pattern", F.lit(True).alias("sure")))
    # Fillers only lower a score, so patterns that those of some documents make unsure are unsure: the scan of all documents is spared them.
    first = own.where(F.pmod(F.xxhash64("uid"), F.lit(FIRST)) == 0)
    sure = materialize(_still(edges, led_by, _proposed(first, led_by), pattern_score))
    proposed = materialize(_proposed(own, sure))
    filled = leftmost(salted_lookup(proposed.drop("sure"), _still(edges, sure, proposed, pattern_score), ["pattern"], "uid").where("sure"))
    led = salted_lookup(found.where("kind = 4").select("uid", "start", "end", "instance", F.explode("patterns").alias("pattern")), led_by, ["pattern"], "uid").where("sure")
    led = salted_lookup(led.select("uid", "start", "end", "instance").distinct(), insts, ["instance"], "uid").where(F.col("score") >= pattern_score)
    led = led.select("uid", "start", "end").unionByName(filled.select("uid", "start", "end")).distinct()
    # Of spans that lie within each other the longest stays.
    before = Window.partitionBy("uid").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    led = led.withColumn("reached", F.max("end").over(before)).where("reached IS NULL OR reached < end")
    more = led.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("kind"), "start", "end"))).alias("more"))
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind: int, start: long, end: long>>")))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.drop("found").join(more, "uid", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_context"))
