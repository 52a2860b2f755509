"""Periodic runs of words: where a stretch of a text repeats itself at least four times, found on its suffix tree.

The method is that of Stoye and Gusfield, on the words of one document:

1. The suffix tree is kept as suffix array and common prefixes: a node is an interval of neighbouring suffixes, its leaf
   list the interval, its depth the least common prefix inside. Suffixes are sorted by doubling; only ties go on.
2. Each place between two neighbouring suffixes splits a node in two. Of the two leaf lists the smaller is traversed:
   a leaf i whose partner at distance the node's depth D lies in the other list is a branching tandem repeat of period D.
   A leaf is in a smaller half at most log2(n) times, so the traversal is O(n log n).
3. A branching repeat is the right end of its run. It is rotated to the left as long as the word before equals the one a
   period later; the number of rotations is found by bisection on common prefixes. Repeats of the same stretch are merged:
   the smallest period stays, so powers of a period give no run of their own.

Documents of a batch are worked on together, up to ``_WORDS`` words at a time, so that numpy's cost is shared; a longer
document is a group of its own. Memory is about 300 bytes a word of the group. Nothing is shuffled.

Defined results: a null or empty text has no words and no run; a null doc_id is never made periodic; repeated rows give
a row each; an empty table gives no row; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import binascii
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POWER = 4
LEAST = 6
_WORDS = 1 << 17
_BLOCK = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Suffixes:
    """Suffixes of several word sequences, each ended by a mark of its own: order, ranks, common prefixes.

    codes: a number a word; ends: where each sequence's mark stands (it is in codes, as a number that no word has).
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes)
        self.levels: list[np.ndarray] = []
        rank, tied = self._ranks(codes[order], order, np.zeros(n, np.int32), np.arange(n))
        self.levels.append(rank)
        width, self.order = 1, order
        while len(tied):  # tied: places in the order whose suffixes agree in the first ``width`` words with a neighbour
            at = self.order[tied]
            group = rank[at].astype(np.int64)
            nxt = at + width
            key = (group << 32) | np.where(nxt < n, rank[np.minimum(nxt, n - 1)], 0)
            perm = np.argsort(key)
            self.order[tied] = at[perm]
            rank, more = self._ranks(key[perm], at[perm], rank.copy(), tied)
            tied, width = tied[more], width * 2
            self.levels.append(rank)
        self.rank = rank

    @staticmethod
    def _ranks(keys: np.ndarray, at: np.ndarray, rank: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets the rank of the suffixes ``at``, sorted, to the first place of their group of equal keys; and which are tied."""
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        rank[at] = np.repeat(places[starts], sizes)
        return rank, np.flatnonzero(np.repeat(sizes > 1, sizes))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j (i != j) have in common; by the ranks of each doubling, exact."""
        n, got = len(self.rank), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            r = self.levels[k]
            a, b = i + got, j + got
            same = (a < n) & (b < n)
            same &= r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)]
            got[same] += 1 << k
        return got


def _bounds(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k of ``at``: the last place before with a smaller common prefix, the first after with none larger."""
    n, big = len(lcp), np.iinfo(np.int32).max
    tables = [lcp]  # tables[k][x] = least of lcp[x : x + 2 ** k]
    value = lcp[at]
    lo, hi = at.copy(), at + 1  # [lo, at) is not smaller, [at + 1, hi) is larger
    k = 0
    while True:  # widths grow while some side still holds a whole block of 2 ** k
        t = tables[-1]
        wide = 1 << k
        left = (lo - wide >= 0) & (np.where(lo - wide >= 0, t[np.maximum(lo - wide, 0)], -1) >= value)
        right = (hi < n) & (t[np.minimum(hi, n - 1)] > value)
        if not left.any() and not right.any():
            break
        lo -= wide * left
        hi += wide * right
        nxt = np.full(n, big, np.int32)
        nxt[: n - wide] = np.minimum(t[: n - wide], t[wide:])
        nxt[n - wide :] = -1  # blocks past the end end the search
        tables.append(nxt)
        k += 1
    for k in range(len(tables) - 1, -1, -1):
        t, wide = tables[k], 1 << k
        left = np.where(lo - wide >= 0, t[np.maximum(lo - wide, 0)], -1) >= value
        lo -= wide * left
        right = (hi < n) & (t[np.minimum(hi, n - 1)] > value)
        hi += wide * right
    return lo - 1, hi


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value) of all numbers in the ranges [start, start + size)."""
    which = np.repeat(np.arange(len(start)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which]


def find_runs(docs: list[list[bytes]], power: int = POWER, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each sequence of words its runs (start, length, period), by start, then period.

    power: times that a run must hold its period at least, two or more; least: words that it must have.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not len(sizes) or sizes.max() < max(least, power):
        return out
    ids: dict[bytes, int] = {}
    number = ids.setdefault
    words = np.array([number(w, len(ids)) for d in docs for w in (*d, None)], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    whose = np.repeat(np.arange(len(docs)), sizes + 1)
    marks = base + sizes
    words[marks] = -1
    suffixes = _Suffixes((whose << 32) | (words + 1))  # a mark is below the words of its document, and unlike any other
    order, rank = suffixes.order, suffixes.rank
    lcp = np.zeros(len(order), np.int32)
    near = suffixes.levels[0][order]
    tied = np.flatnonzero(near[1:] == near[:-1]) + 1
    if not len(tied):
        return out
    lcp[tied] = suffixes.common(order[tied - 1], order[tied])
    split = tied[lcp[tied] * power <= sizes[whose[order[tied]]]]
    before, after = _bounds(lcp, split)
    depth = lcp[split].astype(np.int64)
    found = []
    # the leaf lists of the two halves are order[before:split] and order[split:after]; the half that holds a run's last
    # branching repeat holds the power - 2 repeats before it too
    for mine, size, other, width in ((before, split - before, split, after - split), (split, after - split, before, split - before)):
        for sign, enough in ((1, size >= power - 1), (-1, width >= power - 1)):  # leaf i and its partner i + D, or i - D
            smaller = (size <= width) if mine is before else (size < width)
            use = np.flatnonzero(smaller & enough)
            cuts = np.searchsorted(np.cumsum(size[use]), np.arange(_BLOCK, int(size[use].sum()) + _BLOCK, _BLOCK)) + 1 if len(use) else []
            for part in np.split(use, cuts):
                which, place = _ranges(mine[part], size[part])
                node = part[which]
                i = order[place]
                j = i + sign * depth[node]
                ok = (j >= 0) & (j < len(order))
                r = rank[np.where(ok, j, 0)]
                ok &= (r >= other[node]) & (r < other[node] + width[node])
                found.append(np.stack((np.minimum(i, j)[ok], depth[node][ok])))
    i, d = np.concatenate(found, axis=1)
    end = i + 2 * d
    start = end - power * d
    ok = start >= base[whose[i]]
    end, d, start = end[ok], d[ok], start[ok]
    ok = suffixes.common(start, start + d) >= end - d - start
    end, d, start = end[ok], d[ok], start[ok]
    low, high = base[whose[start]], start  # the run starts in [low, high]: rotate as far as the words allow
    while (low < high).any():
        mid = (low + high) // 2
        holds = suffixes.common(mid, mid + d) >= end - d - mid
        low, high = np.where(holds, low, np.minimum(mid + 1, high)), np.where(holds, mid, high)
    start = high
    ok = end - start >= least
    best: dict[tuple[int, int], int] = {}
    for s, e, p in zip(start[ok].tolist(), end[ok].tolist(), d[ok].tolist(), strict=True):
        best[s, e] = min(p, best.get((s, e), p))
    for (s, e), p in best.items():
        k = int(whose[s])
        out[k].append((s - int(base[k]), e - s, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    mark = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats its period most often; of several the first, then that of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _groups(texts: list[bytes | None], most: int) -> Iterator[list[list[bytes]]]:
    group, held = [], 0
    for text in texts:
        words = (text or b"").split()
        if group and held + len(words) > most:
            yield group
            group, held = [], 0
        group.append(words)
        held += len(words)
    if group:
        yield group


def _scan(power: int, least: int, most: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, done = batch.column(0), 0
            for group in _groups(batch.column(1).cast(pa.binary()).to_pylist(), most):
                runs = find_runs(group, power, least)
                top = [strongest(r) or (None,) * 3 for r in runs]
                kept = [b" ".join(collapsed(w, r)) for w, r in zip(group, runs, strict=True)]
                yield pa.record_batch(
                    [
                        ids.slice(done, len(group)),
                        pa.array([len(w) for w in group], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], _RUN),
                        *(pa.array([t[k] for t in top], pa.int64()) for k in range(3)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"],
                )
                done += len(group)

    return scan


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", power: int = POWER, least: int = LEAST, group_words: int = _WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs, the strongest run's start, length and period, collapsed (the text)."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_scan(power, least, group_words), f"doc_id long, n_words long, runs {RUNS}, start long, length long, period long, collapsed string")


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: a tenth of the documents, by a checksum of the id, repeat a stretch from some word on."""
    h = binascii.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            if doc_id is not None and text and binascii.crc32(str(doc_id).encode()) % 10 == 0:
                texts[k] = b" ".join(made_periodic(doc_id, text.split()))
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where a tenth of the texts are made periodic from some word on."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_plant, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
