"""Substring dedup: words that a run of 50 words repeats from a document with a smaller id are removed.

Seeds are winnowed anchors. Each 50-word window has one anchor, the 10-gram of words with the least hash in it (the
first of several), so two equal windows have the same anchor at the same place: joining documents on anchors finds
every repeated window. The windows of a document that share an anchor follow each other; they are one segment, about 20
windows long. A segment is the anchor extended both ways as far as its windows reach.

1. Segments with the same anchor and the same words are brought together; all windows of a segment that also stands in
   a smaller document are repeats.
2. Anchors with several different segments are extended word by word: the segments are cut from the text of the first
   documents that have them, and each 50-word window around the anchor is looked up among those of the same anchor. A
   window that a smaller document has is a repeat.
3. Overlapping repeats of a document merge to maximal ones, and the words these cover are removed.

Rows meet by segment or by window, both combined in map tasks first, so a passage that a third of all documents hold
is a few rows to each task, and no pairs of documents are listed; joins back to a hot segment or window, and to a hot
anchor, are salted. A segment or a window is identified by 128 bits: 64 of its anchor's words and 64 of its own. Rows
are told apart by id and 128 bits of the text: rows of one id and text have the same repeats, which are kept once.

Defined results: a null text has no words; a null doc_id is above every other; repeats within one document alone, or
among rows of the same doc_id, remove nothing; repeated rows give a row each; an empty table gives no row; a text of any
length is taken whole, at some 150 bytes a word of memory; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_safe_join, materialize

LENGTH = 50
GRAM = 10
_LAST = (1 << 63) - 1
_BLOCK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash from the first: the finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Runs:
    """64-bit hashes of any run of a document's words, in constant time for each, from sums of powers of an odd base."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        up = np.full(n + 1, base, np.uint64)
        down = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.down = np.cumprod(down)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(up)[:n])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``length`` words, the place of its anchor."""
    grams = _Runs(hashes, 0x9E3779B97F4A7C15)
    at = np.arange(len(hashes) - gram + 1)
    keys = grams.of(at, at + gram)
    wide, n = length - gram + 1, len(hashes) - length + 1
    out = np.empty(n, np.int64)
    for a in range(0, n, _BLOCK):
        b = min(a + _BLOCK, n)
        out[a:b] = np.arange(a, b) + np.lib.stride_tricks.sliding_window_view(keys[a : b + wide - 1], wide).argmin(1)
    return out


def segments(words: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray] | None:
    """anchor, seg (hashes), first (its first window), n (its windows) of each segment; None if words are too few."""
    if len(words) < length:
        return None
    hashes = word_hashes(words)
    place = anchors(hashes, length, gram)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.append(first[1:], len(place))
    anchored, run = _Runs(_mixed(hashes), 0xAF251AF3B0F025B5), _Runs(hashes, 0xD1342543DE82EF95)
    end, at = last + length - 1, place[first]
    where = (at - first).astype(np.uint64)  # segments are the same only with the anchor at the same place
    return {"anchor": anchored.of(at, at + gram), "seg": run.of(first, end) + where, "first": first, "n": last - first}


def _scan(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "seg", "first", "n"]
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            found, whose, held = [], [], 0
            for k, text in enumerate(batch.column(3).cast(pa.binary())):
                if (s := segments((text.as_py() or b"").split(), length, gram)) is not None:
                    found.append(s)
                    whose.append((k, len(s["n"])))
                    held += len(s["n"])
                if found and (held > 200_000 or k == batch.num_rows - 1):
                    yield _rows(found, whose, own, names)
                    found, whose, held = [], [], 0
            if found:
                yield _rows(found, whose, own, names)

    return scan


def _rows(found, whose, own, names) -> pa.RecordBatch:
    k = np.repeat(*(np.array(x) for x in zip(*whose, strict=True)))
    cols = {c: np.concatenate([s[c] for s in found]) for c in names}
    return pa.record_batch([pa.array(x) for x in (*(c[k] for c in own), *(cols[c].view(np.int64) for c in names[:2]), cols["first"].astype(np.int32), cols["n"].astype(np.int32))], names=["did", "key", "key2", *names])


def _extend(length: int):
    """Rows (did, key, key2, text, list of segments); yields each window of each segment: its place there and a hash of its words.

    Of rows with the same keys that follow each other the first is enough.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for did, key, key2, text, segs in zip(*(c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns), strict=True):
                now = (did.as_py(), key.as_py(), key2.as_py())
                if now == last:
                    continue
                last, did, text, segs = now, now[0], text.as_py(), segs.as_py()
                run = _Runs(word_hashes((text or b"").split()), 0xD1342543DE82EF95)
                for a in range(0, len(segs), 4096):
                    part = segs[a : a + 4096]
                    n = np.array([s["n"] for s in part])
                    at = np.concatenate([np.arange(k) for k in n])
                    start = np.repeat(np.array([s["first"] for s in part]), n) + at
                    anchor, seg = (np.repeat(np.array([s[c] for s in part], np.int64), n) for c in ("anchor", "seg"))
                    yield pa.record_batch([pa.array(x) for x in (np.full(len(start), did), anchor, seg, at.astype(np.int32), run.of(start, start + length).view(np.int64))], names=["did", "anchor", "seg", "at", "win"])

    return windows


_ROW = ["did", "key", "key2"]


def repeats(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """docs: did, key, key2, text. Rows (did, key, key2, first, n): n windows from first on are repeats."""
    found = materialize(docs.mapInArrow(_scan(length, gram), "did long, key long, key2 long, anchor long, seg long, first int, n int"))
    segs = found.groupBy("anchor", "seg").agg(F.min(F.struct(*_ROW, "first", "n")).alias("one"), F.max("did").alias("most"), F.count(F.lit(1)).alias("rows"))
    contested = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms")).where("forms > 1")
    own = hot_safe_join(segs.select("anchor", "seg", "one"), contested, ["anchor"], "forms", "seg", total=found.count())
    todo = own.groupBy("one.did", "one.key", "one.key2").agg(F.collect_list(F.struct("one.first", "one.n", "anchor", "seg")).alias("segs"))
    wins = materialize(docs.join(todo, _ROW).select(*_ROW, "text", "segs").mapInArrow(_extend(length), "did long, anchor long, seg long, at int, win long"))
    lows = wins.groupBy("anchor", "win").agg(F.min("did").alias("least"), F.max("did").alias("most"), F.count(F.lit(1)).alias("rows")).where("least < most").drop("most")
    partial = hot_safe_join(wins, lows, ["anchor", "win"], "rows", "seg").where("did > least").groupBy("anchor", "seg").agg(F.collect_set("at").alias("at"))
    known = segs.select("anchor", "seg", F.col("one.did").alias("least"), "most", "rows").join(partial, ["anchor", "seg"], "left").where("least < most OR at IS NOT NULL").drop("most")
    whole = F.array(F.struct(F.col("first"), F.col("n")))
    some = F.transform("at", lambda k: F.struct((F.col("first") + k).alias("first"), F.lit(1).alias("n")))
    spans = F.when(F.col("did") > F.col("least"), whole).otherwise(F.coalesce(some, F.array().cast("array<struct<first: int, n: int>>")))
    each = found.withColumn("_place", F.monotonically_increasing_id())  # spreads rows of one id too
    return hot_safe_join(each, known, ["anchor", "seg"], "rows", "_place").select(*_ROW, F.explode(spans).alias("s")).select(*_ROW, "s.first", "s.n")


def _cut(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "kept": []}
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                words = (text.as_py() or b"").split()
                mark = np.zeros(len(words) + 1, np.int64)
                for s in spans.as_py() or ():
                    mark[s["first"]] += 1
                    mark[s["first"] + s["n"] + length - 1] -= 1
                keep = np.cumsum(mark[:-1]) == 0
                rows["n_words"].append(len(words))
                rows["n_removed"].append(int(len(words) - keep.sum()))
                rows["kept"].append(b" ".join([words[i] for i in np.flatnonzero(keep)] if not keep.all() else words))
            yield pa.record_batch([rows["doc_id"], pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept"], pa.binary()).cast(pa.string())], names=list(rows))

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    keys = (F.xxhash64(text_col).alias("key"), F.xxhash64(F.lit("second"), text_col).alias("key2"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("did"), *keys, F.col(text_col).alias("text"))
    spans = repeats(own.select(*_ROW, "text"), length, gram).groupBy(*_ROW).agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    return own.join(spans, _ROW, "left").select("doc_id", "text", "spans").mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept string")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
