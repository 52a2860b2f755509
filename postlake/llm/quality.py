"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Random indexing: a token's index vector has a few +1 and -1 at places given by its hash; a word vector is the sum of the
index vectors around all the word's occurrences in the corpus (itself included), within a document, so nothing is
factorised and partial sums just add up: they are whole numbers, and the same however the corpus is partitioned. Words share ``BUCKETS`` vectors by hash; that makes the table of word vectors a fixed
size (BUCKETS x DIMS, 4 MB), whatever the corpus, and so fit to send to every task. A document's input is the mean of its tokens'
unit word vectors, once plain and once weighted down for frequent words.

The network (numpy, tanh hidden layer, Adam) learns from at most ``MOST_ROWS`` labelled rows, those with the least
hashes of their ids; one training row in eight is kept back to fit the temperature by which logits are divided. Rows
held out by ``held_out`` are never learned from; labels, language, source and id are no inputs.

Defined results: a null text counts as empty; an empty text has the zero vector and gets a score like any other; a null
id is held out; several labels of one id count by their mean, null labels not at all; of several texts of one id the one
with the least pooled vector is learned from; with no usable labels of both
kinds the score is the share of label 1 (0.5 without any); an empty table gives no row; a text of any length is pooled whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 1 << 14
DIMS = 64
NONZERO = 4
WINDOW = 2
MOST_ROWS = 20_000
HIDDEN = 24
THRESHOLD = 0.3
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Tokens of their own: after a word in capitals, for a line seen before in the document, after a token said twice.
_UPPER, _AGAIN, _SAME = BUCKETS, BUCKETS + 1, BUCKETS + 2
_ROWS = BUCKETS + 3


class _Ids(dict):
    """Token -> bucket; plus _ROWS for words in capitals. Emptied when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        own = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS + _ROWS * (len(token) > 1 and token.isupper())
        self[token] = own
        return own


def token_ids(text: str, ids: _Ids) -> np.ndarray:
    found, seen = [], set()
    for line in text.split("\n"):
        if len(line) > 20:
            if line in seen:
                found.append(_AGAIN)
            seen.add(line)
        found += [ids[t] for t in _TOKEN.findall(line)]
    own = np.array(found, np.int64)
    if not len(own):
        return own
    upper, own = own >= _ROWS, own % _ROWS
    same = np.flatnonzero(own[1:] == own[:-1]) + 2
    return np.insert(own, np.concatenate((np.flatnonzero(upper) + 1, same)), np.repeat([_UPPER, _SAME], [upper.sum(), len(same)]))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each token's index vector, the same everywhere."""
    rng = np.random.default_rng(20240)
    places, signs = rng.integers(0, DIMS, (_ROWS + 1, NONZERO)), rng.choice(np.array([-1, 1]), (_ROWS + 1, NONZERO))
    signs[_ROWS] = 0  # the border between documents
    return places, signs


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of index vectors around each token, over a partition; the last place counts its occurrences."""
    places, signs = index_vectors()
    ids, sums, counts = _Ids(), np.zeros((_ROWS + 1, DIMS), np.int64), np.zeros(_ROWS + 1, np.int64)
    border = np.full(WINDOW, _ROWS)

    def add(seq: np.ndarray) -> None:
        nonlocal counts
        counts += np.bincount(seq, minlength=_ROWS + 1)
        for shift in range(-WINDOW, WINDOW + 1):
            word, near = (seq[-shift:], seq[:shift]) if shift < 0 else (seq[: len(seq) - shift], seq[shift:])
            for k in range(NONZERO):
                flat = np.bincount(word * DIMS + places[near, k], weights=signs[near, k], minlength=(_ROWS + 1) * DIMS)
                sums.__iadd__(flat.astype(np.int64).reshape(_ROWS + 1, DIMS))

    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for text in batch.column(0):
            seq = token_ids(text.as_py() or "", ids)
            held += [seq, border]
            size += len(seq)
            if size > 1 << 20:
                add(np.concatenate(held))
                held, size = [], 0
    if size:
        add(np.concatenate(held))
    full = np.flatnonzero(counts[:_ROWS])
    if len(full):
        rows = np.concatenate((sums[full], counts[full, None]), axis=1)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["bucket", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(sums, np.int64)
            total[bucket] = total[bucket] + own if bucket in total else own
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], names=["bucket", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (one for each bucket) and weights of all words of docs: a fixed size."""
    parts = docs.select(text_col).mapInArrow(_around, "bucket int, sums binary")
    rows = parts.repartition("bucket").mapInArrow(_added, "bucket int, sums binary").collect()
    sums = np.zeros((_ROWS, DIMS + 1))
    for r in rows:
        sums[r["bucket"]] = np.frombuffer(r["sums"], np.int64)
    vectors, counts = sums[:, :DIMS], sums[:, DIMS]
    norms = np.linalg.norm(vectors, axis=1)
    vectors = (vectors / np.where(norms == 0, 1, norms)[:, None]).astype(np.float32)
    return vectors, (1e-3 / (1e-3 + counts / max(counts.sum(), 1))).astype(np.float32)


def _pooled(vectors, weights):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vectors.value, weights.value
        ids = _Ids()
        for batch in batches:
            out = np.zeros((batch.num_rows, 2 * DIMS), np.float32)
            for k, text in enumerate(batch.column(1)):
                seq = token_ids(text.as_py() or "", ids)
                for a in range(0, len(seq), 1 << 16):
                    part = seq[a : a + (1 << 16)]
                    own = v[part]
                    out[k, :DIMS] += own.sum(0)
                    out[k, DIMS:] += w[part] @ own
                if len(seq):
                    out[k] /= len(seq)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in out], pa.binary())], names=["doc_id", "pooled"])

    return pool


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Network:
    """Two layers with standardised inputs; temperature fitted apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60):
        rng = np.random.default_rng(seed)
        back = np.arange(len(x)) % 8 == 0
        if min(y[~back].sum(), (~y[~back].astype(bool)).sum()) < 1:
            self.flat = float(y.mean()) if len(y) else 0.5
            return
        self.flat = None
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.std
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        xt, yt = x[~back], y[~back]
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(xt)), max(1, len(xt) // 128)):
                a, b = xt[part], yt[part]
                h = np.tanh(a @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - b) / len(part)
                back_h = np.outer(d, p[2]) * (1 - h * h)
                g = [a.T @ back_h + 1e-3 * p[0], back_h.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, yb = self._logits(x[back]), y[back]
        grid = np.geomspace(0.25, 8, 61)
        self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, logits / t) - yb * logits / t) for t in grid])])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.std) / self.temperature, -50, 50)))


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, 2 * DIMS).astype(float)


def _scored(network: Network, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = network.score(_stack(batch.column(2).to_pylist()))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def _learnable(labels: DataFrame, id_col: str, label_col: str, most_rows: int) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from: at most most_rows."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    return known.where(~is_held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


def _pool(docs: DataFrame, pool, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pool, "doc_id long, pooled binary")


def _fitted(pooled: DataFrame, known: DataFrame) -> Network:
    rows = pooled.join(known, "doc_id").groupBy("doc_id").agg(F.min("pooled").alias("pooled"), F.first("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return Network(_stack([r["pooled"] for r in rows]), np.round(np.array([r["y"] for r in rows], float)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    sc = docs.sparkSession.sparkContext
    pooled = materialize(_pool(docs, _pooled(*map(sc.broadcast, word_vectors(docs, text_col))), id_col, text_col))
    network = _fitted(pooled, _learnable(labels, id_col, label_col, most_rows))
    return pooled.select("doc_id", is_held_out().alias("held_out"), "pooled").mapInArrow(_scored(network, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of docs predicted 1, with all their columns; texts are scored where they are, without a shuffle.

    Only documents to learn from are pooled before that; their ids are at most most_rows and are broadcast.
    """
    sc = docs.sparkSession.sparkContext
    pool = _pooled(*map(sc.broadcast, word_vectors(docs, text_col)))
    known = materialize(_learnable(labels, id_col, label_col, most_rows))
    own = docs.join(F.broadcast(known.select(F.col("doc_id").alias("_known"))), F.col(id_col).cast("long") == F.col("_known"), "left_semi")
    network = _fitted(_pool(own, pool, id_col, text_col), known)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = pa.record_batch([pa.nulls(batch.num_rows), batch.column(at)], names=["doc_id", "text"])
                good = network.score(_stack(next(pool(iter([own]))).column(1).to_pylist())) >= threshold
                yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
