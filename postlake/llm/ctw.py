"""Language-model scores by context-tree weighting over bytes, and by a smoothed unigram model over words.

A text is its words, lower-cased (A-Z), joined by one space and ended by a line feed, which no word holds. A byte is
eight binary decisions, each with a context tree of its own over the bytes before, up to ``depth`` of them (before the
text stand line feeds). A node of a tree has the counts of both decisions in the training texts. Its Krichevsky-Trofimov
estimate Pe is weighted with its children's: Pw = Pe / 2 + product of Pw / 2, and Pw = Pe at full depth. The probability of a
byte mixes the estimates of all depths on its path, each with the weight that training left to it. Training ends before
scoring: a text's probability does not depend on other texts scored.

The work is relational, and no part of the model is held whole anywhere:

1. Texts are cut into chunks (one input partition, or ``CHUNK`` bytes of it) and written once, with the distinct grams of
   each chunk (context and byte as one number) and its distinct words, with their counts in its training texts.
2. Grams are summed over chunks. Trees are built upwards, a depth at a time: a table of nodes, (context, decision), is
   grouped by the context without its earliest byte. Then mixtures go downwards, a join of a depth with the one above.
3. Log-probabilities of grams, and counts of words that several chunks hold, go back to the chunks that hold them, and meet
   the texts there. What a task holds is bounded by its chunk, and what is sent grows with the input.

Defined results: a null or empty text is the end alone; a row with a null id is learnt from; repeated rows count and give
a row each; without training texts every decision is 1/2 and a word's share is 1 (of the end too); an empty table
gives no row; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

DEPTH = 4
#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK = 32 << 20
#: Bytes whose grams are counted, and scored, at once.
_BLOCK, _SCORED_AT_ONCE = 1 << 21, 1 << 18
END = b"\n"
_PARTS = "chunk long, doc_id long, held_out boolean, body binary, gram long, word binary, n long"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words."""
    return (text or b"").lower().split()


def gram_keys(bodies: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each body its context and itself as one number: the latest context byte is the most significant."""
    joined = np.frombuffer((END * depth).join([b"", *bodies]), np.uint8)
    n = len(joined) - depth
    keys = np.zeros(n, np.int64)
    for k in range(1, depth + 1):
        keys = (keys << 8) | joined[depth - k : depth - k + n]
    keys = (keys << 8) | joined[depth:]
    size = np.array([len(b) for b in bodies])
    start = np.cumsum(size + depth) - size - depth
    real = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))
    return keys[real]


class _Counts:
    """Distinct grams with their counts, merged block by block."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, weight: int) -> None:
        found, n = np.unique(keys, return_counts=True)
        keys, n = np.concatenate((self.keys, found)), np.concatenate((self.n, n * weight))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = keys[starts], np.add.reduceat(n[order], starts) if len(starts) else n


class _Lookup:
    """Values by key, for many keys at once: an open table over the keys' mixed bits, which are compared in full. Every key asked for must be there."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        mixed = keys.astype(np.uint64) * self._MIX
        order = np.argsort(mixed)
        self.mixed, self.values = mixed[order], values[order]
        bits = len(keys).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.mixed, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * self._MIX
        at = self.start[(mixed >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.mixed[at] != mixed)
        while len(todo):
            at[todo] += 1
            todo = todo[self.mixed[at[todo]] != mixed[todo]]
        return self.values[at]


def _cut(depth: int, chunk_bytes: int):
    def rows(chunk, doc_id, held_out, body, gram, word, n) -> pa.RecordBatch:
        size = next(len(x) for x in (body, gram, word) if x is not None)
        none = lambda t: pa.nulls(size, t)
        return pa.record_batch(
            [
                pa.array(np.full(size, chunk, np.int64)), none(pa.int64()) if doc_id is None else doc_id, none(pa.bool_()) if held_out is None else held_out,
                none(pa.binary()) if body is None else body, none(pa.int64()) if gram is None else pa.array(gram), none(pa.binary()) if word is None else pa.array(word, pa.binary()),
                none(pa.int64()) if n is None else pa.array(n, pa.int64()),
            ],
            names=[c.split()[0] for c in _PARTS.split(", ")],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        held, grams, words, blocks, sizes = 0, _Counts(), Counter(), ([], []), [0, 0]

        def counted(weight: int) -> None:
            if blocks[weight]:
                grams.add(gram_keys(blocks[weight], depth), weight)
                blocks[weight].clear()
                sizes[weight] = 0

        def closing() -> Iterator[pa.RecordBatch]:
            for weight in (0, 1):
                counted(weight)
            for a in range(0, len(grams.keys), 1 << 18):
                yield rows(chunk, None, None, None, grams.keys[a : a + (1 << 18)], None, grams.n[a : a + (1 << 18)])
            listed = sorted(words)
            for a in range(0, len(listed), 1 << 16):
                part = listed[a : a + (1 << 16)]
                yield rows(chunk, None, None, None, None, part, [words[w] for w in part])

        for batch in batches:
            out = []
            for text, out_of in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                own = tokens(text.as_py())
                body = b" ".join(own) + END
                own.append(END)
                if out_of:
                    for w in own:
                        words[w] += 0
                else:
                    words.update(own)
                weight = 0 if out_of else 1
                blocks[weight].append(body)
                sizes[weight] += len(body)
                if sizes[weight] > _BLOCK:
                    counted(weight)
                out.append(body)
                held += len(body)
            yield rows(chunk, batch.column(0), batch.column(2), pa.array(out, pa.binary()), None, None, None)
            if held > chunk_bytes:
                yield from closing()
                chunk, held, grams, words = chunk + 1, 0, _Counts(), Counter()
        yield from closing()

    return cut


def _log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1/2: Stirling's series at x + 8, and the steps back."""
    y = x + 8
    back = F.log(x * (x + 1) * (x + 2) * (x + 3)) + F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - back


def _log_estimate(n0: Column, n1: Column) -> Column:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any given order."""
    return F.when(n0 + n1 == 0, F.lit(0.0)).otherwise(_log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - F.lit(math.log(math.pi)))


def tree(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """grams: gram, n (in training; 0 for those only to be scored), a row a gram. Returns (gram, logp), natural logarithms.

    A decision is 1 followed by the bits decided before it in the byte: 1 to 255.
    """
    byte = "cast(gram & 255 AS int)"
    bits = F.expr(f"transform(sequence(0, 7), b -> named_struct('decision', shiftleft(1, b) + shiftright({byte}, 8 - b), 'bit', shiftright({byte}, 7 - b) & 1))")
    cells = grams.select("gram", "n", F.shiftright("gram", 8).alias("context"), F.explode(bits).alias("e")).select("gram", "n", "context", "e.*")
    ones = F.when(F.col("bit") == 1, F.col("n")).otherwise(0)
    level = materialize(
        cells.groupBy("context", "decision").agg(F.sum(F.col("n") - ones).alias("n0"), F.sum(ones).alias("n1")).withColumn("own", _log_estimate(F.col("n0"), F.col("n1"))).withColumn("weighted", F.col("own"))
    )  # of full depth
    levels = [level]
    half = F.lit(math.log(0.5))
    for _ in range(depth):
        up = level.groupBy(F.shiftright("context", 8).alias("context"), "decision").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        up = up.withColumn("own", _log_estimate(F.col("n0"), F.col("n1")))
        high, low = F.greatest("own", "below"), F.least("own", "below")
        level = materialize(up.withColumn("weighted", half + high + F.log1p(F.exp(low - high))).drop("below"))
        levels.append(level)
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    stay = F.least(F.exp(half + F.col("own") - F.col("weighted")), F.lit(1.0))
    done = levels[-1].select("context", "decision", (stay * estimate).alias("mixed"), (1 - stay).alias("left"))
    if not depth:
        done = levels[-1].select("context", "decision", estimate.alias("mixed"), F.lit(0.0).alias("left"))
    for k in range(depth - 1, -1, -1):
        above = done.select(F.col("context").alias("above"), "decision", F.col("mixed").alias("mixed_above"), F.col("left").alias("left_above"))
        share = stay if k else F.lit(1.0)
        down = levels[k].withColumn("above", F.shiftright("context", 8)).join(above, ["above", "decision"])
        done = materialize(down.select("context", "decision", (F.col("mixed_above") + F.col("left_above") * share * estimate).alias("mixed"), (F.col("left_above") * (1 - share)).alias("left")))
    each = cells.select("gram", "context", "decision", "bit").join(done.select("context", "decision", "mixed"), ["context", "decision"])
    return each.groupBy("gram").agg(F.sum(F.log(F.when(F.col("bit") == 1, F.col("mixed")).otherwise(1 - F.col("mixed")))).alias("logp"))


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, train_tokens long"


def _score(depth: int):
    def score(texts: pa.Table, model: pa.Table) -> pa.Table:
        grams = model.filter(pc.is_valid(model.column("gram")))
        logp = _Lookup(*(grams.column(c).to_numpy() for c in ("gram", "value")))
        ids, out_of, bodies = texts.column("doc_id"), texts.column("held_out"), texts.column("body").to_pylist()
        words: dict[bytes, int] = Counter()
        for body, out in zip(bodies, out_of.to_pylist(), strict=True):
            if not out:
                words.update((*body.split(), END))
        elsewhere = model.filter(pc.is_valid(model.column("word")))
        words = dict(words) | dict(zip(elsewhere.column("word").to_pylist(), elsewhere.column("value").cast(pa.int64()).to_pylist(), strict=True))
        train, kinds = (texts.column(c)[0].as_py() for c in ("train", "kinds"))
        under = math.log10(train + 0.1 * (kinds + 1))
        n_tokens, n_known, base, scores = ([0] * len(bodies) for _ in range(4))
        start = 0
        while start < len(bodies):
            end, held = start, 0
            while end < len(bodies) and (end == start or held + len(bodies[end]) <= _SCORED_AT_ONCE):
                held += len(bodies[end])
                end += 1
            part = bodies[start:end]
            each = logp.of(gram_keys(part, depth))
            cuts = np.cumsum([len(b) for b in part])
            for k, s in enumerate(np.add.reduceat(each, np.concatenate(([0], cuts[:-1])))):
                scores[start + k] = float(s) / math.log(10)
            start = end
        for k, body in enumerate(bodies):
            counts = np.array([words.get(w, 0) for w in (*body.split(), END)])
            n_tokens[k], n_known[k] = len(counts), int((counts > 0).sum())
            base[k] = float((np.log10(counts + 0.1) - under).sum())
        return pa.table([ids, out_of, pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array([len(b) for b in bodies], pa.int64()), texts.column("train")], names=[c.split()[0] for c in _SCORED.split(", ")])

    return score


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_of: Column | None = None, depth: int = DEPTH, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    out_of: which rows are not learnt from (by default a tenth, by a checksum of the id). Scores are log10 probabilities.
    depth: context bytes, at most 6.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (held_out(F.col(id_col)) if out_of is None else out_of).alias("held_out"))
    parts = materialize(own.mapInArrow(_cut(depth, chunk_bytes), _PARTS), "zstd")
    grams = parts.where("gram IS NOT NULL").select("chunk", "gram", "n")
    logs = tree(materialize(grams.groupBy("gram").agg(F.sum("n").alias("n"))), depth)
    per_word = Window.partitionBy("word")
    words = parts.where("word IS NOT NULL").select("chunk", "word", "n", F.sum("n").over(per_word).alias("all"), (F.row_number().over(per_word.orderBy("chunk")) == 1).alias("first"))
    words = materialize(words.where("first OR all <> n"), "zstd")
    train = parts.where("word IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train"))
    kinds = words.where("first AND all > 0").agg(F.count(F.lit(1)).alias("kinds"))
    texts = parts.where("body IS NOT NULL").select("chunk", "doc_id", "held_out", "body").crossJoin(F.broadcast(train.crossJoin(kinds)))  # one row
    model = grams.join(logs, "gram").select("chunk", "gram", F.lit(None).cast("binary").alias("word"), F.col("logp").alias("value"))
    model = model.unionByName(words.where("all <> n").select("chunk", F.lit(None).cast("long").alias("gram"), "word", F.col("all").cast("double").alias("value")))
    model = model.select(F.col("chunk").alias("at"), "gram", "word", "value")
    scored = texts.groupBy("chunk").cogroup(model.groupBy("at")).applyInArrow(_score(depth), _SCORED)
    return scored.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
