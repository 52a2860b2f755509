"""Filter interaction audit: what each of five filters removes, alone, after others, and in every order.

1. Each partition combines its own rows: of every distinct text, once, which filters it fails, and how many rows it has
   by (id, part). Only these local winners, with the text packed by zstd, are written to the shared folder and routed.
2. They go to partitions by the xxhash of the text. A partition keeps, for every hash, a chain of the different texts
   that have it, each with its least id: full texts are compared, so texts whose hashes collide stay apart. Then it emits
   the ids, and marks those that are not the least of their text.
3. Rows become (id, part, mask) with one bit a filter; their labels are joined; combineByKey merges by part a vector of
   counts by mask: all rows, rows of good quality, toxic rows. 32 x 3 numbers a part are all that the 120 orders need.

A text that a third of all rows hold is one row of each partition to the routing, however many copies there are; a part
that holds most rows is one vector of each partition. Packed texts are frames of one library at one level: equal frames
mean equal texts and the other way round.

Defined results: a null text counts as empty; a null id is above every other; rows of the same id and text are no copies
of each other; a null part is the empty string; a row without a label is neither good nor toxic, and of several labels of
an id the greatest counts; an empty table gives no row; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
MIN_WORDS = 200
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
_UPPER = bytes(range(0x41, 0x5B))
_NOT_FIRST = bytes(range(0x80, 0xC0))  # bytes of a character after its first
_ODD = re.compile(rb"[#$%&*|]")
_E = 1 << FILTERS.index("E")
_LAST = (1, 0)


def fails(text: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    words = text.split()
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < 50 * len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    loud = 100 * upper > 3 * len(text.translate(None, _NOT_FIRST))
    return few | same << 1 | loud << 2 | (_ODD.search(text) is not None) << 3


def _rank(doc_id: int | None) -> tuple[int, int]:
    return _LAST if doc_id is None else (0, doc_id)


LOCAL = "key binary, body binary, mask int, members array<struct<doc_id: bigint, part: string, n: bigint>>"
_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("n", pa.int64())]))


def combine_locally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, text, part) to LOCAL rows, one for each distinct text of all batches."""
    from xxhash import xxh64_digest
    from zstandard import ZstdCompressor

    pack = ZstdCompressor(level=1).compress
    found: dict[bytes, tuple[bytes, int, Counter]] = {}
    for batch in batches:
        for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
            raw = text.as_py() or b""
            body = pack(raw)
            if body not in found:
                found[body] = (xxh64_digest(raw), fails(raw), Counter())
            found[body][2][doc_id, part or ""] += 1
    listed = list(found.items())
    for k in range(0, len(listed), 1024):
        rows = listed[k : k + 1024]
        members = [[{"doc_id": i, "part": p, "n": n} for (i, p), n in m.items()] for _, (_, _, m) in rows]
        yield pa.record_batch([pa.array([r[1][0] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1][1] for r in rows], pa.int32()), pa.array(members, _MEMBERS)], names=["key", "body", "mask", "members"])


def mark_copies(routed: Iterable[tuple]) -> Iterator[tuple]:
    """routed: (key, (body, mask, members)). Yields (id, part, mask, rows), with the bit of E where a smaller id has the text."""
    chains: dict[bytes, list[list]] = {}
    held = []
    for key, (body, mask, members) in routed:
        chain = chains.setdefault(key, [])
        least = min(_rank(m[0]) for m in members)
        link = next((x for x in chain if x[0] == body), None)
        if link is None:
            chain.append(link := [body, least])
        link[1] = min(link[1], least)
        held.append((link, mask, members))
    for link, mask, members in held:
        for doc_id, part, n in members:
            yield doc_id, part, mask | (_E if _rank(doc_id) > link[1] else 0), n


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and a part fail just the filters of a mask."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(part_col).cast("string").alias("part"))
    local: RDD = materialize(rows.mapInArrow(combine_locally, LOCAL)).rdd.map(lambda r: (bytes(r[0]), (bytes(r[1]), r[2], [tuple(m) for m in r[3]])))
    routed = local.partitionBy(shuffle_partitions(spark), lambda key: int.from_bytes(key, "big"))
    return spark.createDataFrame(routed.mapPartitions(mark_copies), "doc_id long, part string, mask int, n long", verifySchema=False)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def _put(vector: np.ndarray, value: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = value
    vector[mask] += (n, good, toxic)
    return vector


def _start(value: tuple[int, int, int, int]) -> np.ndarray:
    return _put(np.zeros((1 << len(FILTERS), 3), np.int64), value)


def ordered_counts(vector: np.ndarray) -> Iterator[tuple]:
    """From counts by mask (all, good, toxic): (filter_order, step, the COUNTS) of every order and step."""
    every = np.arange(len(vector))
    fail = [(every >> k & 1).astype(bool) for k in range(len(FILTERS))]
    alone = [int(vector[1 << k, 0]) for k in range(len(FILTERS))]
    rows, total = [], Counter()
    for order in ORDERS:
        gone = np.zeros(len(vector), bool)
        for step, name in enumerate(order, 1):
            k = FILTERS.index(name)
            now = fail[k] & ~gone
            removed, good, toxic = (int(x) for x in vector[now].sum(0))
            redundant = int(vector[fail[k] & gone, 0].sum())
            gone |= fail[k]
            rows.append((order, step, int(vector[~gone, 0].sum()), removed, redundant, alone[k], good, toxic))
            total[name] += removed
    for row in rows:
        yield *row, total[row[0][row[1] - 1]]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter_order and step, with the COUNTS. labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    own = masks(docs, id_col, text_col, part_col)
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    few = own.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(told, "doc_id", "left")  # an id of many rows is few rows here
    pairs = few.select("part", "mask", "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    vectors = pairs.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(_start, _put, _add)
    rows = vectors.flatMap(lambda kv: [Row(kv[0], *r) for r in ordered_counts(kv[1])])
    return spark.createDataFrame(rows, SCHEMA, verifySchema=False)
