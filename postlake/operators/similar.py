"""Links of similar rows within buckets: tiles of two blocks of rows are compared by matrix products.

A bucket's rows are dealt to blocks of about ``BLOCK`` terms, each written once to a folder of its own; small buckets share
blocks. Each two blocks of a bucket are a tile, whose task reads the two folders: a vector is shuffled and written once,
whatever the number of tiles, and a tile's size is bounded.

In a tile every pair is looked at, part by part, and none is left out that may be similar. First by a bound: terms are dealt to
groups, and x.y is at most the sum over groups of the products of the norms that x and y have there. A few groups tell short
texts apart; parts in which too many pairs are left are done again with twice as many. Of what is left the product is computed;
parts in which that is still much are multiplied whole, in single precision over the terms that both have, and what may be
similar again in double precision. Where only the best link of a row is asked for, no more than a row comes out for each row
and tile.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import arrow_uri, shared, stored

BLOCK, PART = 1 << 20, 512
#: Numbers of groups of terms. A part is done by one of them if no more than 1 of FEW pairs is left; so many pairs are then computed AT_ONCE; tiles of a STRIP share a task.
GROUPS, FEW, AT_ONCE, STRIP = (64, 128, 256, 512, 1024), 64, 1 << 16, 8
_BEST, _PAIR = "id long, original long, score double, home string, part int", "a long, b long, score double"


@dataclass(frozen=True)
class Counts:
    """Vectors as counts, which are small where weights are not. rows: id, bucket, created_at, others, and arrays no and n; a weight is n times the term's idf, over the row's norm."""

    rows: DataFrame
    idf: np.ndarray


@dataclass(frozen=True)
class Packed:
    """Vectors in blocks. rows: id, bucket, created_at, no, w (or n, with idf), others, and the block: home and part; a bucket has one home, which small ones share."""

    rows: DataFrame
    path: str
    idf: np.ndarray | None = None

    @property
    def columns(self) -> tuple[str, ...]:
        return ("id", "bucket", "created_at", "no", "w" if self.idf is None else "n")

    def heads(self) -> DataFrame:
        return self.rows.select("id", "created_at", "home", "part")

    def count(self) -> int:
        return self.rows.count()


def packed(vectors: DataFrame | Counts, rows: DataFrame | None) -> Packed:
    """vectors: id, no, w, a row a term; rows: id, bucket, created_at. Without rows, vectors has all these columns, arrays no and w, and a row a vector, or is Counts. Rows without a bucket are left out."""
    idf = None
    if isinstance(vectors, Counts):
        vectors, idf = vectors.rows, vectors.idf
    if rows is None:
        every = vectors.where("bucket IS NOT NULL").withColumn("created_at", F.col("created_at").cast("long"))
    else:
        v = vectors.groupBy("id").agg(F.collect_list(F.struct("no", "w")).alias("v"))
        own = rows.where("bucket IS NOT NULL").select("id", "bucket", F.col("created_at").cast("long").alias("created_at"))
        every = stored(own.join(v, "id").select("id", "bucket", "created_at", F.col("v.no").alias("no"), F.col("v.w").alias("w")))
    sizes = stored(every.groupBy("bucket").agg(F.sum(F.size("no")).alias("terms")))
    small = F.col("terms") * 2 <= BLOCK
    homes = max(1, -(-(sizes.where(small).agg(F.sum("terms")).first()[0] or 0) // BLOCK))
    large = sizes.where(~small).select("bucket", F.concat(F.lit("b"), F.md5("bucket")).alias("home"), F.ceil(F.col("terms") / BLOCK).cast("int").alias("parts"))  # no more than twice the blocks
    shares = F.concat(F.lit("s"), F.pmod(F.xxhash64("bucket"), F.lit(homes)))
    return _written(every.join(F.broadcast(large), "bucket", "left").withColumns({"home": F.coalesce("home", shares), "parts": F.coalesce("parts", F.lit(1))}), idf)


def _written(rows: DataFrame, idf: np.ndarray | None) -> Packed:
    spark = rows.sparkSession
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "home", "part").write.partitionBy("home", "part").parquet(path, compression="zstd")
    return Packed(spark.read.schema(dealt.schema).parquet(path), path, idf)


def subset(rows: Packed, ids: DataFrame) -> Packed:
    """ids: id, home, part. The rows of ids alone, in as many blocks as they need, with the homes that they have."""
    own = _in_blocks(rows, ids)
    sizes = stored(own.groupBy("home").agg(F.sum(F.size("no")).alias("terms")))
    large = sizes.where(F.col("terms") > BLOCK).select("home", F.ceil(F.col("terms") / BLOCK).cast("int").alias("parts"))
    return _written(own.drop("part").join(F.broadcast(large), "home", "left").withColumn("parts", F.coalesce("parts", F.lit(1))), rows.idf)


def _listed(ids: DataFrame | None, name: str) -> DataFrame | None:
    """Of each block that has any the ids, as an array: its bytes are a small share of the block's."""
    return None if ids is None else ids.groupBy("home", F.col("part").alias(name)).agg(F.collect_list("id").alias(f"of_{name}"))


def _in_blocks(rows: Packed, ids: DataFrame) -> DataFrame:
    spark = rows.rows.sparkSession
    uri = arrow_uri(spark, rows.path)
    if uri is None:
        return rows.rows.join(ids.select("id"), "id", "left_semi")
    fields = [f for f in rows.rows.schema.names if f not in ("home", "part")]

    def read(batches):
        for batch in batches:
            for b in batch.to_pylist():
                t = _folder(uri, b["home"], b["part"], tuple(fields))
                t = t.filter(pa.array(np.isin(t["id"].to_numpy(), b["of_part"])))
                yield from t.append_column("home", pa.repeat(b["home"], len(t))).append_column("part", pa.repeat(pa.scalar(b["part"], pa.int32()), len(t))).to_batches()

    return _listed(ids, "part").mapInArrow(read, rows.rows.select(*fields, "home", "part").schema)


def _folder(uri: str, home: str, part: int, columns: tuple[str, ...]) -> pa.Table:
    """The rows of a block."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/home={home}/part={part}")) if f.is_file and f.extension == "parquet"]
    found = []
    for f in sorted(files):
        with system.open_input_file(f) as opened:
            found.append(pq.ParquetFile(opened).read(list(columns)))
    return pa.concat_tables(found)


def expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of n[k] places from start[k] on, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Block:
    """Rows by bucket. timed: rows without a time are left out."""

    def __init__(self, t: pa.Table, ids: list[int] | None, timed: bool, idf: np.ndarray | None):
        t = t.filter(pa.array(np.isin(t["id"].to_numpy(), ids))) if ids is not None else t
        t = (t.filter(t["created_at"].is_valid()) if timed else t).combine_chunks()
        get = lambda c: pa.concat_arrays(t[c].chunks) if t[c].num_chunks else pa.array([], t.schema.field(c).type)
        self.id, self.at = get("id").to_numpy(), get("created_at").fill_null(0).to_numpy()
        self.n, self.no = get("no").value_lengths().to_numpy(), get("no").flatten().to_numpy()
        self.start = np.cumsum(self.n) - self.n
        self.w = get("w" if idf is None else "n").flatten().to_numpy()
        if idf is not None:
            row, w = np.repeat(np.arange(len(self.n)), self.n), self.w * idf[self.no]
            self.w = w / np.sqrt(np.bincount(row, w * w, len(self.n)))[row]
        bucket = get("bucket").dictionary_encode()
        order = np.argsort(bucket.indices.to_numpy(), kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(bucket.indices.to_numpy(), minlength=len(bucket.dictionary)))])
        self.rows = {b: order[a:e] for b, a, e in zip(bucket.dictionary.to_pylist(), ends[:-1], ends[1:], strict=True)}
        self.sides: dict[str, _Side] = {}

    def side(self, bucket: str, least: float) -> _Side:
        """Of the bucket's rows, kept for the next tile."""
        if bucket not in self.sides:
            self.sides[bucket] = _Side(self, self.rows[bucket], least)
        return self.sides[bucket]


class _Side:
    """Rows of a block's bucket in parts, those of few terms first, each part by id. need: so many terms a similar row has at least."""

    def __init__(self, block: _Block, rows: np.ndarray, least: float):
        rank = np.argsort(np.argsort(block.n[rows], kind="stable"))
        rows = rows[np.lexsort((block.id[rows], rank // PART))]
        self.id, self.at, self.n = block.id[rows], block.at[rows], block.n[rows]
        at = expanded(block.start[rows], self.n)
        self.no, self.w = block.no[at], block.w[at]
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        sums = np.cumsum(np.square(2.0 * self.row - np.sort(2.0 * self.row - self.w)))  # of each row the largest first: weights are 1 at most
        before = np.concatenate([[0.0], sums])[self.start[:-1]]
        self.need = 1 + np.add.reduceat(sums - before[self.row] < least * least - 1e-6, self.start[:-1], dtype=np.int64)
        self.parts = [(k, min(k + PART, len(self.n))) for k in range(0, len(self.n), PART)]
        self.terms = [np.unique(self.no[self.start[a] : self.start[b]]) for a, b in self.parts]

    def dense(self, p: int, dims: np.ndarray, kind: type) -> np.ndarray:
        a, b = self.parts[p]
        s = slice(self.start[a], self.start[b])
        place = np.full(1 + max(int(self.no[s].max()), int(dims[-1])), -1)
        place[dims] = np.arange(len(dims))
        at = place[self.no[s]]
        ok = at >= 0
        out = np.zeros((b - a, len(dims)), kind)
        out[self.row[s][ok] - a, at[ok]] = self.w[s][ok]
        return out

    def norms(self, p: int, group: np.ndarray, groups: int) -> np.ndarray:
        """Of each row of a part its norm in each group of terms."""
        a, b = self.parts[p]
        s = slice(self.start[a], self.start[b])
        return np.sqrt(np.bincount((self.row[s] - a) * groups + group[self.no[s]], np.square(self.w[s]), (b - a) * groups)).astype(np.float32).reshape(b - a, groups)


def _products(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each pair of a row of x and one of y, given in order of x's rows, the product."""
    own, at = np.unique(i, return_inverse=True)
    size, out = 1 + int(max(x.no.max(), y.no.max())), np.empty(len(i))
    many = max(1, min(64, (1 << 20) // size))
    for k in range(0, len(own), many):
        rows = own[k : k + many]
        dense, n = np.zeros((len(rows), size)), x.n[rows]
        p = expanded(x.start[rows], n)
        dense[np.repeat(np.arange(len(rows)), n), x.no[p]] = x.w[p]
        a, b = np.searchsorted(at, (k, k + many))
        for c in range(a, b, 4096):
            pairs = slice(c, min(c + 4096, b))
            n = y.n[j[pairs]]
            p = expanded(y.start[j[pairs]], n)
            out[pairs] = np.add.reduceat(dense[np.repeat(at[pairs] - k, n), y.no[p]] * y.w[p], np.cumsum(n) - n)
    return out


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


def _few(x: _Side, y: _Side, todo: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similar pairs as row numbers in x, in y, and scores, of the parts of which a bound leaves few; these are done in ``todo``. Of one side, pairs come once."""
    size = 1 + int(max(x.no.max(), y.no.max()))
    mass = np.bincount(x.no, np.square(x.w), size) + np.bincount(y.no, np.square(y.w), size)
    rank, kinds = np.empty(size, np.int64), np.count_nonzero(mass)
    rank[np.argsort(-mass, kind="stable")] = np.arange(size)
    mean = lambda s: np.array([s.n[a:b].mean() for a, b in s.parts])
    start = np.minimum(0.75 * np.sqrt(np.outer(mean(x), mean(y))), GROUPS[-1])
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def scored():
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        o = np.argsort(i, kind="stable")
        i, j = i[o], j[o]
        score = _rounded(_products(x, y, i, j))
        ok = score >= least
        pairs.clear()
        return i[ok], j[ok], score[ok]

    waiting = 0
    for groups in GROUPS:
        if groups * 4 > kinds:
            break
        own = groups // 4 if groups >= 256 else 0  # terms that have most weight are groups of their own
        group = np.where(rank < own, rank, own + (rank - own) % (groups - own))
        norms = lru_cache(None)(lambda one, p, group=group, groups=groups: (x if one else y).norms(p, group, groups))
        for p, q in np.argwhere(todo & (start <= groups)):
            near = norms(True, p) @ norms(x is y, q).T >= least - 1e-4
            if x is y and p == q:
                near = np.triu(near, 1)
            n = np.count_nonzero(near)
            if n * FEW > near.size:
                continue
            todo[p, q] = False
            if n:
                i, j = np.nonzero(near)
                pairs.append((i + x.parts[p][0], j + y.parts[q][0]))
                waiting += n
                if waiting > AT_ONCE:
                    yield scored()
                    waiting = 0
    if pairs:
        yield scored()


def _many(x: _Side, y: _Side, p: int, q: int, least: float):
    """Row numbers in x, in y, and their matrix of scores, 0 where they are not similar, of two parts; None if there are none."""
    dims = np.intersect1d(x.terms[p], y.terms[q], assume_unique=True)
    if not len(dims):
        return None
    near = x.dense(p, dims, np.float32) @ y.dense(q, dims, np.float32).T >= least - 1e-4
    if x is y and p == q:
        np.fill_diagonal(near, False)
    i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(i):
        return None
    score = _rounded(x.dense(p, dims, np.float64)[i] @ y.dense(q, dims, np.float64)[j].T)
    return i + x.parts[p][0], j + y.parts[q][0], np.where((score >= least) & near[np.ix_(i, j)], score, 0.0)


def _older(x: _Side, y: _Side, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x its best older row of y: y's rows are in order of id, so the first of the best has the smallest."""
    score = np.where(x.at[i][:, None] > y.at[j][None, :], score, 0.0)
    k, at = score.argmax(1), np.arange(len(i))
    ok = score[at, k] > 0
    return x.id[i][ok], y.id[j[k]][ok], score[at, k][ok]


def _best(id_: np.ndarray, original: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id the best score, ties to the smaller original."""
    o = np.lexsort((original, -score, id_))
    first = np.concatenate([[True], id_[o][1:] != id_[o][:-1]]) if len(o) else o
    return tuple(v[o][first] for v in (id_, original, score))


def _links(x: _Side, y: _Side, least: float, best: bool, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similar rows of two sides, as the columns that come out. both: rows of y look for older ones in x too."""
    some = lambda s: [(s.n[a:b].max(), s.need[a:b].min()) for a, b in s.parts]
    todo = np.array([[n >= d and m >= c for m, d in some(y)] for n, c in some(x)])
    if x is y:
        todo = np.triu(todo)
    if len(x.n) * len(y.n) > PART * PART // 4:
        for i, j, score in _few(x, y, todo, least):
            if best:
                for one, k, other, m in ((x, i, y, j), (y, j, x, i))[: 1 + both]:
                    ok = one.at[k] > other.at[m]
                    if ok.any():
                        yield _best(one.id[k][ok], other.id[m][ok], score[ok])
            else:
                yield np.minimum(x.id[i], y.id[j]), np.maximum(x.id[i], y.id[j]), score
    for p, q in np.argwhere(todo):
        if (found := _many(x, y, p, q, least)) is None:
            continue
        i, j, score = found
        if best:
            yield _older(x, y, i, j, score)
            if both:
                yield _older(y, x, j, i, score.T)
        else:
            r, c = np.nonzero(score)
            one, two, got = x.id[i[r]], y.id[j[c]], score[r, c]
            ok = (one < two) if x is y and p == q else slice(None)
            yield np.minimum(one, two)[ok], np.maximum(one, two)[ok], got[ok]


def _tile(x: _Block, y: _Block, least: float, best: bool, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The links of a tile; of one block with itself x is y."""
    out = []
    for bucket, rows in x.rows.items():
        if bucket not in y.rows or (x is y and len(rows) < 2):
            continue
        for found in _links(x.side(bucket, least), y.side(bucket, least), least, best, both):
            if best:
                out.append(found)
                if sum(len(o[0]) for o in out[-64:]) > 1 << 20:
                    out = [_best(*(np.concatenate(c) for c in zip(*out, strict=True)))]
            elif len(found[0]):
                yield found
    if out:
        yield _best(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _batch(found: tuple, best: bool, home: str, parts: tuple[int, int], own: np.ndarray | None) -> pa.RecordBatch:
    """own: ids of the first block, where rows of both come out."""
    if not best:
        return pa.record_batch(dict(zip(("a", "b", "score"), map(pa.array, found), strict=True)))
    part = np.full(len(found[0]), parts[0], np.int32) if own is None else np.where(np.isin(found[0], own), *parts).astype(np.int32)
    return pa.record_batch([*map(pa.array, found), pa.repeat(home, len(part)), pa.array(part)], names=["id", "original", "score", "home", "part"])


def _compared(rows: Packed, among: Packed | None, least: float, best: bool, own: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """Tiles of rows with rows of ``among``; without it, of rows with each other. own, others: id, home, part of the rows that count, of rows and of ``among``."""
    spark, one_set = rows.rows.sparkSession, among is None
    blocks = lambda r, ids, name: r.rows.select("home", F.col("part").alias(name)).distinct() if ids is None else _listed(ids, name)
    left, right = blocks(rows, own, "i"), blocks(rows if one_set else among, own if one_set else others, "j")
    tiles = left.join(right, "home")
    tiles = stored(tiles.where("i <= j") if one_set else tiles)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tiles.count() // 16)
    uris = [arrow_uri(spark, r.path) for r in ((rows,) if one_set else (rows, among))]
    columns, idf = rows.columns, rows.idf

    def run(home: str, i: int, j: int, x: _Block, y: _Block) -> Iterator[pa.RecordBatch]:
        both = one_set
        for found in _tile(x, y, least, best, both):
            yield _batch(found, best, home, (i, j), x.id if both else None)

    if None in uris:
        return _shuffled(rows, among, tiles, tasks, run, best)

    def read(batches):
        last = None, None
        for batch in batches:
            for t in batch.to_pylist():
                key = (t["home"], t["i"])
                if last[0] != key:
                    last = None, None
                    last = key, _Block(_folder(uris[0], *key, columns), t.get("of_i"), best, idf)
                x = last[1]
                y = x if one_set and t["i"] == t["j"] else _Block(_folder(uris[-1], t["home"], t["j"], columns), t.get("of_j"), best, idf)
                yield from run(t["home"], t["i"], t["j"], x, y)

    dealt = tiles.repartition(tasks, "home", "i", F.floor(F.col("j") / STRIP)).sortWithinPartitions("home", "i", "j")
    return dealt.mapInArrow(read, _BEST if best else _PAIR)


def _shuffled(rows: Packed, among: Packed | None, tiles: DataFrame, tasks: int, run, best: bool) -> DataFrame:
    """The tiles with their rows, shuffled to them once for each tile: for shared folders that Arrow can't read."""
    one_set, columns, idf = among is None, rows.columns, rows.idf

    def side(r: Packed, k: str, number: int) -> DataFrame:
        own = tiles.withColumn("part", F.col(k)).join(r.rows.select(*columns, "home", "part"), ["home", "part"])
        own = own.where(F.array_contains(f"of_{k}", F.col("id"))) if f"of_{k}" in tiles.columns else own
        return own.select("home", "i", "j", *columns, F.lit(number).alias("side"))

    both = side(rows, "i", 0).unionByName(side(rows, "j", 1).where("i < j") if one_set else side(among, "j", 1))

    def grouped(key: tuple, t: pa.Table) -> pa.Table:
        home, i, j = (k.as_py() for k in key)
        one, two = (_Block(t.filter(pa.array(t["side"].to_numpy() == k)), None, best, idf) for k in (0, 1))
        kinds = {"id": pa.int64(), "original": pa.int64(), "score": pa.float64(), "home": pa.string(), "part": pa.int32()} if best else {"a": pa.int64(), "b": pa.int64(), "score": pa.float64()}
        return pa.Table.from_batches(run(home, i, j, one, one if one_set and i == j else two), pa.schema(kinds))

    return both.repartition(tasks, "home", "i", "j").groupBy("home", "i", "j").applyInArrow(grouped, _BEST if best else _PAIR)


def links(rows: Packed, least: float, among: Packed | None = None, own: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """What ``best_older`` gives, with the block of each row that has a link: home, part. own, others: id, home, part; only these of rows, and of ``among``, count."""
    found = _compared(rows, among, least, True, own, others)
    best = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("original")).alias("o"))).alias("best"), F.first("home").alias("home"), F.first("part").alias("part"))
    return best.select("id", (-F.col("best.o")).alias("original"), "best.score", "home", "part")


def best_older(rows: Packed, least: float, among: Packed | None = None, own: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """rows, among: as ``packed`` gives them. id, original, score: of each row the most similar strictly older row of its bucket in ``among``.

    Scores, which are over 0, are rounded to 6 places, those under ``least`` do not count, ties go to the smaller id. Without ``among``, rows are compared with each other.
    """
    return links(rows, least, among, own, others).select("id", "original", "score")


def all_pairs(rows: Packed, least: float, own: DataFrame | None = None) -> DataFrame:
    """rows: as ``packed`` gives them. Pairs (a < b) of a bucket with score >= least, rounded to 6 places."""
    return _compared(rows, None, least, False, own)
