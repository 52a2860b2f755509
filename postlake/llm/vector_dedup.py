"""Embedding near-dedup by sorted projection passes.

Each pass deals the vectors of a label to cells by their nearest of some random pivots, gives each the signs of its
offset from the cell's mean along random directions, concatenated to one number, and orders the label by cell and
number; vectors that are alike share long prefixes and stand close together. Each is compared with the next ``near``
ones at least, in double precision, and pairs of all passes are united to components. Offsets rather than vectors, since
signs of vectors that share a direction hardly differ.

A window cannot reach all partners in a large group of near copies, so it only has to connect the group: then
all members of each component are compared with each other, tile against tile, and every link inside is counted. Links
never lead out of a component, so a link is lost only where no chain of found pairs joins its two ends. Equal vectors
of a label are one row with a count in all this; their links to each other are counted, not listed.

Passes and window are tied to each label: from its size and its spread around the cells' means, which a sample tells,
follows the chance that one pass finds a pair at the bound; ``passes`` are as many as it takes to find ``RECALL`` of
them, and where that would be over ``MOST``, the window widens instead. Recall against block comparison of a set of
queries is tested in tests/llm for clustered labels.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows whose label is null,
link with nothing and are their own component; vectors of different lengths do not link; repeated rows count as vectors
of their own; a null id is left out of minima; other columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, salted_lookup, shuffle_partitions

COSINE = 0.98
PASSES = 12
BITS = 48
NEAR = 256
TILE = 1024
RECALL = 0.95
MOST = 48
PIVOTS = 64
#: Components of the vectors that the sample may have in all.
SAMPLE = 1 << 21


def _unit(column: pa.ListArray) -> np.ndarray:
    x = column.values.to_numpy(zero_copy_only=False).astype(float)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(dims: int, p: int) -> np.ndarray:
    return np.random.default_rng((dims, p)).normal(size=(dims, BITS))


def _effort(n: int, spread: float, passes: int, near: int, cosine: float) -> tuple[int, int]:
    """Passes and window for n vectors whose squared offsets from their cells' means are spread on average."""
    alike = 1 - math.acos(max(-1.0, 1 - (1 - cosine) / spread)) / math.pi
    power = -math.log2(max(alike, 0.5))
    chance = min(1.0, near / n) ** power
    need = math.ceil(math.log(1 - RECALL) / math.log1p(-chance)) if chance < RECALL else 1
    most = max(passes, MOST)
    if need <= most:
        return max(passes, need), near
    return most, math.ceil(n * (1 - (1 - RECALL) ** (1 / most)) ** (1 / power))


def _fit(sample: pa.Table, counts: dict[tuple[int, int], int], passes: int, near: int, cosine: float) -> dict[tuple[int, int], tuple[int, int, list]]:
    """For each (label, dims) of counts: passes, window, and for each pass the pivots and their thresholds along the directions."""
    labels, vecs = sample.column("label").to_numpy(), sample.column("vec").combine_chunks()
    dims, out, spreads, own = vecs.value_lengths().to_numpy(zero_copy_only=False), {}, {}, {}
    for label, d in counts:
        at = np.flatnonzero((labels == label) & (dims == d))
        if len(at):
            own[label, d] = _unit(vecs.take(pa.array(at)))
    for (label, d), x in own.items():
        pivots = x[np.random.default_rng(d).permutation(len(x))[: _pivots(len(x), counts[label, d], near)]]
        cell = (x @ pivots.T).argmax(1)
        sizes = np.bincount(cell)
        # Cells of few vectors would seem too narrow; in those where a usual pair is a link, windows connect all.
        narrow = np.array([x[cell == c].var(0, ddof=1).sum() if m > 1 else 0.0 for c, m in enumerate(sizes)])
        ok = narrow > 1 - cosine
        spreads[label, d] = float((narrow * sizes)[ok].sum() / sizes[ok].sum()) if ok.any() else 1.0
    for (label, d), n in counts.items():
        tries, window = _effort(n, spreads.get((label, d), min(spreads.values(), default=1.0)), passes, near, cosine)
        models, x = [], own.get((label, d))
        for p in range(tries if x is not None else 0):
            pivots = x[np.random.default_rng((d, p, 1)).permutation(len(x))[: _pivots(len(x), n, near)]]
            cell = (x @ pivots.T).argmax(1)
            means = np.stack([x[cell == c].mean(0) if (cell == c).any() else pivots[c] for c in range(len(pivots))])
            models.append((pivots.astype(np.float32), (means @ _directions(d, p)).astype(np.float32)))
        out[label, d] = (tries, window, models)
    return out


def _pivots(sampled: int, n: int, near: int) -> int:
    return max(1, min(PIVOTS, sampled // 64, n // near))


def _keys(models: dict, passes: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                own = batch.filter(pa.array(sizes == d))
                x, label = _unit(own.column(2)), own.column(1).to_numpy()
                known = [(np.flatnonzero(label == v), models[v, d]) for v in np.unique(label).tolist() if (v, d) in models]
                tries = np.full(len(x), passes)
                for at, model in known:
                    tries[at] = model[0]
                for p in range(tries.max()):
                    bounds, cell = np.zeros((len(x), BITS), np.float32), np.zeros(len(x), np.uint64)
                    for at, model in known:
                        if p < len(model[2]):
                            pivots, along = model[2][p]
                            cell[at] = c = (x[at] @ pivots.T).argmax(1)
                            bounds[at] = along[c]
                    order = (cell << np.uint64(BITS)) | ((x @ _directions(int(d), p) > bounds) @ weights)
                    keep = tries > p
                    part = own.filter(pa.array(keep))
                    yield pa.record_batch([pa.array(np.full(len(part), p, np.int32)), part.column(1), pa.array(np.full(len(part), d, np.int32)), pa.array(order[keep].astype(np.int64)), part.column(0), part.column(2)], names=["pass", "label", "dims", "order", "node", "vec"])

    return keys


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (i, j) among n rows connect: themselves, or a star each where there are many."""
    if len(i) <= n:
        return i, j
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        now = low.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == low).all():
            break
        low = now
    at = np.flatnonzero(low != np.arange(n))
    return low[at], at


def _windows(windows_of: dict[tuple[int, int], int], near: int, cosine: float):
    """Batches in order of (pass, label, dims, order); compares each row with the next ``near`` ones of its label at least, or as many as windows_of tells."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches(([tail] if tail is not None else []) + [batch]).combine_chunks()
            old = tail.num_rows if tail is not None else 0
            kind = np.stack([table.column(c).to_numpy() for c in ("pass", "label", "dims")], 1)
            node, vecs = table.column("node").to_numpy(), table.column("vec").combine_chunks()
            starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]).any(1)])
            for a, b in zip(starts, np.r_[starts[1:], len(node)], strict=True):
                width = windows_of.get((int(kind[a, 1]), int(kind[a, 2])), near)
                x = _unit(vecs.slice(a, b - a))
                for k in range(max(0, old - a - width) if old > a else 0, b - a, near):
                    after = max(k, old - a)  # earlier rows have been compared with each other
                    for to in range(after, min(b - a, k + near + width), 4 * near):
                        end = min(b - a, k + near + width, to + 4 * near)
                        close = x[k : k + near] @ x[to:end].T >= cosine
                        i, j = np.nonzero(close)
                        i, j = i + k, j + to
                        i, j = i[i < j], j[i < j]
                        if len(i):
                            i, j = _forest(i - k, j - k, end - k)
                            yield pa.record_batch([pa.array(node[a + k + i]), pa.array(node[a + k + j])], names=["src", "dst"])
            width = windows_of.get((int(kind[-1, 1]), int(kind[-1, 2])), near)
            tail = table.slice(max(0, table.num_rows - width)).combine_chunks().to_batches()[0]

    return windows


def _tiles(cosine: float):
    """Batches in order of (component, i, j): all of one tile pair together. Yields a count of links for each node."""

    def counts(rows: list[tuple[int, bool, int, list[float]]], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node, first, copies = (np.array(x) for x in list(zip(*rows, strict=True))[:3])
        x = np.array([r[3] for r in rows])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if same:
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            yield node, near @ copies
        else:
            near = x[first] @ x[~first].T >= cosine
            yield node[first], near @ copies[~first]
            yield node[~first], copies[first] @ near

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for *own, node, copies, vec in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                component, i, j, tile = own
                if (component, i, j) != key:
                    if rows:
                        for n, c in counts(rows, key[1] == key[2]):
                            yield pa.record_batch([pa.array(n), pa.array(c.astype(np.int64))], names=["node", "links"])
                    key, rows = (component, i, j), []
                rows.append((node, tile == i, copies, vec))
        if rows:
            for n, c in counts(rows, key[1] == key[2]):
                yield pa.record_batch([pa.array(n), pa.array(c.astype(np.int64))], names=["node", "links"])

    return tiles


def label_near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, passes: int = PASSES, near: int = NEAR, tile: int = TILE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    n = shuffle_partitions(vectors.sparkSession)
    vec = F.col("vec")
    usable = F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(vec, lambda c: c != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).cast("long").alias("label"), F.monotonically_increasing_id().alias("uid"))
    content = F.concat_ws(",", F.col("label").cast("string"), F.transform(vec, lambda c: (c + 0.0).cast("string")))
    rows = rows.withColumn("key", F.when(usable, F.sha2(content, 256)))
    rows = materialize(rows)
    distinct = materialize(rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("uid", "label", "vec")).alias("one"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first")).select("key", F.col("one.uid").alias("node"), "one.label", "one.vec", "copies", "first"))
    dims = F.size("vec").alias("dims")
    counts = {(r.label, r.dims): r.n for r in distinct.groupBy("label", dims).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > near).collect()}
    models = {}
    if counts:
        values = distinct.agg(F.sum(F.size("vec").cast("long"))).first()[0]
        share = min(1 << 20, max(1, (SAMPLE << 20) // values))
        sample = distinct.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 20)) < share).select("label", F.col("vec").cast("array<float>").alias("vec")).toArrow()
        models = _fit(sample, counts, passes, near, cosine)
    keyed = distinct.select("node", "label", "vec").mapInArrow(_keys(models, passes), "pass int, label long, dims int, order long, node long, vec array<double>")
    by = ["pass", "label", "dims", "order", "node"]
    windows = {k: m[1] for k, m in models.items() if m[1] != near}
    pairs = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(_windows(windows, near, cosine), "src long, dst long")
    parts = components(pairs)
    members = materialize(distinct.join(parts, "node"))
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = salted_lookup(members, sizes, ["component"], "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "copies", "vec")
    links = dealt.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(_tiles(cosine), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    lowest = members.groupBy("component").agg(F.min("first").alias("lowest"))
    placed = salted_lookup(members.select("node", "component"), lowest, ["component"], "node").select("node", "lowest").join(links, "node", "left")
    known = distinct.join(placed, "node", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("lowest", "first").alias("lowest"))
    final = salted_lookup(rows.select("vec_id", "uid", "key"), known, ["key"], "uid")
    return final.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("lowest")).alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
