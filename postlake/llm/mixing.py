"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order, null last, weigh 3, 1, 2 and so on; together they are to fill a share of all words, none
more than twice its own, and what is above is shared again by weight. A document's expected copies are its source's
target over its size: the whole part is certain, the rest a probability. Probabilities are rounded in pairs: one moves
up and the other down, by the same number of words, with chances that keep each one's expectation, until one is 0 or 1.
So a source's words stay the same up to the one document that is left over.

Pairs are made within small groups of each source, larger documents first; each group leaves one document, and those
meet in groups of the next level of a tree until one is left, which is rounded to the nearer side: a source is at most
half that document off its target. A source's groups grow in number, not in size: documents are dealt to them by id and
size, or by row where more than ``SAME`` rows share both.

Defined results: a null or empty text has size 0 and takes nothing; chance comes from hashes of ids, so reruns agree,
and of repeated rows any may get the copies; an empty table gives no row; a text of any length is counted whole; mixed_rows()
carries other columns. Groups hold numbers only, never texts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_lookup, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
GROUP = 2048
FAN_IN = 64
SAME = 64


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len((t.as_py() or b"").split()) for t in batch.column(1).cast(pa.binary())]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *(batch.column(k) for k in range(2, batch.num_columns))], names=["doc_id", "size", *batch.schema.names[2:]])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sized: source, size. One row per source: source, source_size, n_docs, target. Only sums reach the driver."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = stats.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], weights[x[1] % len(weights)]))
    ranked = materialize(sized.sparkSession.createDataFrame(ranked, "source string, source_size long, n_docs long, weight int"))
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, n = 0.0, -1
    while True:
        full = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        at, taken, free = ranked.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if at == n or not free:
            break
        n, level = at, (total - (taken or 0)) / free
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("source_size") * float(most), F.lit(level) * F.col("weight")).alias("target"))


def pivotal(rows: list[tuple[int, float]], chance: random.Random) -> tuple[list[float], int]:
    """rows: (size > 0, probability strictly between 0 and 1). The rounded probabilities, and the place of the one left (-1: none)."""
    x, held = [p for _, p in rows], -1
    for k, (size, _) in enumerate(rows):
        if held < 0:
            held = k
            continue
        other = rows[held][0]
        up, down = min((1 - x[held]) * other, x[k] * size), min(x[held] * other, (1 - x[k]) * size)
        if chance.random() * (up + down) < down:
            x[held] += up / other
            x[k] -= up / size
        else:
            x[held] -= down / other
            x[k] += down / size
        for i in (held, k):
            if min(abs(x[i]), abs(1 - x[i])) < 1e-9:
                x[i] = float(round(x[i]))
        left = [i for i in (held, k) if 0 < x[i] < 1]
        held = left[0] if left else -1
    return x, held


def _round(level: int):
    """Batches ordered by source and group; a group may go on over batches."""

    def rounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "x", "open"]

        def done(key, rows):
            x, left = pivotal([(r[3], r[4]) for r in rows], random.Random(f"{level} {key}"))
            return pa.record_batch([pa.array([r[2] for r in rows], pa.int64()), pa.array(x, pa.float64()), pa.array([i == left for i in range(len(rows))])], names=names)

        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if rows:
                        yield done(key, rows)
                    key, rows = row[:2], []
                rows.append(row)
        if rows:
            yield done(key, rows)

    return rounding


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, group: int = GROUP) -> DataFrame:
    """One row per row of docs: uid (its place by monotonically_increasing_id), doc_id, source, size, source_size, target, copies, taken."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.monotonically_increasing_id().alias("uid"))
    return _mix(own, weights, share, group)


def _mix(own: DataFrame, weights: tuple[int, ...], share: float, group: int) -> DataFrame:
    """own: doc_id, text, source, uid."""
    sized = materialize(own.mapInArrow(_sizes, "doc_id long, size long, source string, uid long"))
    targets = materialize(source_targets(sized, weights, share).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    tied = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).withColumn("tie", F.xxhash64("doc_id", "size"))
    many = tied.groupBy("tie").agg(F.count(F.lit(1)).alias("same")).where(F.col("same") > SAME)
    rows = salted_lookup(salted_lookup(tied, many, ["tie"], "uid"), targets.drop("source"), ["key"], "uid")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(want)).withColumn("x", want - F.floor(want))
    dealt = F.when(F.col("same").isNull(), F.col("tie")).otherwise(F.xxhash64("tie", "uid"))
    rows = materialize(rows.withColumn("n_groups", F.ceil(F.col("n_docs") / group)).withColumn("group", F.pmod(dealt, F.col("n_groups"))).drop("same"))
    todo = rows.where("size > 0 AND x > 1e-9 AND x < 1 - 1e-9")
    depth, most = 0, (targets.agg(F.max(F.ceil(F.col("n_docs") / group))).first()[0] or 1)
    n, decided = shuffle_partitions(own.sparkSession), None
    now = todo.select("key", "group", "uid", "size", "x", "tie", "doc_id")
    while True:
        dealt = now.repartition(n, "key", "group").sortWithinPartitions("key", "group", F.desc("size"), "tie", "doc_id", "uid").select("key", "group", "uid", "size", "x")
        out = materialize(dealt.mapInArrow(_round(depth), "uid long, x double, open boolean"))
        fixed = out.where("NOT open").select("uid", "x")
        decided = fixed if decided is None else decided.unionByName(fixed)
        if most <= 1:
            decided = decided.unionByName(out.where("open").select("uid", F.round("x").alias("x")))
            break
        most, depth = -(-most // FAN_IN), depth + 1
        now = todo.drop("x").join(out.where("open").select("uid", "x"), "uid").select("key", F.expr(f"group div {FAN_IN**depth}").alias("group"), "uid", "size", "x", "tie", "doc_id")
    final = rows.join(decided.withColumnRenamed("x", "rounded"), "uid", "left").withColumn("copies", (F.col("base") + F.coalesce("rounded", F.when(F.col("size") > 0, F.round("x")), F.lit(0))).cast("long"))
    return final.select("uid", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, group: int = GROUP) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns.

    Rows are written once with a number of their own, since a scan planned again may cut the files otherwise.
    """
    rows = materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_uid")))
    own = rows.select(F.col(f"_row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"_row.`{text_col}`").alias("text"), F.col(f"_row.`{source_col}`").cast("string").alias("source"), F.col("_uid").alias("uid"))
    copies = _mix(own, weights, share, group).where("copies > 0").select(F.col("uid").alias("_uid"), "copies")
    return rows.join(copies, "_uid").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
