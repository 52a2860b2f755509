"""Exact dedup by skew-safe combining: locally, then within salted digest groups, then over salt winners.

Each Arrow batch is combined first: one row for each of its distinct texts, with the ids of that text's rows (at most
a batch of them). Local winners meet by (digest, salt), the salt being that of their partition, so a text that a third
of all rows share is dealt to many tasks. Only salt winners meet by digest. Every stage groups by the digest and the
whole content, so a collision of digests cannot merge different texts. Membership travels as pointers: row, local
winner, salt winner, final winner; no join has a text's digest as its key, and none is skewed.

The content is shuffled as a zstd frame, made by one library at one level: equal frames mean equal contents and the
other way round.

Defined results: a null text counts as empty; a null doc_id is below every other; among rows with the same text and the
same largest doc_id one stays; an empty table gives an empty result; other columns are carried by keep_one(); a text of
any length is compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SALTS = 64
_LOCAL = "digest string, salt int, body binary, id long, uid long, members array<struct<doc_id: long, uid: long>>"


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _locally(salts: int, digest: Callable[[bytes], str]):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        uid, pack = part << 33, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            groups: dict[bytes, list[dict]] = {}
            for doc_id, text in zip(ids, texts, strict=True):
                groups.setdefault(text or b"", []).append({"doc_id": doc_id, "uid": uid})
                uid += 1
            best = [max(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["uid"])) for g in groups.values()]
            yield pa.record_batch(
                [
                    pa.array([digest(t) for t in groups], pa.string()),
                    pa.array([part % salts] * len(groups), pa.int32()),
                    pa.array([pack(t) for t in groups], pa.binary()),
                    pa.array([b["doc_id"] for b in best], pa.int64()),
                    pa.array([b["uid"] for b in best], pa.int64()),
                    pa.array(list(groups.values()), pa.list_(pa.struct([("doc_id", pa.int64()), ("uid", pa.int64())]))),
                ],
                names=["digest", "salt", "body", "id", "uid", "members"],
            )

    return combine


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[bytes], str] = sha256_hex) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (that is, digest)."""
    local = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_locally(salts, digest), _LOCAL)
    salted = Window.partitionBy("digest", "salt", "body")
    merged = local.select("digest", "body", "members", "uid", F.max(F.struct("id", "uid")).over(salted).alias("winner"), F.sum(F.size("members")).over(salted).alias("n"))
    merged = materialize(merged.withColumn("body", F.when(F.col("uid") == F.col("winner.uid"), F.col("body"))))  # from here on only salt winners have the content
    whole = Window.partitionBy("digest", "body")
    final = (
        merged.where(F.col("uid") == F.col("winner.uid"))
        .select(F.col("uid").alias("salt_uid"), F.max("winner").over(whole).alias("keep"), F.sum("n").over(whole).alias("group_size"))
    )
    rows = merged.select("digest", F.col("winner.uid").alias("salt_uid"), "members").join(final, "salt_uid")
    return rows.select("digest", "keep", "group_size", F.explode("members").alias("row")).select(
        F.col("row.doc_id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", (F.col("row.uid") == F.col("keep.uid")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, one with the largest id.

    Both steps are hash or sort aggregations on the digest and the whole text, so each map task combines its own rows
    before the shuffle; the salt spreads the rows of a hot text.
    """
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(id_col).cast("long").alias("_id"), F.monotonically_increasing_id().alias("_uid"), row.alias("_row"))
    own = own.select("_text", F.struct("_id", "_uid").alias("_rank"), F.col("_row").dropFields(f"c{cols.index(text_col)}").alias("_row") if len(cols) > 1 else F.col("_row"), F.col(f"_row.c{cols.index(text_col)}").isNull().alias("_null"))
    own = own.withColumn("_digest", F.sha2("_text", 256)).withColumn("_salt", F.pmod(F.shiftright("_rank._uid", 33), F.lit(salts)).cast("int"))
    best = F.max_by(F.struct("_row", "_null", "_rank"), "_rank").alias("_best")
    local = own.groupBy("_digest", "_salt", "_text").agg(best).select("_digest", "_text", "_best.*")
    kept = local.groupBy("_digest", "_text").agg(best)
    text = F.when(~F.col("_best._null"), F.col("_text"))
    return kept.select(*[(text if c == text_col else F.col(f"_best._row.c{i}")).alias(c) for i, c in enumerate(cols)])
