"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; without it, in local mode only, a folder of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="postlake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def _stored(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    return _stored(df, codec)[0]


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by key as its tasks have it: what groups or joins by key reads it without a shuffle. For rows of megabytes."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = df.write.bucketBy(buckets, key).options(**{"path": path, "compression": "zstd", "parquet.page.size.row.check.min": 1, "parquet.block.size": 1 << 25})
    rows.saveAsTable(name)
    _written.append(path)
    return spark.table(name)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that materialize() or bucketed() wrote."""
    if (name := path.rpartition("/")[2]).startswith("llm_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes all tables that materialize() and bucketed() wrote in this process. For when no result that reads them is needed any more."""
    for path in list(_written):
        remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(left: DataFrame, dim: DataFrame, keys: list[str], spread: str, salts: int = 16) -> DataFrame:
    """Left join to a table with one row per key, where a few keys may hold most rows of left.

    Rows of left take one of ``salts`` salts by the hash of ``spread``; each row of dim is repeated for every salt, so
    a hot key's rows are dealt to ``salts`` tasks. Null keys match nothing.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    wide = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(wide, [*keys, "_salt"], "left").drop("_salt")


def hot_safe_join(left: DataFrame, dim: DataFrame, keys: list[str], rows: str, spread: str, salts: int = 64, part: int = 1000, total: int | None = None) -> DataFrame:
    """Inner join to a table with one row per key, of which some keys may hold much of left; left: a table as read, or total tells its rows, or more.

    dim's column ``rows`` tells how many rows of left have the key. Keys with over 1/part of left's rows are hot; there
    are fewer than ``part`` of them, so their list has a proven bound and is broadcast. Only their rows are salted.
    """
    least = (left.count() if total is None else total) / part
    hot = F.broadcast(dim.where(F.col(rows) > least).select(*keys, F.lit(salts).alias("_salts")))
    salted = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    wide = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > least, salts - 1).otherwise(0))))
    return salted.join(wide, [*keys, "_salt"]).drop("_salt")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), for nodes with an edge; component is the smallest node.

    edges: two long columns, src and dst. Alternates the large-star and small-star steps until no edge changes; each
    round is written to the shared folder, and the one before deleted. Hubs need no list of neighbours: a round only
    takes minima by node.
    """
    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct()
    (e, path), last = _stored(e), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).withColumn("low", F.least("low", "src"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.explode(F.array(F.struct("src", F.col("low").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")))).alias("e")).select("e.*")
        e, now_at = _stored(small.where("src > dst").distinct())
        remove(edges.sparkSession, path)
        path = now_at
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
