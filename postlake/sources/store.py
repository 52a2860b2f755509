"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it, in local mode only, a folder of our own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="postlake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet, packed by zstd, and read back: each of its columns is computed once, and lost executors lose none."""
    path = f"{shared(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_uri(spark: SparkSession, path: str) -> str | None:
    """The path as Arrow's file systems take it, or null if Arrow knows none for it."""
    from pyarrow import fs

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    whole = "file:///" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole
    try:
        system, inner = fs.FileSystem.from_uri(whole)
        return whole if system.get_file_info(inner).type == fs.FileType.Directory else None
    except (pa.ArrowException, OSError, ImportError):
        return None


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder, in place of what is there under the new name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(target), True)
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be renamed to {target}")


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df written as a table bucketed and sorted by keys: joins and groupings on them read it without a shuffle."""
    spark = df.sparkSession
    name = f"postlake_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{shared(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
