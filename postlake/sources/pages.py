"""Crawled pages as a data source, in batch and as a stream: ``spark.read.format("crawled_pages")``, once registered.

The path is a Parquet file or a folder of them, in any file system that Arrow reads. A partition is one row group; a
stream's offset is the number of row groups read so far, in order of file names, so a folder that gets more files goes on
where it was. Only the columns asked for, by the option ``columns``, are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = {"page_id": "long", "url": "string", "html": "string"}


@dataclass
class RowGroup(InputPartition):
    file: str
    group: int


def _row_groups(path: str) -> list[RowGroup]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    one = system.get_file_info(at)
    files = [one] if one.is_file else sorted((f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".parquet")), key=lambda f: f.base_name)
    found = []
    for f in files:
        with system.open_input_file(f.path) as opened:
            found += [RowGroup(f.path if isinstance(system, fs.LocalFileSystem) else f"{system.type_name}://{f.path}", g) for g in range(pq.ParquetFile(opened).num_row_groups)]
    return found


def _rows(part: RowGroup, columns: list[str]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(part.file) if "://" in part.file else (fs.LocalFileSystem(), part.file)
    kinds = pa.schema([(c, pa.int64() if SCHEMA[c] == "long" else pa.string()) for c in columns])
    with system.open_input_file(at) as opened:
        for batch in pq.ParquetFile(opened).iter_batches(batch_size=256, row_groups=[part.group], columns=columns):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).cast(kinds.field(c).type) for c in columns], schema=kinds)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def partitions(self) -> list[RowGroup]:
        return _row_groups(self.path)

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.columns)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        return {"groups": len(_row_groups(self.path))}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return _row_groups(self.path)[start["groups"] : end["groups"]]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return _rows(partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


class CrawledPages(DataSource):
    """Options: path; columns, of page_id, url and html, joined by commas (all by default)."""

    @classmethod
    def name(cls) -> str:
        return "crawled_pages"

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options.get("columns", ",".join(SCHEMA)).split(",")]

    def schema(self) -> str:
        return ", ".join(f"{c} {SCHEMA[c]}" for c in self._columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._columns())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._columns())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. The classes travel by value, so Python workers need not have this library."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CrawledPages)
