"""Words of texts with how often they stand there, counted in the task that has the text.

A text is a row before and after: words are not shuffled to be counted, and tables of them hold arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

#: So many words are counted at once, and one text at least.
PART = 1 << 20
_BAG = [T.StructField("word", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.LongType()))]


def parts(batch: pa.RecordBatch, lists: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PART elements of a column of lists."""
    ends = np.cumsum(batch[lists].value_lengths().fill_null(0).to_numpy())
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PART, "right")))
        yield batch.slice(a, b - a)
        a = b


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def rows_of(column: pa.Array) -> np.ndarray:
    """Of each element of a column of lists the row that it is in."""
    return np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts(batch, "word"):
            flat = part["word"].flatten().dictionary_encode()
            kinds = max(1, len(flat.dictionary))
            each, n = np.unique(rows_of(part["word"]) * kinds + flat.indices.to_numpy(), return_counts=True)
            offsets = np.searchsorted(each, np.arange(part.num_rows + 1) * kinds)
            own = [lists(offsets, flat.dictionary.take(pa.array(each % kinds))), lists(offsets, pa.array(n, pa.int64()))]
            yield pa.record_batch([*part.columns[:-1], *own], names=[*part.schema.names, "n"])


def counted(df: DataFrame, words: Column, *kept: str) -> DataFrame:
    """A row for each row of df: the columns kept, then arrays word and n of the distinct elements of ``words``; both empty where it is null."""
    rows = df.select(*kept, words.alias("word"))
    return rows.mapInArrow(_count, T.StructType([*rows.schema.fields[:-1], *_BAG]))
