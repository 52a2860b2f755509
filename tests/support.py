"""The test data, and the comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter
from pathlib import Path

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value as both engines have it: numbers by value, times as text, nothing rounded but doubles to 9 places."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, duck, sql: str) -> int:
    """Fails unless df's rows are those of sql; returns their number."""
    found = duck.execute(sql)
    want_names = [d[0] for d in found.description]
    want = rows_of(want_names, found.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(want_names)
    more, less = got - want, want - got
    assert not more and not less, f"only in Spark: {list(more.items())[:3]}; only in SQL: {list(less.items())[:3]}"
    return sum(got.values())
