"""Every query that has SQL gives the rows of its SQL; the others run."""

from __future__ import annotations

import pytest
from support import DATA, compare

from postlake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    compare(catalogue.QUERIES[name](spark, str(DATA)), duck, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
