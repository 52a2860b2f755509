"""Mergeable sketches: distinct counts and quantiles kept by day, so that any span of days is a merge and no rescan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2_BUCKETS = 12
RANKS = 400
#: Three standard errors of a distinct count, and the error of a rank that a quantile sketch of this size keeps to.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LOG2_BUCKETS / 2)
RANK_ERROR = 0.01


def daily(rows: DataFrame, day: Column, by: list[str], distinct: str, value: str) -> DataFrame:
    """day, by, distinct (an HLL sketch), quantiles (a KLL sketch), n: a few kilobytes for each day and group, however many rows."""
    return rows.groupBy(day.alias("day"), *by).agg(
        F.hll_sketch_agg(distinct, F.lit(LOG2_BUCKETS)).alias("distinct"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(RANKS)).alias("quantiles"), F.count(F.lit(1)).alias("n")
    )


def merged(days: DataFrame, by: list[str]) -> DataFrame:
    """by, distinct, quantiles, n over all days given: sketches are merged, rows are not read again."""
    every = F.array_sort(F.collect_list(F.struct("day", "quantiles")))
    out = days.groupBy(*by).agg(F.hll_union_agg("distinct").alias("distinct"), every.alias("_all"), F.sum("n").alias("n"))
    whole = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.col("_all")[0]["quantiles"], lambda a, x: F.kll_sketch_merge_double(a, x["quantiles"]))
    return out.withColumn("quantiles", whole).select(*by, "distinct", "quantiles", "n")


def distinct_of(sketch: str = "distinct") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile_of(share: float, sketch: str = "quantiles") -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
