"""Distinct counts and percentiles by round, from sketches that merge without their rows.

A HyperLogLog sketch of 2**LG registers has a relative standard error of about 1.04 / sqrt(2**LG); a KLL sketch of
size K has a rank error of about 1.65 / K for single queries at 99 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 12, 400


def by_round(rows: DataFrame, keys: list[str], item: str, value: str, lg: int = LG, k: int = K) -> DataFrame:
    """rows -> keys, n, items (HyperLogLog of ``item``), spread (KLL of ``value``): one row for each round and group, to be stored."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(item), F.lit(lg)).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("spread"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sketches rolled up to fewer keys."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("spread").alias("spread"))


def distinct_of(items: Column) -> Column:
    return F.hll_sketch_estimate(items)


def percentile_of(spread: Column, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(spread, F.lit(p))

