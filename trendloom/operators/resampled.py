"""Intervals by a Poisson bootstrap in one pass.

Each row stands in replicate b as often as a Poisson number of mean 1 says, which is read off a hash of the row's id and b.
So replicates need no sampling by size, rows may come in any order and partition, and reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compare import order_statistics

REPLICATES = 200


def cumulative(most: int = 12) -> list[float]:
    """Chances of at most 0, 1, ... events of mean 1."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append((out[-1] if out else 0.0) + term)
        term /= k + 1
    return out


def weight(row_id: Column, replicate: Column, seed: int = 1) -> Column:
    """The Poisson number of a row in a replicate."""
    text = F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), replicate.cast("string"), F.lit(str(seed)))
    u = (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return sum((F.when(u > c, 1).otherwise(0) for c in cumulative()), F.lit(0))


def shares(rows: DataFrame, by: list[str], hit: Column, row_id: Column, replicates: int = REPLICATES, level: float = 0.95, seed: int = 1) -> DataFrame:
    """by -> n, share, low, high: the share of rows with ``hit``, and the percentile interval of its replicates (nearest rank); null hits don't count.

    A row meets its replicates in its own task, where counts are added up first; what is shuffled is one row for each group, replicate and task.
    """
    base = rows.where(hit.isNotNull()).select(*by, hit.cast("int").alias("_hit"), row_id.alias("_row"))
    held = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_b")).withColumn("_w", weight(F.col("_row"), F.col("_b"), seed))
    each = held.groupBy(*by, "_b").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_hit")).alias("_k")).where("_n > 0")
    n, tail = F.col("n"), round((1 - level) / 2, 9)
    at = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * n)).cast("long")
    bounds = order_statistics(each.withColumn("_share", F.col("_k") / F.col("_n")), by, "_share", {"low": at(tail), "high": at(round(1 - tail, 9))}).drop("n")
    own = base.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_hit").alias("share"))
    return own.join(bounds, by) if by else own.crossJoin(bounds)  # one row each
