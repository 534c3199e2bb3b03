"""Overlaps of intervals by key.

End points of both sides are ordered by (key, time) in range partitions, and a running count of starts, carried over from the
partitions before, sweeps over them. A stretch is every ``STRETCH`` starts of a key; an interval is open in the stretches from the
one of its start to the one of its end, so what a stretch receives is its own starts and the intervals carried
open into it. Sides meet by equality of (key, stretch), and a pair belongs to the stretch of its later start. A key may
hold all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Starts of a key to a stretch.
STRETCH = 1024


def swept(rows: DataFrame, stretch: int) -> DataFrame:
    """rows(_key, _from, _to, ...) -> + _lo, _hi: the stretches of an interval's start and end among all starts of its key."""
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    point = lambda t, kind: F.struct(t.alias("t"), F.lit(kind).alias("kind"))
    points = rows.select("_key", "_id", F.explode(F.array(point(F.col("_from"), 0), point(F.col("_to"), 1))).alias("p")).select("_key", "_id", "p.*")
    # At equal times starts come first: intervals are closed.
    order = ["t", "kind", "_id"]
    dealt = cut(points.repartitionByRange("_key", *order).withColumn("_part", F.spark_partition_id()))
    held = dealt.groupBy("_key", "_part").agg(F.count_if(F.col("kind") == 0).alias("_n"))
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    run = W.partitionBy("_key", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(held, ["_key", "_part"]).withColumn("_at", F.floor((F.col("_before") + F.sum((F.col("kind") == 0).cast("long")).over(run) - 1) / stretch))
    ends = placed.groupBy("_id").agg(F.max(F.when(F.col("kind") == 0, F.col("_at"))).alias("_lo"), F.max(F.when(F.col("kind") == 1, F.col("_at"))).alias("_hi"))
    return rows.join(ends, "_id").drop("_id")


def overlaps(left: DataFrame, right: DataFrame, start: str, end: str, keys: list[str] | None = None, stretch: int = STRETCH) -> DataFrame:
    """(l, r): structs of the rows of either side whose closed intervals share a point, within equal ``keys``.

    Null keys or ends, and intervals that end before they start, overlap nothing; repeated rows pair each for itself.
    """
    keys = keys or []

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.where(F.col(start) <= F.col(end))
        for k in keys:
            kept = kept.where(F.col(k).isNotNull())
        key = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
        return kept.select(key.alias("_key"), F.col(start).alias("_from"), F.col(end).alias("_to"), F.struct("*").alias(name))

    l_rows, r_rows = side(left, "l"), side(right, "r")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    own = ["_key", "_from", "_to"]
    both = l_rows.select(*own, "l", none(r_rows, "r"), F.lit(True).alias("_left")).union(r_rows.select(*own, none(l_rows, "l"), "r", F.lit(False)))
    placed = cut(swept(both, stretch)).withColumn("_stretch", F.explode(F.sequence("_lo", "_hi")))
    a = placed.where("_left").select("_key", "_stretch", F.col("_from").alias("_a"), F.col("_to").alias("_b"), F.col("_lo").alias("_la"), "l")
    b = placed.where("not _left").select("_key", "_stretch", F.col("_from").alias("_c"), F.col("_to").alias("_d"), F.col("_lo").alias("_lb"), "r")
    met = a.join(b, ["_key", "_stretch"]).where((F.col("_a") <= F.col("_d")) & (F.col("_c") <= F.col("_b")) & (F.col("_stretch") == F.greatest("_la", "_lb")))
    return met.select("l", "r")
