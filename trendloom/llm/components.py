"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (v, label): every vertex with the least vertex it is connected to.

    Labels go along the edges and then jump to the label's own label, so the
    number of rounds is about the logarithm of the longest path. Each round is
    written to the shared folder. A vertex of many edges is summed on the map side first.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # A vertex with many lower neighbours keeps the lowest; the others are tied to that one, which leaves few edges in dense groups.
    lowest = down.groupBy("a").agg(F.min("b").alias("low"))
    rest = down.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    thin = lowest.select("a", F.col("low").alias("b")).union(rest).distinct()
    both = materialize(thin.union(thin.select(F.col("b"), F.col("a"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select("v", F.least("v", "n").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(heard.withColumnRenamed("a", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("label").alias("far"))
        # A label is itself a vertex, so the inner join finds a row for each.
        new = materialize(near.join(jump, "l").select("v", "old", F.least("l", "far").alias("label")), "labels")
        changed = new.where("old <> label").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            return labels.select("v", "label")
