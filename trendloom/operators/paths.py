"""Paths and centrality by rounds of messages along edges.

Edges are (src, dst), directed; ``both_ways`` makes them undirected. Each round joins what nodes hold to their edges, adds up
what arrives at a node, and is written as a table, which cuts the lineage. Messages are added up before they are
shuffled, so a node of many edges gets a row for each task. Rounds end when nothing changes (``hops``, ``communities``), when
ranks change less than ``tolerance`` in all, or at ``most_rounds``.

Null ends and repeated edges don't count; a table without edges gives what its nodes alone have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, unique


def clean(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Edges once, in ``n`` partitions if given; what is partitioned so already stays where it is."""
    return unique(edges.where("src is not null and dst is not null").select("src", "dst"), n)


def both_ways(edges: DataFrame, n: int | None = None) -> DataFrame:
    return clean(edges.select("src", "dst").union(edges.select("dst", "src")), n)


def hops(edges: DataFrame, sources: DataFrame, most_rounds: int = 64) -> DataFrame:
    """sources(node) -> (node, hops) of all nodes reached: the least number of edges from a source."""
    edges = cut(clean(edges))
    known = cut(sources.where("node is not null").select("node").distinct().withColumn("hops", F.lit(0)))
    for k in range(1, most_rounds + 1):
        # Only what was reached last sends.
        last = known.where(F.col("hops") == k - 1).select(F.col("node").alias("src"))
        fresh = edges.join(last, "src").select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
        fresh = cut(fresh.withColumn("hops", F.lit(k)))
        if not fresh.limit(1).count():
            break
        known = cut(known.union(fresh))
    return known


def page_rank(edges: DataFrame, damping: float = 0.85, most_rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """(node, rank): ranks sum to 1; what nodes without edges out hold is dealt to all nodes."""
    edges = cut(clean(edges))
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).union(edges.select("dst", F.lit(0)))
    nodes = cut(ends.groupBy("node").agg(F.sum("out").alias("out")))
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(most_rounds if n else 0):
        # A node's share goes with the node, so edges carry their ends only.
        shares = ranks.where("out > 0").select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        came = edges.join(shares, "src").groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("came"))
        sent = ranks.where("out > 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        rest = (1 - damping) / n + damping * (1 - sent) / n
        new = cut(ranks.join(came, "node", "left").select("node", "out", F.col("rank").alias("was"), (F.lit(rest) + damping * F.coalesce("came", F.lit(0.0))).alias("rank")))
        change = new.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        ranks = new.drop("was")
        if change < tolerance:
            break
    return ranks.select("node", "rank")


def communities(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, label): the least node that is reached by edges either way; labels spread until none changes."""
    edges = cut(both_ways(edges))
    labels = cut(edges.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(most_rounds):
        came = edges.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("came"))
        new = labels.join(came, "node", "left").withColumn("now", F.least("label", F.coalesce("came", F.col("label"))))
        # A label's own label is nearer to the end: chains halve.
        jump = new.select(F.col("node").alias("now"), F.col("now").alias("next")).where(F.col("now") != F.col("next"))
        new = cut(new.join(jump, "now", "left").select("node", F.col("label").alias("was"), F.least("now", F.coalesce("next", F.col("now"))).alias("label")))
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            break
    return labels
