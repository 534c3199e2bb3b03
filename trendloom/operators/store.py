"""The graph as a store on disk that takes rounds in and out one by one.

nodes and edges are tables partitioned by round: a load or a deletion replaces its round's partition and reads no other. Of what
queries need over all rounds - a keyword's count, an edge's number of rounds, a node's number of rounds and of
edges into it - totals are kept, bucketed by a hash of the key. A round changes the totals of its own
keys only, by the difference of what it was and what it is, and rewrites their buckets.

A crash between the tables is mended by loading the round again: ``rebuild`` makes totals anew from the rounds.
One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, parts
from .graph import EDGES, NODES

NODE_TOTALS = "label string, key string, rounds long, count long, bucket int"
EDGE_TOTALS = "src_label string, src string, rel string, dst_label string, dst string, rounds long, bucket int"
#: What tells a node, and an edge.
NODE, EDGE = ["label", "key"], ["src_label", "src", "rel", "dst_label", "dst"]


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def table(self, name: str, schema: str) -> DataFrame:
        """A table, empty if nothing has been written yet."""
        path = f"{self.path}/{name}"
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        return self.table("nodes", NODES)

    def edges(self) -> DataFrame:
        return self.table("edges", EDGES)

    def node_totals(self) -> DataFrame:
        return self.table("node_totals", NODE_TOTALS).drop("bucket")

    def edge_totals(self) -> DataFrame:
        return self.table("edge_totals", EDGE_TOTALS).drop("bucket")

    def put(self, rows: DataFrame, name: str, by: str) -> None:
        """Replaces the partitions that ``rows`` has, written as it is dealt out."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")

    def dealt(self, rows: DataFrame, n: int, by: str, values: int, keys: list[str]) -> DataFrame:
        """``rows`` in ``n`` partitions by ``by``, of which there are ``values``, and a share of its keys: a large round or bucket is several tasks'."""
        share = F.pmod(F.xxhash64(F.lit(self.buckets), *keys), F.lit(-(-n // max(values, 1)))).cast("int")
        return rows.withColumn("share", share).repartition(n, by, "share")

    def load(self, nodes: DataFrame, edges: DataFrame, *rounds: str) -> None:
        """The rounds' rows put in place of what they had; loading twice changes nothing."""
        own = F.col("round").isin(*rounds)
        self.replace(cut(nodes.where(own)), cut(edges.where(own)), rounds)

    def delete(self, *rounds: str) -> None:
        self.replace(self.nodes().limit(0), self.edges().limit(0), rounds)

    def replace(self, nodes: DataFrame, edges: DataFrame, rounds: tuple[str, ...]) -> None:
        had = F.col("round").isin(*rounds)
        node_change = cut(self.signed(nodes, self.nodes().where(had), NODE, F.coalesce("count", F.lit(0))))
        edge_change = cut(self.signed(edges, self.edges().where(had), EDGE, None))
        for name, rows, old, keys in (("nodes", nodes, self.nodes(), NODE), ("edges", edges, self.edges(), EDGE)):
            there = {r[0] for r in rows.select("round").distinct().collect()}  # rounds asked for
            if there:
                self.put(self.dealt(rows, parts(self.spark, rows.count()), "round", len(there), keys).select(*old.columns), name, "round")
            for gone in set(rounds) - there:
                self.drop(name, gone)
        self.add("node_totals", node_change, NODE, NODE_TOTALS)
        self.add("edge_totals", edge_change, EDGE, EDGE_TOTALS)

    def signed(self, new: DataFrame, old: DataFrame, keys: list[str], count: Column | None) -> DataFrame:
        """keys -> rounds, and count for nodes: by how much the totals change."""
        measures = ["rounds"] if count is None else ["rounds", "count"]
        one = lambda df, sign: df.select(*keys, "round", F.lit(sign).alias("sign"), *([] if count is None else [count.alias("count")]))
        # Dealt out by keys once, for both groupings.
        rows = one(new, 1).union(one(old, -1)).repartition(parts(self.spark, new.count() + old.count()), *keys)
        own = rows.groupBy(*keys, "round", "sign").agg(F.first("sign").cast("long").alias("rounds"), *([] if count is None else [(F.col("sign") * F.max("count")).alias("count")]))
        sums = own.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])
        changed = F.lit(False)
        for c in measures:
            changed = changed | (F.col(c) != 0)
        return sums.where(changed).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    def add(self, name: str, change: DataFrame, keys: list[str], schema: str) -> None:
        """Adds a change to the totals, in the buckets that it touches; what comes to no rounds goes."""
        touched = [r[0] for r in change.select("bucket").distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return
        old = self.table(name, schema)
        measures = [c for c in old.columns if c not in (*keys, "bucket")]
        both = old.where(F.col("bucket").isin(touched)).unionByName(change.select(*old.columns))
        left = {r[0] for r in both.groupBy("bucket").agg(F.sum("rounds").alias("n")).where("n > 0").select("bucket").collect()}
        # A key lies in one share of its bucket, so totals are added up where they are written.
        rows = self.dealt(both, parts(self.spark, both.count()), "bucket", len(touched), keys)
        now = rows.groupBy(*keys, "bucket", "share").agg(*[F.sum(c).alias(c) for c in measures]).where("rounds > 0").select(*old.columns)
        if left:
            self.put(now, name, "bucket")  # moved into place when all is written, so it may read what it replaces
        for b in set(touched) - left:
            self.drop(name, str(b), "bucket")

    def drop(self, name: str, value: str, by: str = "round") -> None:
        """Removes a partition."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value) if value else "__HIVE_DEFAULT_PARTITION__"
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{by}={named}")
        target.getFileSystem(conf).delete(target, True)

    def rebuild(self) -> None:
        """Totals made anew from all rounds."""
        for name, rows, keys, count in (("node_totals", self.nodes(), NODE, F.coalesce("count", F.lit(0))), ("edge_totals", self.edges(), EDGE, None)):
            own = rows.groupBy(*keys, "round").agg(*([F.max(count).alias("count")] if count is not None else [F.lit(0).alias("_")]))
            sums = own.groupBy(*keys).agg(F.count("*").alias("rounds"), *([F.sum("count").alias("count")] if count is not None else []))
            sums = sums.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))
            columns = sums.columns
            self.put(self.dealt(sums, parts(self.spark, rows.count()), "bucket", self.buckets, keys).select(*columns), name, "bucket")

    # What queries read of the totals.

    def keyword_totals(self) -> DataFrame:
        return self.node_totals().where("label = 'Keyword'").select(F.col("key").alias("name"), "count")

    def orphans(self, *labels: str) -> DataFrame:
        into = self.edge_totals().where(F.col("dst_label").isin(*labels)).select(F.col("dst_label").alias("label"), F.col("dst").alias("key")).distinct()
        return self.node_totals().where(F.col("label").isin(*labels)).select("label", "key").join(into, NODE, "left_anti")
