"""A property graph as two tables, stamped by round.

nodes(label, key, round, count, importance); edges(src_label, src, rel, dst_label, dst, round).
Counts are kept for each round, so loading a round again replaces it and deleting it takes its counts away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, unique

NODES = "label string, key string, round string, count long, importance double"
EDGES = "src_label string, src string, rel string, dst_label string, dst string, round string"
#: Orphans are pruned in two passes: a combo holds ingredients, so it goes before them; the other labels hold nothing.
PRUNE_ORDER = (("Date", "Category", "Season", "Tag", "Example", "Combo"), ("Ingredient",))


def edge(src_label: str, src: Column, rel: str, dst_label: str, dst: Column) -> Column:
    return F.struct(F.lit(src_label).alias("src_label"), src.alias("src"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), dst.alias("dst"))


def build(records: DataFrame, round_id: str) -> tuple[DataFrame, DataFrame]:
    """Enriched records of a round -> (nodes, edges)."""
    k = F.col("keyword")
    some = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    combo_names = F.transform(F.filter("combo", lambda c: F.size(c["items"]) > 0), lambda c: F.array_join(c["items"], "+"))
    related = F.filter("related", lambda r: (F.trim(r) != "") & (r != k))
    examples = F.slice(F.filter(F.transform("example", lambda x: F.trim(x)), lambda e: e != ""), 1, 2)
    many = [
        F.array(edge("Keyword", k, "RECORDED_ON", "Date", F.lit(round_id))),
        F.transform(some(F.col("category")), lambda x: edge("Keyword", k, "HAS_CATEGORY", "Category", x)),
        F.transform(some(F.col("season")), lambda x: edge("Keyword", k, "HAS_SEASON", "Season", x)),
        F.transform(F.coalesce("tag", F.array().cast("array<string>")), lambda x: edge("Keyword", k, "HAS_TAG", "Tag", x)),
        F.transform(combo_names, lambda x: edge("Keyword", k, "IS_COMBO_WITH", "Combo", x)),
        F.flatten(F.transform("combo", lambda c: F.transform(c["items"], lambda i: edge("Combo", F.array_join(c["items"], "+"), "INCLUDES", "Ingredient", i)))),
        F.transform(examples, lambda x: edge("Keyword", k, "HAS_EXAMPLE", "Example", x)),
        F.transform(related, lambda x: edge("Keyword", k, "RELATED", "Keyword", x)),
        F.transform(related, lambda x: edge("Keyword", x, "RECORDED_ON", "Date", F.lit(round_id))),
    ]
    empty = F.array().cast("array<struct<src_label:string,src:string,rel:string,dst_label:string,dst:string>>")
    edges = records.select(F.explode(F.concat(*[F.coalesce(m, empty) for m in many])).alias("e")).select("e.*").distinct().withColumn("round", F.lit(round_id))
    own = records.groupBy(k.alias("key")).agg(F.sum("count").alias("count"), F.last("importance", True).alias("importance")).select(F.lit("Keyword").alias("label"), "key", "count", "importance")
    ends = edges.select(F.col("dst_label").alias("label"), F.col("dst").alias("key")).union(edges.select("src_label", "src")).distinct()
    # A related name that has no record of its own is a stub of count 0.
    nodes = ends.join(own, ["label", "key"], "left").select("label", "key", F.lit(round_id).alias("round"), F.when(F.col("label") == "Keyword", F.coalesce("count", F.lit(0))).alias("count"), "importance")
    return nodes, edges


def upsert(table: DataFrame, new: DataFrame, round_id: str) -> DataFrame:
    """The round's rows replaced by ``new``; loading twice changes nothing."""
    return table.where(F.col("round") != round_id).unionByName(new)


def keyword_totals(nodes: DataFrame) -> DataFrame:
    """(name, count, importance) over all rounds; importance of the last round that has one."""
    return nodes.where("label = 'Keyword'").groupBy(F.col("key").alias("name")).agg(F.sum("count").alias("count"), F.max_by("importance", F.when(F.col("importance").isNotNull(), F.col("round"))).alias("importance"))


def node_stats(nodes: DataFrame) -> DataFrame:
    return nodes.select("label", "key").distinct().groupBy("label").agg(F.count("*").alias("n"))


def edge_stats(edges: DataFrame, n: int | None = None) -> DataFrame:
    """rel -> how many edges, rounds apart; compared in ``n`` partitions if given."""
    return unique(edges.select("src_label", "src", "rel", "dst_label", "dst"), n).groupBy("rel").agg(F.count("*").alias("n"))


def orphans(nodes: DataFrame, edges: DataFrame, *labels: str) -> DataFrame:
    """Nodes of the labels that no edge points to."""
    into = edges.where(F.col("dst_label").isin(*labels)).select(F.col("dst_label").alias("label"), F.col("dst").alias("key")).distinct()
    return nodes.where(F.col("label").isin(*labels)).select("label", "key").distinct().join(into, ["label", "key"], "left_anti")


def pathless(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ingredients that no keyword reaches through a combo."""
    combos = edges.where("rel = 'IS_COMBO_WITH' and src_label = 'Keyword'").select(F.col("dst").alias("combo")).distinct()
    reached = edges.where("rel = 'INCLUDES'").select(F.col("src").alias("combo"), F.col("dst").alias("key")).join(combos, "combo").select("key").distinct()
    return nodes.where("label = 'Ingredient'").select("key").distinct().join(reached, "key", "left_anti")


def degree_scores(nodes: DataFrame, edges: DataFrame, label: str, rel: str, limit: int = 10) -> DataFrame:
    """Nodes of a label by how many edges of a relation point at them, ties by name; a relation that was never written gives zeros."""
    into = edges.where(F.col("rel") == rel).select(F.col("dst").alias("keyword"), F.lit(1).alias("_one"))
    own = nodes.where(F.col("label") == label).select(F.col("key").alias("keyword")).distinct()
    return own.join(into, "keyword", "left").groupBy("keyword").agg(F.count("_one").alias("score")).orderBy(F.desc("score"), "keyword").limit(limit)


def keywords_per_round(edges: DataFrame) -> DataFrame:
    dated = edges.where("rel = 'RECORDED_ON'").select(F.col("dst").alias("date"), "src").distinct()
    return dated.groupBy("date").agg(F.count("*").alias("keywords"))


def untagged(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keywords without a date."""
    dated = edges.where("rel = 'RECORDED_ON'").select(F.col("src").alias("key")).distinct()
    return nodes.where("label = 'Keyword'").select("key").distinct().join(dated, "key", "left_anti")


def prune(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without orphans, pass by pass; edges that leave a pruned node go with it."""
    nodes, edges = cut(nodes), cut(edges)  # read several times by each pass
    for labels in PRUNE_ORDER:
        gone = cut(orphans(nodes, edges, *labels))  # uncut, the plan would double with every use
        # Only rows of the labels are compared with what goes; the others are most of the graph and stay where they lie.
        of = lambda c: F.coalesce(F.col(c).isin(*labels), F.lit(False))
        nodes = nodes.where(of("label")).join(gone, ["label", "key"], "left_anti").select(*nodes.columns).union(nodes.where(~of("label")))
        leaving = gone.select(F.col("label").alias("src_label"), F.col("key").alias("src"))
        edges = edges.where(of("src_label")).join(leaving, ["src_label", "src"], "left_anti").select(*edges.columns).union(edges.where(~of("src_label")))
    return nodes, edges


def round_split(edges: DataFrame, round_id: str) -> DataFrame:
    """Keywords of a round: only_here or shared, by their number of dates."""
    dates = edges.where("rel = 'RECORDED_ON'").groupBy("src").agg(F.countDistinct("dst").alias("dates"), F.max((F.col("dst") == round_id).cast("int")).alias("here"))
    return dates.where("here = 1").select(F.col("src").alias("keyword"), F.when(F.col("dates") == 1, "only_here").otherwise("shared").alias("kind"))


def delete_plan(edges: DataFrame, round_id: str) -> DataFrame:
    """One row, before anything is deleted: how many keywords would go with the round, and how many stay because of another."""
    return round_split(edges, round_id).agg(F.count_if(F.col("kind") == "only_here").alias("deleted_keywords"), F.count_if(F.col("kind") == "shared").alias("kept_shared_keywords"))


def pruned(before: DataFrame, after: DataFrame) -> DataFrame:
    """label -> how many nodes of ``before`` are gone from ``after``."""
    own = lambda t: t.select("label", "key").distinct()
    return own(before).join(own(after), ["label", "key"], "left_anti").groupBy("label").agg(F.count("*").alias("n"))


def all_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("label", "key").distinct()


def delete_round(nodes: DataFrame, edges: DataFrame, round_id: str) -> tuple[DataFrame, DataFrame]:
    """Without what the round added, then pruned."""
    return prune(nodes.where(F.col("round") != round_id), edges.where(F.col("round") != round_id))


def reset(table: DataFrame) -> tuple[int, DataFrame]:
    """How many rows there were, and the empty table."""
    return table.count(), table.limit(0)


def expand(edges: DataFrame, centre: DataFrame, most: int = 600) -> DataFrame:
    """Edges out of the nodes in ``centre``(label, key), in a total order, ``most`` at the most."""
    c = centre.select(F.col("label").alias("src_label"), F.col("key").alias("src"))
    return edges.join(c, ["src_label", "src"]).select("src_label", "src", "rel", "dst_label", "dst").distinct().orderBy("src_label", "src", "rel", "dst_label", "dst").limit(most)


#: Lists of a neighbourhood by relation.
LISTS = {"HAS_TAG": "tags", "HAS_CATEGORY": "categories", "HAS_SEASON": "seasons", "IS_COMBO_WITH": "combos", "RELATED": "related", "RECORDED_ON": "dates"}


def neighbourhood(edges: DataFrame, centre: DataFrame | None = None) -> DataFrame:
    """keyword -> tags, categories, seasons, combos with their ingredients, related (both directions), dates: one aggregate of all relations.

    A keyword's lists are one row, as the lookup of single keywords wants them; ``centre``(k) limits the
    work to the keywords asked for before anything is collected.
    """
    held = edges.where("rel = 'INCLUDES'").groupBy(F.col("src").alias("v")).agg(F.array_join(F.array_sort(F.collect_set("dst")), "+").alias("held"))
    own = edges.where(F.col("rel").isin(*LISTS) & ((F.col("src_label") == "Keyword") | (F.col("rel") == "RELATED"))).select(F.col("src").alias("k"), "rel", F.col("dst").alias("v"), F.col("src_label") == "Keyword")
    combos = edges.where("rel = 'IS_COMBO_WITH'").select(F.col("src").alias("k"), F.col("dst").alias("v"), (F.col("src_label") == "Keyword").alias("mine")).distinct().join(held, "v", "left")
    combos = combos.select("k", F.lit("IS_COMBO_WITH"), F.concat("v", F.lit("("), F.coalesce("held", F.lit("")), F.lit(")")), "mine")
    back = edges.where("rel = 'RELATED'").select("dst", "rel", "src", F.lit(False))
    rows = own.where("rel <> 'IS_COMBO_WITH'").union(combos).union(back).toDF("k", "rel", "v", "mine")
    rows = rows.join(centre.select("k").distinct(), "k", "left_semi") if centre is not None else rows
    lists = [F.collect_set(F.when(F.col("rel") == rel, F.col("v"))).alias(name) for rel, name in LISTS.items()]
    out = rows.groupBy("k").agg(F.max("mine").alias("_mine"), *lists).where("_mine")
    return out.select("k", *[F.when(F.size(name) > 0, F.array_join(F.array_sort(name), ",")).alias(name) for name in LISTS.values()])
