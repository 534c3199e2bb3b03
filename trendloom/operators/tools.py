"""What clients ask of the graph, as functions over tables: candidates for many questions at once, neighbours, the whole graph.

Vocabulary, trending, search and validation are ``retrieve.vocabulary``,
``retrieve.trending`` (with ``retrieve.clamp``), ``retrieve.search`` and ``grounding.validation``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, parts, unique
from . import graph as g
from . import retrieve as rt


def conditions(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """questions(qid, question, use_ingredient, tags, season, category) -> qid, path, source, unknown and the conditions that hold.

    Given conditions count where the graph knows them, others are listed as unknown (tags, season, category); a question without any is
    read by the rules. Values meet the vocabulary by equality, so it may have any size.
    """
    rule = rt.parse_question(F.col("question"))
    given = F.col("use_ingredient").isNotNull() | F.col("tags").isNotNull() | F.col("season").isNotNull() | F.col("category").isNotNull()
    one = lambda label, c: F.array(F.struct(F.lit(label).alias("label"), c.alias("value")))
    asked = F.concat(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("Tag").alias("label"), t.alias("value"))), one("Season", F.col("season")), one("Category", F.col("category")))
    words = questions.select("qid", F.posexplode(asked).alias("pos", "w")).select("qid", "pos", "w.*").where("value is not null")
    met = words.join(rt.vocabulary(edges).withColumn("known", F.lit(True)), ["label", "value"], "left")
    kept = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "value")))), lambda x: x["value"])
    known = F.coalesce("known", F.lit(False))
    bound = met.groupBy("qid").agg(
        kept(known & (F.col("label") == "Tag")).alias("own_tags"), F.max(F.when(known & (F.col("label") == "Season"), F.col("value"))).alias("own_season"), F.max(F.when(known & (F.col("label") == "Category"), F.col("value"))).alias("own_category"), kept(~known).alias("unknown")
    )
    none = F.array().cast("array<string>")
    out = questions.join(bound, "qid", "left")
    return out.select(
        "qid", F.when(F.coalesce("use_ingredient", rule["use_ingredient"]), "ingredient").otherwise("menu").alias("path"), F.when(given, "agent").otherwise("rule").alias("source"), F.coalesce("unknown", none).alias("unknown"),
        F.when(given, F.coalesce("own_tags", none)).otherwise(rule["tags"]).alias("tags"), F.when(given, F.col("own_season")).otherwise(rule["season"]).alias("season"), F.when(given, F.col("own_category")).otherwise(rule["category"]).alias("category"),
    )


def candidates_of(asked: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = rt.LIMIT) -> DataFrame:
    """asked(qid, path, tags, season, category) -> qid, rank, keyword, relaxed: the route's candidates, never none; ``relaxed`` lists what was dropped, and 'all' if the stand-ins answer.

    Edges are counted first, for the number of partitions, so they had better be written.
    """
    totals, n = cut(g.keyword_totals(nodes)), parts(edges.sparkSession, edges.count())
    menu = rt.relaxation_ladder(asked.where("path = 'menu'").select("qid", "tags", "season", "category"), totals, edges, limit=limit, n=n).select("qid", "rank", "keyword", "relaxed")
    # ``limit`` rows each, so they may be numbered and broadcast.
    own = rt.ingredient_candidates(edges, totals, limit, n).withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("latest"), F.desc_nulls_last("freq"), "ingredient"))).select("rank", F.col("ingredient").alias("keyword"), F.lit("").alias("relaxed"))
    by_name = rt.all_ingredients(nodes, limit).withColumn("rank", F.row_number().over(W.orderBy("keyword"))).select("rank", "keyword", F.lit("all").alias("relaxed"))
    stand_in = by_name.crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))).where("n = 0").drop("n")
    return menu.union(asked.where("path = 'ingredient'").select("qid").crossJoin(F.broadcast(own.union(stand_in))).select("qid", "rank", "keyword", "relaxed"))


def find_candidates(questions: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = rt.LIMIT) -> DataFrame:
    """-> qid, path, source, unknown, relaxed, rank, keyword: the conditions of ``conditions`` and the candidates of ``candidates_of``."""
    asked = cut(conditions(questions, edges))
    found = candidates_of(asked.select("qid", "path", "tags", "season", "category"), nodes, edges, limit)
    return asked.select("qid", "path", "source", "unknown").join(found, "qid").select("qid", "path", "source", F.array_join("unknown", ",").alias("unknown"), "relaxed", "rank", "keyword")


def keyword_neighbours(keywords: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """keywords(k) -> k, found, count and the lists of ``graph.neighbourhood``; a keyword that the graph lacks is not found."""
    asked = keywords.select("k").distinct()
    totals = g.keyword_totals(nodes).select(F.col("name").alias("k"), "count", F.lit(True).alias("_found"))
    return asked.join(totals, "k", "left").join(g.neighbourhood(edges, asked), "k", "left").withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found")


def whole_graph(edges: DataFrame, most: int = 600, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(type, id), edges(source, target, label)) of the first ``most`` edges, found once; ends without a name are left out.

    Edges are compared in ``n`` partitions if given.
    """
    named = edges.where("src <> '' and dst <> ''").select("src_label", "src", "rel", "dst_label", "dst")
    kept = cut(unique(named, n).orderBy("src_label", "src", "rel", "dst_label", "dst").limit(most))
    ends = kept.select(F.col("src_label").alias("type"), F.col("src").alias("id")).union(kept.select("dst_label", "dst")).distinct()
    return ends, kept.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel").alias("label"))
