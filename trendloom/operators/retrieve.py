"""Candidates from the graph: question rules, two routes, and the relaxation ladder for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import apart, cut, unique

LIMIT = 10
LEAST = 3
LADDER = ("none", "category", "season", "tags")

# Words of the source data's language, by what they ask for.
ROUTE_WORDS = ("재료",)
TAG_WORDS = {"단맛": ("달콤",), "비주얼": ("비주얼", "예쁜"), "트렌디": ("SNS", "핫한")}
SEASON_WORDS = {"봄": ("계절",)}
CATEGORY_WORDS = {"디저트": ("신메뉴", "카페")}


def parse_question(q: Column) -> dict[str, Column]:
    """The conditions that a question's words ask for, by the fixed rules above."""
    said = lambda words: F.array_max(F.array(*[q.contains(w) for w in words]))
    first = lambda rules: F.coalesce(*[F.when(said(words), F.lit(v)) for v, words in rules.items()], F.lit(None).cast("string"))
    tags = F.array_compact(F.array(*[F.when(said(words), F.lit(v)) for v, words in TAG_WORDS.items()]))
    return {"use_ingredient": said(ROUTE_WORDS), "tags": tags, "season": first(SEASON_WORDS), "category": first(CATEGORY_WORDS)}


def valid_conditions(tags: Column, season: Column, category: Column, vocab: dict[str, Column], most: int = 3) -> Column:
    """Whether extracted conditions are within the vocabulary: at most ``most`` tags; season and category may be null."""
    ok = lambda x, name: x.isNull() | F.array_contains(vocab[name], x)
    return (F.size(tags) <= most) & F.forall(tags, lambda t: F.array_contains(vocab["tags"], t)) & ok(season, "season") & ok(category, "category")


def vocabulary(edges: DataFrame) -> DataFrame:
    """(label, value): distinct tags, seasons and categories that aren't empty."""
    return edges.where(F.col("dst_label").isin("Tag", "Season", "Category") & (F.col("dst") != "")).select(F.col("dst_label").alias("label"), F.col("dst").alias("value")).distinct()


def bind_vocabulary(tags: Column, season: Column, category: Column, vocab: dict[str, Column]) -> dict[str, Column]:
    """Conditions within the vocabulary (arrays by name), and the unknown ones in order: tags, season, category."""
    outside = lambda x, name: F.filter(F.array_compact(F.array(x)), lambda v: ~F.array_contains(vocab[name], v))
    inside = lambda x, name: F.when(F.array_contains(vocab[name], x), x)
    return {
        "tags": F.filter(tags, lambda t: F.array_contains(vocab["tags"], t)), "season": inside(season, "season"), "category": inside(category, "category"),
        "unknown": F.concat(F.filter(tags, lambda t: ~F.array_contains(vocab["tags"], t)), outside(season, "season"), outside(category, "category")),
    }


def ingredient_candidates(edges: DataFrame, totals: DataFrame, limit: int = LIMIT, n: int | None = None) -> DataFrame:
    """Ingredients reached by a keyword's combos: by last date, then by the sum of counts over all (path, date) rows, then by name.

    A keyword's dates are counted before the paths meet them: a path stands for as many rows as its
    keyword has dates, or one without any. Edges are compared in ``n`` partitions if given.
    """
    e = unique(edges.where(F.col("rel").isin("INCLUDES", "IS_COMBO_WITH", "RECORDED_ON")).select("rel", "src", "dst"), n, "src")
    includes = e.where("rel = 'INCLUDES'").select(F.col("src").alias("combo"), F.col("dst").alias("ingredient"))
    combo_of = e.where("rel = 'IS_COMBO_WITH'").select(F.col("src").alias("name"), F.col("dst").alias("combo"))
    dates = e.where("rel = 'RECORDED_ON'").groupBy(F.col("src").alias("name")).agg(F.max("dst").alias("date"), F.count("*").alias("times"))
    names = totals.select("name", "count").join(apart(dates), "name", "left").select("name", "date", (F.col("count") * F.coalesce("times", F.lit(1))).alias("mentions"))
    rows = apart(combo_of).join(names, "name").groupBy("combo").agg(F.max("date").alias("date"), F.sum("mentions").alias("mentions")).join(apart(includes), "combo")
    ranked = rows.groupBy("ingredient").agg(F.max("date").alias("latest"), F.sum("mentions").alias("freq"))
    return ranked.orderBy(F.desc_nulls_last("latest"), F.desc_nulls_last("freq"), "ingredient").limit(limit)


def menu_rows(cond: DataFrame, totals: DataFrame, edges: DataFrame, distinct: bool = False, n: int | None = None) -> DataFrame:
    """cond(qid, rung, tags, season, category) -> (qid, rung, keyword, count): keywords that meet all present conditions.

    A keyword comes once for each tag it meets, as the source does; ``distinct`` gives it once.
    Conditions are turned to (qid, rung, relation, value) rows and meet the edges by equality. Edges get their keyword's count before
    that, as each meets many conditions, and lie by keyword, in ``n`` partitions if given; what they meet is counted there.
    """
    e = edges.where(F.col("rel").isin("HAS_TAG", "HAS_SEASON", "HAS_CATEGORY")).select(F.col("src").alias("keyword"), "rel", F.col("dst").alias("value"))
    e = unique(e.join(apart(totals.select(F.col("name").alias("keyword"), "count")), "keyword"), n, "keyword")
    some = lambda c, rel: F.when(c.isNotNull() & (c != ""), F.array(F.struct(F.lit(rel).alias("rel"), c.alias("value"))))
    none = F.array().cast("array<struct<rel:string,value:string>>")
    wants = F.concat(F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("HAS_TAG").alias("rel"), t.alias("value"))), F.coalesce(some(F.col("season"), "HAS_SEASON"), none), F.coalesce(some(F.col("category"), "HAS_CATEGORY"), none))
    asked = cond.withColumn("wants", wants).withColumn("kinds", F.size(F.array_distinct(F.transform("wants", lambda w: w["rel"]))))
    met = asked.select("qid", "rung", "kinds", F.explode("wants").alias("w")).select("qid", "rung", "kinds", "w.rel", "w.value").join(e, ["rel", "value"])
    kinds = sum(F.max((F.col("rel") == rel).cast("int")) for rel in ("HAS_TAG", "HAS_SEASON", "HAS_CATEGORY"))
    hits = met.groupBy("qid", "rung", "kinds", "keyword", "count").agg(kinds.alias("rels"), F.greatest(F.lit(1), F.count_if(F.col("rel") == "HAS_TAG")).alias("times")).where("rels = kinds")
    if not distinct:
        hits = hits.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    free = asked.where("kinds = 0").select("qid", "rung").crossJoin(F.broadcast(popular(totals)))
    return hits.select("qid", "rung", "keyword", "count").union(free.select("qid", "rung", "keyword", "count"))


def all_ingredients(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first ingredients by name: what stands in where no combo has been loaded."""
    return nodes.where("label = 'Ingredient'").select(F.col("key").alias("keyword")).distinct().orderBy("keyword").limit(limit)


def simple_candidates(questions: DataFrame, nodes: DataFrame, edges: DataFrame, totals: DataFrame, limit: int = LIMIT) -> DataFrame:
    """questions(qid, use_ingredient, tags, season, category) -> (qid, rank, keyword, stand_in): one try with all conditions; where it finds nothing, ingredients by name or the most frequent keywords.

    The lists that many questions share have ``limit`` rows, so they may be broadcast.
    """
    numbered = lambda rows, *order: rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # noqa: E731  ``limit`` rows
    asked = questions.where(F.coalesce("use_ingredient", F.lit(False)))
    menu = questions.where(~F.coalesce("use_ingredient", F.lit(False)))
    own = numbered(ingredient_candidates(edges, totals, limit).withColumnRenamed("ingredient", "keyword"), F.desc_nulls_last("latest"), F.desc_nulls_last("freq"), "keyword").select("rank", "keyword", F.lit(False).alias("stand_in"))
    by_name = numbered(all_ingredients(nodes, limit), "keyword").select("rank", "keyword", F.lit(True).alias("stand_in"))
    known = own.agg(F.count("*").alias("_known"))
    ingredients = own.union(by_name.crossJoin(F.broadcast(known)).where("_known = 0").drop("_known"))
    out = asked.select("qid").crossJoin(F.broadcast(ingredients))
    found = top_rows(menu_rows(menu.select("qid", F.lit(0).alias("rung"), "tags", "season", "category"), totals, edges), ["qid"], limit).select("qid", "rank", "keyword", F.lit(False).alias("stand_in"))
    most = numbered(popular(totals, limit), F.desc_nulls_last("count"), "keyword").select("rank", "keyword", F.lit(True).alias("stand_in"))
    none = menu.select("qid").join(found.select("qid").distinct(), "qid", "left_anti").crossJoin(F.broadcast(most))
    return out.union(found).union(none).select("qid", "rank", "keyword", "stand_in")


def popular(totals: DataFrame, limit: int = LIMIT) -> DataFrame:
    return totals.select(F.col("name").alias("keyword"), "count").orderBy(F.desc_nulls_last("count"), "keyword").limit(limit)


def top_rows(rows: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last("count"), "keyword")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def rungs(cond: DataFrame) -> DataFrame:
    """(qid, tags, season, category) -> a row for each rung tried: all conditions, then without category, season, tags; absent ones are skipped."""
    has = {"category": F.col("category").isNotNull() & (F.col("category") != ""), "season": F.col("season").isNotNull() & (F.col("season") != ""), "tags": F.size("tags") > 0}
    steps = []
    for i, _ in enumerate(LADDER):
        dropped = LADDER[1 : i + 1]
        keep = lambda c: F.lit(None).cast("string") if c in dropped else F.col(c)  # noqa: B023, E731
        tags = F.array().cast("array<string>") if "tags" in dropped else F.col("tags")
        tried = has[LADDER[i]] if i else F.lit(True)
        relaxed = F.array_compact(F.array(*[F.when(has[d], F.lit(d)) for d in dropped])) if dropped else F.array().cast("array<string>")
        steps.append(F.when(tried, F.struct(F.lit(i).alias("rung"), tags.alias("tags"), keep("season").alias("season"), keep("category").alias("category"), relaxed.alias("relaxed"))))
    return cond.select("qid", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("qid", "s.*")


def relaxation_ladder(cond: DataFrame, totals: DataFrame, edges: DataFrame, least: int = LEAST, limit: int = LIMIT, distinct: bool = False, n: int | None = None) -> DataFrame:
    """cond(qid, tags, season, category) -> (qid, rank, keyword, count, relaxed): all questions and rungs in one plan.

    The first rung of ``least`` rows or more counts, else the last tried; with no rows there, the most
    frequent keywords stand in and ``relaxed`` ends with ``all``. ``n`` as in ``menu_rows``.
    """
    steps = rungs(cond)
    rows = cut(top_rows(menu_rows(steps, totals, edges, distinct, n), ["qid", "rung"], limit))  # read twice
    sized = steps.select("qid", "rung", "relaxed").join(rows.groupBy("qid", "rung").agg(F.count("*").alias("n")), ["qid", "rung"], "left").fillna(0, ["n"])
    chosen = sized.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("rung"))), F.max("rung")).alias("rung"))
    chosen = chosen.join(sized, ["qid", "rung"])
    found = apart(rows).join(chosen, ["qid", "rung"]).select("qid", "rank", "keyword", "count", F.array_join("relaxed", ",").alias("relaxed"))
    stand_in = chosen.where("n = 0").crossJoin(F.broadcast(top_rows(popular(totals, limit).withColumn("_", F.lit(1)), ["_"], limit)))
    return found.union(stand_in.select("qid", "rank", "keyword", "count", F.array_join(F.concat("relaxed", F.array(F.lit("all"))), ",")))


def trending(edges: DataFrame, totals: DataFrame, limit: int = LIMIT) -> DataFrame:
    dates = edges.where("rel = 'RECORDED_ON'").groupBy(F.col("src").alias("name")).agg(F.max("dst").alias("latest"))
    return totals.join(dates, "name", "left").orderBy(F.desc_nulls_last("latest"), F.desc_nulls_last("count"), "name").limit(limit)


def search(rows: DataFrame, text: str, pattern: str, id_col: str, limit: int = 5) -> DataFrame:
    """Rows whose text holds the pattern in any case (% and _ are wildcards), the first by id."""
    return rows.where(F.col(text).ilike(f"%{pattern}%")).orderBy(id_col).limit(limit)


def clamp(n: int, most: int = 50) -> int:
    return max(1, min(n, most))
