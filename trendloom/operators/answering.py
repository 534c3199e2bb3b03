"""Questions answered over tables: understood, given candidates, and the stored attempts at an answer judged until one holds.

The chain of the question service for all questions at once. What a model says (conditions it extracted, answers it gave) enters as
columns. Many questions ask for the same: candidates are found once for each distinct condition and joined to the questions by
it, a join with one row of a condition on its small side, whose hot conditions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grounding import validation
from ..session import apart, cut
from . import retrieve as rt
from . import tools

#: Tags that extracted conditions may have.
MOST_TAGS = 3
CONDITIONS = ("use_ingredient", "tags", "season", "category")


def condition_key(*columns: str) -> Column:
    """Equal for equal conditions, nulls included."""
    return F.to_json(F.struct(*columns))


def understood(questions: DataFrame, edges: DataFrame, most_tags: int = MOST_TAGS) -> DataFrame:
    """questions(qid, question, use_ingredient, tags, season, category) -> qid, question, source and the conditions that count.

    Extracted conditions count (source ``llm``) if they say whether ingredients are asked for, have ``most_tags`` tags at the most and
    every value is in the graph's vocabulary; absent tags are none. Else the question's words decide (``rule``). A null question says nothing.
    """
    none = F.array().cast("array<string>")
    given = questions.select("qid", "question", "use_ingredient", F.coalesce("tags", none).alias("tags"), "season", "category").withColumn("_c", condition_key("tags", "season", "category"))
    distinct = given.select("_c", "tags", "season", "category").distinct()
    one = lambda label, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(label).alias("label"), c.alias("value")))).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    values = F.concat(F.transform("tags", lambda t: F.struct(F.lit("Tag").alias("label"), t.alias("value"))), one("Season", F.col("season")), one("Category", F.col("category")))
    strange = distinct.select("_c", F.explode(values).alias("w")).select("_c", "w.*").join(apart(rt.vocabulary(edges)), ["label", "value"], "left_anti")
    rows = given.join(apart(strange.select("_c").distinct().withColumn("_strange", F.lit(True))), "_c", "left")
    holds = F.col("use_ingredient").isNotNull() & (F.size("tags") <= most_tags) & F.col("_strange").isNull()
    rule = rt.parse_question(F.coalesce("question", F.lit("")))
    return rows.select("qid", "question", F.when(holds, "llm").otherwise("rule").alias("source"), *[F.when(holds, F.col(c)).otherwise(rule[c]).alias(c) for c in CONDITIONS])


def with_candidates(asked: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = rt.LIMIT) -> DataFrame:
    """understood questions + path, relaxed (conditions dropped, in order, ``all`` if stand-ins answer) and candidates (in order, ``limit`` at the most)."""
    rows = cut(asked.withColumn("path", F.when(F.col("use_ingredient"), "ingredient").otherwise("menu")).withColumn("_c", F.when(F.col("use_ingredient"), F.lit("ingredient")).otherwise(condition_key("tags", "season", "category"))))
    distinct = cut(rows.groupBy("_c").agg(*[F.first(c).alias(c) for c in ("path", "tags", "season", "category")]))  # read several times
    found = tools.candidates_of(distinct.withColumnRenamed("_c", "qid"), nodes, edges, limit)
    lists = found.groupBy(F.col("qid").alias("_c")).agg(F.max("relaxed").alias("_r"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("candidates"))
    none = F.array().cast("array<string>")
    relaxed = F.when(F.col("_r") == "", none).otherwise(F.split("_r", ","))
    return rows.join(lists, "_c", "left").withColumns({"relaxed": F.coalesce(relaxed, none), "candidates": F.coalesce("candidates", none)}).drop("_c", "_r")


def answered(questions: DataFrame, attempts: DataFrame, nodes: DataFrame, edges: DataFrame, retries: int = 2, limit: int = rt.LIMIT) -> DataFrame:
    """The whole chain: one row for each question.

    attempts(qid, attempt, answer) are what a model gave, from 1; those after ``retries`` further ones were not asked for and are not read, nor are
    those after the first that holds. -> qid, question, source, path, the conditions, relaxed, candidates, ok, attempts (made), answer (that holds), reason
    (why the last one fails; ``absent`` without any), raw (the last one failing), feedback (the reasons that were given back, in order). A question with a null qid has no attempts.
    """
    asked = cut(with_candidates(understood(questions, edges), nodes, edges, limit))
    tried = attempts.where(F.col("attempt").between(1, retries + 1)).join(apart(asked.select("qid", "candidates")), "qid")
    reason = validation(F.col("answer"), F.col("candidates"))
    judged = tried.select("qid", "attempt", "answer", reason.alias("reason"))
    fails = F.col("reason") != "ok"
    ends = judged.groupBy("qid").agg(
        F.min(F.when(~fails, F.struct("attempt", "answer"))).alias("good"), F.max(F.struct("attempt", "reason", "answer")).alias("last"), F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(fails, F.struct("attempt", "reason")))).alias("fails"),  # retries + 1 at the most
    )
    ok = F.col("good").isNotNull()
    back = F.transform(F.filter("fails", lambda f: f["attempt"] < F.coalesce(F.col("good.attempt"), F.col("last.attempt"))), lambda f: f["reason"])
    return asked.join(ends, "qid", "left").select(
        *asked.columns, ok.alias("ok"), F.coalesce("good.attempt", "n", F.lit(0)).cast("long").alias("attempts"), F.col("good.answer").alias("answer"),
        F.when(~ok, F.coalesce("last.reason", F.lit("absent"))).alias("reason"), F.when(~ok, F.col("last.answer")).alias("raw"), F.coalesce(back, F.array().cast("array<string>")).alias("feedback"),
    )


def rejected(rows: DataFrame) -> DataFrame:
    """Of ``answered``: what ``io.dead_letters`` keeps of questions without an answer that holds."""
    return rows.where(~F.col("ok")).select("question", F.col("candidates").alias("keywords"), "reason", F.col("raw").alias("raw_response"), "attempts")
