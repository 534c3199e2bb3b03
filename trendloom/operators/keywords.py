"""Keywords of documents: the rarest terms that are in the vocabulary.

Terms of a document are distinct, so a term's weight is its inverse document
frequency, ln((N + 1) / (df + 1)), and nothing needs a vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank_punctuation, ngrams, tokens
from ..session import cut, spread


def document_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" ", blank_punctuation(title), blank_punctuation(description))


def term_sets(docs: DataFrame, id_col: str, text: Column, drop_empty: bool = False) -> DataFrame:
    """(id, terms): each document's distinct terms, written once, so that the texts are tokenised once however often the terms are read."""
    words = spread(docs).select(F.col(id_col), tokens(text, drop_empty).alias("words"))  # a column of its own, as several expressions read it
    return cut(words.select(id_col, F.array_union("words", ngrams(F.col("words"), 2)).alias("terms")))


def exploded(sets: DataFrame, id_col: str) -> DataFrame:
    return sets.select(F.col(id_col), F.explode("terms").alias("token"))


def vocabulary(rows: DataFrame, size: int = 10_000) -> DataFrame:
    """(token, df): the terms of most documents, ties by token. Counted with map-side partial sums; the cut is a top-k, not a sort."""
    return rows.groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(size)


def idf_top_keywords(docs: DataFrame, id_col: str, text: Column, top: int = 8, size: int = 10_000, drop_empty: bool = False) -> DataFrame:
    """(id, rank, token, df, idf): the ``top`` rarest vocabulary terms; ties by df, then token.

    The vocabulary has at most ``size`` rows, so the join may broadcast it whatever the corpus; it leaves
    few terms, of which each task keeps ``top`` for a document before anything is shuffled. Vocabulary terms are ordered
    once, by a number, so that a document's terms are compared by one integer.
    """
    sets = term_sets(docs, id_col, text, drop_empty)
    n = sets.agg(F.count("*").alias("n"))
    vocab = vocabulary(exploded(sets, id_col), size).crossJoin(F.broadcast(n)).select("token", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))
    # The rarest first; the window has ``size`` rows at most.
    vocab = cut(vocab.withColumn("_order", F.row_number().over(W.orderBy(F.desc("idf"), F.desc("df"), "token"))))
    scored = exploded(sets, id_col).join(F.broadcast(vocab.select("token", "_order")), "token").select(id_col, "_order")
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy(id_col).orderBy("_order"))).where(F.col("rank") <= top)
    return best.join(F.broadcast(vocab), "_order").select(id_col, "rank", "token", "df", "idf")


def as_arrays(top: DataFrame, id_col: str) -> DataFrame:
    """(id, keywords array in rank order)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "token")))
    return top.groupBy(id_col).agg(F.transform(ordered, lambda s: s["token"]).alias("keywords"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; null keys are one key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def replayed(doc_keywords: DataFrame) -> DataFrame:
    """Documents rebuilt from stored keywords: the title is the keywords in a row."""
    return doc_keywords.select("video_id", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ").alias("title"), F.lit("").alias("description"))


def base_wins(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    return base.unionByName(extra.join(base.select(key), key, "left_anti"))
