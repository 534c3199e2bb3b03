"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``docs``.

1. language: texts without a letter go, and texts to which no language is clearly nearest; a document without lang gets the predicted one.
2. near_duplicates: of each class of near duplicates the least doc_id stays.
3. secrets: found spans are replaced by a mark; every document stays.
4. mixing: sources are mixed to their target weights; a document taken more than
   once is repeated, one taken in part keeps its first words.
5. packing: texts are packed into bins; the result has a row for each piece.

Columns beyond doc_id, text, lang, source and n_chars pass through under any name.

Defined results: null and empty texts hold no letter and go in the first stage; a null doc_id is an
ordinary row, which is no copy of another; a null lang isn't learned from, a null source is a source of its own; of equal
rows one stays; ties go to the smaller doc_id; texts are taken whole, however long; an empty table gives
an empty result. The tables between the stages are removed when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import langid, mixing, near, packing, secrets
from trendloom.llm.common import discard, materialize, ship

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs under names that no operator uses, and the way back."""
    ship(docs.sparkSession)
    names = [c if c in OWN else f"__other_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, back = shielded(docs)
    model = langid.train(safe.select("doc_id", "text", "lang"))
    kept = langid.predict(safe, model).where(~langid.rejected(F.col("lang_pred"), F.col("lang_ambiguous"), F.col("text")))
    return back(kept.withColumn("lang", F.coalesce("lang", F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred")))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, back = shielded(docs)
    return back(near.keep_one(safe, near.near_classes(safe.select("doc_id", "text"))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, back = shielded(docs)
    out = secrets.scan(safe).withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe, back = shielded(docs)
    rows = safe.withColumns({"size": mixing.word_count(F.col("text")), "quality": mixing.letter_quality(F.col("text")), "salt": F.md5(F.col("text").cast("binary"))})
    return back(mixing.apply_mix(safe, mixing.mix(rows, salt="salt")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix_sources), ("packing", pack)]

#: Near duplicates, entropy windows and packing aren't expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = kept
    return docs
