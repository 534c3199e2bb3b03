"""Canonical schemas, and adapters from the shapes that earlier rounds were written in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_DOCS = "video_id string, title string, description string"
DOC_KEYWORDS = "video_id string, keywords array<string>"
MENUS = "cafe_id string, cafe_name string, gu string, menu_name string, price long"
FILTERED = "keyword string, count long"
COMBINED = "keyword string, new_count long, matched_parts array<string>"
ENRICHED = "keyword string, category string, example array<string>, season string, tag array<string>, combo array<struct<items:array<string>>>, related array<string>, count long, importance double"
ANSWERS = "question string, answer array<struct<name:string,description:string>>, keywords array<string>"
DEAD_LETTER = "question string, keywords array<string>, reason string, raw_response string, failed_at timestamp, attempts int"
#: The seasons that a record may carry.
SEASONS = ("봄", "여름", "가을", "겨울")


def adapt_enriched(df: DataFrame) -> DataFrame:
    """Records of either shape as ENRICHED.

    The old shape has ``example`` as a string and ``combo`` as an array of ``a+b``
    strings; the new one has arrays and structs. Free-form seasons become null.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    example = F.col("example") if isinstance(kinds["example"], T.ArrayType) else sentences(F.col("example"))
    element = kinds["combo"].elementType
    combo = F.col("combo") if isinstance(element, T.StructType) else combos(F.col("combo"))
    season = F.when(F.col("season").isin(*SEASONS), F.col("season"))
    return df.select("keyword", "category", example.alias("example"), season.alias("season"), "tag", combo.alias("combo"), "related", F.col("count").cast("long").alias("count"), F.col("importance").cast("double").alias("importance"))


def sentences(text, most: int = 2):
    """The first sentences of a string, trimmed, blanks dropped."""
    return F.slice(F.filter(F.transform(F.split(text, "[.!?]"), lambda x: F.trim(x)), lambda s: s != ""), 1, most)


def combos(items):
    """``a+b`` strings as array<struct<items>>; strings without a plus are dropped."""
    parts = F.filter(items, lambda s: s.contains("+"))
    return F.transform(parts, lambda s: F.struct(F.transform(F.split(s, r"\+"), lambda x: F.trim(x)).alias("items")))
