"""Scans and sinks. Every scan has a schema; sinks write what the scans read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def kafka_batch(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A whole topic from the earliest offset; needs the Kafka connector on the class path."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def parse_messages(rows: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Binary JSON messages as columns; malformed ones give nulls and stay."""
    return rows.select(F.from_json(F.col(value).cast("string"), schema).alias("data")).select("data.*")


def to_messages(rows: DataFrame, key: str | None = None) -> DataFrame:
    """(value) or (key, value) rows as a Kafka sink takes them; a key keeps an id in one partition."""
    value = F.to_json(F.struct("*")).alias("value")
    return rows.select(F.col(key).cast("string").alias("key"), value) if key else rows.select(value)


def write_kafka(rows: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    to_messages(rows, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, hint: str = "") -> DataFrame:
    """JSON lines under a schema; a path (or glob) that meets no file is an error, with a hint at what makes it."""
    try:
        return spark.read.schema(schema).json(paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raise FileNotFoundError(f"no input at {paths}" + (f"; {hint}" if hint else "")) from e


def last_per_id(rows: DataFrame, key: str, position: Column) -> DataFrame:
    """The last row of each id by position."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), position).alias("_r")).select(key, "_r.*")


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def read_csv_sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet with a header, possibly after a byte-order mark; columns are matched by place."""
    return spark.read.option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).schema(schema).csv(path)


def write_csv_sheet(rows: DataFrame, path: str) -> None:
    """With the byte-order mark before the first header, as spreadsheets expect."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"﻿{first}").write.mode("overwrite").option("header", True).csv(path)


def dead_letters(rows: DataFrame, path: str, append: bool = True) -> None:
    """Rejected rows; a batch overwrites, and only if there are any."""
    if append:
        rows.write.mode("append").json(path)
    elif rows.limit(1).count():
        rows.write.mode("overwrite").json(path)


def index_documents(rows: DataFrame, order: list[str]) -> DataFrame:
    """+ id q_1, q_2, ... in order. Each task numbers its own range, after the rows of the ranges before."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each task
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_part").withColumn("id", F.concat(F.lit("q_"), (F.col("_start") + own).cast("string"))).drop("_part", "_start")


def write_rounds(rows: DataFrame, path: str) -> None:
    """A folder for each round; only the rounds written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)


def merge_tail(files: DataFrame) -> DataFrame:
    return files.groupBy("keyword").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "keyword")


# Marks that names carry and that their keys must lose; '' is none, and as often as it is listed.
TEMPERATURES = ("", "", "", "ICE", "HOT", "(ICE)", "(HOT)", "아이스", "핫")
SIZES = ("", "", "", "L", "R", "라지", "톨", "그란데", "(L)", "(R)", "벤티")
OPTIONS = ("", "", "", "", "샷추가", "연하게", "휘핑추가", "1+1", "시럽추가", "디카페인")


def draw(seed: int, *what: str | int | Column) -> Column:
    """A whole number below 1,000,000 by a hash of ``what``, so that reruns agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *[w if isinstance(w, Column) else F.lit(w) for w in what]), F.lit(1_000_000))


def decorated(name: Column, seed: int, row: Column) -> Column:
    """A name with a drawn temperature before it and a size and an option after it."""
    pick = lambda marks, k: F.element_at(F.array(*[F.lit(m) for m in marks]), (draw(seed, k, row) % len(marks) + 1).cast("int"))
    parts = F.array(pick(TEMPERATURES, "temperature"), name, pick(SIZES, "size"), pick(OPTIONS, "option"))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def synthetic_menus(spark: SparkSession, cafes: int, head: dict[str, float], tail: DataFrame, seed: int = 42, gus: int = 25) -> DataFrame:
    """Menus of ``cafes`` cafes by hashed draws: each head name with its probability, and 2 to 9 tail(keyword, count) names by weight, with replacement; decorated; prices 2500 to 9000 in steps of 500.

    A tail draw is a place in the running sum of the weights; it meets its name by the block of places that both lie in.
    """
    own = spark.range(cafes).withColumn("gu", draw(seed, "gu", F.col("id")) % gus)
    heads = F.array_compact(F.array(*[F.when(draw(seed, "head", name, F.col("id")) < int(1_000_000 * p), F.lit(name)) for name, p in head.items()]))
    rows = own.select("id", "gu", F.explode(heads).alias("base"), F.lit(0).cast("long").alias("nth"))
    run = W.orderBy(F.desc("count"), "keyword").rowsBetween(W.unboundedPreceding, 0)  # a row for each name
    places = tail.withColumn("to", F.sum("count").over(run)).withColumn("from", F.col("to") - F.col("count"))
    total = places.agg(F.max("to")).first()[0] or 0
    if total:
        width = max(1, total // 1024)
        blocks = places.select("keyword", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width))).alias("block"))
        several = own.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), 2 + draw(seed, "several", F.col("id")) % 8)))
        drawn = several.withColumn("place", F.pmod(F.xxhash64(F.lit(seed), F.lit("tail"), "id", "nth"), F.lit(total))).withColumn("block", F.floor(F.col("place") / width))
        met = drawn.join(blocks, "block").where("from <= place and place < to")
        rows = rows.union(met.select("id", "gu", F.col("keyword").alias("base"), "nth"))
    row = F.xxhash64("id", "nth", "base")
    return rows.select(
        F.concat(F.lit("cafe-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("cafe_id"), F.concat(F.lit("cafe "), F.col("id") % 977).alias("cafe_name"), F.concat(F.lit("gu "), "gu").alias("gu"),
        decorated(F.col("base"), seed, row).alias("menu_name"), (2500 + 500 * (draw(seed, "price", row) % 14)).cast("long").alias("price"),
    )
