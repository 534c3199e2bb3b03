"""Topics kept in files, and streams over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..sources import io, topic
from ..streaming import frequencies
from .text_queries import query, table

EVENT = "event_id long, event_type string, value double, user_id long"


def sent(spark, d):
    """Events as messages by user, in two commits: errors first."""
    path = scratch(spark, "topic")
    rows = table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    for some in ("event_type = 'error'", "event_type <> 'error' or event_type is null"):
        topic.publish(io.to_messages(rows.where(some), "user_id"), path)
    return path


@query("SELECT user_id::VARCHAR AS key, event_id, event_type, value FROM events")
def topic_round_trip(spark, d):
    rows = topic.read_topic(spark, sent(spark, d))
    return rows.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("key", "e.event_id", "e.event_type", "e.value")


@query("SELECT user_id::VARCHAR AS key, count(*) AS messages, 1::BIGINT AS partitions, count(*) FILTER (event_type = 'error') AS errors, coalesce(sum(value), 0) AS total, TRUE AS errors_first FROM events GROUP BY user_id")
def topic_keys(spark, d):
    """A key is in one partition; what an earlier commit holds has lower offsets."""
    rows = topic.read_topic(spark, sent(spark, d))
    e = rows.select(F.col("key").cast("string").alias("key"), "partition", "offset", F.from_json(F.col("value").cast("string"), EVENT).alias("e"))
    error = F.col("e.event_type") == "error"
    last, first = F.max(F.when(error, F.col("offset"))), F.min(F.when(~error, F.col("offset")))
    return e.groupBy("key").agg(F.count("*").alias("messages"), F.countDistinct("partition").alias("partitions"), F.count_if(error).alias("errors"), F.coalesce(F.sum("e.value"), F.lit(0.0)).alias("total"), F.coalesce(last < first, F.lit(True)).alias("errors_first"))


@query("SELECT count(*) AS messages, 0::BIGINT AS gaps, count(*) FILTER (event_type = 'error') AS errors FROM events")
def topic_offsets(spark, d):
    """Offsets of a partition run from 0 without gaps."""
    rows = topic.read_topic(spark, sent(spark, d)).select("partition", "offset", F.get_json_object(F.col("value").cast("string"), "$.event_type").alias("kind"))
    own = rows.groupBy("partition").agg(F.count("*").alias("n"), (F.max("offset") + 1 - F.count_distinct("offset")).alias("gaps"), F.count_if(F.col("kind") == "error").alias("errors"))
    return own.agg(F.sum("n").alias("messages"), F.sum("gaps").alias("gaps"), F.sum("errors").alias("errors"))


@query("SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY event_type")
def topic_stream(spark, d):
    """A stream that stops after the first commit and goes on from its checkpoint after the second: every message once."""
    path, out, state = (scratch(spark, name) for name in ("topic", "received", "state"))
    rows = table(spark, d, "events").select("event_id", "event_type", "value", "user_id")
    for some in ("event_type = 'error'", "event_type <> 'error' or event_type is null"):
        topic.publish(io.to_messages(rows.where(some), "user_id"), path)
        got = topic.stream_topic(spark, path).select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")
        got.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(EVENT).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


WORDS = r"""d AS (SELECT doc_id, rtrim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'), ' ') AS s FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(string_split(ltrim(s, ' '), ' ')) AS token FROM d)"""


@query(f"WITH {WORDS} SELECT token, count(*) AS df FROM x WHERE token <> '' GROUP BY token")
def doc_freq_stream(spark, d):
    """Running document frequencies of words of Latin letters, over four batches with a restart after each."""
    docs, changes, state = (scratch(spark, name) for name in ("documents", "frequencies", "state"))
    rows = table(spark, d, "documents").select("doc_id", "text")
    for k in range(4):
        rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k).write.mode("append").parquet(docs)
        words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z]+", " ")), " "))
        tokens = spark.readStream.schema("doc_id long, text string").parquet(docs).select(F.explode(words).alias("token")).where("token <> ''")
        frequencies.keep(frequencies.running(tokens), changes, state).awaitTermination()
    return frequencies.current(spark.read.schema("token string, df long, batch long").parquet(changes)).select("token", "df")
