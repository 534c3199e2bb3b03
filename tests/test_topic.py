"""Topics in files: placement, offsets, streams that restart."""

import pytest
from pyspark.sql import functions as F

from trendloom.sources import io, topic


def messages(spark, lo, hi):
    return io.to_messages(spark.range(lo, hi).select("id", (F.col("id") % 7).alias("who")), "who")


def test_round_trip_places_keys_and_numbers_messages(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert topic.read_topic(spark, path).count() == 0
    for lo in (0, 100):
        topic.publish(messages(spark, lo, lo + 100), path, 3)
    rows = topic.read_topic(spark, path)
    assert rows.schema == spark.createDataFrame([], topic.SCHEMA).schema
    got = rows.select(F.col("key").cast("string").alias("key"), F.get_json_object(F.col("value").cast("string"), "$.id").cast("long").alias("id"), "partition", "offset", "topic").collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and {r["topic"] for r in got} == {"t"}
    for key in {r["key"] for r in got}:
        mine = [r for r in got if r["key"] == key]
        assert len({r["partition"] for r in mine}) == 1
        first = [r["offset"] for r in mine if r["id"] < 100]
        assert max(first) < min(r["offset"] for r in mine if r["id"] >= 100)
    for p in {r["partition"] for r in got}:
        assert sorted(r["offset"] for r in got if r["partition"] == p) == list(range(sum(r["partition"] == p for r in got)))
    part = topic.read_topic(spark, path, startingOffsets='{"0": 5}', endingOffsets='{"0": 9, "1": 0, "2": 0}')
    assert sorted(r["offset"] for r in part.collect()) == [5, 6, 7, 8]


def test_nulls_and_unkeyed_rows(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(None, b"a"), (b"k", None), (None, None), (b"", b"")], "key binary, value binary")
    topic.publish(rows, path, 2)
    topic.publish(rows.drop("key"), path, 2)
    got = [(r["key"], r["value"]) for r in topic.read_topic(spark, path).collect()]
    want = [(None, b"a"), (b"k", None), (None, None), (b"", b""), (None, b"a"), (None, None), (None, None), (None, b"")]
    assert sorted(map(repr, ((k and bytes(k) if k is not None else None, v and bytes(v) if v is not None else None) for k, v in got))) == sorted(map(repr, want))
    with pytest.raises(Exception, match="has 2 partitions"):
        topic.publish(rows, path, 3)


def test_a_stream_resumes_where_it_stopped(spark, tmp_path):
    path, out, state = f"file://{tmp_path}/t", f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        topic.stream_topic(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for lo in (0, 50, 120):
        topic.publish(messages(spark, lo, lo + 30), path, 4)
        run()
        run()  # nothing new
    got = spark.read.parquet(out)
    assert got.count() == got.select("partition", "offset").distinct().count() == 90


def test_a_stream_copies_a_topic_once(spark, tmp_path):
    source, copy = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    for lo in (0, 40):
        topic.publish(messages(spark, lo, lo + 40), source, 2)
        topic.publish_stream(topic.stream_topic(spark, source), copy, f"{tmp_path}/state", "copy", 3).awaitTermination()
    log = topic.Log(copy)
    log.commit([("lost.arrow", 0, 5)], 3, "copy", log.last()["batches"]["copy"])  # a batch that is committed again
    same = lambda p: sorted(bytes(r["value"]) for r in topic.read_topic(spark, p).collect())
    assert same(source) == same(copy) and len(same(copy)) == 80
