"""Scans, sinks, the load as a stream, and synthetic menus."""

import json

import pytest
from pyspark.sql import functions as F

from trendloom import schemas
from trendloom.functions import text as tx
from trendloom.sources import io
from trendloom.streaming import ingest


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], schemas.DOC_KEYWORDS)
    for k in range(2):
        io.write_jsonl(rows, f"{tmp_path}/{k}/keywords.jsonl")
    back = io.read_jsonl(spark, [f"{tmp_path}/0/*", f"{tmp_path}/1/*"], schemas.DOC_KEYWORDS)
    assert sorted(map(tuple, back.collect())) == [("a", ["x", "y"])] * 2 + [("b", [])] * 2
    with pytest.raises(FileNotFoundError, match="run the keyword job first"):
        io.read_jsonl(spark, f"{tmp_path}/none", schemas.DOC_KEYWORDS, hint="run the keyword job first")


def test_last_row_per_id(spark, tmp_path):
    (tmp_path / "k.jsonl").write_text("\n".join(json.dumps({"video_id": i, "keywords": [w]}) for i, w in (("a", "1"), ("b", "2"), ("a", "3"))) + "\n\n")
    rows = io.read_jsonl(spark, str(tmp_path / "k.jsonl"), schemas.DOC_KEYWORDS).where("video_id is not null").withColumn("at", F.monotonically_increasing_id())
    assert {r["video_id"]: r["keywords"] for r in io.last_per_id(rows, "video_id", F.col("at")).collect()} == {"a": ["3"], "b": ["2"]}


def test_sheet_with_a_byte_order_mark(spark, tmp_path):
    rows = spark.createDataFrame([("딸기", 3, "y"), ("a, b", 1, None)], "keyword string, count int, label string")
    io.write_csv_sheet(rows.coalesce(1), f"{tmp_path}/sheet")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "sheet").glob("part-*"))
    assert raw.startswith(b"\xef\xbb\xbfkeyword")
    assert sorted(map(tuple, io.read_csv_sheet(spark, f"{tmp_path}/sheet", "keyword string, count int, label string").collect())) == sorted(map(tuple, rows.collect()))


def test_dead_letters(spark, tmp_path):
    rows = spark.createDataFrame([("q", "r")], "question string, reason string")
    for _ in range(2):
        io.dead_letters(rows, f"{tmp_path}/append")
        io.dead_letters(rows, f"{tmp_path}/batch", append=False)
    io.dead_letters(rows.limit(0), f"{tmp_path}/batch", append=False)
    assert spark.read.json(f"{tmp_path}/append").count() == 2 and spark.read.json(f"{tmp_path}/batch").count() == 1


def test_rounds_are_replaced_one_by_one(spark, tmp_path):
    rows = lambda r, xs: spark.createDataFrame([(x, r) for x in xs], "x int, round string")
    io.write_rounds(rows("a", [1, 2]).union(rows("b", [3])), f"{tmp_path}/t")
    io.write_rounds(rows("b", [4, 5]), f"{tmp_path}/t")
    assert sorted((r["x"], r["round"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "a"), (2, "a"), (4, "b"), (5, "b")]


def test_index_numbers_over_many_tasks(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    got = {r["x"]: r["id"] for r in io.index_documents(rows, ["x"]).collect()}
    assert got == {x: f"q_{x + 1}" for x in range(1000)}
    assert io.index_documents(rows.limit(0), ["x"]).count() == 0


def test_messages(spark):
    rows = spark.createDataFrame([("v1", "t", "d"), (None, "t", None)], schemas.RAW_DOCS)
    assert io.to_messages(rows).columns == ["value"] and io.to_messages(rows, "video_id").columns == ["key", "value"]
    sent = io.to_messages(rows).select(F.col("value").cast("binary")).union(spark.createDataFrame([(bytearray(b"not json"),)], "value binary"))
    assert sorted(map(tuple, io.parse_messages(sent, schemas.RAW_DOCS).collect()), key=str) == sorted([("v1", "t", "d"), (None, "t", None), (None, None, None)], key=str)


def test_kafka_needs_its_connector(spark):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException, match="(?i)kafka"):
        io.kafka_batch(spark, "localhost:9092", "t")
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        io.write_kafka(spark.createDataFrame([("v", "t", "d")], schemas.RAW_DOCS), "localhost:9092", "t", "video_id")


def test_stream_loads_each_id_once(spark, tmp_path):
    day = "2025-05-01 10:0{}:00"
    put = lambda k, ids: (tmp_path / "in").mkdir(exist_ok=True) or (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"value": json.dumps({"video_id": i, "title": f"t{k}", "description": ""}), "timestamp": day.format(k)}) for i in ids))
    seen = []

    def run():
        stream = spark.readStream.schema("value string, timestamp timestamp").json(str(tmp_path / "in"))
        rows = ingest.deduplicated(stream, schemas.RAW_DOCS)
        ingest.load(rows, lambda df, n: seen.extend(r["video_id"] for r in df.collect()), str(tmp_path / "checkpoint")).awaitTermination()

    put(1, ["a", "b", "a"])
    run()
    put(2, ["b", "c"])
    run()
    assert sorted(seen) == ["a", "b", "c"]


def test_synthetic_menus(spark):
    tail = spark.createDataFrame([("와플", 90), ("마카롱", 10), ("없음", 0)], "keyword string, count long")
    args = (spark, 4000, {"콜드브루": 0.9, "녹차": 0.3}, tail)
    rows = io.synthetic_menus(*args).cache()
    assert rows.exceptAll(io.synthetic_menus(*args)).count() == 0
    of = lambda name: rows.where(F.col("menu_name").contains(name)).count()
    assert 3500 < of("콜드브루") < 3700 and 1100 < of("녹차") < 1300
    assert 0.87 < of("와플") / (of("와플") + of("마카롱")) < 0.93 and of("없음") == 0
    assert 2 <= (of("와플") + of("마카롱")) / 4000 <= 9
    assert rows.where("price < 2500 or price > 9000 or price % 500 <> 0").count() == 0
    assert rows.select("gu").distinct().count() == 25 and of("샷추가") > 0 and of("벤티") > 0
    keys = {r[0] for r in rows.select(tx.normal_key(F.col("menu_name"))).distinct().collect()}
    assert keys == {"콜드브루", "녹차", "와플", "마카롱"}
    none = io.synthetic_menus(spark, 10, {"콜드브루": 1.0}, tail.limit(0))
    assert none.count() == 10
