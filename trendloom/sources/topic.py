"""A topic kept in files, as source and sink for batches and streams: what a broker's connector gives, without a broker.

A topic is a folder that driver and executors share. Segments are Arrow files of one topic partition each;
entries of the log name the segments that a commit added, with their first offsets, the ends of all partitions
and the last batch of each stream that writes. Only what an entry names is read, so a task that is
lost or runs twice leaves nothing behind that counts, and a stream's batch that is committed again is skipped.

Rows have the connector's columns. ``publish`` places rows with a key by the key's hash, so an id stays in
one partition, in the order of its commits; rows without a key are dealt out by their value. Offsets of a partition
are dense and start at 0. A topic has one writer at a time, as its entries are numbered.

Null keys and values stay null. An empty topic, or one that isn't there yet, gives no rows.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: The columns of the message broker's connector.
SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"
#: Fixed value: messages are stamped when they are appended.
APPEND_TIME = 1
FORMAT = "topic"


@dataclass
class Segment(InputPartition):
    """Offsets lo .. hi of a file whose first message is ``base``."""

    file: str
    partition: int
    base: int
    lo: int
    hi: int
    at: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]


class Log:
    """The entries of a topic."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.path = path.rstrip("/")
        self.fs, self.root = fs.FileSystem.from_uri(self.path)

    def numbers(self) -> list[int]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def entry(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/log/{number:012d}.json") as f:
            return json.loads(f.read())

    def last(self) -> dict:
        numbers = self.numbers()
        return self.entry(numbers[-1]) if numbers else {"number": -1, "ends": [], "batches": {}}

    def commit(self, files: list[tuple[str, int, int]], partitions: int, writer: str | None = None, batch: int = -1) -> None:
        last = self.last()
        if writer is not None and last["batches"].get(writer, -1) >= batch:
            return
        ends = last["ends"] or [0] * partitions
        if len(ends) != partitions:
            raise ValueError(f"{self.path} has {len(ends)} partitions, not {partitions}")
        segments = []
        for file, partition, count in sorted(files, key=lambda x: (x[1], x[0])):
            segments.append({"file": file, "partition": partition, "base": ends[partition], "count": count})
            ends[partition] += count
        batches = last["batches"] | ({writer: batch} if writer is not None else {})
        entry = {"number": last["number"] + 1, "at": int(time.time() * 1e6), "ends": ends, "batches": batches, "segments": segments}
        self.fs.create_dir(f"{self.root}/log", recursive=True)
        # Readers see an entry whole or not at all.
        name = f"{self.root}/log/{entry['number']:012d}.json"
        with self.fs.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(f"{name}.part", name)

    def segments(self, start: dict[str, int], end: dict[str, int]) -> list[Segment]:
        out = []
        for number in self.numbers():
            entry = self.entry(number)
            for s in entry["segments"]:
                p = str(s["partition"])
                lo, hi = max(s["base"], start.get(p, 0)), min(s["base"] + s["count"], end.get(p, s["base"] + s["count"]))
                if lo < hi:
                    out.append(Segment(s["file"], s["partition"], s["base"], lo, hi, entry["at"]))
        return out


def rows_of(path: str, topic: str, segment: Segment) -> Iterator[pa.RecordBatch]:
    log = Log(path)
    with log.fs.open_input_file(f"{log.root}/data/{segment.file}") as f:
        reader, at = pa.ipc.open_file(f), segment.base
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            lo, hi = max(segment.lo - at, 0), min(segment.hi - at, batch.num_rows)
            if lo < hi:
                n, part = hi - lo, batch.slice(lo, hi - lo)
                stamp = pa.array([segment.at] * n, pa.timestamp("us", "UTC"))
                columns = [part["key"], part["value"], pa.array([topic] * n), pa.array([segment.partition] * n, pa.int32()), pa.array(range(at + lo, at + hi), pa.int64()), stamp, pa.array([APPEND_TIME] * n, pa.int32())]
                yield pa.record_batch(columns, names=["key", "value", "topic", "partition", "offset", "timestamp", "timestampType"])
            at += batch.num_rows


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.topic = options["path"], options["path"].rstrip("/").rsplit("/", 1)[-1]
        self.start, self.end = options.get("startingoffsets", "earliest"), options.get("endingoffsets", "latest")

    def partitions(self) -> list[Segment]:
        return Log(self.path).segments(json.loads(self.start) if self.start != "earliest" else {}, json.loads(self.end) if self.end != "latest" else {})

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, self.topic, partition) if isinstance(partition, Segment) else iter(())


class StreamReader(Reader, DataSourceStreamReader):
    """Offsets are {partition: next offset}; a restarted query goes on from those in its checkpoint."""

    def __init__(self, options: dict) -> None:
        super().__init__({"startingoffsets": "latest"} | options)

    def initialOffset(self) -> dict:
        return {"earliest": dict, "latest": self.latestOffset}.get(self.start, lambda: json.loads(self.start))()

    def latestOffset(self) -> dict:
        return {str(p): n for p, n in enumerate(Log(self.path).last()["ends"])}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return Log(self.path).segments(start, {p: end.get(p, 0) for p in end}) if end else []


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.count, self.writer = options["path"], int(options["partitions"]), options.get("writer")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.compute as pc

        log, held = Log(self.path), {}
        log.fs.create_dir(f"{log.root}/data", recursive=True)
        schema = pa.schema([("key", pa.binary()), ("value", pa.binary())])
        try:
            for batch in iterator:
                for p in pc.unique(batch["partition"]).to_pylist():
                    part = batch.filter(pc.equal(batch["partition"], p))
                    if p not in held:
                        name = f"{p}-{uuid.uuid4().hex}.arrow"
                        sink = log.fs.open_output_stream(f"{log.root}/data/{name}")
                        held[p] = [name, sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")), 0]
                    held[p][2].write_batch(pa.record_batch([part["key"].cast(pa.binary()), part["value"].cast(pa.binary())], schema=schema))
                    held[p][3] += part.num_rows
        finally:
            for _, sink, out, _ in held.values():
                out.close()
                sink.close()
        return Written([(name, p, n) for p, (name, _, _, n) in held.items()])

    def commit(self, messages: list[Written]) -> None:
        Log(self.path).commit([f for m in messages if m for f in m.files], self.count)


class StreamWriter(Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written], batchId: int) -> None:
        Log(self.path).commit([f for m in messages if m for f in m.files], self.count, self.writer or "stream", batchId)


class TopicSource(DataSource):
    """Options: path; startingOffsets and endingOffsets (earliest, latest or JSON by partition); for sinks partitions, and for streams a name as writer."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its classes travel with the plan."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TopicSource)


def placed(rows: DataFrame, partitions: int) -> DataFrame:
    """rows(value) or (key, value) -> key, value, partition: a key's rows are in the partition of its hash."""
    key = F.col("key").cast("binary") if "key" in rows.columns else F.lit(None).cast("binary")
    value = F.col("value").cast("binary")
    return rows.select(key.alias("key"), value.alias("value")).withColumn("partition", F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(partitions)).cast("int")).repartition(partitions, "partition")


def publish(rows: DataFrame, path: str, partitions: int = 8) -> None:
    """Append rows, as ``io.to_messages`` gives them, as one commit."""
    register(rows.sparkSession)
    placed(rows, partitions).write.format(FORMAT).option("partitions", partitions).mode("append").save(path)


def read_topic(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def stream_topic(spark: SparkSession, path: str, starting: str = "earliest") -> DataFrame:
    register(spark)
    return spark.readStream.format(FORMAT).option("startingOffsets", starting).load(path)


def publish_stream(rows: DataFrame, path: str, checkpoint: str, writer: str, partitions: int = 8):
    """A streaming sink; ``writer`` names the query across restarts, so a batch that is repeated is not appended again."""
    register(rows.sparkSession)
    sink = placed(rows, partitions).writeStream.format(FORMAT).option("partitions", partitions).option("writer", writer)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
