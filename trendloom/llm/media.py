"""Media columns: content-addressed payloads in tar shards, metadata from headers.

A payload is a whole number of rows of 576 grey samples (0 to 255) and is
stored as a PNG of 8-bit grey, without loss. A row of the index carries the digest of the
payload, the shard, and the offset and length of the stored form in it. Range
reads of the first bytes of an entry fill width, height and depth; the samples are
read when features are asked for.

Payloads are deduplicated by digest over all tasks: equal
payloads are stored once, however many rows refer to them. A task writes its
own shards of bounded size under a name that no other attempt uses; the index, a table
in the shared folder, names only shards of attempts that were committed.

Shards are written through pyarrow's file systems, so the shared folder may be
any that those reach (file, hdfs, s3, gs).

Defined results: null text is empty, and its payload is one row of 255s; texts
of any length are stored whole; equal texts have equal values in every column; an empty table
gives an empty index; other columns stay with the documents, not with the media.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, shuffle_parts
from .lm import probes

WIDTH = 576
SHARD_BYTES = 64 << 20
#: Size of the filter of repeated payloads, whatever the input; a fuller one only sends more payloads through the shuffle.
FILTER_BITS = 1 << 27
HASHES = 4
#: The PNG signature and the bytes of signature and header chunk.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
INDEX = "digest string, shard string, offset long, length long"


def padded(text: Column) -> Column:
    """The payload: UTF-8 bytes, filled up with bytes 255 to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    gap = F.when(F.length(raw) == 0, F.lit(WIDTH)).otherwise(F.pmod(-F.length(raw), F.lit(WIDTH)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), gap.cast("int"))))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """PNG, 8-bit grey, WIDTH samples to a row, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER_BYTES of a stored payload."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored payload")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode(stored: bytes) -> bytes:
    width, height, _ = read_header(stored)
    at, data = 8, b""
    while at < len(stored):
        n = struct.unpack(">I", stored[at : at + 4])[0]
        if stored[at + 4 : at + 8] == b"IDAT":
            data += stored[at + 8 : at + 8 + n]
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, in thousandths, and a 64-bit average hash over 64 equal stretches."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    means = x.reshape(64, -1).mean(1)  # 576 is 9 times 64
    bits = int("".join("1" if m >= means.mean() else "0" for m in means), 2)
    return f"mean={round(1000 * x.mean())};dev={round(1000 * x.std())};hash={bits:016x}"


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shards:
    """Writes entries to tar shards under ``root``; a shard ends at SHARD_BYTES."""

    def __init__(self, root: str) -> None:
        self.fs, self.root = open_fs(root)
        self.fs.create_dir(self.root, recursive=True)
        self.out = None

    def add(self, digest: str, stored: bytes) -> tuple[str, int]:
        if self.out is not None and self.at >= SHARD_BYTES:
            self.close()
        if self.out is None:
            self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
        info.size = len(stored)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + stored + b"\0" * (-len(stored) % 512))
        start = self.at + len(head)
        self.at = start + len(stored) + (-len(stored) % 512)
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def repeated_filter(payloads: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over the hashes of the payloads that occur more than once."""
    often = payloads.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.shiftrightunsigned("h", 56).alias("part"))
    bits = FILTER_BITS >> 8

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(bits, bool)
        for at in probes(table["h"].to_numpy().view(np.uint64), 1, bits).first(HASHES):
            out[at.astype(np.int64)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.packbits(out).tobytes()], pa.binary())})

    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in often.groupBy("part").applyInArrow(fill, "part long, data binary").collect():
        whole[r["part"] * bits // 8 : (r["part"] + 1) * bits // 8] = np.frombuffer(r["data"], np.uint8)
    return whole


def maybe_repeated(h: np.ndarray, whole: np.ndarray) -> np.ndarray:
    h, bits = h.view(np.uint64), FILTER_BITS >> 8
    base, found = (h >> np.uint64(56)).astype(np.int64) * bits, np.ones(len(h), bool)
    for at in probes(h, 1, bits).first(HASHES):
        bit = base + at.astype(np.int64)
        found &= (whole[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
    return found


def store(payloads: DataFrame, root: str | None = None) -> tuple[DataFrame, str]:
    """payloads(payload binary) -> (index table, root): each distinct payload once, in tar shards under root.

    Payloads that occur once are written where they lie. Only those that a filter
    of the repeated ones lets through (all repeated ones, and few others) are shuffled, once from each task.
    """
    root = root or fresh_path(payloads.sparkSession, "media")
    rows = payloads.select("payload", F.xxhash64("payload").alias("h"))
    shared = payloads.sparkSession.sparkContext.broadcast(repeated_filter(rows.select("h")))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(root)
        for batch in batches:
            out = []
            for i in np.flatnonzero(~maybe_repeated(batch["h"].to_numpy(), shared.value)).tolist():
                payload = batch["payload"][i].as_py()
                digest, form = hashlib.sha256(payload).hexdigest(), encode(payload)
                out.append((digest, *shards.add(digest, form), len(form)))
            if out:
                yield pa.record_batch(dict(zip(("digest", "shard", "offset", "length"), map(list, zip(*out)))))
        shards.close()

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, forms = [], []
            for i in np.flatnonzero(maybe_repeated(batch["h"].to_numpy(), shared.value)).tolist():
                payload = batch["payload"][i].as_py()
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    forms.append(encode(payload))
            if digests:
                yield pa.record_batch({"digest": pa.array(digests, pa.binary()), "stored": pa.array(forms, pa.binary())})

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, last = Shards(root), None
        for batch in batches:
            out = []
            for digest, stored in zip(batch["digest"].to_pylist(), batch["stored"]):
                if digest != last:
                    form = stored.as_py()
                    out.append((digest.hex(), *shards.add(digest.hex(), form), len(form)))
                    last = digest
            if out:
                yield pa.record_batch(dict(zip(("digest", "shard", "offset", "length"), map(list, zip(*out)))))
        shards.close()

    forms = rows.mapInArrow(squeezed, "digest binary, stored binary")
    index = forms.repartition("digest").sortWithinPartitions("digest").mapInArrow(written, INDEX)
    return materialize(rows.mapInArrow(single, INDEX).union(index), "media-index"), root


def metadata(index: DataFrame, root: str) -> DataFrame:
    """index -> + width, height, bits, by range reads of headers only."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for batch in batches:
            got = [None] * batch.num_rows
            for shard, rows in by_shard(batch).items():
                with fs.open_input_file(f"{base}/{shard}") as f:
                    for i, offset, _ in rows:
                        f.seek(offset)
                        got[i] = read_header(f.read(HEADER_BYTES))
            cols = list(zip(*got)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in cols)], names=[*batch.schema.names, "width", "height", "bits"])

    return index.mapInArrow(heads, f"{INDEX}, width int, height int, bits int")


def by_shard(batch: pa.RecordBatch) -> dict[str, list[tuple[int, int, int]]]:
    out: dict[str, list[tuple[int, int, int]]] = {}
    for i, (shard, offset, length) in enumerate(zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length")))):
        out.setdefault(shard, []).append((i, offset, length))
    return {shard: sorted(rows, key=lambda r: r[1]) for shard, rows in sorted(out.items())}


def read_back(index: DataFrame, root: str) -> DataFrame:
    """index(+ width, height, bits) -> + what the stored bytes give: sizes, digests, features."""
    schema = f"{INDEX}, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        for batch in batches:
            sizes, rows = list(zip(batch["width"].to_pylist(), batch["height"].to_pylist())), [None] * batch.num_rows
            for shard, entries in by_shard(batch).items():
                with fs.open_input_file(f"{base}/{shard}") as f:
                    for i, offset, length in entries:
                        f.seek(offset)
                        stored = f.read(length)
                        payload = decode(stored)
                        if len(payload) != sizes[i][0] * sizes[i][1]:
                            raise OSError(f"{shard}: entry at {offset} is damaged")
                        rows[i] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return index.mapInArrow(read, schema)


ADDED = ("n_bytes", "digest", "shard", "offset", "length", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def media_columns(docs: DataFrame) -> DataFrame:
    """docs(text, ...) -> every other column that has none of the names given here: n_bytes, digest, shard, offset, length, width, height, bits and the columns of ``read_back``."""
    docs = docs.drop(*ADDED)  # columns of the result's names give way
    payload = padded(F.col("text"))
    index, root = store(docs.select(payload.alias("payload")))
    # Entries are read in stretches of shards, so that tasks read neighbouring bytes and alike amounts.
    dealt = index.repartition(shuffle_parts(docs.sparkSession), "shard", F.floor(F.col("offset") / (4 << 20)))
    known = read_back(metadata(dealt, root), root)
    rows = docs.withColumns({"n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), "digest": F.sha2(payload, 256)}).drop("text")
    return rows.join(known, "digest")
