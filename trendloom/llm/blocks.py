"""Blocks of documents with a dictionary each.

A block holds the documents of one stretch of a task: their ids, packed codes
into the block's dictionary, and the dictionary's distinct tokens. Only distinct
tokens of a block travel to be looked up, so a token of which every
document is full is one row for each block.
"""

from __future__ import annotations

import secrets
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a block; a longer document is a block of its own.
BLOCK_BYTES = 24 << 20
SCHEMA = "block long, doc_ids array<long>, n_bytes array<long>, flags array<boolean>, lens array<int>, packed binary, tokens array<string>, used array<int>"


def squeeze(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def expand(data: bytes, dtype: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], n, asbytes=True), dtype=dtype) if n else np.zeros(0, dtype)


def build(docs: DataFrame, tokens_of: Callable[[str], list[str]], flag: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) -> blocks.

    ``packed`` holds the codes of all documents in order, ``lens`` the number of codes of each;
    ``used`` how often documents whose ``flag`` is true hold each token.
    Null text is empty. Materialise the result: blocks get random names.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> tuple:
            return [], [], [], [], [], {}

        ids, sizes, flags, lens, codes, known = fresh()
        held = 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            set_here = [c for c, is_set in zip(codes, flags) if is_set]
            used = np.bincount(np.concatenate(set_here), minlength=len(known)) if set_here else np.zeros(len(known))
            row = {
                "block": pa.array([secrets.randbits(62)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "n_bytes": pa.array([sizes], pa.list_(pa.int64())), "flags": pa.array([flags], pa.list_(pa.bool_())),
                "lens": pa.array([lens], pa.list_(pa.int32())), "packed": pa.array([squeeze(flat.astype(np.uint32))], pa.binary()), "tokens": pa.array([list(known)], pa.list_(pa.string())), "used": pa.array([used.astype(np.int32)], pa.list_(pa.int32())),
            }
            return pa.record_batch(row)

        for batch in batches:
            marks = batch["flag"].to_pylist()
            for i in range(batch.num_rows):
                text = batch["text"][i].as_py() or ""
                size = len(text.encode())
                if ids and held + size > block_bytes:
                    yield out()
                    ids, sizes, flags, lens, codes, known = fresh()
                    held = 0
                held += size
                words = tokens_of(text)
                codes.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint32))
                lens.append(len(words))
                ids.append(batch["doc_id"][i].as_py())
                sizes.append(size)
                flags.append(bool(marks[i]))
        if ids:
            yield out()

    rows = docs.select("doc_id", "text", (F.col(flag) if flag else F.lit(False)).alias("flag"))
    return rows.mapInArrow(packed, SCHEMA)


BAG_SCHEMA = "block long, doc_ids array<long>, n_bytes array<long>, lens array<int>, gaps binary, counts binary, packs array<struct<part:int,n:int,data:binary>>"


def pack_tokens(tokens: list[str]) -> bytes:
    """Tokens hold a line feed only if they are one, so line feeds separate them and the line feed itself is written as nothing."""
    raw = "\n".join("" if t == "\n" else t for t in tokens).encode()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack_tokens(data: bytes) -> list[str]:
    raw = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return [t or "\n" for t in raw.decode().split("\n")]


def build_bags(docs: DataFrame, tokens_of: Callable[[str], list[str]], parts: int) -> DataFrame:
    """docs(doc_id, text, ...) -> blocks of bags: each document's distinct tokens with their frequencies.

    A block's dictionary is ordered by (part, token), where the part is a hash of
    the token, and is packed by part; ``gaps`` holds the differences of each
    document's ascending codes, ``counts`` the frequencies, ``lens`` how many.
    Null text is empty. Materialise the result: blocks get random names.
    """

    def out(ids: list, sizes: list, bags: list[dict[str, int]]) -> pa.RecordBatch:
        tokens = list({t for bag in bags for t in bag})
        part = np.fromiter((xxhash.xxh3_64_intdigest(t) % parts for t in tokens), np.int64, len(tokens))
        order = sorted(range(len(tokens)), key=lambda i: (part[i], tokens[i]))
        code = {tokens[i]: k for k, i in enumerate(order)}
        ordered, part = [tokens[i] for i in order], part[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        packs = [{"part": int(part[a]), "n": int(b - a), "data": pack_tokens(ordered[a:b])} for a, b in zip(cuts, [*cuts[1:], len(part)])]
        gaps, counts = [], []
        for bag in bags:
            mine = np.fromiter(map(code.__getitem__, bag), np.int64, len(bag))
            by = np.argsort(mine)
            gaps.append(np.diff(mine[by], prepend=0))
            counts.append(np.fromiter(bag.values(), np.int64, len(bag))[by])
        row = {
            "block": pa.array([secrets.randbits(62)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "n_bytes": pa.array([sizes], pa.list_(pa.int64())), "lens": pa.array([[len(b) for b in bags]], pa.list_(pa.int32())),
            "gaps": pa.array([squeeze(np.concatenate(gaps).astype(np.uint32))], pa.binary()), "counts": pa.array([squeeze(np.concatenate(counts).astype(np.uint32))], pa.binary()),
            "packs": pa.array([packs], pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("data", pa.binary())]))),
        }
        return pa.record_batch(row)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, bags, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                text = text.as_py() or ""
                size = len(text.encode())
                if ids and held + size > BLOCK_BYTES:
                    yield out(ids, sizes, bags)
                    ids, sizes, bags, held = [], [], [], 0
                held += size
                ids.append(doc_id)
                sizes.append(size)
                bags.append(Counter(tokens_of(text)))
        if ids:
            yield out(ids, sizes, bags)

    return docs.select("doc_id", "text").mapInArrow(packed, BAG_SCHEMA)
