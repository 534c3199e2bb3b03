"""Best-fit packing with several permitted bin sizes.

Items (documents, cut into pieces where they exceed the largest size) are
packed in descending length. A piece goes into the open bin that it leaves
least room in; where none fits, the bin size that costs least is opened: the
cost of a size is the padding expected for it, measured on the items that are
still to be placed, so that the sizes are chosen jointly and not one by one.
At the end each bin is downsized to the smallest permitted size that holds its
contents.

Scale: lengths are computed where the texts lie; only (doc_id, length) moves.
Items are dealt at random, by hash, into blocks of about ``block_items``
documents, and each block is packed on its own, so memory is bounded and no
state is shared. A row's block is a hash of its id, its text and its place in the input, so
copies and repeated rows spread over the blocks too; lengths and hashes are written before
they are dealt, so that a task run again meets the same blocks.

Defined results: null or empty texts have length 0 and go into no bin; equal
rows are separate items; a null doc_id is an ordinary row; columns beyond doc_id and text are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts_for
from .mixing import word_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SCHEMA = "bin_id string, capacity int, used int, doc_id long, piece int, piece_start long, piece_length int, bin_start int"
NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
ARROW = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[field.split()[1]] for field in SCHEMA.split(", ")]


class OpenBins:
    """Open bins by room left, with the best fit found by bisection over the rooms in use."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.at: dict[int, list[int]] = {}

    def add(self, room: int, bin_no: int) -> None:
        if room not in self.at:
            bisect.insort(self.rooms, room)
            self.at[room] = []
        self.at[room].append(bin_no)

    def take(self, length: int) -> tuple[int, int] | None:
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        bins = self.at[room]
        bin_no = bins.pop()
        if not bins:
            del self.at[room]
            self.rooms.pop(i)
        return room, bin_no


def cut(lengths: Sequence[int], largest: int) -> list[tuple[int, int, int, int]]:
    """(length, item, piece, start), longest first."""
    pieces = [(min(largest, n - s), i, k, s) for i, n in enumerate(lengths) for k, s in enumerate(range(0, n, largest))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    return pieces


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(bin, capacity, used, item, piece, start, length, offset in bin) for each piece."""
    sizes = sorted(set(capacities))
    pieces = cut(lengths, sizes[-1])
    order = np.array([p[0] for p in pieces], dtype=np.int64)
    ahead = np.concatenate([np.cumsum(order[::-1])[::-1], [0]])  # words still to be placed
    up = order[::-1]
    sums = np.concatenate([[0], np.cumsum(up)])
    bins, opened, placed = OpenBins(), [], []
    for k, (n, item, piece, start) in enumerate(pieces):
        found = bins.take(n)
        if found is None:
            least = None
            for size in sizes:
                if size < n:
                    continue
                room = size - n
                # What is ahead and fits the room: the shortest pieces, all after this one.
                fits = min(int(np.searchsorted(up, room, side="right")), len(pieces) - k - 1)
                waste = max(0, room - int(sums[fits]))
                if fits and not waste:
                    waste = min(room, int(up[0])) // 2  # the gap that best fit leaves on average
                cost = (waste / size, -size if ahead[k + 1] >= size else size)
                if least is None or cost < least[0]:
                    least = (cost, size)
            size = least[1]
            opened.append([size, 0])
            found = (size, len(opened) - 1)
        room, bin_no = found
        placed.append((bin_no, item, piece, start, n, opened[bin_no][1]))
        opened[bin_no][1] += n
        if room > n:
            bins.add(room - n, bin_no)
    final = [min(s for s in sizes if s >= used) for _, used in opened]
    return [(b, final[b], opened[b][1], item, piece, start, n, at) for b, item, piece, start, n, at in placed]


#: Copies of a row that are made together.
COPIES = 1 << 16


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, block_items: int = 4_000) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each piece of each document in its bin."""
    # Equal rows are told apart by their number among each other, so blocks don't depend on how rows are partitioned.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("n"), F.xxhash64("text").alias("t"))
    rows = rows.where("n > 0").groupBy("doc_id", "n", "t").agg(F.count("*").alias("c"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPIES))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES), F.col("c") - F.col("k") * COPIES) - 1)))
    rows = materialize(rows.select("doc_id", "n", F.xxhash64("doc_id", "t", F.col("k") * COPIES + F.col("j")).alias("h")), "pack-items")
    blocks = parts_for(rows.count(), block_items)
    items = rows.select("doc_id", "n", F.pmod("h", F.lit(blocks)).cast("int").alias("block"))
    sizes = tuple(sorted(set(capacities)))

    def packed(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["n"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        block = table["block"][0].as_py()
        placed = [(f"{block}-{b}", c, u, rows[i][0], p, s, n, at) for b, c, u, i, p, s, n, at in pack([n for _, n in rows], sizes)]
        return pa.table([pa.array(values, kind) for values, kind in zip(zip(*placed), ARROW)], names=NAMES)

    return items.groupBy("block").applyInArrow(packed, SCHEMA)


def padding_share(packed: DataFrame) -> DataFrame:
    """bins, capacity, used and the share of padding over all bins."""
    bins = packed.groupBy("bin_id").agg(F.first("capacity").alias("capacity"), F.first("used").alias("used"))
    return bins.agg(F.count("*").alias("bins"), F.sum("capacity").alias("capacity"), F.sum("used").alias("used")).withColumn("padding", 1 - F.col("used") / F.col("capacity"))


__all__ = ["CAPACITIES", "pack", "pack_documents", "padding_share"]
