"""Text search by an index of trigrams.

Each trigram of the lower-cased text has lists of the ids of rows that hold it, sorted, as differences, cut by ranges of ids
so that a list is bounded whatever the trigram. A pattern's literal parts give trigrams; lists are intersected
before any text is read, and only the rows left are matched.

Lists are made where the texts lie, for some megabytes of text at a time, and merged by trigram and range: what moves are
lists of small numbers instead of a row for each trigram of each text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, spread
from .retrieve import search

#: Ids to a list.
RANGE = 1 << 16
#: Characters to a block, whose lists are made together; longer texts go through several.
BLOCK_CHARS = 1 << 21


def build(rows: DataFrame, text: str, id_col: str) -> DataFrame:
    """rows -> (gram, part, first, gaps), in the order of grams; id_col is a whole number, null ids and texts are not indexed."""
    texts = spread(rows.select(F.col(id_col).cast("long").alias("id"), F.lower(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))
    # Written, as the range partitioning reads its input twice.
    found = cut(texts.mapInArrow(lists_of(RANGE, BLOCK_CHARS), "gram string, part long, places array<int>"))
    places = F.sort_array(F.array_distinct(F.flatten(F.collect_list("places"))))  # the blocks of a repeated id share places
    lists = found.repartitionByRange("gram", "part").groupBy("gram", "part").agg(places.alias("ids"))
    gaps = F.zip_with(F.slice("ids", F.lit(2), F.size("ids")), F.slice("ids", F.lit(1), F.size("ids") - 1), lambda b, a: b - a)
    first = F.element_at("ids", 1) + F.col("part") * F.lit(RANGE).cast("long")
    return lists.select("gram", "part", first.alias("first"), F.when(F.size("ids") > 1, gaps).otherwise(F.array().cast("array<int>")).alias("gaps")).sortWithinPartitions("gram", "part")


def lists_of(size: int, block: int):
    """(id, text) -> (gram, part, places): for each block of texts its trigrams' ids, as sorted places in their range of ``size`` ids."""

    def lists(ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if len(chars) < 3:
            return
        seen = np.zeros(0x110000, bool)
        seen[chars] = True
        letters = np.flatnonzero(seen)
        who, row = np.unique(np.array(ids, np.int64), return_inverse=True)
        n, m = len(letters), len(who)
        if n**3 * m >= 2**63:  # a trigram and a row don't fit one number
            half = len(ids) // 2
            yield from lists(ids[:half], texts[:half])
            yield from lists(ids[half:], texts[half:])
            return
        text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        here = np.flatnonzero(text[2:] == text[:-2])
        number = np.zeros(0x110000, np.int64)
        number[letters] = np.arange(n)
        x = number[chars]
        held = np.sort((((x[here] * n) + x[here + 1]) * n + x[here + 2]) * m + row[text[here]])
        if not len(held):
            return
        gram, row = np.divmod(held[np.concatenate([[True], held[1:] != held[:-1]])], m)
        part, place = np.divmod(who[row], size)
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])]))
        g = gram[first]
        words = letters[np.stack([g // (n * n), g // n % n, g % n], 1)].astype("<u4").tobytes().decode("utf-32-le")
        starts = np.concatenate([first, [len(gram)]]).astype(np.int32)
        yield pa.record_batch({"gram": pa.array([words[i : i + 3] for i in range(0, len(words), 3)], pa.string()), "part": part[first], "places": pa.ListArray.from_arrays(starts, place.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, whole in zip(batch["id"].to_pylist(), batch["text"]):
                whole = whole.as_py()
                for at in range(0, max(1, len(whole) - 2), block):
                    text = whole[at : at + block + 2]
                    if held + len(text) > block and ids:
                        yield from lists(ids, texts)
                        ids, texts, held = [], [], 0
                    ids.append(i)
                    texts.append(text)
                    held += len(text)
        if ids:
            yield from lists(ids, texts)

    return run


def grams_of(pattern: str) -> list[str]:
    """Trigrams of the parts of a LIKE pattern that hold no wildcard."""
    parts = [p.lower() for p in re.split("[%_]", pattern)]
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


def candidates(index: DataFrame, grams: list[str]) -> DataFrame:
    """(id): ids that all the lists of ``grams`` hold."""
    mine = index.where(F.col("gram").isin(grams)).select("gram", "part", F.posexplode(F.concat(F.array("first"), F.col("gaps").cast("array<long>"))).alias("place", "gap"))
    run = W.partitionBy("gram", "part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # a list has RANGE ids at the most
    return mine.select(F.sum("gap").over(run).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("id")


def search_indexed(index: DataFrame, rows: DataFrame, text: str, pattern: str, id_col: str, limit: int = 5) -> DataFrame:
    """``retrieve.search`` over the rows that the index leaves; a pattern without three literal characters in a row is matched with all rows."""
    grams = grams_of(pattern)
    if not grams:
        return search(rows, text, pattern, id_col, limit)
    found = candidates(index, grams).select(F.col("id").alias("_id"))
    return search(rows.join(found, F.col(id_col) == F.col("_id"), "left_semi"), text, pattern, id_col, limit)
