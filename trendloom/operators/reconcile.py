"""Two runs reconciled from summaries: what is exchanged follows the number of differences and not the runs.

A row is an element, two hashes of its id and of id and content. A summary (an invertible Bloom lookup table) adds each element
to four cells of the part that its id falls into. Cells are sums, so summaries of rounds or of files add up, can be stored, and are made
by partial aggregation. In the difference of two summaries equal rows are gone; a cell that holds a single element shows it, which takes it
out of its other cells, and so on until nothing is left. Only rows with an id found so are read and compared, exactly.

Parts are numbered by an estimate of the differences, ``LOAD`` for 1024 cells. A part that can't be taken
apart is compared row by row, so results don't depend on it. What remains is that two different contents of an id agree in 64 bits of hash.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .compare import compare_runs

#: Cells of a part: four rows of 256, an element being in one of each.
PLACES, ROW = 4, 256
#: Differing elements that a part is meant for; a part of 1024 cells gives up at some 790.
LOAD = 400
#: Rows of a list of ids that may be broadcast.
SMALL = 1 << 20
#: Elements of a part at the most, so that the sums of a cell fit into a long.
MOST = 1 << 36
SUMS = ["n", "key_high", "key_low", "mix_high", "mix_low", "check"]
_LOW = (1 << 32) - 1


def key_hash(key: Column) -> Column:
    """Of the id as JSON, in which a null differs from a text."""
    return F.xxhash64(F.to_json(F.struct(key.alias("v"))))


def elements(rows: DataFrame, key: str, values: str) -> DataFrame:
    """rows -> kh (hash of the id), mix (of id and content), check (of both)."""
    own = rows.select(key_hash(F.col(key)).alias("kh"), F.to_json(F.struct(F.col(values).alias("v"))).alias("v"))
    own = own.select("kh", F.xxhash64("kh", "v").alias("mix"))
    return own.withColumn("check", F.crc32(F.concat_ws(":", F.col("kh").cast("string"), F.col("mix").cast("string")).cast("binary")))


def part_of(kh: Column, parts: int) -> Column:
    return F.pmod(kh, F.lit(parts).cast("long"))


def summary(rows: DataFrame, parts: int, key: str = "id", values: str = "keywords") -> DataFrame:
    """part, cell and the sums of a cell over the elements in it; summaries with equal ``parts`` may be added up (``added``)."""
    mix, low = F.col("mix"), F.lit(_LOW)
    cells = F.array(*[F.shiftrightunsigned(mix, 8 * i).bitwiseAND(F.lit(ROW - 1)) + i * ROW for i in range(PLACES)])
    halves = [F.shiftrightunsigned("kh", 32).alias("key_high"), F.col("kh").bitwiseAND(low).alias("key_low"), F.shiftrightunsigned(mix, 32).alias("mix_high"), mix.bitwiseAND(low).alias("mix_low")]
    placed = elements(rows, key, values).select(part_of(F.col("kh"), parts).alias("part"), F.lit(1).cast("long").alias("n"), *halves, "check", F.explode(cells).alias("cell"))
    return placed.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in SUMS])


def added(*summaries: DataFrame) -> DataFrame:
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in SUMS])


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of a less those of b; what comes to nothing is left out."""
    sums = added(a, b.select("part", "cell", *[(-F.col(c)).alias(c) for c in SUMS]))
    return sums.where(" or ".join(f"`{c}` <> 0" for c in SUMS))


def single(cell: int, sums: list[int], part: int, parts: int) -> tuple[list[int], list[int]] | None:
    """What a cell holds if it holds copies of one element: the element's sums for one copy, and its cells."""
    n = sums[0]
    if n == 0 or any(s % n for s in sums):
        return None
    one = [s // n for s in sums]
    if any(not 0 <= s <= _LOW for s in one):
        return None
    signed = [v - (1 << 64) if v >> 63 else v for v in ((one[1] << 32) | one[2], (one[3] << 32) | one[4])]
    cells = [(one[4] >> 8 * i) % ROW + i * ROW for i in range(PLACES)]
    good = cell in cells and signed[0] % parts == part and zlib.crc32(f"{signed[0]}:{signed[1]}".encode()) == one[5]
    return (one, cells) if good else None


def taken_apart(change: DataFrame, parts: int) -> DataFrame:
    """cells of a difference -> part, kh, whole: the ids' hashes, or a row that is not ``whole`` for a part that can't be taken apart.

    A part has 1024 cells at the most and is one group.
    """

    def peel(cells: pd.DataFrame) -> pd.DataFrame:
        part, held = int(cells["part"].iloc[0]), defaultdict(lambda: [0] * len(SUMS))
        for row in cells[["cell", *SUMS]].itertuples(index=False):
            held[int(row[0])] = [int(v) for v in row[1:]]
        todo, found = list(held), set()
        for _ in range(64 * PLACES * ROW):  # far more steps than elements; errors can't go on for ever
            if not todo:
                break
            cell = todo.pop()
            got = single(cell, held[cell], part, parts)
            if got:
                one, at = got
                n = held[cell][0]
                for c in at:
                    held[c] = [s - n * v for s, v in zip(held[c], one)]
                todo += at
                kh = (one[1] << 32) | one[2]
                found.add(kh - (1 << 64) if kh >> 63 else kh)
        if any(any(s) for s in held.values()):
            return pd.DataFrame({"part": [part], "kh": pd.array([None], dtype="Int64"), "whole": [False]})
        return pd.DataFrame({"part": part, "kh": pd.array(sorted(found), dtype="Int64"), "whole": True})

    return change.groupBy("part").applyInPandas(peel, "part long, kh long, whole boolean")


def estimate(a: DataFrame, b: DataFrame, key: str = "id", values: str = "keywords") -> tuple[int, float]:
    """(rows of both, about how many elements differ), from 32 levels of 1024 counters, a level for half as many elements as the one before."""
    mark = lambda df, sign: elements(df, key, values).select("mix", (sign * F.col("check")).alias("d"))
    high = F.shiftrightunsigned("mix", 32)
    level = F.least(F.bit_count(high.bitwiseAND(-high) - 1), F.lit(31))
    both = mark(a, 1).union(mark(b, -1)).groupBy(level.alias("level"), F.col("mix").bitwiseAND(F.lit(1023)).alias("slot")).agg(F.sum("d").alias("d"), F.count("*").alias("n"))
    levels = {r[0]: (r[1], r[2]) for r in both.groupBy("level").agg(F.count_if(F.col("d") != 0), F.sum("n")).collect()}  # 32 rows
    used = [min(levels.get(i, (0, 0))[0], 1023) for i in range(32)]
    first = next(i for i in range(32) if all(u < 800 for u in used[i:]) or i == 31)
    return sum(n for _, n in levels.values()), sum(-1024 * math.log(1 - u / 1024) for u in used[first:]) * 2**first


def parts_for(rows: int, differing: float) -> int:
    return max(1, math.ceil(differing / LOAD), math.ceil(rows / MOST))


def candidates(a: DataFrame, b: DataFrame, key: str = "id", values: str = "keywords", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of a, rows of b) of all ids whose rows differ, copies counted; rows with a null id are equal to none and always among them.

    Equal rows come along only from a part that could not be taken apart, and where hashes of ids agree.
    """
    parts = parts or parts_for(*estimate(a, b, key, values))
    found = cut(taken_apart(difference(summary(a, parts, key, values), summary(b, parts, key, values)), parts))
    n, lost = found.agg(F.count("*"), F.count_if(~F.col("whole"))).first()
    listed = (lambda df: F.broadcast(df)) if n <= SMALL else (lambda df: df)
    null = found.sparkSession.range(1).select(key_hash(F.lit(None).cast(a.schema[key].dataType)).alias("_kh"))
    bad = found.where("not whole").select(F.col("part").alias("_part"))
    ids = found.where("whole").select(F.col("kh").alias("_kh")).union(null)

    def of(rows: DataFrame) -> DataFrame:
        marked = rows.withColumn("_kh", key_hash(F.col(key)))
        if not lost:
            return marked.join(listed(ids), "_kh", "left_semi").select(*rows.columns)
        marked = marked.withColumn("_part", part_of(F.col("_kh"), parts))
        single_ids = marked.join(listed(ids), "_kh", "left_semi").join(listed(bad), "_part", "left_anti")
        return single_ids.select(*rows.columns).union(marked.join(listed(bad), "_part", "left_semi").select(*rows.columns))

    return of(a), of(b)


def compare_by_summaries(a: DataFrame, b: DataFrame, key: str = "id", values: str = "keywords", parts: int | None = None) -> DataFrame:
    """``compare.compare_runs`` of runs whose ids are unique. Two absent contents of an id count as exact."""
    near_a, near_b = candidates(a, b, key, values, parts)
    absent = near_a.where(F.col(values).isNull()).select(key).join(near_b.where(F.col(values).isNull()).select(key), key).agg(F.count("*").alias("absent"))
    here = compare_runs(near_a, near_b, key, values).crossJoin(absent)  # one row each
    all_a = a.agg(F.count("*").alias("n_a"))
    common = F.col("n_a") - F.col("only_a")
    exact = common - (F.col("common") - F.col("exact") - F.col("absent"))
    return here.crossJoin(all_a).select("only_a", "only_b", common.alias("common"), exact.alias("exact"), (exact + F.col("order_only")).alias("set_equal"), "order_only", "content_diff")


def differing(a: DataFrame, b: DataFrame, key: str = "id", values: str = "keywords", parts: int | None = None) -> DataFrame:
    """key, kind (only_a, only_b, changed) of each id whose rows differ, ids being unique."""
    near_a, near_b = candidates(a, b, key, values, parts)
    left, right = near_a.select(F.col(key), F.col(values).alias("_x"), F.lit(True).alias("_a")), near_b.select(F.col(key), F.col(values).alias("_y"), F.lit(True).alias("_b"))
    both = left.join(right, key, "full")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return both.select(key, kind.alias("kind")).where("kind is not null")
