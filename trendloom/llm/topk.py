"""Exact top-k search by inner product: tiled matrix products, tree-merged lists.

Vectors are turned to integers, ``floor(scale * x)``. Candidates are packed into
shards and queries into tiles; each (tile, slot) pair of the grid gets every
shard dealt to its slot, a product of tile and shard gives the scores, a partial
selection keeps k of each row, and a running list merges shard after shard in
a task. Two more merges, over groups of slots and then over all, finish the
tree. Nothing is broadcast: the grid replicates each side by a fixed factor
(queries by ``slots``, candidates by the number of tiles). Tiles are dealt to by partition, so that
each has its share of the queries, and numbers travel in the fewest bytes that hold them.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without vec_id; vectors of another length than the
query's don't meet it; empty vectors score 0. vec_id identifies a row: repeated
rows of one vec_id count once (the least vector), and a query never meets its
own vec_id. Ties go to the smaller vec_id. Fewer than k candidates: all of
them. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts_for

MAX = 2**63 - 1
#: Vectors that one task packs into shards.
PACK_ROWS = 1 << 18
KINDS = {2: np.int16, 4: np.int32, 8: np.float64}


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices of whole float64 numbers; beyond 64 bits the nearest long."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**52:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(x) for x in row] for row in b]
    return np.array([[max(-MAX, min(MAX, sum(int(x) * y for x, y in zip(row, other)))) for other in whole] for row in a], dtype=np.int64).reshape(len(a), len(b))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, ties to the smaller id; ids ascend along the columns or are one row for each query."""
    if score.shape[1] > 4 * k and ids.ndim == 1 and np.abs(score).max(initial=0) < 2**40:
        n = score.shape[1]
        key = score * n + np.arange(n - 1, -1, -1)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
        return np.take_along_axis(score, at, 1), ids[at]
    ids = np.broadcast_to(ids, score.shape)
    at = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, at, 1), np.take_along_axis(ids, at, 1)


def narrow(m: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers as (bytes to a number, data): 2 or 4 if they fit, else 8 as floats."""
    most = float(np.abs(m).max(initial=0))
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return width, m.astype(KINDS[width]).tobytes()


def wide(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, KINDS[width]).reshape(n, -1).astype(np.float64) if data else np.zeros((n, 0))


def pack(rows: DataFrame, each: int) -> DataFrame:
    """(id, v) -> shards of at most ``each`` vectors of one dimension, ids ascending.

    Rows are packed in order of their id, so that a task that is run again makes the same shards.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, list]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            got = sorted(waiting.pop(dim))
            ids = np.array([g[0] for g in got], dtype=np.int64)
            m = np.array([g[1] for g in got], dtype=np.float64).reshape(len(got), dim)
            width, data = narrow(m)
            return pa.record_batch({"dim": pa.array([dim], pa.int32()), "width": pa.array([width], pa.int32()), "ids": [ids.tobytes()], "m": [data]})

        for batch in batches:
            for i, v in zip(batch["id"].to_pylist(), batch["v"].to_pylist()):
                held = waiting.setdefault(len(v), [])
                held.append((i, v))
                if len(held) == each:
                    yield out(len(v))
        for dim in list(waiting):
            yield out(dim)

    return rows.select("id", "v").sortWithinPartitions("id").mapInArrow(packed, "dim int, width int, ids binary, m binary")


def query_tiles(queries: DataFrame, tiles: int, tile_rows: int) -> DataFrame:
    """(id, v) -> tile, dim, q_width, q_ids, q_m: a partition of the queries is a tile."""
    q = pack(queries.repartition(tiles, "id"), tile_rows).withColumn("tile", (F.spark_partition_id() % tiles).cast("long"))
    return q.select("tile", "dim", F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, tile_rows: int = 4096, shard_rows: int = 4096, slots: int = 48) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> query_id, rank, vec_id, score; queries are the rows with vec_id divisible by ``every``."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("double")).alias("v"))
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    total, asked = rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    tiles = parts_for(asked, tile_rows)
    q = query_tiles(queries, tiles, tile_rows).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    parts = parts_for(total, PACK_ROWS, slots)
    deduped = rows.groupBy("id").agg(F.min("v").alias("v")).repartition(parts, "id")
    c = pack(deduped, shard_rows).withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
    c = c.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), "slot", "dim", "width", "ids", "m")
    grid = q.join(c, ["tile", "slot", "dim"])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for slot, q_ids, q_m, q_width, ids, m, width in zip(*(batch[c].to_pylist() for c in ("slot", "q_ids", "q_m", "q_width", "ids", "m", "width"))):
                qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                got = scores(wide(q_m, q_width, len(qi)), wide(m, width, len(ci)))
                s, i = best(got, ci, min(k + 1, len(ci)))  # one more: the query itself may be among them
                kept = i != qi[:, None]
                old = lists.get((slot, q_ids))
                s, i, kept = (np.hstack([o, n]) if old is not None else n for o, n in zip(old or (None,) * 3, (s, i, kept)))
                if s.shape[1] > 4 * (k + 1):
                    rank = np.lexsort((i, -s, ~kept), axis=1)[:, : k + 1]
                    s, i, kept = (np.take_along_axis(x, rank, 1) for x in (s, i, kept))
                lists[slot, q_ids] = (s, i, kept)
        for (slot, q_ids), (s, i, kept) in lists.items():
            rank = np.lexsort((i, -s, ~kept), axis=1)[:, :k]
            s, i, kept = (np.take_along_axis(x, rank, 1) for x in (s, i, kept))
            qi = np.repeat(np.frombuffer(q_ids, np.int64), s.shape[1]).reshape(s.shape)
            yield pa.record_batch({"query_id": qi[kept], "slot": pa.array(np.full(kept.sum(), slot), pa.int32()), "vec_id": i[kept], "score": s[kept]})

    lists = grid.mapInArrow(product, "query_id long, slot int, vec_id long, score long")
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    branch = W.partitionBy("query_id", "branch").orderBy(*order)
    merged = lists.withColumn("branch", F.floor(F.col("slot") / 8)).withColumn("rank", F.row_number().over(branch)).where(F.col("rank") <= k)
    merged = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
