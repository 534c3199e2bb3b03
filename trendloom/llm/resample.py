"""Resampling of documents by importance towards the distribution of a target text.

Features are a text's words and pairs of neighbouring words, dealt to buckets by CRC-32. Both the corpus and the
target are counted by bucket; a bucket's gain is the logarithm of how much likelier it is in the target,
and a document's weight is the mean gain of its features. A draw by Gumbel keys takes a share of
the documents with chances that follow their weights.

The dictionary of distinct features is global: blocks of documents count their words and pairs by number,
and send each distinct feature once, as text with its count, packed by a hash of it. In a part the counts of a feature meet; each distinct one
is hashed once, its count is added to its bucket, and the buckets go back to the blocks in the order asked.
Bucket totals are ``BUCKETS`` numbers, whatever the input; their gains are
joined to each document's feature counts. A feature that every document holds is one entry for each block.

Ranks of the draw come from rows dealt out by range of the score, and a count for each range.

Defined results: null text and texts without words have no features, weight 0 and are not drawn, as all texts with fewer than
``least_words`` words; a null doc_id counts as the empty text in the draw; repeated rows have features,
and ranks, of their own; an empty target has the gains of no counts; other columns are ignored; an empty table gives
an empty result; texts are taken whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks
from .common import discard, materialize, parts_for, size_hint
from .decontam import words_of
from .lm import mix, pair_keys, token_keys

BUCKETS = 10000
LEAST_WORDS = 20
#: Bytes of documents, as Catalyst estimates them, to a part of the dictionary.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 12 << 20, 6, 1 << 16
#: Text bytes in a block.
BLOCK_BYTES = 12 << 20
#: Features hashed together.
GROUP = 1 << 18


def features(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: its distinct features in order (words, then pairs), their hashes and counts, and for each word and each pair of neighbours in turn the place of its feature; pairs that cross documents have -1."""
    tokens = pa.array(row["tokens"], pa.string())
    order = pc.array_sort_indices(tokens).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    flat = rank[blocks.expand(row["packed"], np.uint32)] if len(order) else np.zeros(0, np.int64)
    tokens = tokens.take(pa.array(order))
    of = np.repeat(np.arange(len(row["lens"])), row["lens"])
    inside = of[1:] == of[:-1]
    pairs, at = np.unique((flat[:-1] * len(order) + flat[1:])[inside], return_inverse=True)
    first, second = pairs // max(1, len(order)), pairs % max(1, len(order))
    keys = token_keys(tokens.to_pylist())
    text = pa.concat_arrays([tokens, pc.binary_join_element_wise(tokens.take(pa.array(first)), tokens.take(pa.array(second)), " ")])
    paired = np.full(max(0, len(flat) - 1), -1, np.int64)
    paired[inside] = at + len(order)
    counts = np.concatenate([np.bincount(flat, minlength=len(order)), np.bincount(at, minlength=len(pairs))]).astype(np.int64)
    return text, np.concatenate([mix(keys), pair_keys(keys[first], keys[second])]), counts, flat, paired


def by_part(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of each feature, their order by part)."""
    part = (hashes % np.uint64(parts)).astype(np.int64)
    return part, np.argsort(part, kind="stable")


def asked(made: DataFrame, parts: int) -> DataFrame:
    """blocks -> (part, block, lens, data, counts): a block's features of a part, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, hashes, counts, _, _ = features(row)
                part, order = by_part(hashes, parts)
                text, counts, part = text.take(pa.array(order)), counts[order], part[order]
                lens = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.uint32)
                ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] else np.zeros(0, np.uint8)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
                spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
                for lo in range(0, len(spans), 64):
                    some = spans[lo : lo + 64]
                    yield pa.record_batch({"part": pa.array([int(part[a]) for a, _ in some], pa.int64()), "block": pa.array([row["block"]] * len(some), pa.int64()), "lens": pa.array([blocks.squeeze(lens[a:b]) for a, b in some], pa.binary()), "data": pa.array([blocks.squeeze(data[ends[a] : ends[b]]) for a, b in some], pa.binary()), "counts": pa.array([blocks.squeeze(counts[a:b].astype(np.uint32)) for a, b in some], pa.binary())})

    return made.select("block", "tokens", "packed", "lens").mapInArrow(run, "part long, block long, lens binary, data binary, counts binary")


def unpacked(lens: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """asked rows -> (block, part, data, sums): the bucket of each feature that a block asked for; sums, once for each part, are its counts by bucket."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lens = [blocks.expand(x.as_py(), np.uint32) for x in table["lens"]]
        text = unpacked(np.concatenate(lens), b"".join(blocks.expand(x.as_py(), np.uint8).tobytes() for x in table["data"]))
        code = text.dictionary_encode()
        at = code.indices.to_numpy()
        counts = np.bincount(at, np.concatenate([blocks.expand(x.as_py(), np.uint32) for x in table["counts"]]), len(code.dictionary))
        bucket = np.concatenate([np.fromiter(map(zlib.crc32, code.dictionary.slice(i, GROUP).to_pylist()), np.uint32) for i in range(0, len(code.dictionary), GROUP)]) % buckets
        sums = np.bincount(bucket, counts, buckets).astype(np.int64)
        answer = bucket[at].astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        ends = np.cumsum([len(x) for x in lens])
        data = [blocks.squeeze(answer[end - len(x) : end]) for x, end in zip(lens, ends)]
        return pa.table({"block": table["block"], "part": table["part"], "data": pa.array(data, pa.binary()), "sums": pa.array([blocks.squeeze(sums)] + [None] * (len(data) - 1), pa.binary())})

    return rows.groupBy("part").applyInArrow(run, "block long, part long, data binary, sums binary")


def totals(answers: DataFrame, buckets: int) -> DataFrame:
    """answers -> (bucket, n): counts of buckets over all parts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for sums in batch["sums"]:
                held += blocks.expand(sums.as_py(), np.int64)
        full = np.flatnonzero(held)
        yield pa.record_batch({"bucket": pa.array(full, pa.int64()), "n": pa.array(held[full], pa.int64())})

    return answers.where("sums is not null").select("sums").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(blocks, answers, (bucket, n), number of parts)."""
    parts = min(MOST_PARTS, parts_for(size_hint(docs), PART_BYTES, LEAST_PARTS))
    made = materialize(blocks.build(docs.select("doc_id", "text"), lambda text: [w.decode() for w in words_of(text)], block_bytes=BLOCK_BYTES), "feature-blocks")
    answers = materialize(hashed(asked(made, parts), buckets), "feature-buckets")
    return made, answers, totals(answers, buckets), parts


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets: thousandths of the log ratio of target to corpus, each count plus one, rounded down."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double"))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))  # one row


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_words, n_features, weight: the mean gain of a document's features, rounded down."""
    made, answers, corpus, parts = counted(docs, buckets)
    aimed_at = counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    gain = np.zeros(buckets, np.int64)
    for row in gains(corpus, aimed_at[2], buckets).collect():  # as many rows as buckets
        gain[row["bucket"]] = row["gain"]
    discard(*aimed_at[:2])

    def run(key: tuple, held: pa.Table, got: pa.Table) -> pa.Table:
        kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        found = np.concatenate([*(blocks.expand(x["data"], kind) for x in got.sort_by("part").to_pylist()), np.zeros(0, kind)])
        out = []
        for row in held.to_pylist():
            _, hashes, _, flat, paired = features(row)
            mine = np.empty(len(found), np.int64)
            mine[by_part(hashes, parts)[1]] = gain[found]
            lens = np.array(row["lens"], np.int64)
            of = np.repeat(np.arange(len(lens)), lens)
            inside = paired >= 0
            # A document's features with their counts, met by their gains.
            codes, times = np.unique(np.concatenate([of * len(mine) + flat, of[1:][inside] * len(mine) + paired[inside]]), return_counts=True)
            sums = np.bincount(codes // max(1, len(mine)), mine[codes % max(1, len(mine))] * times, len(lens)).astype(np.int64)
            n = lens + np.maximum(lens - 1, 0)
            out.append((row["doc_ids"], lens, n, np.where(n > 0, sums // np.maximum(n, 1), 0)))
        cat = lambda i: np.concatenate([np.asarray(o[i]) for o in out])
        return pa.table({"doc_id": pa.array([d for o in out for d in o[0]], pa.int64()), **{name: pa.array(cat(i), pa.int64()) for i, name in enumerate(("n_words", "n_features", "weight"), 1)}})

    blocked = made.select("block", "doc_ids", "tokens", "packed", "lens").groupBy("block")
    return blocked.cogroup(answers.select("block", "part", "data").groupBy("block")).applyInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(rows: DataFrame, per_cent: int, least_words: int = LEAST_WORDS, seed: int = 7, parts: int | None = None) -> DataFrame:
    """rows(doc_id, n_words, weight, ...) -> + score, rank: the ``per_cent`` highest scores of the rows with ``least_words`` words, ranked; rank is null for the others.

    A row's score is its weight plus a Gumbel number, in thousandths, made of its id and the seed.
    """
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0)))
    scored = materialize(rows.withColumn("score", F.col("weight") + noise).withColumn("_in", F.coalesce(F.col("n_words") >= least_words, F.lit(False))), "scores")
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("weight"), F.col("n_words")]
    parts = parts or min(4096, max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    dealt = materialize(scored.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "score-ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.count_if("_in").alias("_able"))
    # A row for each range.
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.floor(F.sum("_able").over(W.partitionBy(F.lit(0))) * per_cent / 100).alias("_most"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*order))
    ranked = dealt.join(F.broadcast(sizes), "_part").withColumn("_place", place)
    discard(scored)
    return ranked.withColumn("rank", F.when(F.col("_in") & (F.col("_place") <= F.col("_most")), F.col("_place"))).drop("_part", "_before", "_most", "_place", "_in")


__all__ = ["draw", "gains", "weights"]
