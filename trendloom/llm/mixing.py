"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, ``-ln(u) / quality``; within a source
the documents in ascending key order are a weighted sample without
replacement. A source's target is met by complete epochs over the source first
and then by the documents with the smallest keys whose running word count
stays within what is left; the document on the boundary gives its first words
only, so that a source's total is its target rounded down.

Scale: the running count is not one window over a source (one source may hold a
third of all rows). Keys are mapped to places between 0 and 1, and a source's range of places is
cut into ``buckets`` slices whose sizes are summed on the map side; the slice
with the source's boundary is cut again, until it holds ``SLICE`` rows at most or
only equal keys. Rows below it are taken, rows above are not, and only its own rows are
put in order, equal rows counted first.

Defined results: null text has size 0; documents of size 0 take 0; null
sources are one source, ordered last; a null, NaN or non-positive quality counts
as the least quality; the key is a hash of doc_id, ``salt`` (if given) and seed; ties of keys go to the smaller doc_id, then to the
smaller size, so that rows equal in these may meet the boundary in either order with the same
totals; an empty table gives an empty result; other columns are kept whatever their names, but for
source_size, target and taken, which are the result's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize

LEAST_QUALITY = 0.05
#: Rows of a boundary slice that are put in order together.
SLICE = 1 << 16
#: Times a slice is cut; 1024**4 slices tell all places apart that differ by 1e-12.
LEVELS = 4


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white-space characters; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def letter_quality(text: Column) -> Column:
    """Share of characters other than ASCII digits and punctuation; at least LEAST_QUALITY."""
    shown = F.coalesce(text, F.lit(""))
    share = F.lit(1.0) - F.regexp_count(shown, F.lit(r"[!-@\[-`{-~]")) / F.greatest(F.length(shown), F.lit(1))
    return F.greatest(share, F.lit(LEAST_QUALITY))


def unit_hash(doc_id: Column, seed: int, salt: Column | None = None) -> Column:
    """Uniform in (0, 1), a function of doc_id, salt and seed alone."""
    parts = [doc_id] if salt is None else [doc_id, salt]
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) -> target: weights repeat over the sources by code point, null last.

    The targets are the water-filling solution: ``least(most * size, level *
    weight)``, with the level at which they sum to ``share`` of all sizes.
    """
    one = W.partitionBy()
    order = W.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight)
    t = t.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(one))
    up = W.partitionBy().orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    after = up.rowsBetween(W.currentRow, W.unboundedFollowing)
    t = t.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source, by cap / weight, whose cap the level doesn't exceed fixes the level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(one)["level"]
    return t.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_size", "target")


def mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = 1024, salt: str | None = None, slice_rows: int = SLICE) -> DataFrame:
    """rows(doc_id, source, size, quality, ...) -> + source_size, target, taken.

    ``salt`` names a column that tells rows of one doc_id apart, such as a digest of the text.
    The number of sources must be moderate (one small row for each is sorted on
    one executor); the number of documents need not be.
    """
    rows = rows.drop("source_size", "target", "taken")  # columns of the result's names give way
    quality = F.when(F.col("quality").isNull() | F.isnan("quality") | (F.col("quality") < LEAST_QUALITY), F.lit(LEAST_QUALITY)).otherwise(F.col("quality"))
    key = -F.log(unit_hash(F.col("doc_id"), seed, F.col(salt) if salt else None)) / quality
    flat = rows.select(F.struct("*").alias("row"), "doc_id", "source", F.col("size").cast("long").alias("size"), key.alias("key"))
    flat = materialize(flat.withColumn("place", F.col("key") / (1 + F.col("key"))), "mix-rows")  # sizes are dear, and places must not change
    plan = source_targets(flat.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")), "mix-plan")
    edge, level = boundary(flat, plan, buckets, slice_rows)
    rows = flat.alias("f").join(plan.alias("p"), F.expr("f.source <=> p.source"), "left").join(edge.alias("e"), F.expr("f.source <=> e.source"), "left")
    slot = slot_of(F.col("f.place"), buckets, level)
    rows = rows.select("f.*", "p.source_size", "p.target", "p.epochs", "p.rest", (slot - F.col("e.slot")).alias("side"), "e.before")
    clear = rows.where("side is null or side <> 0").withColumn("extra", F.when(F.col("side") < 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    out = clear.drop("side", "before").unionByName(in_order(rows.where("side = 0")))
    return out.select("row.*", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def slot_of(place: Column, buckets: int, level: int) -> Column:
    return F.floor(place * float(buckets**level)).cast("long")


def boundary(flat: DataFrame, plan: DataFrame, buckets: int, slice_rows: int) -> tuple[DataFrame, int]:
    """(source, slot, before) of the slice in which each source's fractional epoch ends, and the level of the slices; no row for sources without one."""
    edge, level = plan.where("rest > 0").select("source", F.col("rest"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("before")), 0
    while level < LEVELS:
        inside = flat.alias("f").join(edge.alias("e"), F.expr("f.source <=> e.source")).where(slot_of(F.col("f.place"), buckets, level) == F.col("e.slot"))
        level += 1
        sums = inside.groupBy("f.source", slot_of(F.col("f.place"), buckets, level).alias("slot")).agg(F.sum("f.size").alias("held"), F.count("*").alias("n"), F.first("e.rest").alias("rest"), F.first("e.before").alias("start"))
        run = W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("held").over(run), F.lit(0)))
        edge = materialize(sums.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("held"))).select("source", "rest", "slot", "before", "n"), "mix-edge")
        if (edge.agg(F.max("n")).first()[0] or 0) <= slice_rows:
            break
    return edge, level


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of the boundary slices -> + extra, the words that the fractional epoch takes of each.

    Equal rows are counted by task first, so that the running count has a row for each distinct row and task.
    """
    same = ("key", "doc_id", "size", "source", "part")
    cut = materialize(rows.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id()}), "mix-cut")
    counted = cut.groupBy(*same).agg(F.count("*").alias("n"), F.first("before").alias("start"))
    run = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "part").rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.col("start") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0))).drop("start", "n")
    met = cut.drop("before").alias("c").join(counted.alias("k"), F.expr(" and ".join(f"c.{x} <=> k.{x}" for x in same))).select("c.*", "k.before")
    own = W.partitionBy(*same).orderBy("nth")
    before = F.col("before") + (F.row_number().over(own) - 1) * F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - before)).cast("long")
    return met.withColumn("extra", extra).drop("side", "before", "part", "nth")


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Documents as the mix takes them: a copy for each complete epoch, then the first words of the fractional one.

    ``mixed`` is ``mix`` over the same documents and still carries text and size.
    """
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    texts = F.concat(
        F.array_repeat(F.col("text"), whole),
        F.when(rest > 0, F.array(F.array_join(F.slice(words, 1, rest), " "))).otherwise(F.array().cast("array<string>")),
    )
    out = mixed.where("taken > 0").withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
