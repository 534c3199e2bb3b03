"""Names that miss the catalogue by a typing error: edit distance 1 or 2 by an index of deletions.

Two texts within distance d share a text that is left of each when at most d characters are deleted. So both sides
are expanded to what deletions leave, meet there by equality, and what meets is measured. What deletions leave of many
catalogue names is split by a hash of the name, and the misses that meet it are sent to each share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of a catalogue that one task compares with the misses of a deletion.
SHARE = 4096


def one_less(text: Column) -> Column:
    """The text with each of its characters deleted in turn."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def deletions(text: Column, distance: int) -> Column:
    """Distinct texts that are left after at most ``distance`` deletions, the text itself among them."""
    held = last = F.array(text)
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(F.filter(last, lambda t: t != ""), one_less)))
        held = F.concat(held, last)
    return F.array_distinct(held)


def near_pairs(misses: DataFrame, catalogue: DataFrame, distance: int = 2, share: int = SHARE) -> DataFrame:
    """misses(key), catalogue(key) -> (key, near, distance): all catalogue keys within ``distance`` edits; null keys are near nothing."""
    own = lambda df, name: df.where("key is not null").select(F.col("key").alias(name)).distinct()
    left = own(misses, "key").select("key", F.explode(deletions(F.col("key"), distance)).alias("left"))
    right = own(catalogue, "near").select("near", F.explode(deletions(F.col("near"), distance)).alias("left"))
    # Only what exceeds a share has more than one.
    hot = right.groupBy("left").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")).where("shares > 1")
    dealt = lambda df: df.join(hot, "left", "left").fillna(1, ["shares"])
    right = dealt(right).select("left", "near", F.pmod(F.xxhash64("near"), F.col("shares")).alias("share"))
    left = dealt(left).select("left", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)).alias("share"))
    met = left.join(right, ["left", "share"]).where(F.abs(F.length("key") - F.length("near")) <= distance).select("key", "near").distinct()
    return met.withColumn("distance", F.levenshtein("key", "near")).where(F.col("distance") <= distance)


def nearest(misses: DataFrame, catalogue: DataFrame, distance: int = 2) -> DataFrame:
    """misses(key) -> key, near, distance: the nearest catalogue key, the first by name among equals; null where none is within ``distance``."""
    best = near_pairs(misses, catalogue, distance).groupBy("key").agg(F.min(F.struct("distance", "near")).alias("b"))
    return misses.join(best, "key", "left").select(*misses.columns, F.col("b.near").alias("near"), F.col("b.distance").alias("distance"))
