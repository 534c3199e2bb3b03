"""Comparison of runs, digests of content, order statistics, nearest later rows.

Order within a group is found by a window where no group has more than ``GROUP_ROWS`` rows, which a count by group
tells first. Else it is found on range-partitioned tables: each task orders its own
stretch, and what it needs from the others is one small row for each (group, stretch). So a group
may be as large as the table; both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a group that one task orders.
GROUP_ROWS = 1 << 20


def largest(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def paired(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """(k, x, y, in_a, in_b) of a full join."""
    left = a.select(F.col(key).alias("k"), F.col(values).alias("x"), F.lit(True).alias("in_a"))
    return left.join(b.select(F.col(key).alias("k"), F.col(values).alias("y"), F.lit(True).alias("in_b")), "k", "full")


def same_set(x: Column, y: Column) -> Column:
    return F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "id", values: str = "keywords") -> DataFrame:
    """One row: ids only in a, only in b, common, equal lists, equal sets, order only, different content."""
    j = paired(a, b, key, values)
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    exact, alike = both & (F.col("x") == F.col("y")), both & same_set(F.col("x"), F.col("y"))
    return j.agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(both).alias("common"), F.count_if(exact).alias("exact"), F.count_if(alike).alias("set_equal"), F.count_if(alike & ~exact).alias("order_only"), F.count_if(both & ~alike).alias("content_diff"))


def run_diffs(a: DataFrame, b: DataFrame, key: str = "id", values: str = "keywords", most: int = 10) -> DataFrame:
    """The first ``most`` common ids whose lists differ: what only either side holds, in its order, and whether only the order differs."""
    j = paired(a, b, key, values).where("in_a and in_b and x <> y")
    lacks = lambda x, y: F.filter(x, lambda v: ~F.array_contains(y, v))
    return j.select(F.col("k").alias(key), lacks(F.col("x"), F.col("y")).alias("only_in_a"), lacks(F.col("y"), F.col("x")).alias("only_in_b"), same_set(F.col("x"), F.col("y")).alias("order_only")).orderBy(key).limit(most)


def one_sided(a: DataFrame, b: DataFrame, key: str = "id", most: int = 5) -> DataFrame:
    """(side, key): the first ``most`` ids of a that b lacks, and of b that a lacks."""
    first = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").orderBy(key).limit(most).select(F.lit(side).alias("side"), key)
    return first(a, b, "a").union(first(b, a, "b"))


def injected(files: list[DataFrame], key: str) -> DataFrame:
    """One row: distinct ids over several inputs."""
    rows = files[0].select(key)
    for f in files[1:]:
        rows = rows.union(f.select(key))
    return rows.agg(F.countDistinct(key).alias("n"))


def content_digest(rows: DataFrame, key: str, values: str, by: list[str] | None = None) -> DataFrame:
    """First 16 hex digits of SHA-256 over the rows of a group by key: the values joined by 0x1F, each row ended by 0x1E.

    A digest runs through its bytes in order, so a group is one task's; its rows pass through in
    order and are not held.
    """
    by = by or []
    groups = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))
    line = F.concat(F.col(key).cast("string"), F.array_join(values, "\x1f"), F.lit("\x1e"))
    flat = rows.select(groups.alias("g"), F.xxhash64(groups).alias("h"), F.col(key).cast("string").alias("k"), line.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held, pa.array([digest.hexdigest()[:16]])], names=["g", "digest"])

        for batch in batches:
            for i, v in enumerate(batch["v"]):
                if held is None or batch["g"][i] != held[0]:
                    if held is not None:
                        yield done()
                    held, digest = batch["g"].slice(i, 1), hashlib.sha256()
                digest.update((v.as_py() or "").encode())
        if held is not None:
            yield done()

    ordered = flat.repartition("h").sortWithinPartitions("h", "g", "k", "v").select("g", "v")
    kind = ordered.schema["g"].dataType.simpleString()
    out = ordered.mapInArrow(run, f"g {kind}, digest string")
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "digest")


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column], most_rows: int = GROUP_ROWS) -> DataFrame:
    """by -> n and the elements at ``places`` (Columns over ``n``, counted from 1) of the sorted non-null values.

    Exact. An empty table gives no group, and without groups one row of nulls. Equal values are counted first; in groups of more than ``most_rows`` rows the distinct ones are dealt out by range, and a value's place is
    the number of values in the stretches before plus its place in its own.
    """
    alike = lambda x, y, cols: F.expr(" and ".join([f"{x}.`{c}` <=> {y}.`{c}`" for c in cols] or ["true"]))
    rows = rows.where(F.col(value).isNotNull())
    counted = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    if largest(rows, by) <= most_rows:
        group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        wants = F.array(*[F.struct(F.lit(k).alias("name"), at.cast("long").alias("at")) for k, at in places.items()])
        placed = counted.withColumns({"_to": F.sum("_n").over(group.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("_n").over(group)})
        hits = placed.withColumn("_hit", F.explode(F.filter(wants, lambda w: (F.col("_to") - F.col("_n") < w["at"]) & (w["at"] <= F.col("_to")))))
        return hits.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_hit.name") == k, F.col("_v"))).alias(k) for k in places])
    dealt = cut(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    stretches = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_held"))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    stretches = stretches.withColumns({"_before": F.coalesce(F.sum("_held").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_held").over(group)})
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), at.cast("long").alias("at")) for k, at in places.items()])
    # Only the stretches that hold a place are ordered.
    wanted = stretches.withColumn("_want", F.explode(F.filter(wanted, lambda w: (F.col("_before") < w["at"]) & (w["at"] <= F.col("_before") + F.col("_held")))))
    needed = cut(wanted.groupBy(*by, "_part", "n", "_before").agg(F.collect_list("_want").alias("_wants")))
    own = dealt.alias("d").join(needed.alias("w"), alike("d", "w", [*by, "_part"])).select("d.*", "w.n", "w._before", "w._wants")
    run = W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumn("_to", F.col("_before") + F.sum("_n").over(run))
    hits = own.withColumn("_hit", F.explode(F.filter("_wants", lambda w: (F.col("_to") - F.col("_n") < w["at"]) & (w["at"] <= F.col("_to")))))
    return hits.groupBy(*by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("_hit.name") == k, F.col("_v"))).alias(k) for k in places])


def asof_forward(left: DataFrame, right: DataFrame, left_t: str, right_t: str, value: str, keys: list[str] | None = None, most_rows: int = GROUP_ROWS) -> DataFrame:
    """+ the right row of equal or first later time within ``keys``, of equal times the least value; null keys and times match nothing.

    Where ``keys`` have more than ``most_rows`` rows, both sides are dealt out by (keys, time) range. A running frame finds the match in a row's own stretch;
    rows without one there take the first right row of the next stretch that has any.
    """
    keys = keys or []
    names = left.columns
    hit = F.struct(F.col(right_t).alias("t"), F.col(value).alias("v"))
    kind = right.select(hit.alias("h")).schema[0].dataType
    present = F.lit(True)
    for c in [*keys, right_t]:
        present = present & F.col(c).isNotNull()
    l_rows = left.select(F.struct("*").alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_hit"))
    r_rows = right.where(present).select(F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_t).alias("_t"), F.lit(1).alias("_side"), hit.alias("_hit"))
    ks = [f"_k{i}" for i in range(len(keys))]
    group = W.partitionBy(*ks) if ks else W.partitionBy(F.lit(0))
    result = lambda df, best: df.withColumn("_best", best).select(*[F.col("_row")[c].alias(c) for c in names], F.col("_best.t").alias("match_time"), F.col("_best.v").alias("match_value"))
    counts = [x.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n")) for x in (left, right.where(present))]
    if (counts[0].union(counts[1]).groupBy(*ks).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) <= most_rows:
        run = group.orderBy(F.desc_nulls_first("_t"), F.desc("_side"), F.desc("_hit")).rowsBetween(W.unboundedPreceding, 0)
        found = l_rows.union(r_rows).withColumn("_next", F.last("_hit", ignorenulls=True).over(run)).where("_side = 0")
        return result(found, F.when(F.col("_t").isNotNull(), F.col("_next")))
    dealt = cut(l_rows.union(r_rows).repartitionByRange(*ks, "_t").withColumn("_part", F.spark_partition_id()))
    # From the last to the first, equal times with the right side before the left: the last hit seen is the next in time.
    own = W.partitionBy(*ks, "_part").orderBy(F.desc_nulls_first("_t"), F.desc("_side"), F.desc("_hit")).rowsBetween(W.unboundedPreceding, 0)
    found = dealt.withColumn("_next", F.last("_hit", ignorenulls=True).over(own)).where("_side = 0")
    firsts = dealt.groupBy(*ks, "_part").agg(F.min("_hit").alias("_first"))
    later = cut(firsts.withColumn("_later", F.last("_first", ignorenulls=True).over(group.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1))).select(*ks, "_part", "_later"))
    both = found.alias("f").join(later.alias("l"), F.expr(" and ".join(f"f.{c} <=> l.{c}" for c in [*ks, "_part"])))
    return result(both.select("f._row", "f._t", "f._next", "l._later"), F.when(F.col("_t").isNotNull(), F.coalesce("_next", "_later")))
