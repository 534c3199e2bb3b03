"""Runs reconciled from summaries against a plain comparison."""

import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators import compare as cp
from trendloom.operators import reconcile as rc

SCHEMA = "id string, keywords array<string>, more int"


def made(n, changes, seed=1):
    """Two runs: n rows, of which ``changes`` each are changed, missing in b, and new in b."""
    rnd = random.Random(seed)
    a = {f"k{i}": [f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(4))] for i in range(n)}
    b, ids = dict(a), rnd.sample(sorted(a), 2 * changes)
    for k in ids[:changes]:
        b[k] = [*a[k], "new"]
    for k in ids[changes:]:
        del b[k]
    b |= {f"n{i}": ["x"] for i in range(changes)}
    return a, b


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1) for k, v in (rows.items() if isinstance(rows, dict) else rows)], SCHEMA)


def plain(a, b):
    return {(k, "only_a") for k in a.keys() - b.keys()} | {(k, "only_b") for k in b.keys() - a.keys()} | {(k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}


@pytest.mark.parametrize("changes", [0, 1, 40, 900])
def test_differing_ids(spark, changes):
    a, b = made(3000, changes)
    got = rc.differing(frame(spark, a), frame(spark, b))
    assert {tuple(r) for r in got.collect()} == plain(a, b)
    rows, _ = rc.candidates(frame(spark, a), frame(spark, b))
    assert rows.columns == ["id", "keywords", "more"] and rows.count() == 2 * changes  # equal rows aren't read out


def test_the_estimate_follows_the_differences(spark):
    for changes in (0, 10, 1500):
        a, b = made(6000, changes, 3)
        rows, many = rc.estimate(frame(spark, a), frame(spark, b))
        want = 4 * changes  # a changed row is two elements
        assert rows == len(a) + len(b) and abs(many - want) <= 0.15 * want


def test_parts_that_cannot_be_taken_apart_are_compared_row_by_row(spark):
    a, b = made(3000, 700, 5)
    left, right = frame(spark, a), frame(spark, b)
    for parts in (1, 3):
        cells = rc.difference(rc.summary(left, parts), rc.summary(right, parts))
        assert cells.count() <= parts * rc.PLACES * rc.ROW
        whole = {r["whole"] for r in rc.taken_apart(cells, parts).collect()}
        assert False in whole
        assert {tuple(r) for r in rc.differing(left, right, parts=parts).collect()} == plain(a, b)


def test_summaries_add_up(spark):
    a, b = made(2000, 20, 7)
    left = frame(spark, a)
    halves = [left.where(F.substring("id", -1, 1) < "5"), left.where(F.substring("id", -1, 1) >= "5")]
    parts = 2
    stored = rc.added(*[rc.summary(h, parts) for h in halves])
    assert rc.difference(stored, rc.summary(left, parts)).count() == 0
    out = rc.taken_apart(rc.difference(stored, rc.summary(frame(spark, b), parts)), parts)
    want = {r[0] for r in spark.createDataFrame([(k,) for k, _ in plain(a, b)], "id string").select(rc.key_hash(F.col("id"))).collect()}
    assert {r["kh"] for r in out.collect()} == want


def test_counts_of_a_comparison(spark):
    a, b = made(800, 30, 9)
    for k in [k for k in sorted(a) if k in b and len(set(a[k])) > 1][:25]:
        b[k] = a[k][::-1]
    left, right = frame(spark, a), frame(spark, b)
    for parts in (None, 1):
        assert rc.compare_by_summaries(left, right, parts=parts).collect() == cp.compare_runs(left, right).collect()


def test_nulls_repeats_and_empty_tables(spark):
    none = frame(spark, [])
    some = frame(spark, [("a", ["x"]), ("b", None), ("c", [None]), ("d", [""]), (None, ["x"])])
    assert {tuple(r) for r in rc.differing(none, none).collect()} == set()
    assert {tuple(r) for r in rc.differing(some.where("id is not null"), none).collect()} == {(k, "only_a") for k in "abcd"}
    other = frame(spark, [("a", ["x"]), ("b", []), ("c", [""]), ("d", [""]), (None, ["x"])])
    got = sorted(map(tuple, rc.differing(some, other).collect()), key=repr)
    assert got == sorted([("b", "changed"), ("c", "changed"), (None, "only_a"), (None, "only_b")], key=repr)
    assert rc.compare_by_summaries(some, some).first().asDict() == {"only_a": 1, "only_b": 1, "common": 4, "exact": 4, "set_equal": 4, "order_only": 0, "content_diff": 0}
    # Copies are counted: an id with a copy more is a candidate with all its rows, one with as many is not.
    twice, thrice = frame(spark, [("a", ["x"])] * 2 + [("b", ["y"])] * 2), frame(spark, [("a", ["x"])] * 3 + [("b", ["y"])] * 2)
    rows = [r["id"] for side in rc.candidates(twice, thrice) for r in side.collect()]
    assert rows == ["a"] * 5
    # An id of another type, and other names.
    x = spark.range(5).select(F.col("id").alias("_n"), (F.col("id") * 2).alias("keywords"))
    assert [tuple(r) for r in rc.differing(x, x.where("_n <> 3"), "_n").collect()] == [(3, "only_a")]
