"""Intervals, rates and the places of the percentile rules in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share; (0, 0) for n = 0."""
    n = F.nullif(n, F.lit(0))
    p, zz = k / n, z * z
    mid, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = (mid - spread) / (1 + zz / n), (mid + spread) / (1 + zz / n)
    zero = F.lit(0.0)
    return F.when(n.isNull(), zero).otherwise(F.greatest(zero, low)), F.when(n.isNull(), zero).otherwise(F.least(F.lit(1.0), high))


def wilson_or_null(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The same rounded to 4 digits, half to even; nulls for n = 0."""
    low, high = wilson(k, n, z)
    return F.when(n > 0, F.bround(low, 4)), F.when(n > 0, F.bround(high, 4))


# Percentile rules: the place, counted from 1, of an element among n sorted values.


def nearest_rank(n: Column, p: float) -> Column:
    """Element ceil(p n)."""
    return F.greatest(F.lit(1), F.ceil(F.lit(p) * n)).cast("long")


def rounded_index(n: Column, p: float) -> Column:
    """Element round(p (n - 1)), half to even, counted from 0."""
    return F.bround(F.lit(p) * (n - 1), 0).cast("long") + 1


def upper_median(n: Column) -> Column:
    return F.floor(n / 2).cast("long") + 1


def lower_median(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("long")


def low_index(n: Column, p: float) -> Column:
    """Element int(p n) - 1, counted from 0, as tool latencies are reported."""
    return F.greatest(F.lit(1), F.floor(F.lit(p) * n)).cast("long")


def precision_recall(tp: Column, fp: Column, fn_s: Column, tn_s: Column, dropped: Column) -> dict[str, Column]:
    """Precision with interval; misses carried over from a sample of the dropped; recall, whose bounds turn around."""
    p_lo, p_hi = wilson(tp, tp + fp)
    m_lo, m_hi = wilson(fn_s, fn_s + tn_s)
    recall = lambda fn: F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))
    fn = fn_s / F.nullif(fn_s + tn_s, F.lit(0)) * dropped
    return {
        "precision": tp / F.nullif(tp + fp, F.lit(0)), "precision_low": p_lo, "precision_high": p_hi,
        "missed": fn, "missed_low": m_lo * dropped, "missed_high": m_hi * dropped,
        "recall": recall(fn), "recall_low": recall(m_hi * dropped), "recall_high": recall(m_lo * dropped),
    }
