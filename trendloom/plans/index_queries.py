"""Indexes, sketches, and joins by nearness: over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import nearkeys as nk
from ..operators import resampled as rs
from ..operators import search as se
from ..operators import sketches as sk
from ..session import cut
from .text_queries import query, table

FOUND = lambda p: f"SELECT * FROM (SELECT doc_id, '{p}' AS pattern FROM documents WHERE text ILIKE '%{p}%' ORDER BY doc_id LIMIT 5)"
PATTERNS = ("Secret", "token_=", "of the", "zz", "no such text at all")


@query(" UNION ALL ".join(map(FOUND, PATTERNS)))
def search_by_index(spark, d):
    """The first rows by id for each pattern; one has no trigram."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = cut(se.build(docs, "text", "doc_id"))
    out = None
    for p in PATTERNS:
        one = se.search_indexed(index, docs, "text", p, "doc_id").select("doc_id", F.lit(p).alias("pattern"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_near, TRUE AS median_near, TRUE AS p95_near FROM events GROUP BY event_type")
def sketches_by_day(spark, d):
    """Sketches by day merged over all days, against exact counts: within 5 % and within 0.01 of the rank."""
    rows = table(spark, d, "events")
    stored = cut(sk.by_round(rows.withColumn("round", F.to_date("ts")), ["round", "event_type"], "user_id", "value"))
    near = sk.merged(stored, ["event_type"])
    exact = rows.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.expr("percentile(value, 0.5)").alias("p50"), F.expr("percentile(value, 0.95)").alias("p95"))
    j = near.join(exact, "event_type")
    at = lambda p, share: F.col(p).between(sk.percentile_of(F.col("spread"), share - 0.01), sk.percentile_of(F.col("spread"), share + 0.01))
    return j.select("event_type", "n", "users", (F.abs(sk.distinct_of(F.col("items")) - F.col("users")) <= 0.05 * F.col("users")).alias("users_near"), at("p50", 0.5).alias("median_near"), at("p95", 0.95).alias("p95_near"))


MISSED = """c AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS key FROM part WHERE p_size <= 25),
m AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN lower(p_type) || p_name WHEN 1 THEN 'x' || lower(p_type) || ' ' || p_name WHEN 2 THEN substr(lower(p_type), 2) || ' ' || p_name || 's' ELSE lower(p_type) || ' un' || p_name || 's' END AS key FROM part)"""


def missed(spark, d):
    part = table(spark, d, "part")
    kind, name, m = F.lower("p_type"), F.col("p_name"), F.col("p_size") % 4
    key = F.when(m == 0, F.concat(kind, name)).when(m == 1, F.concat(F.lit("x"), kind, F.lit(" "), name)).when(m == 2, F.concat(F.expr("substring(lower(p_type), 2)"), F.lit(" "), name, F.lit("s"))).otherwise(F.concat(kind, F.lit(" un"), name, F.lit("s")))
    return part.select(key.alias("key")).distinct(), part.where("p_size <= 25").select(F.concat(kind, F.lit(" "), name).alias("key")).distinct()


@query(f"WITH {MISSED} SELECT m.key, c.key AS near, levenshtein(m.key, c.key)::INTEGER AS distance FROM m, c WHERE levenshtein(m.key, c.key) <= 2")
def near_keys(spark, d):
    return nk.near_pairs(*missed(spark, d))


@query(f"WITH {MISSED}, p AS (SELECT m.key, c.key AS near, levenshtein(m.key, c.key)::INTEGER AS distance FROM m, c WHERE levenshtein(m.key, c.key) <= 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, near) AS n FROM p) SELECT m.key, near, distance FROM m LEFT JOIN (SELECT * FROM r WHERE n = 1) USING (key)")
def nearest_keys(spark, d):
    return nk.nearest(*missed(spark, d))


SPANS = "s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + (value * 60000000)::BIGINT AS b FROM events)"


def spans(spark, d):
    """Events as intervals: as many minutes as their value."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", at.alias("a"), (at + F.round(F.col("value") * 60000000).cast("long")).alias("b"))


@query(f"WITH {SPANS} SELECT x.event_id AS error, y.event_id AS purchase FROM s x JOIN s y ON x.event_type = 'error' AND y.event_type = 'purchase' AND x.user_id = y.user_id AND x.a <= y.b AND y.a <= x.b")
def interval_overlaps(spark, d):
    """Errors and purchases of a user that overlap."""
    rows = spans(spark, d)
    met = iv.overlaps(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"), "a", "b", ["user_id"])
    return met.select(F.col("l.event_id").alias("error"), F.col("r.event_id").alias("purchase"))


@query(f"WITH {SPANS} SELECT y.event_id, count(*) AS running FROM s x JOIN s y ON x.event_type = 'error' AND y.event_type = 'signup' AND x.a <= y.b AND y.a <= x.b GROUP BY y.event_id")
def interval_overlaps_of_one_key(spark, d):
    """How many errors of anyone a signup overlaps: all rows have one key."""
    rows = spans(spark, d)
    met = iv.overlaps(rows.where("event_type = 'error'"), rows.where("event_type = 'signup'"), "a", "b", stretch=256)
    return met.groupBy(F.col("r.event_id").alias("event_id")).agg(F.count("*").alias("running"))


_CHANCES = " + ".join(f"(u > {c!r}::DOUBLE)::INTEGER" for c in rs.cumulative())


@query(f"""WITH w AS (SELECT quality, toxic AS hit, b, (('0x' || substr(md5(doc_id || ':' || b || ':1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM labels, generate_series(1, 200) g(b)),
e AS (SELECT quality, b, sum({_CHANCES}) AS n, sum(({_CHANCES}) * hit) AS k FROM w GROUP BY quality, b),
r AS (SELECT quality, k / n AS share, row_number() OVER (PARTITION BY quality ORDER BY k / n) AS pos, count(*) OVER (PARTITION BY quality) AS m FROM e WHERE n > 0),
i AS (SELECT quality, max(share) FILTER (pos = greatest(1, ceil(0.025 * m))) AS low, max(share) FILTER (pos = greatest(1, ceil(0.975 * m))) AS high FROM r GROUP BY quality)
SELECT quality, n, share, low, high FROM (SELECT quality, count(*) AS n, avg(toxic) AS share FROM labels GROUP BY quality) JOIN i USING (quality)""")
def bootstrap_intervals(spark, d):
    """Shares of toxic texts by quality, with resampled intervals."""
    return rs.shares(table(spark, d, "labels"), ["quality"], F.col("toxic"), F.col("doc_id"))
