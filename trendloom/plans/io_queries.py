"""Sinks and scans over the standard tables, written and read back; plans by name; guarantees of the retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import menujoin as mj
from ..operators import retrieve as rt
from ..session import cut, scratch
from ..sources import io
from . import graph_queries as gq
from .text_queries import catalogue, menus, query, table

EVENT = "event_id long, user_id long, event_type string, value double"


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_lines_round_trip(spark, d):
    """A folder for errors and one for the rest, scanned together under a schema."""
    path, rows = scratch(spark, "lines"), table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    error = F.col("event_type").eqNullSafe("error")
    io.write_jsonl(rows.where(error), f"{path}/errors")
    io.write_jsonl(rows.where(~error), f"{path}/others")
    return io.read_jsonl(spark, [f"{path}/errors", f"{path}/others"], EVENT, "written by this query")


@query("SELECT p_partkey, p_name, p_brand || ', \"' || p_type || '\"' AS label, p_size FROM part")
def sheet_round_trip(spark, d):
    """Labels with commas and quotes, after a byte-order mark."""
    path = scratch(spark, "sheet")
    label = F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"'))
    io.write_csv_sheet(table(spark, d, "part").select("p_partkey", "p_name", label.alias("label"), "p_size"), path)
    return io.read_csv_sheet(spark, path, "p_partkey long, p_name string, label string, p_size int")


@query("SELECT conv_id, turn, count(*) AS times FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn FROM conversations WHERE role = 'system') GROUP BY ALL")
def dead_letters_append(spark, d):
    """Two batches of rejected turns, appended."""
    path, rows = scratch(spark, "dead"), table(spark, d, "conversations")
    for role in ("user", "system"):
        io.dead_letters(rows.where(F.col("role") == role).select("conv_id", "turn"), path)
    return spark.read.schema("conv_id long, turn long").json(path).groupBy("conv_id", "turn").agg(F.count("*").alias("times"))


@query("SELECT event_type AS round, count(*) FILTER (event_type <> 'view' OR value > 50) AS n FROM events GROUP BY event_type HAVING count(*) FILTER (event_type <> 'view' OR value > 50) > 0")
def rounds_replaced(spark, d):
    """A round for each type; that of views is written again with large values only."""
    path, rows = scratch(spark, "rounds"), table(spark, d, "events").select("event_id", "value", F.col("event_type").alias("round"))
    io.write_rounds(rows, path)
    io.write_rounds(rows.where("round = 'view' and value > 50"), path)
    return spark.read.schema("event_id long, value double, round string").parquet(path).groupBy("round").agg(F.count("*").alias("n"))


@query("SELECT 'merge' AS strategy, TRUE AS as_asked, count(*) AS rows FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type || ' ' || p_name IN (SELECT p_type || ' ' || p_name FROM part WHERE p_size <= 2) UNION ALL SELECT 'broadcast', TRUE, count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type || ' ' || p_name IN (SELECT p_type || ' ' || p_name FROM part WHERE p_size <= 2)")
def join_strategies(spark, d):
    """Whether the plan has the join that was asked for, and the rows that it gives."""
    out = None
    for strategy, name in (("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")):
        rows = mj.joined(menus(spark, d), catalogue(spark, d), strategy)
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(strategy).alias("strategy"), F.lit(name in mj.join_strategy(rows)).alias("as_asked"), "rows")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {gq.GRAPH} SELECT count(*) AS removed, 0::BIGINT AS left_over FROM e")
def graph_reset(spark, d):
    edges = cut(gq.edges(spark, d))
    removed, empty = g.reset(edges)
    return empty.agg(F.count("*").alias("left_over")).select(F.lit(removed).cast("long").alias("removed"), "left_over")


@query(f"WITH {gq.ASKED} SELECT count(*) AS questions, count(*) AS answered FROM q")
def never_empty(spark, d):
    """Each question gets candidates, whatever its conditions."""
    asked = gq.questions(spark)
    found = rt.relaxation_ladder(asked, cut(gq.totals(spark, d)), gq.conditions(spark, d)).select("qid").distinct().withColumn("_hit", F.lit(1))
    return asked.join(found, "qid", "left").agg(F.count("*").alias("questions"), F.count("_hit").alias("answered"))


@query(f"WITH {gq.GRAPH} SELECT name, count, latest FROM tot LEFT JOIN (SELECT src, max(dst) AS latest FROM e WHERE rel = 'RECORDED_ON' GROUP BY src) ON src = name ORDER BY latest DESC NULLS LAST, count DESC NULLS LAST, name LIMIT 50")
def trending_clamped(spark, d):
    """900 rows asked for, of which 50 are allowed."""
    return rt.trending(gq.edges(spark, d, "RECORDED_ON"), gq.totals(spark, d), rt.clamp(900)).select("name", "count", "latest")
