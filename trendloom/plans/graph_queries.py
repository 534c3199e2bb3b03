"""The graph of parts: dates, tags, categories, seasons, combos of suppliers, ingredients of nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import graph as g
from ..operators import paths as pa
from ..operators import retrieve as rt
from ..operators import tools
from ..operators.store import GraphStore
from ..session import cut, parts, scratch, unique
from .text_queries import query, table

YEAR = "1998"


def sales_parts(spark, d):
    """Partitions for what has up to a row for each row of lineitem."""
    return parts(spark, table(spark, d, "lineitem").count())


def edges(spark, d, *rels):
    """Edges, of some relations or of all, with the year of shipping as round for dates and combos, and 'base' for the rest.

    Deduplicated as numbers, before names are made, in partitions by the number of rows. Each relation is a branch of its own
    with a constant name, so what reads one relation computes no other.
    """
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy").alias("year"))
    part = table(spark, d, "part")
    supplier = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "n_name")
    name = lambda letter, c: F.concat(F.lit(letter), (F.col(c) if isinstance(c, str) else c).cast("string"))
    key = name("p", "p_partkey")
    base = F.lit("base")
    # By relation: distinct numbers, the edge made of them, its round.
    made = {
        "RECORDED_ON": (line.select("l_partkey", "year"), g.edge("Keyword", name("p", "l_partkey"), "RECORDED_ON", "Date", F.col("year")), F.col("year")),
        "IS_COMBO_WITH": (line, g.edge("Keyword", name("p", "l_partkey"), "IS_COMBO_WITH", "Combo", name("s", "l_suppkey")), F.col("year")),
        "HAS_TAG": (part.select("p_partkey", "p_type"), g.edge("Keyword", key, "HAS_TAG", "Tag", F.col("p_type")), base),
        "HAS_CATEGORY": (part.select("p_partkey", "p_brand"), g.edge("Keyword", key, "HAS_CATEGORY", "Category", F.col("p_brand")), base),
        "HAS_SEASON": (part.select("p_partkey", (F.col("p_size") % 4).alias("z")), g.edge("Keyword", key, "HAS_SEASON", "Season", name("z", "z")), base),
        # Every tenth part is related to one that isn't sold.
        "RELATED": (part.where(F.col("p_partkey") % 10 == 0).select("p_partkey"), g.edge("Keyword", key, "RELATED", "Keyword", name("p", F.col("p_partkey") + 1000000)), base),
        "INCLUDES": (supplier, g.edge("Combo", name("s", "s_suppkey"), "INCLUDES", "Ingredient", F.col("n_name")), base),
    }
    sold = ("RECORDED_ON", "IS_COMBO_WITH")
    n = sales_parts(spark, d) if {*(rels or made)} & {*sold} else None
    out = None
    for rel in rels or made:
        rows, e, r = made[rel]
        one = unique(rows, n if rel in sold else None).select(e.alias("e"), r.alias("round")).select("e.*", "round")
        out = one if out is None else out.union(one)
    return out


def graph(spark, d):
    """(nodes, edges), both written once: queries read them several times."""
    e = cut(edges(spark, d))
    return cut(nodes(spark, d, e)), e


def keywords(spark, d):
    """Keywords by year with the year's quantity as count."""
    line = table(spark, d, "lineitem").groupBy("l_partkey", F.date_format("l_shipdate", "yyyy").alias("round")).agg(F.sum("l_quantity").cast("long").alias("count"))
    return line.select(F.lit("Keyword").alias("label"), F.concat(F.lit("p"), "l_partkey").alias("key"), "round", "count")


def totals(spark, d):
    """Counts of keywords over all rounds, those that are only related with 0; no other node is built."""
    stubs = edges(spark, d, "RELATED").select(F.lit("Keyword").alias("label"), F.col("dst").alias("key"), "round", F.lit(0).cast("long").alias("count"))
    return g.keyword_totals(keywords(spark, d).union(stubs).withColumn("importance", F.lit(None).cast("double")))


def nodes(spark, d, e):
    """Keywords by year; other labels from the edges and from all nations."""
    own = keywords(spark, d)
    ends = e.where("dst_label <> 'Keyword' or rel = 'RELATED'")
    ends = ends.select(F.col("dst_label").alias("label"), F.col("dst").alias("key"), "round", F.when(F.col("rel") == "RELATED", F.lit(0)).cast("long").alias("count")).distinct()
    extra = table(spark, d, "nation").select(F.lit("Ingredient").alias("label"), F.concat("n_name", F.lit("_X")).alias("key"), F.lit("base").alias("round"), F.lit(None).cast("long").alias("count")).where("key like '%_1_X'")
    return own.union(ends).union(extra).withColumn("importance", F.lit(None).cast("double"))


GRAPH = r"""
line AS (SELECT DISTINCT 'p' || l_partkey AS k, 's' || l_suppkey AS s, strftime(l_shipdate, '%Y') AS y FROM lineitem),
prt AS (SELECT 'p' || p_partkey AS k, p_type, p_brand, 'z' || (p_size % 4) AS z, 'p' || (p_partkey + 1000000 * (p_partkey % 10 = 0)::INTEGER) AS r FROM part),
sup AS (SELECT 's' || s_suppkey AS s, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (
  SELECT DISTINCT 'Keyword' AS src_label, k AS src, 'RECORDED_ON' AS rel, 'Date' AS dst_label, y AS dst, y AS round FROM line
  UNION ALL SELECT DISTINCT 'Keyword', k, 'IS_COMBO_WITH', 'Combo', s, y FROM line
  UNION ALL SELECT DISTINCT 'Keyword', k, 'HAS_TAG', 'Tag', p_type, 'base' FROM prt
  UNION ALL SELECT DISTINCT 'Keyword', k, 'HAS_CATEGORY', 'Category', p_brand, 'base' FROM prt
  UNION ALL SELECT DISTINCT 'Keyword', k, 'HAS_SEASON', 'Season', z, 'base' FROM prt
  UNION ALL SELECT DISTINCT 'Combo', s, 'INCLUDES', 'Ingredient', n_name, 'base' FROM sup
  UNION ALL SELECT DISTINCT 'Keyword', k, 'RELATED', 'Keyword', r, 'base' FROM prt WHERE r <> k),
n AS (
  SELECT 'Keyword' AS label, 'p' || l_partkey AS key, strftime(l_shipdate, '%Y') AS round, sum(l_quantity)::BIGINT AS count FROM lineitem GROUP BY ALL
  UNION ALL SELECT DISTINCT dst_label, dst, round, NULL FROM e WHERE dst_label <> 'Keyword'
  UNION ALL SELECT 'Ingredient', n_name || '_X', 'base', NULL FROM nation WHERE n_name || '_X' LIKE '%_1_X'
  UNION ALL SELECT DISTINCT 'Keyword', dst, 'base', 0 FROM e WHERE rel = 'RELATED'),
tot AS (SELECT key AS name, sum(count)::BIGINT AS count FROM n WHERE label = 'Keyword' GROUP BY key),
pop AS (SELECT name AS keyword, count FROM tot ORDER BY count DESC NULLS LAST, name LIMIT 10)
"""


@query(f"WITH {GRAPH} SELECT label, count(*) AS n FROM (SELECT DISTINCT label, key FROM n) GROUP BY label")
def graph_node_stats(spark, d):
    return g.node_stats(graph(spark, d)[0])


@query(f"WITH {GRAPH} SELECT rel, count(*) AS n FROM (SELECT DISTINCT src_label, src, rel, dst_label, dst FROM e) GROUP BY rel")
def graph_edge_stats(spark, d):
    return g.edge_stats(edges(spark, d), sales_parts(spark, d))


@query(f"WITH {GRAPH} SELECT DISTINCT label, key FROM n WHERE label IN ('Ingredient', 'Combo') AND NOT EXISTS (SELECT 1 FROM e WHERE dst_label = label AND dst = key)")
def orphans(spark, d):
    return g.orphans(*graph(spark, d), "Ingredient", "Combo")


@query(f"WITH {GRAPH} SELECT DISTINCT key FROM n WHERE label = 'Keyword' AND NOT EXISTS (SELECT 1 FROM e WHERE rel = 'RECORDED_ON' AND src = key)")
def untagged_keywords(spark, d):
    return g.untagged(*graph(spark, d))


@query(f"""WITH {GRAPH}, de AS (SELECT DISTINCT rel, src, dst FROM e)
SELECT i.dst AS ingredient, max(r.dst) AS latest, sum(t.count)::BIGINT AS freq FROM de i JOIN de c ON i.rel = 'INCLUDES' AND c.rel = 'IS_COMBO_WITH' AND c.dst = i.src JOIN tot t ON t.name = c.src LEFT JOIN de r ON r.rel = 'RECORDED_ON' AND r.src = c.src
GROUP BY i.dst ORDER BY latest DESC NULLS LAST, freq DESC NULLS LAST, ingredient LIMIT 10""")
def ingredient_candidates(spark, d):
    return rt.ingredient_candidates(edges(spark, d, "INCLUDES", "IS_COMBO_WITH", "RECORDED_ON"), totals(spark, d))


def conditions(spark, d):
    """The relations that questions put conditions on."""
    return edges(spark, d, "HAS_TAG", "HAS_SEASON", "HAS_CATEGORY")


#: (qid, tags, season, category); some match much, some little, some nothing.
QUESTIONS = [(1, ["ECONOMY", "SMALL"], "z1", "Brand#2"), (2, ["PROMO"], "z2", None), (3, [], None, None), (4, ["nothing"], "z9", "Brand#99"), (5, [], "z0", "Brand#7"), (6, ["nothing"], None, "Brand#3")]


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "qid int, tags array<string>, season string, category string")


_lit = lambda x: "NULL" if x is None else f"'{x}'"
ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, [{', '.join(map(_lit, t))}]::VARCHAR[], {_lit(s)}, {_lit(c)})" for q, t, s, c in QUESTIONS) + ") v(qid, tags, season, category))"
#: Rows of each rung: a keyword once for each of its tags asked for.
RUNG_ROWS = """
st AS (
  SELECT qid, 0 AS rung, tags, season, category, '' AS relaxed FROM q
  UNION ALL SELECT qid, 1, tags, season, NULL, 'category' FROM q WHERE category IS NOT NULL
  UNION ALL SELECT qid, 2, tags, NULL, NULL, concat_ws(',', CASE WHEN category IS NOT NULL THEN 'category' END, 'season') FROM q WHERE season IS NOT NULL
  UNION ALL SELECT qid, 3, []::VARCHAR[], NULL, NULL, concat_ws(',', CASE WHEN category IS NOT NULL THEN 'category' END, CASE WHEN season IS NOT NULL THEN 'season' END, 'tags') FROM q WHERE len(tags) > 0),
hit AS (
  SELECT st.qid, st.rung, tot.name AS keyword, tot.count FROM st JOIN tot ON TRUE
  LEFT JOIN (SELECT DISTINCT src, dst FROM e WHERE rel = 'HAS_TAG') tg ON len(st.tags) > 0 AND tg.src = tot.name AND list_contains(st.tags, tg.dst)
  WHERE (len(st.tags) = 0 OR tg.src IS NOT NULL)
    AND (st.season IS NULL OR EXISTS (SELECT 1 FROM e WHERE rel = 'HAS_SEASON' AND src = tot.name AND dst = st.season))
    AND (st.category IS NULL OR EXISTS (SELECT 1 FROM e WHERE rel = 'HAS_CATEGORY' AND src = tot.name AND dst = st.category))),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, rung ORDER BY count DESC NULLS LAST, keyword)::INTEGER AS rank FROM hit) WHERE rank <= 10)
"""


@query(f"WITH {GRAPH}, {ASKED}, {RUNG_ROWS} SELECT qid, rank, keyword, count FROM rk WHERE rung = 0")
def menu_candidates(spark, d):
    cond = questions(spark).withColumn("rung", F.lit(0))
    rows = rt.menu_rows(cond, cut(totals(spark, d)), conditions(spark, d))
    return rt.top_rows(rows, ["qid"]).select("qid", "rank", "keyword", "count")


@query(f"""WITH {GRAPH}, {ASKED}, {RUNG_ROWS}, sz AS (SELECT st.qid, st.rung, st.relaxed, count(rk.keyword) AS n FROM st LEFT JOIN rk ON rk.qid = st.qid AND rk.rung = st.rung GROUP BY ALL),
ch AS (SELECT qid, coalesce(min(rung) FILTER (n >= 3), max(rung)) AS rung FROM sz GROUP BY qid), c AS (SELECT sz.* FROM sz JOIN ch ON sz.qid = ch.qid AND sz.rung = ch.rung)
SELECT c.qid, rank, keyword, count, relaxed FROM c JOIN rk ON rk.qid = c.qid AND rk.rung = c.rung
UNION ALL SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY count DESC NULLS LAST, keyword)::INTEGER, keyword, count, concat_ws(',', nullif(relaxed, ''), 'all') FROM c, pop WHERE n = 0""")
def relaxation_ladder(spark, d):
    return rt.relaxation_ladder(questions(spark), cut(totals(spark, d)), conditions(spark, d))


@query(f"""WITH {GRAPH}, d0 AS (SELECT src, count(DISTINCT dst) AS dates, max((dst = '{YEAR}')::INTEGER) AS here FROM e WHERE rel = 'RECORDED_ON' GROUP BY src)
SELECT src AS keyword, CASE WHEN dates = 1 THEN 'only_here' ELSE 'shared' END AS kind FROM d0 WHERE here = 1""")
def round_split(spark, d):
    return g.round_split(edges(spark, d), YEAR)


@query(f"""WITH {GRAPH}, d0 AS (SELECT src, count(DISTINCT dst) AS dates, max((dst = '{YEAR}')::INTEGER) AS here FROM e WHERE rel = 'RECORDED_ON' GROUP BY src)
SELECT count(*) FILTER (dates = 1) AS deleted_keywords, count(*) FILTER (dates > 1) AS kept_shared_keywords FROM d0 WHERE here = 1""")
def delete_plan(spark, d):
    return g.delete_plan(edges(spark, d), YEAR)


@query(f"WITH {GRAPH} SELECT DISTINCT label, key FROM n")
def graph_dump(spark, d):
    return g.all_nodes(graph(spark, d)[0])


@query(f"""WITH {GRAPH}, n1 AS (SELECT DISTINCT label, key FROM n WHERE round <> 'base' OR label <> 'Keyword'), gone AS (SELECT label, key FROM n1 WHERE label <> 'Keyword' AND label <> 'Ingredient' AND NOT EXISTS (SELECT 1 FROM e WHERE dst_label = label AND dst = key))
SELECT label, count(*) AS n FROM (SELECT * FROM gone UNION SELECT label, key FROM n1 WHERE label = 'Ingredient' AND NOT EXISTS (SELECT 1 FROM e WHERE dst_label = 'Ingredient' AND dst = key AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.label = src_label AND gone.key = src))) GROUP BY label""")
def pruned_orphans(spark, d):
    n, e = graph(spark, d)
    return g.pruned(n, g.prune(n, e)[0])


@query(f"""WITH {GRAPH}, e1 AS (SELECT * FROM e WHERE round <> '{YEAR}'), n1 AS (SELECT * FROM n WHERE round <> '{YEAR}'),
gone AS (SELECT DISTINCT label, key FROM n1 WHERE label IN ('Date', 'Category', 'Season', 'Tag', 'Example', 'Combo') AND NOT EXISTS (SELECT 1 FROM e1 WHERE dst_label = label AND dst = key)),
e2 AS (SELECT * FROM e1 WHERE NOT EXISTS (SELECT 1 FROM gone WHERE label = src_label AND key = src)),
n2 AS (SELECT * FROM n1 WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.label = n1.label AND gone.key = n1.key) AND (label <> 'Ingredient' OR EXISTS (SELECT 1 FROM e2 WHERE dst_label = label AND dst = key)))
SELECT 'node' AS what, label AS kind, count(*) AS n FROM (SELECT DISTINCT label, key FROM n2) GROUP BY label
UNION ALL SELECT 'edge', rel, count(*) FROM (SELECT DISTINCT src_label, src, rel, dst_label, dst FROM e2) GROUP BY rel""")
def delete_round(spark, d):
    n, e = g.delete_round(*graph(spark, d), YEAR)
    return g.node_stats(n).select(F.lit("node").alias("what"), F.col("label").alias("kind"), "n").union(g.edge_stats(e, sales_parts(spark, d)).select(F.lit("edge"), "rel", "n"))


@query(f"""WITH {GRAPH}, k AS (SELECT DISTINCT src AS k FROM e WHERE src_label = 'Keyword'), l AS (SELECT DISTINCT src AS k, rel, dst AS v FROM e UNION SELECT dst, rel, src FROM e WHERE rel = 'RELATED')
SELECT k.k, string_agg(v, ',' ORDER BY v) FILTER (rel = 'HAS_TAG') AS tags, string_agg(v, ',' ORDER BY v) FILTER (rel = 'HAS_CATEGORY') AS categories, string_agg(v, ',' ORDER BY v) FILTER (rel = 'HAS_SEASON') AS seasons,
string_agg(v || '(' || coalesce(held, '') || ')', ',' ORDER BY v || '(' || coalesce(held, '') || ')') FILTER (rel = 'IS_COMBO_WITH') AS combos, string_agg(v, ',' ORDER BY v) FILTER (rel = 'RELATED') AS related, string_agg(v, ',' ORDER BY v) FILTER (rel = 'RECORDED_ON') AS dates FROM k LEFT JOIN l ON l.k = k.k LEFT JOIN (SELECT src AS c, string_agg(DISTINCT dst, '+' ORDER BY dst) AS held FROM e WHERE rel = 'INCLUDES' GROUP BY src) ON rel = 'IS_COMBO_WITH' AND c = v GROUP BY k.k""")
def neighborhood(spark, d):
    return g.neighbourhood(edges(spark, d))


@query(f"WITH {GRAPH} SELECT name, count, latest FROM tot LEFT JOIN (SELECT src, max(dst) AS latest FROM e WHERE rel = 'RECORDED_ON' GROUP BY src) ON src = name ORDER BY latest DESC NULLS LAST, count DESC NULLS LAST, name LIMIT 10")
def trending(spark, d):
    return rt.trending(edges(spark, d, "RECORDED_ON"), totals(spark, d)).select("name", "count", "latest")


@query("SELECT doc_id, source FROM documents WHERE text ILIKE '%secret%' OR text ILIKE '%token_=%' ORDER BY doc_id LIMIT 5")
def search_ilike(spark, d):
    docs = table(spark, d, "documents")
    found = rt.search(docs, "text", "secret", "doc_id").union(rt.search(docs, "text", "token_=", "doc_id"))
    return found.select("doc_id", "source").distinct().orderBy("doc_id").limit(5)


@query(f"WITH {GRAPH} SELECT DISTINCT src_label, src, rel, dst_label, dst FROM e WHERE src_label = 'Keyword' AND src IN ('p1', 'p10', 'p77') ORDER BY ALL LIMIT 600")
def edge_expand(spark, d):
    centre = spark.createDataFrame([("Keyword", "p1"), ("Keyword", "p10"), ("Keyword", "p77")], "label string, key string")
    return g.expand(edges(spark, d), centre)


@query(f"WITH {GRAPH} SELECT 'Tag' AS label, dst AS value FROM e WHERE dst_label = 'Tag' AND dst <> '' UNION SELECT 'Season', dst FROM e WHERE dst_label = 'Season' UNION SELECT 'Category', dst FROM e WHERE dst_label = 'Category'")
def vocabulary_lists(spark, d):
    return rt.vocabulary(edges(spark, d))


@query(f"WITH {GRAPH} SELECT dst AS date, count(DISTINCT src) AS keywords FROM e WHERE rel = 'RECORDED_ON' GROUP BY dst")
def keywords_per_round(spark, d):
    return g.keywords_per_round(edges(spark, d))


REACHED = "SELECT i.dst FROM e i JOIN e c ON c.rel = 'IS_COMBO_WITH' AND c.dst = i.src WHERE i.rel = 'INCLUDES'"


@query(f"WITH {GRAPH} SELECT DISTINCT key FROM n WHERE label = 'Ingredient' AND key NOT IN ({REACHED})")
def pathless_ingredients(spark, d):
    return g.pathless(*graph(spark, d))


@query(f"""WITH {GRAPH}, i AS (SELECT DISTINCT key FROM n WHERE label = 'Ingredient')
(SELECT 'absent' AS rel, key AS keyword, 0::BIGINT AS score FROM i ORDER BY key LIMIT 10) UNION ALL
(SELECT 'INCLUDES', key, count(dst) AS score FROM i LEFT JOIN e ON rel = 'INCLUDES' AND dst = key GROUP BY key ORDER BY score DESC, key LIMIT 10)""")
def degree_scores(spark, d):
    """Ingredients scored by a relation that is never written, beside one that is."""
    n, e = graph(spark, d)
    of = lambda rel, name: g.degree_scores(n, e, "Ingredient", rel).select(F.lit(name).alias("rel"), "keyword", "score")
    return of("CONTAINS", "absent").union(of("INCLUDES", "INCLUDES"))


@query(f"""WITH {GRAPH}, i AS (SELECT DISTINCT key FROM n WHERE label = 'Ingredient'), s AS (SELECT key, count(dst) AS score FROM i LEFT JOIN e ON rel = 'INCLUDES' AND dst = key GROUP BY key),
loose AS (SELECT key FROM i WHERE key NOT IN ({REACHED})),
r AS (SELECT 'turning' AS query, rep, row_number() OVER (PARTITION BY rep ORDER BY score DESC, md5(key || ':' || rep), key) AS rank, key, score FROM s, generate_series(0, 4) t(rep)
  UNION ALL SELECT 'steady', rep, row_number() OVER (PARTITION BY rep ORDER BY score DESC, key), key, score FROM s, generate_series(0, 4) t(rep)
  UNION ALL SELECT 'blind', rep, row_number() OVER (PARTITION BY rep ORDER BY key DESC), key, 0 FROM s, generate_series(0, 4) t(rep)),
l AS (SELECT query, rep, string_agg(key, ',' ORDER BY rank) AS o, string_agg(key, ',' ORDER BY key) AS st FROM r WHERE rank <= 10 GROUP BY ALL)
SELECT l.query, count(DISTINCT st) AS distinct_sets, count(DISTINCT o) AS distinct_orders, any_value(distinct_scores) AS distinct_scores, any_value(zero) AS all_scores_zero, any_value(loose_in_top) AS orphans_in_top
FROM l JOIN (SELECT query, count(DISTINCT score) AS distinct_scores, bool_and(score = 0) AS zero, count(*) FILTER (key IN (SELECT key FROM loose)) AS loose_in_top FROM r WHERE rank <= 10 AND rep = 0 GROUP BY query) f ON f.query = l.query GROUP BY l.query""")
def candidate_stability(spark, d):
    """Five repeats of three rankings of ingredients: one whose ties turn with the repeat, one with a total order, one without scores."""
    from pyspark.sql import Window as W

    n, e = graph(spark, d)
    scored = g.degree_scores(n, e, "Ingredient", "INCLUDES", 1000).select("keyword", "score", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("repeat"))
    top = lambda name, score, *order: scored.select(F.lit(name).alias("query"), "repeat", "keyword", score.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("repeat").orderBy(*order))).where("rank <= 10")
    turning = top("turning", F.col("score"), F.desc("score"), F.md5(F.concat("keyword", F.lit(":"), F.col("repeat").cast("string")).cast("binary")), "keyword")
    runs = turning.unionByName(top("steady", F.col("score"), F.desc("score"), "keyword")).unionByName(top("blind", F.lit(0).cast("long"), F.desc("keyword")))
    return ev.stability(runs, g.pathless(n, e).select(F.col("key").alias("keyword")))


SIMPLE_SQL = f"""WITH {GRAPH}, {ASKED}, {RUNG_ROWS}, route AS (SELECT qid, qid % 2 = 0 AS ing FROM q)"""


@query(f"""{SIMPLE_SQL}, de AS (SELECT DISTINCT rel, src, dst FROM e),
ig AS (SELECT ingredient AS keyword, row_number() OVER (ORDER BY latest DESC NULLS LAST, freq DESC NULLS LAST, ingredient)::INTEGER AS rank FROM (
  SELECT i.dst AS ingredient, max(r.dst) AS latest, sum(t.count) AS freq FROM de i JOIN de c ON i.rel = 'INCLUDES' AND c.rel = 'IS_COMBO_WITH' AND c.dst = i.src JOIN tot t ON t.name = c.src LEFT JOIN de r ON r.rel = 'RECORDED_ON' AND r.src = c.src GROUP BY i.dst)),
rp AS (SELECT keyword, row_number() OVER (ORDER BY count DESC NULLS LAST, keyword)::INTEGER AS rank FROM pop)
SELECT qid, rank, keyword, FALSE AS stand_in FROM route, ig WHERE ing AND rank <= 10
UNION ALL SELECT rk.qid, rank, keyword, FALSE FROM rk JOIN route ON route.qid = rk.qid AND NOT ing WHERE rung = 0
UNION ALL SELECT qid, rank, keyword, TRUE FROM route, rp WHERE NOT ing AND qid NOT IN (SELECT qid FROM rk WHERE rung = 0)""")
def simple_candidates(spark, d):
    n, e = graph(spark, d)
    return rt.simple_candidates(questions(spark).withColumn("use_ingredient", F.col("qid") % 2 == 0), n, e, cut(g.keyword_totals(n)))


@query(f"""{SIMPLE_SQL}, byname AS (SELECT key AS keyword, row_number() OVER (ORDER BY key)::INTEGER AS rank FROM (SELECT DISTINCT key FROM n WHERE label = 'Ingredient')),
rp AS (SELECT keyword, row_number() OVER (ORDER BY count DESC NULLS LAST, keyword)::INTEGER AS rank FROM pop)
SELECT qid, rank, keyword, TRUE AS stand_in FROM route, byname WHERE ing AND rank <= 10
UNION ALL SELECT qid, rank, keyword, len(tags) + (season IS NOT NULL)::INTEGER + (category IS NOT NULL)::INTEGER > 0 FROM q, rp WHERE qid % 2 = 1""")
def simple_candidates_without_edges(spark, d):
    """Before any combo or tag is loaded, the stand-ins answer."""
    n, e = graph(spark, d)
    return rt.simple_candidates(questions(spark).withColumn("use_ingredient", F.col("qid") % 2 == 0), n, e.limit(0), cut(g.keyword_totals(n)))


def records(spark, d, brand):
    """Enriched records of the parts of a brand: category, season or none, tags, combos of two, an example, a related name that may have no record."""
    p = table(spark, d, "part").where(F.col("p_brand") == brand)
    name = F.concat(F.lit("p"), "p_partkey")
    return p.select(
        name.alias("keyword"), "p_brand", F.col("p_brand").alias("category"), F.array(F.concat(F.lit("  about "), "p_name"), F.lit(" "), F.lit("second"), F.lit("third")).alias("example"), F.when(F.col("p_size") % 2 == 0, F.lit("봄")).alias("season"),
        F.array("p_type", F.split("p_name", " ")[0]).alias("tag"), F.array(F.struct(F.split("p_name", " ").alias("items"))).alias("combo"), F.array(F.concat(F.lit("p"), F.col("p_partkey") + 1), name, F.lit(" ")).alias("related"), F.col("p_size").cast("long").alias("count"), (F.col("p_size") / 50).alias("importance"),
    ).drop("p_brand")


def built_sql(brand: str, round_id: str) -> tuple[str, str]:
    r = f"(SELECT 'p' || p_partkey AS k, * FROM part WHERE p_brand = '{brand}')"
    e = f"""SELECT DISTINCT 'Keyword' AS src_label, k AS src, 'RECORDED_ON' AS rel, 'Date' AS dst_label, '{round_id}' AS dst FROM {r}
UNION SELECT 'Keyword', k, 'HAS_CATEGORY', 'Category', p_brand FROM {r} UNION SELECT 'Keyword', k, 'HAS_SEASON', 'Season', '봄' FROM {r} WHERE p_size % 2 = 0
UNION SELECT 'Keyword', k, 'HAS_TAG', 'Tag', p_type FROM {r} UNION SELECT 'Keyword', k, 'HAS_TAG', 'Tag', string_split(p_name, ' ')[1] FROM {r}
UNION SELECT 'Keyword', k, 'IS_COMBO_WITH', 'Combo', replace(p_name, ' ', '+') FROM {r} UNION SELECT 'Combo', replace(p_name, ' ', '+'), 'INCLUDES', 'Ingredient', unnest(string_split(p_name, ' ')) FROM {r}
UNION SELECT 'Keyword', k, 'HAS_EXAMPLE', 'Example', unnest(['about ' || p_name, 'second']) FROM {r}
UNION SELECT 'Keyword', k, 'RELATED', 'Keyword', 'p' || (p_partkey + 1) FROM {r} UNION SELECT 'Keyword', 'p' || (p_partkey + 1), 'RECORDED_ON', 'Date', '{round_id}' FROM {r}"""
    return r, e


R1, E1 = built_sql("Brand#1", "r1")
R2, E2 = built_sql("Brand#2", "r2")


def two_rounds(spark, d):
    """Two rounds, the second loaded twice."""
    (n1, e1), (n2, e2) = g.build(records(spark, d, "Brand#1"), "r1"), g.build(records(spark, d, "Brand#2"), "r2")
    n, e = g.upsert(n1, n2, "r2"), g.upsert(e1, e2, "r2")
    return cut(g.upsert(n, n2, "r2")), cut(g.upsert(e, e2, "r2"))


@query(f"SELECT src_label, src, rel, dst_label, dst, 'r1' AS round FROM ({E1}) UNION ALL SELECT src_label, src, rel, dst_label, dst, 'r2' FROM ({E2})")
def built_edges(spark, d):
    return two_rounds(spark, d)[1]


@query(f"""WITH e AS (SELECT *, 'r1' AS round FROM ({E1}) UNION ALL SELECT *, 'r2' FROM ({E2})), c AS (SELECT k, 'r1' AS round, p_size AS count FROM {R1} UNION ALL SELECT k, 'r2', p_size FROM {R2}),
n AS (SELECT src_label AS label, src AS key, round FROM e UNION SELECT dst_label, dst, round FROM e)
SELECT label, key, n.round, CASE WHEN label = 'Keyword' THEN coalesce(count, 0) END::BIGINT AS count, CASE WHEN label = 'Keyword' THEN round(count / 50, 6) END AS importance FROM n LEFT JOIN c ON label = 'Keyword' AND c.k = key AND c.round = n.round""")
def built_nodes(spark, d):
    """Keywords with the round's count; related names without a record are stubs of count 0."""
    return two_rounds(spark, d)[0].withColumn("importance", F.round("importance", 6))


@query(f"""WITH c AS (SELECT k, 'r1' AS round, p_size AS count FROM {R1} UNION ALL SELECT k, 'r2', p_size FROM {R2} UNION ALL SELECT 'p' || (p_partkey + 1), NULL, 0 FROM {R1} UNION ALL SELECT 'p' || (p_partkey + 1), NULL, 0 FROM {R2})
SELECT k AS name, sum(count)::BIGINT AS count, round(arg_max(count, round) / 50, 6) AS importance FROM c GROUP BY k""")
def keyword_totals(spark, d):
    return g.keyword_totals(two_rounds(spark, d)[0]).withColumn("importance", F.round("importance", 6))


#: (qid, question, use_ingredient, tags, season, category): conditions given in part, unknown ones, and questions for the rules.
TOOL_QUESTIONS = [
    (1, "any", None, ["BOGUS", "ECONOMY", "other"], "z1", None), (2, "새 재료", None, None, None, None), (3, "x", False, None, "zz", "Brand#2"), (4, "신메뉴", None, None, None, None),
    (5, "plain", True, None, None, None), (6, "재료", False, ["PROMO", "SMALL"], None, "Brand#3"), (7, "", None, ["none"], None, "Brand#999"),
]


def tool_questions(spark):
    return spark.createDataFrame(TOOL_QUESTIONS, "qid int, question string, use_ingredient boolean, tags array<string>, season string, category string")


_list = lambda xs: "NULL::VARCHAR[]" if xs is None else f"[{', '.join(map(_lit, xs))}]"
TOOL_SQL = f"""raw AS (SELECT * FROM (VALUES {', '.join(f"({q}, {_lit(t)}, {'NULL' if u is None else u}::BOOLEAN, {_list(tags)}, {_lit(s)}, {_lit(c)})" for q, t, u, tags, s, c in TOOL_QUESTIONS)}) v(qid, question, ui, tags, season, category)),
voc AS (SELECT (SELECT list(DISTINCT dst) FROM e WHERE rel = 'HAS_TAG') AS vt, (SELECT list(DISTINCT dst) FROM e WHERE rel = 'HAS_SEASON') AS vs, (SELECT list(DISTINCT dst) FROM e WHERE rel = 'HAS_CATEGORY') AS vc),
b AS (SELECT *, ui IS NOT NULL OR tags IS NOT NULL OR season IS NOT NULL OR category IS NOT NULL AS given, coalesce(tags, []) AS tg FROM raw, voc),
c AS (SELECT qid, CASE WHEN coalesce(ui, contains(question, '재료')) THEN 'ingredient' ELSE 'menu' END AS path, CASE WHEN given THEN 'agent' ELSE 'rule' END AS source,
  concat_ws(',', nullif(array_to_string(list_filter(tg, lambda t: NOT list_contains(vt, t)), ','), ''), CASE WHEN NOT list_contains(vs, season) THEN season END, CASE WHEN NOT list_contains(vc, category) THEN category END) AS unknown,
  CASE WHEN given THEN list_filter(tg, lambda t: list_contains(vt, t)) ELSE []::VARCHAR[] END AS tags, CASE WHEN given AND list_contains(vs, season) THEN season END AS season,
  CASE WHEN given THEN CASE WHEN list_contains(vc, category) THEN category END WHEN contains(question, '신메뉴') THEN '디저트' END AS category FROM b),
q AS (SELECT qid, tags, season, category FROM c WHERE path = 'menu')"""


@query(f"""WITH {GRAPH}, {TOOL_SQL}, {RUNG_ROWS}, sz AS (SELECT st.qid, st.rung, st.relaxed, count(rk.keyword) AS n FROM st LEFT JOIN rk ON rk.qid = st.qid AND rk.rung = st.rung GROUP BY ALL),
ch AS (SELECT qid, coalesce(min(rung) FILTER (n >= 3), max(rung)) AS rung FROM sz GROUP BY qid), cc AS (SELECT sz.* FROM sz JOIN ch ON sz.qid = ch.qid AND sz.rung = ch.rung),
de AS (SELECT DISTINCT rel, src, dst FROM e),
ig AS (SELECT ingredient AS keyword, row_number() OVER (ORDER BY latest DESC NULLS LAST, freq DESC NULLS LAST, ingredient)::INTEGER AS rank FROM (
  SELECT i.dst AS ingredient, max(r.dst) AS latest, sum(t.count) AS freq FROM de i JOIN de c2 ON i.rel = 'INCLUDES' AND c2.rel = 'IS_COMBO_WITH' AND c2.dst = i.src JOIN tot t ON t.name = c2.src LEFT JOIN de r ON r.rel = 'RECORDED_ON' AND r.src = c2.src GROUP BY i.dst)),
got AS (SELECT cc.qid, cc.relaxed, rank, keyword FROM cc JOIN rk ON rk.qid = cc.qid AND rk.rung = cc.rung
  UNION ALL SELECT qid, concat_ws(',', nullif(relaxed, ''), 'all'), row_number() OVER (PARTITION BY qid ORDER BY count DESC NULLS LAST, keyword)::INTEGER, keyword FROM cc, pop WHERE n = 0
  UNION ALL SELECT qid, '', rank, keyword FROM c, ig WHERE path = 'ingredient' AND rank <= 10)
SELECT c.qid, path, source, unknown, relaxed, rank, keyword FROM c JOIN got ON got.qid = c.qid""")
def tool_candidates(spark, d):
    n, e = graph(spark, d)
    return tools.find_candidates(tool_questions(spark), n, e)


@query(f"""WITH {GRAPH}, a AS (SELECT * FROM (VALUES ('p1'), ('p10'), ('p1000010'), ('absent')) v(k))
SELECT k, name IS NOT NULL AS found, count, (SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM e WHERE rel = 'HAS_TAG' AND src = k) AS tags,
(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT dst AS v FROM e WHERE rel = 'RELATED' AND src = k UNION SELECT src FROM e WHERE rel = 'RELATED' AND dst = k AND k IN (SELECT src FROM e WHERE src_label = 'Keyword'))) AS related,
(SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM e WHERE rel = 'RECORDED_ON' AND src = k) AS dates FROM a LEFT JOIN tot ON name = k""")
def tool_neighbours(spark, d):
    n, e = graph(spark, d)
    asked = spark.createDataFrame([("p1",), ("p10",), ("p1000010",), ("absent",)], "k string")
    return tools.keyword_neighbours(asked, n, e).select("k", "found", "count", "tags", "related", "dates")


@query(f"""WITH {GRAPH}, k AS (SELECT DISTINCT src_label, src, rel, dst_label, dst FROM e WHERE src <> '' AND dst <> '' ORDER BY ALL LIMIT 600)
SELECT 'edge' AS what, rel AS kind, src || ' ' || dst AS id FROM k UNION ALL SELECT DISTINCT 'node', src_label, src FROM k UNION SELECT 'node', dst_label, dst FROM k""")
def tool_whole_graph(spark, d):
    ends, kept = tools.whole_graph(edges(spark, d), n=sales_parts(spark, d))
    return kept.select(F.lit("edge").alias("what"), F.col("label").alias("kind"), F.concat_ws(" ", "source", "target").alias("id")).union(ends.select(F.lit("node"), "type", "id"))


def stored(spark, d):
    """A store of the graph's rounds: all loaded, then one again, and one taken out."""
    n, e = graph(spark, d)
    store = GraphStore(spark, scratch(spark, "graph"), 16)
    rounds = sorted(r[0] for r in n.select("round").distinct().collect())  # a row for each round
    store.load(n, e, *rounds)
    store.load(n, e, rounds[0])
    store.delete(YEAR)
    return store


@query(f"WITH {GRAPH} SELECT key AS name, sum(count)::BIGINT AS count FROM n WHERE label = 'Keyword' AND round <> '{YEAR}' GROUP BY key")
def stored_keyword_totals(spark, d):
    """Counts that the store keeps while rounds come and go."""
    return stored(spark, d).keyword_totals()


@query(f"WITH {GRAPH} SELECT src_label, src, rel, dst_label, dst, count(DISTINCT round) AS rounds FROM e WHERE round <> '{YEAR}' GROUP BY ALL")
def stored_edges(spark, d):
    return stored(spark, d).edge_totals()


def links(spark, d):
    """Keywords and their combos, both ways."""
    return pa.both_ways(edges(spark, d, "IS_COMBO_WITH").select("src", "dst"), 2 * sales_parts(spark, d))


LINKS = "u AS (SELECT DISTINCT k AS src, s AS dst FROM line UNION SELECT s, k FROM line)"


@query(f"""WITH RECURSIVE {GRAPH}, {LINKS}, h AS (SELECT DISTINCT src AS node, 0 AS hops FROM u WHERE src IN ('p1', 's2') UNION SELECT u.dst, hops + 1 FROM h JOIN u ON u.src = h.node WHERE hops < 6)
SELECT node, min(hops)::INTEGER AS hops FROM h GROUP BY node""")
def hops_by_combos(spark, d):
    """Least number of steps between keywords and combos from one of each."""
    return pa.hops(links(spark, d), links(spark, d).where("src in ('p1', 's2')").select(F.col("src").alias("node")), 6)


@query(f"""WITH RECURSIVE {GRAPH}, {LINKS}, o AS (SELECT src, count(*) AS out FROM u GROUP BY src), c AS (SELECT count(*) AS n FROM o),
r AS (SELECT src AS node, 1.0::DOUBLE / n AS rank, 0 AS i FROM o, c
  UNION ALL SELECT u.dst, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(rank / out), i + 1 FROM r JOIN u ON u.src = r.node JOIN o ON o.src = u.src, c WHERE i < 5 GROUP BY u.dst, i)
SELECT node, round(rank, 9) AS rank FROM r WHERE i = 5""")
def page_rank_of_combos(spark, d):
    return pa.page_rank(links(spark, d), most_rounds=5, tolerance=0.0).select("node", F.round("rank", 9).alias("rank"))
