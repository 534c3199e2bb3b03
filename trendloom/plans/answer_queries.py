"""Questions of all customers through the whole chain: conditions, candidates, stored attempts, verdicts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.grounding import names_of
from ..operators import answering as aw
from ..session import apart
from .graph_queries import GRAPH, RUNG_ROWS, graph
from .text_queries import query, table

# A customer's segment gives tags and words, its nation season and category, its balance the route; its orders in turn are the attempts.
ALIEN, PROSE = '[{"name":"%b"},{"name":"alien"}]', "recommended: %b"
#: By priority; %b is the best-selling part of the brand asked for, %n the nation.
ATTEMPTS = {"1-URGENT": '[{"name":"new %b","description":"x"}]', "2-HIGH": '```json\n[{"name":"NATION_%n"}]\n```', "3-MEDIUM": PROSE, "4-NOT SPECIFIED": ALIEN}
TAGS = {"FURNITURE": ["ECONOMY", "SMALL"], "BUILDING": [], "AUTOMOBILE": ["PROMO"], "MACHINERY": ["LARGE", "STANDARD", "MEDIUM", "PROMO"]}
WORDS = {"MACHINERY": " 재료", "HOUSEHOLD": " 신메뉴", "FURNITURE": " 계절"}


def by_value(c: str, values: dict, make):
    out = None
    for k, v in values.items():
        out = F.when(F.col(c) == k, make(v)) if out is None else out.when(F.col(c) == k, make(v))
    return out


def questions(spark, d):
    c = table(spark, d, "customer")
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    return c.select(
        F.col("c_custkey").alias("qid"), F.concat("c_name", F.coalesce(by_value("c_mktsegment", WORDS, F.lit), F.lit(""))).alias("question"),
        F.when(balance <= 9000, balance < 0).alias("use_ingredient"), by_value("c_mktsegment", TAGS, lambda v: F.array(*map(F.lit, v)).cast("array<string>")).alias("tags"),
        F.when(nation < 20, F.concat(F.lit("z"), nation % 5)).alias("season"), F.when(nation % 3 != 0, F.concat(F.lit("Brand#"), nation + 2)).alias("category"),
    )


def attempts(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    best = sold.join(apart(table(spark, d, "part")), F.expr("l_partkey = p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.min(F.struct(-F.col("n"), "p_partkey")).alias("b")).select("brand", F.concat(F.lit("p"), "b.p_partkey").alias("best"))
    buyers = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat(F.lit("Brand#"), F.col("c_nationkey") + 2).alias("brand")).join(best, "brand", "left")
    text = F.coalesce(by_value("o_orderpriority", ATTEMPTS, F.lit), F.when(F.col("o_orderstatus") == "F", "[]").otherwise('[{"description":"%b"}]'))
    text = F.replace(F.replace(text, F.lit("%b"), F.coalesce("best", F.lit("none"))), F.lit("%n"), F.col("c_nationkey").cast("string"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    o = o.withColumn("attempt", F.row_number().over(W.partitionBy("qid").orderBy("o_orderkey")))
    return o.join(apart(buyers), F.expr("qid = c_custkey")).select("qid", "attempt", text.alias("answer"))


_text = lambda s: "'" + s.replace("\n", "' || chr(10) || '") + "'"
ASK = rf"""{GRAPH.rstrip()},
voc AS (SELECT (SELECT list(DISTINCT dst) FROM e WHERE rel = 'HAS_TAG') AS vt, (SELECT list(DISTINCT dst) FROM e WHERE rel = 'HAS_SEASON') AS vs, (SELECT list(DISTINCT dst) FROM e WHERE rel = 'HAS_CATEGORY') AS vc),
cu AS (SELECT c_custkey AS qid, c_name || CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items())} ELSE '' END AS question, CASE WHEN c_acctbal <= 9000 THEN c_acctbal < 0 END AS ui,
  CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN {v}::VARCHAR[]" for k, v in TAGS.items())} ELSE [] END AS tags, CASE WHEN c_nationkey < 20 THEN 'z' || (c_nationkey % 5) END AS season,
  CASE WHEN c_nationkey % 3 <> 0 THEN 'Brand#' || (c_nationkey + 2) END AS category FROM customer),
ex AS (SELECT *, ui IS NOT NULL AND len(tags) <= 3 AND list_has_all(vt, tags) AND (season IS NULL OR list_contains(vs, season)) AND (category IS NULL OR list_contains(vc, category)) AS holds FROM cu, voc),
und AS (SELECT qid, question, CASE WHEN holds THEN 'llm' ELSE 'rule' END AS source, CASE WHEN CASE WHEN holds THEN ui ELSE contains(question, '재료') END THEN 'ingredient' ELSE 'menu' END AS path,
  CASE WHEN holds THEN tags ELSE []::VARCHAR[] END AS tags, CASE WHEN holds THEN season WHEN contains(question, '계절') THEN '봄' END AS season, CASE WHEN holds THEN category WHEN contains(question, '신메뉴') THEN '디저트' END AS category FROM ex),
q AS MATERIALIZED (SELECT row_number() OVER (ORDER BY tags, season, category) AS qid, tags, season, category FROM (SELECT DISTINCT tags, season, category FROM und WHERE path = 'menu')), {RUNG_ROWS.strip()},
sz AS (SELECT st.qid, st.rung, st.relaxed, count(rk.keyword) AS n FROM st LEFT JOIN rk ON rk.qid = st.qid AND rk.rung = st.rung GROUP BY ALL),
ch AS (SELECT qid, coalesce(min(rung) FILTER (n >= 3), max(rung)) AS rung FROM sz GROUP BY qid), cc AS (SELECT sz.* FROM sz JOIN ch ON sz.qid = ch.qid AND sz.rung = ch.rung),
got AS (SELECT cc.qid, cc.relaxed, rank, keyword FROM cc JOIN rk ON rk.qid = cc.qid AND rk.rung = cc.rung
  UNION ALL SELECT qid, concat_ws(',', nullif(relaxed, ''), 'all'), row_number() OVER (PARTITION BY qid ORDER BY count DESC NULLS LAST, keyword)::INTEGER, keyword FROM cc, pop WHERE n = 0),
ml AS (SELECT q.qid, tags, season, category, max(relaxed) AS relaxed, list(keyword ORDER BY rank) AS cands FROM got JOIN q ON q.qid = got.qid GROUP BY ALL),
de AS (SELECT DISTINCT rel, src, dst FROM e),
ig AS (SELECT list(ingredient ORDER BY latest DESC NULLS LAST, freq DESC NULLS LAST, ingredient)[1:10] AS cands FROM (
  SELECT i.dst AS ingredient, max(r.dst) AS latest, sum(t.count) AS freq FROM de i JOIN de c2 ON i.rel = 'INCLUDES' AND c2.rel = 'IS_COMBO_WITH' AND c2.dst = i.src JOIN tot t ON t.name = c2.src LEFT JOIN de r ON r.rel = 'RECORDED_ON' AND r.src = c2.src GROUP BY i.dst)),
an AS (SELECT u.qid, question, source, path, CASE WHEN path = 'menu' THEN relaxed ELSE '' END AS relaxed, CASE WHEN path = 'menu' THEN ml.cands ELSE ig.cands END AS cands
  FROM und u CROSS JOIN ig LEFT JOIN ml ON path = 'menu' AND ml.tags = u.tags AND ml.season IS NOT DISTINCT FROM u.season AND ml.category IS NOT DISTINCT FROM u.category),
bs AS (SELECT p_brand, arg_min('p' || p_partkey, (-s, p_partkey)) AS best FROM part JOIN (SELECT l_partkey, sum(l_quantity)::BIGINT AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1),
tr AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, replace(replace(CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN {_text(v)}" for k, v in ATTEMPTS.items())}
  ELSE CASE WHEN o_orderstatus = 'F' THEN '[]' ELSE '[{{"description":"%b"}}]' END END, '%b', coalesce(best, 'none')), '%n', c_nationkey::VARCHAR) AS answer
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN bs ON p_brand = 'Brand#' || (c_nationkey + 2)),
b AS (SELECT tr.*, cands, CASE WHEN answer LIKE '```%' THEN regexp_replace(regexp_replace(substr(answer, 4), '^[A-Za-z]+' || chr(10), ''), '```[^`]*$', '') ELSE answer END AS body FROM tr JOIN an USING (qid) WHERE attempt <= 3),
nm AS (SELECT *, json_valid(body) AS valid, CASE WHEN json_valid(body) AND json_type(body) = 'ARRAY' THEN [json_extract_string(body, '$[' || i || '].name') FOR i IN range(json_array_length(body)::BIGINT)] ELSE [] END AS names FROM b),
lo AS (SELECT *, [x FOR x IN names IF len(list_filter(cands, lambda c: contains(lower(replace(x, ' ', '')), lower(replace(c, ' ', ''))))) = 0] AS loose FROM nm),
jd AS (SELECT *, CASE WHEN NOT valid THEN 'json_parse_error' WHEN len(names) = 0 THEN 'not_a_list' WHEN len(list_filter(names, lambda x: x IS NULL)) > 0 THEN 'missing_name_field' WHEN len(loose) > 0 THEN 'ungrounded:' || array_to_string(loose[1:3], ',') ELSE 'ok' END AS reason FROM lo),
en AS (SELECT qid, min(attempt) FILTER (reason = 'ok') AS good, count(*) AS n, arg_max(reason, attempt) AS last, arg_max(answer, attempt) AS raw, arg_min(names, attempt) FILTER (reason = 'ok') AS names FROM jd GROUP BY qid),
fb AS (SELECT jd.qid, string_agg(reason, '|' ORDER BY attempt) AS back FROM jd JOIN en ON en.qid = jd.qid AND attempt < coalesce(good, n) WHERE reason <> 'ok' GROUP BY jd.qid),
fin AS (SELECT an.*, good IS NOT NULL AS ok, coalesce(good, n, 0) AS attempts, array_to_string(names, '|') AS names, CASE WHEN good IS NULL THEN coalesce(last, 'absent') END AS reason, CASE WHEN good IS NULL THEN raw END AS raw, coalesce(back, '') AS feedback
  FROM an LEFT JOIN en ON en.qid = an.qid LEFT JOIN fb ON fb.qid = an.qid)"""


def chain(spark, d):
    return aw.answered(questions(spark, d), attempts(spark, d), *graph(spark, d))


@query(f"WITH {ASK} SELECT qid, source, path, relaxed, array_to_string(cands, '|') AS candidates, ok, attempts, names, reason, feedback FROM fin")
def answered_questions(spark, d):
    """Each customer's question with its candidates and the first attempt that holds, of three."""
    joined = lambda c: F.array_join(c, "|")
    return chain(spark, d).select("qid", "source", "path", F.array_join("relaxed", ",").alias("relaxed"), joined("candidates").alias("candidates"), "ok", "attempts", joined(names_of(F.col("answer"))).alias("names"), "reason", joined("feedback").alias("feedback"))


@query(f"WITH {ASK} SELECT question, array_to_string(cands, '|') AS keywords, reason, raw AS raw_response, attempts FROM fin WHERE NOT ok")
def questions_given_up(spark, d):
    """What goes to the dead letters."""
    return aw.rejected(chain(spark, d)).withColumn("keywords", F.array_join("keywords", "|"))
