"""Keywords, phrases, names, joins on names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import keywords as kw
from ..operators import menujoin as mj
from ..operators import phrases as ph
from ..session import cut
from ..sources import io

Q, SQL = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


TERMS = r"""
t AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[/,+]', ' ', 'g')) AS s FROM documents),
b AS (SELECT doc_id, s, regexp_replace(s, '[\t\n\x0B\f\r ]+$', '') AS r FROM t),
w AS (SELECT doc_id, CASE WHEN s = '' THEN [''] WHEN r = '' THEN []::VARCHAR[] ELSE string_split_regex(r, '[\t\n\x0B\f\r ]') END AS w FROM b),
x AS (SELECT DISTINCT doc_id, unnest(list_concat(w, CASE WHEN len(w) < 2 THEN [] ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END)) AS token FROM w),
v AS (SELECT token, count(*) AS df FROM x GROUP BY token ORDER BY df DESC, token LIMIT 10000)
"""


TOP = f"""WITH {TERMS}, n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, token, df, ln((n + 1) / (df + 1)) AS idf FROM x JOIN v USING (token), n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC, df DESC, token)::INTEGER AS rank FROM s)"""


@query(f"{TOP} SELECT doc_id, rank, token, df, round(idf, 6) AS idf FROM r WHERE rank <= 8")
def idf_top_keywords(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return kw.idf_top_keywords(docs, "doc_id", kw.document_text(F.col("text"), F.lit(None).cast("string"))).withColumn("idf", F.round("idf", 6))


@query(f"WITH {TERMS} SELECT token, df FROM v")
def doc_freq_vocab(spark, d):
    sets = kw.term_sets(table(spark, d, "documents"), "doc_id", kw.document_text(F.col("text"), F.lit(None).cast("string")))
    return kw.vocabulary(kw.exploded(sets, "doc_id"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedup_latest(spark, d):
    return kw.latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_props_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query(f"{TOP} SELECT doc_id::VARCHAR AS video_id, string_agg(token, ' ' ORDER BY rank) AS title, '' AS description FROM r WHERE rank <= 8 GROUP BY doc_id")
def replay_titles(spark, d):
    top = idf_top_keywords(spark, d).withColumn("video_id", F.col("doc_id").cast("string"))
    return kw.replayed(kw.as_arrays(top, "video_id"))


@query("SELECT c_custkey AS id, 'base' AS src FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL SELECT o_custkey, 'extra' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def merge_base_wins(spark, d):
    """Customers of two market segments, and the orders of all others."""
    base = table(spark, d, "customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("id"), F.lit("base").alias("src"))
    return kw.base_wins(base, table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("extra").alias("src")), "id")


def part_key():
    return tx.normal_key(F.concat("p_type", F.lit(" "), "p_name"))


def menus(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), part_key().alias("key")).where("key <> ''")
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("gu"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("cafe_id"), "l_suppkey", F.col("l_extendedprice").alias("price"))
    return line.join(part, "l_partkey").join(supplier, "l_suppkey")


def catalogue(spark, d):
    """What is on the list of keywords: types and names of which a part of the least two sizes is sold."""
    return table(spark, d, "part").where("p_size <= 2").select(part_key().alias("key")).where("key <> ''").distinct()


MENUS = """m AS (SELECT p_type || ' ' || p_name AS key, l_suppkey AS cafe_id, s_nationkey AS gu, l_extendedprice AS price FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
WHERE p_type || ' ' || p_name IN (SELECT p_type || ' ' || p_name FROM part WHERE p_size <= 2))"""
ROLLUP = f"WITH {MENUS} SELECT key, count(DISTINCT cafe_id) AS cafe_count, count(*) AS menu_count, count(DISTINCT gu) AS gu_count, round(avg(price), 0) AS avg_price FROM m GROUP BY key"


@query(ROLLUP)
def menu_rollup_plain(spark, d):
    return mj.rollup(mj.joined(menus(spark, d), catalogue(spark, d), "merge"))


@query(ROLLUP)
def menu_rollup_broadcast(spark, d):
    return mj.rollup(mj.joined(menus(spark, d), catalogue(spark, d), "broadcast"))


@query(ROLLUP)
def menu_rollup_salted(spark, d):
    rows = cut(mj.joined(menus(spark, d), catalogue(spark, d), "plain"))  # read four times
    return mj.salted_rollup(rows, mj.hot_keys(rows, 5), F.xxhash64("l_orderkey", "l_linenumber"))


@query(f"WITH {MENUS} SELECT key, count(*) AS n FROM m GROUP BY key ORDER BY n DESC, key LIMIT 5")
def hot_keys(spark, d):
    return mj.hot_keys(mj.joined(menus(spark, d), catalogue(spark, d)), 5)


SIZE_SQL = r"(^|[ \t\n\r])(\(?[ ]*([LRSML]|라지|톨|그란데|벤티|숏|레귤러|스몰|미디움|라rge)[ ]*\)?)([ \t\n\r]|$)"


@query(rf"""WITH r AS (SELECT p_partkey, '(ICE) ' || p_name || ' L 샷추가 ' || p_size || 'ml R' AS raw FROM part),
a AS (SELECT p_partkey, raw, regexp_replace(regexp_replace(regexp_replace(raw, '(\(?\s*(ICE|HOT|아이스|핫|따뜻한|차가운)\s*\)?)', ' ', 'g'), '(샷\s*추가|1\s*\+\s*1)', ' ', 'g'), '(\d+\s*(ml|ML|oz|OZ|g|G|개|잔|인분))', ' ', 'g') AS s FROM r),
b AS (SELECT p_partkey, raw, regexp_replace(regexp_replace(s, '{SIZE_SQL}', ' \4', 'g'), '{SIZE_SQL}', ' \4', 'g') AS s FROM a)
SELECT p_partkey, raw, trim(regexp_replace(s, '\s+', ' ', 'g')) AS key FROM b""")
def normalized_key(spark, d):
    raw = F.concat(F.lit("(ICE) "), "p_name", F.lit(" L 샷추가 "), F.col("p_size").cast("string"), F.lit("ml R"))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("key", tx.normal_key(F.col("raw")))


@query("SELECT part::INTEGER AS part, coalesce(n, 0)::BIGINT AS rows FROM generate_series(0, 15) g(part) LEFT JOIN (SELECT l_suppkey % 13 AS p, count(*) AS n FROM lineitem GROUP BY 1) ON p = part")
def partition_sizes(spark, d):
    """Sizes of parts that rows are dealt to by supplier, empty ones included."""
    return mj.sizes_of(table(spark, d, "lineitem"), F.pmod("l_suppkey", F.lit(13)).cast("int"), 16)


@query("""WITH s AS (SELECT l_suppkey, count(*) AS rows FROM lineitem GROUP BY 1)
SELECT max(rows) AS max_rows, median(rows)::DOUBLE AS median_rows, min(rows) AS min_rows, sum(rows)::BIGINT AS total_rows, round(max(rows) / median(rows), 2) AS max_over_median FROM s""")
def skew_by_supplier(spark, d):
    return mj.skew_report(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("rows")))


@query()
def partition_skew(spark, d):
    dealt = table(spark, d, "lineitem").repartition(16, "l_suppkey")
    return mj.skew_report(mj.partition_sizes(dealt, 16))


PHRASES = """k AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS s FROM part), w AS (SELECT string_split(s, ' ') AS w FROM k),
g AS (SELECT unnest(w) AS phrase, 1 AS w FROM w UNION ALL SELECT unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w
  UNION ALL SELECT w[1] || ' ' || w[2] || ' ' || w[3], 2 FROM w WHERE len(w) > 2),
p AS (SELECT phrase, sum(w)::BIGINT AS weight FROM g GROUP BY phrase)"""


def part_keywords(spark, d):
    return table(spark, d, "part").select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("keyword"))


@query(f"WITH {PHRASES} SELECT phrase, weight FROM p")
def phrase_weights(spark, d):
    return ph.phrase_weights(part_keywords(spark, d))


@query(f"WITH {PHRASES}, q AS (SELECT phrase, weight, CASE WHEN phrase LIKE '% %' THEN weight * 1.5 ELSE weight END::DOUBLE AS priority FROM p) SELECT *, row_number() OVER (ORDER BY priority DESC, phrase)::INTEGER AS rank FROM q ORDER BY rank LIMIT 500")
def phrase_top500(spark, d):
    return ph.top_phrases(ph.phrase_weights(part_keywords(spark, d)), 500)


@query(f"WITH {PHRASES}, picks AS (SELECT * FROM (VALUES (1, 'small ring'), (2, 'nothing here'), (3, 'ring'), (4, 'red widget')) t(pos, phrase)) SELECT pos, p.phrase AS keyword, weight AS count FROM picks JOIN p ON p.phrase = picks.phrase")
def phrase_whitelist(spark, d):
    picks = spark.createDataFrame([(1, "small ring"), (2, "nothing here"), (3, "ring"), (4, "red widget")], "pos int, phrase string")
    return ph.whitelist(picks, ph.phrase_weights(part_keywords(spark, d)))


@query("""WITH b AS (SELECT text AS part, item_id + 1 AS count FROM benchmark UNION ALL SELECT DISTINCT n_name, 100000 FROM nation),
m AS (SELECT DISTINCT md5(text) AS k, part, count FROM documents JOIN b ON contains(text, part))
SELECT doc_id, coalesce(sum(count), 0)::BIGINT AS new_count, coalesce(string_agg(part, '|' ORDER BY part), '') AS matched FROM documents LEFT JOIN m ON md5(text) = k GROUP BY doc_id""")
def substring_matches(spark, d):
    """Whole benchmark texts, and names of nations, in whole documents."""
    base = table(spark, d, "benchmark").select(F.col("text").alias("keyword"), (F.col("item_id") + 1).alias("count")).union(table(spark, d, "nation").select("n_name", F.lit(100000).cast("long")).distinct())
    found = ph.substring_matches(table(spark, d, "documents").select("doc_id", F.col("text").alias("keyword")), base)
    return found.select("doc_id", "new_count", F.array_join("matched_parts", "|").alias("matched"))


@query("""WITH w AS (SELECT DISTINCT lower(p_type) AS part, min(p_size) AS count FROM part GROUP BY 1 UNION ALL SELECT DISTINCT string_split(p_name, ' ')[2], 50 FROM part),
n AS (SELECT DISTINCT lower(p_type) || ' ' || p_name || 's' AS keyword FROM part)
SELECT keyword, coalesce(sum(count), 0)::BIGINT AS new_count, coalesce(string_agg(part, '|' ORDER BY part), '') AS matched FROM n LEFT JOIN w ON contains(keyword, part) GROUP BY keyword""")
def phrase_substrings(spark, d):
    """Single words as parts of longer phrases, inside words too."""
    part = table(spark, d, "part")
    base = part.groupBy(F.lower("p_type").alias("keyword")).agg(F.min("p_size").cast("long").alias("count")).union(part.select(F.split("p_name", " ")[1], F.lit(50).cast("long")).distinct())
    found = ph.substring_matches(part.select(F.concat(F.lower("p_type"), F.lit(" "), "p_name", F.lit("s")).alias("keyword")).distinct(), base)
    return found.select("keyword", "new_count", F.array_join("matched_parts", "|").alias("matched"))


BANNED = "(s IN ('초코', '케이크', '우유', '빵', '쿠키', '디저트', '치즈', '도넛', '음료') OR regexp_matches(s, '먹방|만들기|레시피|리뷰|정보|도전|쇼츠|타이틀|브이로그') OR suffix(s, ' 디저트') OR length(trim(s)) <= 1)"


@query(f"""WITH t AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '디저트' WHEN 1 THEN p_name || ' 디저트' WHEN 2 THEN p_type || ' 레시피' WHEN 3 THEN ' x ' WHEN 4 THEN '디저트 ' || p_name ELSE p_name END AS s FROM part)
SELECT p_partkey, s, {BANNED} AS banned FROM t""")
def ban_flags(spark, d):
    m = F.col("p_size") % 7
    s = F.when(m == 0, "디저트").when(m == 1, F.concat("p_name", F.lit(" 디저트"))).when(m == 2, F.concat("p_type", F.lit(" 레시피"))).when(m == 3, " x ").when(m == 4, F.concat(F.lit("디저트 "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).withColumn("banned", tx.banned(F.col("s")))


@query(r"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract(props, '$.k')::BIGINT WHEN 1 THEN json_extract(props, '$.k')::BIGINT + 1 END AS k,
CASE event_id % 3 WHEN 0 THEN event_type || '|x y' WHEN 1 THEN event_type || '|' || user_id::VARCHAR ELSE '' END AS items FROM events""")
def rescued_answers(spark, d):
    """Objects and lists that are bare, wrapped in prose, or missing."""
    m = F.col("event_id") % 3
    k = F.get_json_object("props", "$.k").cast("long")
    obj = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit('Sure, here:\n{"k": '), (k + 1).cast("string"), F.lit("}\nbye"))).otherwise(F.lit("none"))
    lst = F.when(m == 0, F.concat(F.lit('["'), "event_type", F.lit('", "x y"]'))).when(m == 1, F.concat(F.lit("The list:\n1. "), "event_type", F.lit("\n2.  "), F.col("user_id").cast("string"), F.lit("\n- no"))).otherwise(F.lit("nothing"))
    out = table(spark, d, "events").select("event_id", obj.alias("o"), lst.alias("l"))
    return out.select("event_id", tx.json_rescue(F.col("o"), "k long")["k"].alias("k"), F.array_join(tx.list_rescue(F.col("l")), "|").alias("items"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([trim(x) FOR x IN [p_name, p_name || ' ', ' ' || p_brand, p_type, ' ', p_type, lower(p_type), 'z', 'y', 'x'] IF x <> p_name], lambda x: x <> '')))[1:5], '|') AS related FROM part""")
def related_clean(spark, d):
    raw = F.array("p_name", F.concat("p_name", F.lit(" ")), F.concat(F.lit(" "), "p_brand"), "p_type", F.lit(" "), "p_type", F.lower("p_type"), F.lit("z"), F.lit("y"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", F.array_join(tx.clean_related(raw, F.col("p_name")), "|").alias("related"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def last_row_per_id(spark, d):
    return io.last_per_id(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.col("ts")).select("user_id", "event_id", "event_type")


@query("SELECT s_suppkey, s_acctbal, 'q_' || row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS id FROM supplier")
def indexed_documents(spark, d):
    return io.index_documents(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"])


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, ''), nullif(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END, '')) AS shown FROM part")
def display_names(spark, d):
    name, value = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise("")
    return table(spark, d, "part").select("p_partkey", tx.display_name(name, value).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'menus for ' ELSE 'ingredients for ' END || p_name || chr(10) || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type || chr(10) || chr(10) || '[{"name": "", "description": ""}]' || CASE WHEN p_size > 40 THEN chr(10) || chr(10) || 'not_a_list' ELSE '' END AS prompt FROM part""")
def prompt_texts(spark, d):
    feedback = F.when(F.col("p_size") > 40, F.lit("not_a_list"))
    return table(spark, d, "part").select("p_partkey", tx.prompt(F.col("p_name"), F.array("p_brand", "p_type"), F.col("p_size") % 2 == 1, ("ingredients for {}", "menus for {}"), feedback).alias("prompt"))


@query("SELECT p_partkey, sum(l_quantity) AS count, round_even(sum(l_quantity) / max(sum(l_quantity)) OVER (), 4) AS importance FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_partkey")
def importance_ratio(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("count"))
    return ph.importance(counts)


@query(r"""SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN ['봄', '여름', '가을', '겨울'][p_size % 5 + 1] END AS season, lower(p_type) || ',' || p_brand AS tags, 'a ' || p_name || '|b' AS example, p_name || '|x' AS combo FROM part""")
def enrichment_clean(spark, d):
    raw = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("keyword"), F.lit(1).alias("count"), F.element_at(F.array(*[F.lit(s) for s in ("봄", "여름", "가을", "겨울", "사계절")]), F.col("p_size") % 5 + 1).alias("season"),
        F.array(F.col("p_brand"), F.concat(F.lit(" "), F.lower("p_type")), F.col("p_brand"), F.lit(" x ")).alias("tag"), F.concat(F.lit("a "), "p_name", F.lit(". b! . c")).alias("example"),
        F.array(F.lit("plain"), F.concat("p_name", F.lit(" + x"))).alias("combo"), F.array("p_name").alias("related"),
    )
    out = ph.enriched(raw)
    return out.select("p_partkey", "season", F.array_join(F.reverse("tag"), ",").alias("tags"), F.array_join("example", "|").alias("example"), F.array_join(F.element_at("combo", 1)["items"], "|").alias("combo"))


@query("SELECT c_mktsegment AS keyword, max(floor(c_acctbal)::BIGINT) AS count FROM customer GROUP BY 1")
def tail_merge(spark, d):
    return io.merge_tail(table(spark, d, "customer").select(F.col("c_mktsegment").alias("keyword"), F.floor("c_acctbal").alias("count")))


#: Head names by how many cafes have them.
HEADS = {"콜드브루": 0.97, "카페 라떼": 0.6, "아이스크림": 0.4}


@query()
def synthetic_menus(spark, d):
    """A cafe for each customer, tail names from the parts' names by how often they occur."""
    cafes = table(spark, d, "customer").count()
    tail = table(spark, d, "part").groupBy(F.col("p_name").alias("keyword")).agg(F.count("*").alias("count"))
    return io.synthetic_menus(spark, cafes, HEADS, tail)


@query("SELECT event_id::VARCHAR AS key, event_type, value FROM events")
def message_round_trip(spark, d):
    sent = io.to_messages(table(spark, d, "events").select("event_id", "event_type", "value"), "event_id").withColumn("value", F.col("value").cast("binary"))
    return io.parse_messages(sent, "event_id long, event_type string, value double").select(F.col("event_id").cast("string").alias("key"), "event_type", "value")
