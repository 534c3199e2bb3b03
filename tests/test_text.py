import hashlib
import math
import random

import pytest

from pyspark.sql import functions as F

from trendloom.functions import grounding as gr
from trendloom.functions import stats as st
from trendloom.functions import text as tx
from trendloom.operators import compare as cp
from trendloom.operators import graph as g
from trendloom.operators import keywords as kw
from trendloom.operators import menujoin as mj
from trendloom.operators import phrases as ph
from trendloom.operators import retrieve as rt
from trendloom.schemas import adapt_enriched


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_tokens_keep_inner_empty_words(spark):
    got = one(spark, [("B  a c c",), (" d b",), ("e b ",), ("",), ("   ",)], "s string", tx.tokens(F.col("s")))
    assert got == [["b", "", "a", "c", "c"], ["", "d", "b"], ["e", "b"], [""], []]


def test_ngrams(spark):
    assert one(spark, [(["a", "b", "c"],), (["a"],)], "w array<string>", tx.ngrams(F.col("w"), 2)) == [["a b", "b c"], []]


def test_normal_key(spark):
    cases = {"(ICE) 바닐라 라떼 L 샷추가": "바닐라 라떼", "HOT 아메리카노 그란데": "아메리카노", "딸기 케이크 1+1": "딸기 케이크", "콜드브루 500ml": "콜드브루", "라떼 L R (M)": "라떼", "아이스크림": "크림", "핫도그": "도그", "사과": "사", "": "", "L": ""}
    got = one(spark, [(k,) for k in cases], "s string", tx.normal_key(F.col("s")))
    want = list(cases.values())
    want[7] = "사과"  # the particle goes, one letter is no noun, so the stripped text stands
    assert got == want
    assert one(spark, [(None,)], "s string", tx.normal_key(F.col("s"))) == [""]
    assert one(spark, [("아이스크림",), ("아이스 라떼",)], "s string", tx.normal_key(F.col("s"), True)) == ["아이스크림", "라떼"]


def test_idf_does_not_depend_on_partitions(spark):
    docs = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 6))) for i in range(20)]
    runs = []
    for n in (1, 3, 7):
        df = spark.createDataFrame(docs, "id int, s string").repartition(n)
        runs.append(sorted(map(tuple, kw.idf_top_keywords(df, "id", F.col("s")).collect())))
    assert runs[0] == runs[1] == runs[2] and runs[0]


def test_validation(spark):
    c = F.array(F.lit("딸기"), F.lit("바닐라"))
    cases = {'[{"name":"딸기 라떼"}]': "ok", '{"name":"딸기"}': "not_a_list", "[]": "not_a_list", "[1]": "missing_name_field", '[{"description":"x"}]': "missing_name_field", "prose": "json_parse_error", '```json\n[{"name":"딸기"}]\n```': "ok", '```\n[{"name":"딸기"}]': "ok", '[{"name":"x"}]': "ungrounded:x"}
    assert one(spark, [(k,) for k in cases], "s string", gr.validation(F.col("s"), c)) == list(cases.values())


def test_wilson_and_percentiles(spark):
    low, high = st.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(50, 100), (0, 10), (0, 0)], "k int, n int").select(low, high).collect()
    assert 0.39 < rows[0][0] < 0.41 and 0.27 < rows[1][1] < 0.28 and tuple(rows[2]) == (0.0, 0.0)
    low, high = st.wilson_or_null(F.col("k"), F.col("n"))
    assert [tuple(r) for r in spark.createDataFrame([(50, 100), (0, 0)], "k int, n int").select(low, high).collect()] == [(0.4038, 0.5962), (None, None)]
    x = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 100.0, None)], "v double")
    n = F.col("n")
    places = {"a": st.nearest_rank(n, 0.95), "b": st.rounded_index(n, 0.5), "c": st.upper_median(n), "d": st.low_index(n, 0.95)}
    for most_rows in (0, 100):
        assert tuple(cp.order_statistics(x, [], "v", places, most_rows).first()) == (5, 100.0, 3.0, 3.0, 4.0)
        assert tuple(cp.order_statistics(x.limit(0), [], "v", places, most_rows).first()) == (None,) * 5


@pytest.mark.parametrize("most_rows", [0, 1 << 20])
def test_order_statistics_of_a_hot_group(spark, most_rows):
    rnd = random.Random(6)
    rows = [("hot" if rnd.random() < 0.9 else None if i % 2 else f"k{i % 5}", rnd.choice([7.0, rnd.random() * 100])) for i in range(5000)]
    n = F.col("n")
    got = cp.order_statistics(spark.createDataFrame(rows, "`the key` string, v double").repartition(8), ["the key"], "v", {"low": F.lit(1), "mid": st.upper_median(n), "p95": st.nearest_rank(n, 0.95), "top": n}, most_rows).collect()
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    want = {k: (len(v), v[0], v[len(v) // 2], v[math.ceil(0.95 * len(v)) - 1], v[-1]) for k, v in ((k, sorted(v)) for k, v in by.items())}
    assert {r["the key"]: tuple(r)[1:] for r in got} == want


def test_salted_rollup_ignores_null_prices(spark):
    rows = spark.createDataFrame([("k", "c1", "g", 10.0, 1), ("k", "c2", "g", None, 2)], "key string, cafe_id string, gu string, price double, id int")
    plain, salted = mj.rollup(rows).collect(), mj.salted_rollup(rows, mj.hot_keys(rows, 1), F.col("id"), 4).collect()
    assert plain == salted and plain[0]["avg_price"] == 10.0


def test_salted_rollup_of_a_hot_key(spark):
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.8 else f"k{i % 7}", rnd.choice([None, f"c{rnd.randrange(400)}"]), rnd.choice([None, "a", "b"]), rnd.choice([None, 2.0, 4.0]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, cafe_id string, gu string, price double, id int")
    assert sorted(mj.rollup(df).collect()) == sorted(mj.salted_rollup(df, mj.hot_keys(df, 2), F.col("id"), 8).collect())


def test_strategies(spark):
    a, b = spark.range(100).select(F.col("id").alias("key")), spark.range(5).select(F.col("id").alias("key"))
    assert "SortMergeJoin" in mj.join_strategy(mj.joined(a, b, "merge")) and "BroadcastHashJoin" in mj.join_strategy(mj.joined(a, b, "broadcast"))
    assert [tuple(r) for r in mj.partition_sizes(a.repartition(3), 3).orderBy("part").select(F.sum("rows"), F.count("*")).collect()] == [(100, 3)]


def test_measured_runs(spark):
    menus = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("cafe_id"), (F.col("id") % 3).alias("gu"), F.lit(1.0).alias("price"), "id")
    words = menus.select("key").distinct()
    runs = {s: mj.measured(menus, words, F.col("id"), s, repeat=2, partitions=8, buckets=8, hot=1) for s in ("merge", "broadcast", "salted")}
    assert all(len(r) == 2 and r[0]["rows"] == 2000 and r[0]["keys"] == 26 for r in runs.values())
    assert runs["merge"][0]["join"] == "SortMergeJoin" and runs["broadcast"][0]["join"] == "BroadcastHashJoin" and runs["salted"][0]["hot_keys"] == ["hot"]
    assert runs["salted"][0]["skew"]["max_rows"] < runs["merge"][0]["skew"]["max_rows"]


def brute_asof(left, right, key):
    return sorted((i, *min(((t, v) for k, t, v in right if t is not None and t >= at and k == k2 and k is not None), default=(None, None))) if at is not None else (i, None, None) for i, k2, at in left) if key else None


@pytest.mark.parametrize("most_rows", [0, 1 << 20])
def test_asof_on_a_hot_key(spark, most_rows):
    rnd = random.Random(3)
    left = [(i, "hot" if rnd.random() < 0.9 else rnd.choice(["x", None]), rnd.choice([None, *range(200)])) for i in range(800)]
    right = [("hot" if rnd.random() < 0.9 else rnd.choice(["x", None]), rnd.choice([None, rnd.randrange(180)]), rnd.randrange(50)) for _ in range(150)]
    l_rows = spark.createDataFrame(left, "i int, k string, at int").withColumn("_t", F.lit("kept")).repartition(6)
    r_rows = spark.createDataFrame(right, "k string, t int, v int").repartition(6)
    got = cp.asof_forward(l_rows, r_rows, "at", "t", "v", ["k"], most_rows)
    assert got.columns == ["i", "k", "at", "_t", "match_time", "match_value"]
    assert sorted((r["i"], r["match_time"], r["match_value"]) for r in got.collect()) == brute_asof(left, right, True)
    free = cp.asof_forward(l_rows.where("at is not null"), r_rows, "at", "t", "v", None, most_rows).collect()
    pairs = [(t, v) for _, t, v in right if t is not None]
    assert all((r["match_time"], r["match_value"]) == min((p for p in pairs if p[0] >= r["at"]), default=(None, None)) for r in free)


def test_digest(spark):
    rows = spark.createDataFrame([("g", "b", ["x", "y"]), ("g", "a", ["z"]), (None, "c", []), ("h", "c", ["w"])], "g string, id string, words array<string>")
    sha = lambda *lines: hashlib.sha256("".join(f"{i}{chr(31).join(w)}{chr(30)}" for i, w in lines).encode()).hexdigest()[:16]
    got = {r["g"]: r["digest"] for r in cp.content_digest(rows, "id", "words", ["g"]).collect()}
    assert got == {"g": sha(("a", ["z"]), ("b", ["x", "y"])), None: sha(("c", [])), "h": sha(("c", ["w"]))}
    assert cp.content_digest(rows.where("g = 'h'"), "id", "words").collect()[0]["digest"] == got["h"]
    assert cp.content_digest(rows.limit(0), "id", "words", ["g"]).count() == 0


def test_substrings(spark):
    base = ["딸기", "라떼 크", "of the long road", "a b c", "", "x", "딸기", "g  r", " ", "떼 ", " c"]
    texts = ["end  ", "long  road", "long   road", "딸기 라떼 크림", "end of the long road", "end of the long  road", "a b c", "za b cz", None, "", "xx", "딸기 라떼 크림"]
    new = spark.createDataFrame(list(enumerate(texts)), "i int, keyword string")
    got = {r["i"]: (r["new_count"], r["matched_parts"]) for r in ph.substring_matches(new, spark.createDataFrame([(b, 10**k) for k, b in enumerate(base)], "keyword string, count long")).collect()}
    want = {i: (sum(10**k for k, b in enumerate(base) if b and t and b in t), sorted(b for b in base if b and t and b in t)) for i, t in enumerate(texts)}
    assert got == want


@pytest.mark.parametrize("limit", [2 << 20, 12, 1])
def test_substrings_in_shares(spark, limit):
    rnd = random.Random(limit)
    base = ["the", "a.. the b..", "딸기", "딸기 라떼", "", "x", "x", "th", "the b", None] + ["".join(rnd.choice("abé ") for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    texts = [None, "", "a.. the b", "딸기 라떼 x"] + ["".join(rnd.choice("abéx the딸기") for _ in range(rnd.randrange(200))) for _ in range(30)]
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "i int, keyword string, new_count string")
    got = ph.substring_matches(rows, spark.createDataFrame([(b, 1 + k) for k, b in enumerate(base)], "keyword string, count long"), limit)
    assert {r["i"]: (r["new_count"], r["matched_parts"]) for r in got.collect()} == {i: (sum(k + 1 for k, b in enumerate(base) if b and t and b in t), sorted(b for b in base if b and t and b in t)) for i, t in enumerate(texts)}


def test_substrings_of_words_of_a_megabyte(spark):
    word = "q" * 1_000_000
    new = spark.createDataFrame([(1, f"{word}key{word} a the b"), (2, word)], "i int, keyword string")
    base = spark.createDataFrame([("qkeyq", 1), ("the b", 2), ("q" * 50, 4), ("nothing", 8)], "keyword string, count long")
    assert {r["i"]: r["new_count"] for r in ph.substring_matches(new, base).collect()} == {1: 7, 2: 4}


def test_morphology_hook(spark):
    analyzer = lambda c: F.when(c.contains("beta"), F.array(F.lit("noun"), F.lit("other")))
    rows = spark.createDataFrame([("alpha beta",), ("alpha gamma",)], "s string")
    assert [r[0] for r in rows.select(tx.normal_key(F.col("s"), analyzer=analyzer)).collect()] == ["noun other", "alpha gamma"]


def record(k, tag, combo, count, category="c", season="봄", related=()):
    return (k, category, [], season, list(tag), [(list(x),) for x in combo], list(related), count, 0.5)


SCHEMA = "keyword string, category string, example array<string>, season string, tag array<string>, combo array<struct<items:array<string>>>, related array<string>, count long, importance double"


def graph_of(spark, rounds):
    nodes = edges = None
    for r, recs in rounds.items():
        n, e = g.build(spark.createDataFrame(recs, SCHEMA), r)
        nodes, edges = (n, e) if nodes is None else (g.upsert(nodes, n, r), g.upsert(edges, e, r))
    return nodes, edges


def test_graph_ranks_and_rounds(spark):
    rounds = {"2025-04-01": [record("old", ["t"], [["바닐라", "우유"]], 999)], "2025-05-01": [record("a", ["t", "u"], [["딸기", "크림"]], 100), record("b", ["t"], [["딸기"]], 50, related=["stub"])]}
    nodes, edges = graph_of(spark, rounds)
    again = g.upsert(nodes, g.build(spark.createDataFrame(rounds["2025-05-01"], SCHEMA), "2025-05-01")[0], "2025-05-01")
    totals = {r["name"]: r["count"] for r in g.keyword_totals(again).collect()}
    assert totals == {"old": 999, "a": 100, "b": 50, "stub": 0}
    got = [(r["ingredient"], r["freq"]) for r in rt.ingredient_candidates(edges, g.keyword_totals(nodes)).collect()]
    assert got == [("딸기", 150), ("크림", 100), ("바닐라", 999), ("우유", 999)]
    n, e = g.delete_round(nodes, edges, "2025-04-01")
    assert not {"바닐라", "우유", "old"} & {r["key"] for r in n.collect()}
    assert g.orphans(n, e, "Combo", "Ingredient", "Tag").count() == 0


def test_ladder_relaxes_and_never_comes_empty(spark):
    recs = [record(f"k{i}", ["t"], [], 10 + i, category="x" if i == 0 else "y") for i in range(5)]
    nodes, edges = graph_of(spark, {"r": recs})
    cond = spark.createDataFrame([(1, ["t"], "봄", "x"), (2, ["no"], None, None), (3, [], None, None)], "qid int, tags array<string>, season string, category string")
    rows = rt.relaxation_ladder(cond, g.keyword_totals(nodes), edges).collect()
    relaxed = {r["qid"]: r["relaxed"] for r in rows}
    assert relaxed == {1: "category", 2: "tags", 3: ""}
    assert all(sum(r["qid"] == q for r in rows) == 5 for q in (1, 2, 3))


def test_stub_becomes_a_keyword(spark):
    nodes, edges = graph_of(spark, {"r1": [record("a", ["t"], [], 5, related=["b", "a", " "])], "r2": [record("b", ["t"], [], 7)]})
    totals = {r["name"]: (r["count"], r["importance"]) for r in g.keyword_totals(nodes).collect()}
    assert totals == {"a": (5, 0.5), "b": (7, 0.5)}
    assert g.delete_plan(edges, "r1").first().asDict() == {"deleted_keywords": 1, "kept_shared_keywords": 1}
    assert g.delete_plan(edges, "none").first().asDict() == {"deleted_keywords": 0, "kept_shared_keywords": 0}


def test_base_wins_and_labels(spark):
    rows = lambda side, ids: spark.createDataFrame([(i, side) for i in ids], "id string, side string")
    assert sorted(map(tuple, kw.base_wins(rows("base", ["v1", "v2"]), rows("extra", ["v1", "v3"]), "id").collect())) == [("v1", "base"), ("v2", "base"), ("v3", "extra")]
    labels = {"y": True, "YES": True, "1": True, "예": True, " o ": True, "n": False, "0": False, "아니오": False, "X": False, "": None, "maybe": None}
    assert one(spark, [(k,) for k in labels], "s string", tx.decode_label(F.col("s"))) == list(labels.values())


def test_question_rules(spark):
    asks = {"요즘 달콤하고 예쁜 신메뉴": (False, ["단맛", "비주얼"], None, "디저트"), "SNS 핫한 재료": (True, ["트렌디"], None, None), "계절 음료": (False, [], "봄", None), "카페": (False, [], None, "디저트"), "비주얼 재료": (True, ["비주얼"], None, None), "": (False, [], None, None)}
    p = rt.parse_question(F.col("s"))
    got = spark.createDataFrame([(k,) for k in asks], "s string").select(*[v.alias(k) for k, v in p.items()]).collect()
    assert [tuple(r) for r in got] == list(asks.values())


def test_wilson_cases(spark):
    def plain(k, n, z=1.96):
        if not n:
            return 0.0, 0.0
        p, d = k / n, 1 + z * z / n
        mid, spread = (p + z * z / (2 * n)) / d, z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
        return max(0.0, mid - spread), min(1.0, mid + spread)

    cases = [(49, 49), (0, 100), (50, 100), (0, 0), (0, 10), (5, 10)]
    low, high = st.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame(cases, "k int, n int").select(low, high).collect()
    assert all(abs(a - b) < 1e-12 for r, c in zip(got, cases) for a, b in zip(r, plain(*c)))


def test_fences(spark):
    body = '[{"name":"딸기"}]'
    forms = [body, f"```json\n{body}\n```", f"```\n{body}\n```", f"```{body}```", f"```JSON\n{body}", f"  ```json\n{body}\n```  "]
    got = one(spark, [(f,) for f in forms], "s string", gr.validation(F.col("s"), F.array(F.lit("딸기"))))
    assert got == ["ok"] * len(forms)


def test_clamp():
    assert [rt.clamp(n) for n in (-3, 0, 7, 50, 900)] == [1, 1, 7, 50, 50]


def test_duplicates_by_tag_and_distinct(spark):
    nodes, edges = graph_of(spark, {"r": [record("k", ["t", "u"], [], 1)]})
    cond = spark.createDataFrame([(1, 0, ["t", "u"], None, None)], "qid int, rung int, tags array<string>, season string, category string")
    assert rt.menu_rows(cond, g.keyword_totals(nodes), edges).count() == 2
    assert rt.menu_rows(cond, g.keyword_totals(nodes), edges, True).count() == 1


def test_reset(spark):
    nodes, edges = graph_of(spark, {"r": [record("k", ["t"], [], 1)]})
    n, empty = g.reset(edges)
    assert n == edges.count() > 0 and empty.count() == 0 and empty.columns == edges.columns


def test_compare_runs(spark):
    a = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "y"]), (3, ["x"]), (4, ["z"])], "id int, keywords array<string>")
    b = spark.createDataFrame([(1, ["x", "y"]), (2, ["y", "x"]), (3, ["q"]), (5, ["z"])], "id int, keywords array<string>")
    assert tuple(cp.compare_runs(a, b).first()) == (1, 1, 3, 1, 2, 1, 1)


def test_old_and_new_shapes_converge(spark):
    old = spark.createDataFrame([("k", "c", "A. B! C", "사계절", ["t"], ["a+b", "plain"], ["r"], 1, 0.1)], "keyword string, category string, example string, season string, tag array<string>, combo array<string>, related array<string>, count long, importance double")
    new = spark.createDataFrame([("k", "c", ["A", "B"], None, ["t"], [(["a", "b"],)], ["r"], 1, 0.1)], SCHEMA)
    assert adapt_enriched(old).collect() == adapt_enriched(new).collect()
