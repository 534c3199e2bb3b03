"""The question chain on a small graph, by hand."""

from trendloom.operators import answering as aw
from trendloom.operators import graph as g
from trendloom.sources import io

QUESTIONS = "qid long, question string, use_ingredient boolean, tags array<string>, season string, category string"
ATTEMPTS = "qid long, attempt int, answer string"


def small(spark):
    n = spark.createDataFrame([("Keyword", k, "r", c, None) for k, c in (("tea", 9), ("cake", 7), ("bun", 5), ("pie", 5))] + [("Ingredient", "milk", "r", None, None)], g.NODES)
    e = [("tea", "HAS_TAG", "Tag", "sweet"), ("cake", "HAS_TAG", "Tag", "sweet"), ("bun", "HAS_TAG", "Tag", "sweet"), ("pie", "HAS_TAG", "Tag", "warm"), ("tea", "HAS_SEASON", "Season", "fall"), ("tea", "HAS_CATEGORY", "Category", "")]
    return n, spark.createDataFrame([("Keyword", s, r, dl, d, "r") for s, r, dl, d in e], g.EDGES)


def asked(spark, rows):
    return spark.createDataFrame(rows, QUESTIONS)


def test_conditions_hold_only_within_the_vocabulary(spark):
    rows = [
        (1, "x", False, ["sweet"], "fall", None), (2, "재료", False, ["sweet", "bitter"], None, None), (3, "신메뉴", None, ["sweet"], None, None), (4, None, None, None, None, None),
        (5, "x", True, None, None, None), (6, "x", False, ["sweet", "warm", "sweet", "warm"], None, None), (7, "x", False, [None], None, None), (8, "x", False, [], None, ""),
    ]
    got = {r["qid"]: (r["source"], r["use_ingredient"], r["tags"], r["season"], r["category"]) for r in aw.understood(asked(spark, rows), small(spark)[1]).collect()}
    assert got[1] == ("llm", False, ["sweet"], "fall", None) and got[5] == ("llm", True, [], None, None)
    assert got[2][:2] == ("rule", True) and got[3] == ("rule", False, [], None, "디저트")
    assert all(got[q] == ("rule", False, [], None, None) for q in (4, 6, 7, 8))


def test_the_first_attempt_that_holds_answers(spark, tmp_path):
    n, e = small(spark)
    rows = [(q, f"q{q}", False, ["sweet"], "fall", None) for q in (1, 2, 3, 4)] + [(5, "q5", True, None, None, None), (None, "q", False, None, None, None)]
    tries = [
        (1, 1, "no"), (1, 2, "[]"), (1, 3, '[{"name":"green tea"}]'), (1, 4, "no"),
        (2, 1, "no"), (2, 2, None), (2, 3, '[{"name":"alien"},{"name":"cake"}]'), (2, 4, '[{"name":"cake"}]'),  # asked once too often
        (3, 1, '[{"name":"bun"}]'), (3, 2, "no"), (5, 1, '[{"name":"oat milk"}]'), (99, 1, '[{"name":"tea"}]'),
    ]
    out = aw.answered(asked(spark, rows), spark.createDataFrame(tries, ATTEMPTS), n, e)
    got = {r["qid"]: r for r in out.collect()}
    assert len(got) == 6
    assert got[1]["candidates"] == ["tea", "cake", "bun"] and got[1]["relaxed"] == ["season"]  # with the season one keyword only
    assert (got[1]["ok"], got[1]["attempts"], got[1]["feedback"], got[1]["reason"], got[1]["raw"]) == (True, 3, ["json_parse_error", "not_a_list"], None, None)
    assert (got[2]["ok"], got[2]["attempts"], got[2]["reason"], got[2]["raw"]) == (False, 3, "ungrounded:alien", tries[6][2])
    assert got[2]["feedback"] == ["json_parse_error", "json_parse_error"]
    assert (got[3]["ok"], got[3]["attempts"], got[3]["answer"], got[3]["feedback"]) == (True, 1, '[{"name":"bun"}]', [])
    assert (got[4]["ok"], got[4]["attempts"], got[4]["reason"]) == (False, 0, "absent")
    assert got[5]["path"] == "ingredient" and got[5]["candidates"] == ["milk"] and got[5]["relaxed"] == ["all"] and got[5]["ok"]
    assert got[None]["candidates"][0] == "tea" and not got[None]["ok"]
    io.dead_letters(aw.rejected(out), str(tmp_path / "dead"))
    kept = {r["question"]: r for r in spark.read.json(str(tmp_path / "dead")).collect()}
    assert set(kept) == {"q2", "q4", "q"} and kept["q2"]["keywords"] == ["tea", "cake", "bun"] and kept["q2"]["attempts"] == 3


def test_no_questions_no_attempts_no_graph(spark):
    none, tries = asked(spark, []), spark.createDataFrame([], ATTEMPTS)
    n, e = small(spark)
    assert aw.answered(none, tries, n, e).count() == 0
    one = aw.answered(asked(spark, [(1, "x", False, ["sweet"], None, None)]), tries, n.limit(0), e.limit(0)).first()
    assert one["candidates"] == [] and one["source"] == "rule" and one["reason"] == "absent"
