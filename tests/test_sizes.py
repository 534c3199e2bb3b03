"""What bounds a task: partitions follow the number of rows."""

import pytest
from oracles import DATA, both
from pyspark.sql import functions as F

from trendloom import session
from trendloom.plans import answer_queries as aq
from trendloom.plans import graph_queries as gq
from trendloom.plans.text_queries import SQL, Q

SMALL = DATA / "sf0.001"


@pytest.fixture
def hundreds(monkeypatch):
    """Partitions of 400 rows."""
    monkeypatch.setattr(session, "PART_ROWS", 400, raising=False)
    return 400


def largest(df):
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_edges_are_compared_in_partitions_by_rows(spark, hundreds):
    assert largest(gq.edges(spark, str(SMALL), "RECORDED_ON", "IS_COMBO_WITH")) < 2 * hundreds
    got, want = both(spark, Q["graph_edge_stats"], SQL["graph_edge_stats"], SMALL)
    assert got == want


@pytest.mark.parametrize("name", ["stored_edges", "stored_keyword_totals"])
def test_a_round_and_a_bucket_of_the_store_are_several_tasks(spark, hundreds, name):
    store = gq.stored(spark, str(SMALL))
    for t in ("edges", "edge_totals"):
        files = spark.read.option("recursiveFileLookup", "true").parquet(f"{store.path}/{t}").groupBy(F.input_file_name().alias("f")).count()
        assert files.agg(F.max("count")).first()[0] < 3 * hundreds, t
    got, want = both(spark, Q[name], SQL[name], SMALL)
    assert got == want


def test_pruning_writes_edges_once(spark, monkeypatch):
    cut, written = gq.g.cut, []
    monkeypatch.setattr(gq.g, "cut", lambda df: written.append(df.columns) or cut(df))
    n, e = spark.createDataFrame([("Combo", "c", "r", None, None)], gq.g.NODES), spark.createDataFrame([("Combo", "c", "INCLUDES", "Ingredient", "i", "r"), ("Keyword", "k", "RECORDED_ON", "Date", "d", "r")], gq.g.EDGES)
    assert [r["rel"] for r in gq.g.prune(n, e)[1].collect()] == ["RECORDED_ON"]
    assert sum("rel" in c for c in written) == 1


def test_the_whole_graph_is_found_once(spark):
    e = spark.createDataFrame([("Keyword", f"k{i % 9}", "R", "Date", "d", str(i)) for i in range(30)], gq.g.EDGES)
    nodes, kept = gq.tools.whole_graph(e, 5)
    assert nodes.inputFiles() and nodes.inputFiles() == kept.inputFiles()
    assert [r["source"] for r in kept.orderBy("source").collect()] == ["k0", "k1", "k2", "k3", "k4"]


def test_links_are_compared_in_partitions_by_rows(spark, hundreds):
    assert largest(gq.links(spark, str(SMALL))) < 2 * hundreds


def test_ranks_make_their_edges_once(spark, monkeypatch):
    cut, written = gq.pa.cut, []
    monkeypatch.setattr(gq.pa, "cut", lambda df: written.append(df.columns) or cut(df))
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    assert sum(r["rank"] for r in gq.pa.page_rank(e, most_rounds=2).collect()) == pytest.approx(1)
    assert written[0] == ["src", "dst"] and not any("src" in c for c in written[1:])


def broadcasts(plan):
    """Rows of each broadcast in a plan that has run."""
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else None
    if inner is not None:
        return broadcasts(inner)
    rows = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    below = plan.children()
    return rows + [n for i in range(below.size()) for n in broadcasts(below.apply(i))]


def test_the_question_chain_broadcasts_conditions_but_no_questions_parts_or_edges(spark, monkeypatch):
    cut, rows = session.cut, []

    def seen(df):
        df.collect()
        rows.extend(broadcasts(df._jdf.queryExecution().executedPlan()))
        return cut(df)

    for module in (aq.aw, gq, gq.tools, gq.rt):
        monkeypatch.setattr(module, "cut", seen, raising=False)
    assert seen(Q["answered_questions"](spark, str(DATA / "sf0.01"))).count() == 1500  # of 2000 parts
    assert 0 < max(rows) < 500


def test_what_keywords_meet_is_counted_in_partitions_of_whole_keywords(spark):
    asked = spark.createDataFrame([(1, 0, ["a", "b"], "s", None), (2, 0, ["a"], None, None), (3, 1, [], None, "c"), (4, 0, [], None, None)], "qid long, rung int, tags array<string>, season string, category string")
    e = [(f"k{i}", rel, v) for i in range(40) for rel, v in (("HAS_TAG", "a"), ("HAS_TAG", "b" if i % 2 else "d"), ("HAS_SEASON", "s" if i < 10 else "t"), ("HAS_CATEGORY", "c" if i == 7 else ""))]
    e = spark.createDataFrame([("Keyword", k, rel, "X", v, r) for k, rel, v in e for r in "12"], gq.g.EDGES)  # two rounds
    totals = spark.createDataFrame([(f"k{i}", i or None) for i in range(20)], "name string, count long")  # half of the keywords have none
    want = sorted([(1, f"k{i}") for i in range(10) for _ in range(1 + i % 2)] + [(2, f"k{i}") for i in range(20)] + [(3, "k7")] + [(4, f"k{i}") for i in range(10, 20)])
    for n in (None, 3):
        got = gq.rt.menu_rows(asked, totals, e, n=n)
        assert sorted((r["qid"], r["keyword"]) for r in got.collect()) == want
        assert all(r["count"] == (int(r["keyword"][1:]) or None) for r in got.collect())
    split = gq.rt.unique(e.select("src", "rel", "dst"), 3, "src")
    assert split.rdd.getNumPartitions() == 3 and split.select("src", F.spark_partition_id().alias("p")).distinct().count() == 40
