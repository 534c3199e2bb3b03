"""Indexes, stores, sketches, intervals and streams against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators import graph as g
from trendloom.operators import intervals as iv
from trendloom.operators import nearkeys as nk
from trendloom.operators import paths as pa
from trendloom.operators import resampled as rs
from trendloom.operators import search as se
from trendloom.operators.store import GraphStore
from trendloom.streaming import frequencies as fq


def test_search_index_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(se, "RANGE", 16)
    rnd = random.Random(1)
    texts = [None, "", "ab", "ABC", "Straße%_x"] + ["".join(rnd.choice("abcÄ %_\n") for _ in range(rnd.randrange(120))) for _ in range(120)]
    rows = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)] + [(None, "abcabc"), (6, "abc again")], "id long, text string")
    index = se.build(rows, "text", "id")
    for pattern in ("abc", "ABCÄ", "a_c", "ab%cÄ", "b", "", "a%b", "nowhere", "%abc%bca%"):
        want = sorted((r["id"], r["text"]) for r in rows.where("id is not null").where(F.col("text").ilike(f"%{pattern}%")).collect())
        got = se.search_indexed(index, rows.where("id is not null"), "text", pattern, "id", 1000)
        assert sorted((r["id"], r["text"]) for r in got.collect()) == want, pattern
    sizes = index.select(F.max(F.size("gaps"))).first()[0]
    assert sizes < 16


@pytest.mark.parametrize("block", [7, 1 << 21])
def test_the_index_holds_each_trigram_of_each_row(spark, monkeypatch, block):
    monkeypatch.setattr(se, "RANGE", 16)
    monkeypatch.setattr(se, "BLOCK_CHARS", block)
    rnd = random.Random(2)
    texts = [None, "", "ab", "a\0\0b", "ÄÖÜ😀😀é", "\0" * 9, "İIıß" * 5] + ["".join(rnd.choice("aB \n😀Ä") for _ in range(rnd.randrange(60))) for _ in range(90)]
    rows = [(rnd.choice([-(2**62), 2**62, i - 40, i % 9]), t) for i, t in enumerate(texts)]
    index = se.build(spark.createDataFrame(rows, "id long, text string").repartition(3), "text", "id").collect()
    low = {r["text"]: r["low"] for r in spark.createDataFrame(rows, "id long, text string").selectExpr("text", "lower(text) low").collect()}
    want = {(low[t][i : i + 3], k) for k, t in rows if t for i in range(len(low[t]) - 2)}
    got = [(r["gram"], r["first"] + sum(r["gaps"][:i])) for r in index for i in range(len(r["gaps"]) + 1)]
    assert len(got) == len(set(got)) and set(got) == want
    assert len({(r["gram"], r["part"]) for r in index}) == len(index)


def test_what_moves_for_the_index_are_lists(spark, monkeypatch):
    written = []
    monkeypatch.setattr(se, "cut", lambda df: written.append(df.cache()) or written[0], raising=False)
    rows = spark.range(800).select("id", F.concat(F.lit("the same words in each of the texts "), "id").alias("text")).coalesce(2)
    pairs = se.build(rows, "text", "id").select(F.sum(F.size("gaps") + 1)).first()[0]
    assert pairs > 20_000 and written and written[0].count() < pairs / 5


def test_trigrams_and_rows_beyond_one_number():
    import pyarrow as pa

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k::8]) for k in range(8)]
    batch = pa.record_batch({"id": list(range(8)), "text": texts})
    found = [(g, p, x) for b in se.lists_of(16, 1 << 21)(iter([batch])) for g, p, x in zip(*(b[c].to_pylist() for c in ("gram", "part", "places")))]
    assert len(found) == sum(len(t) - 2 for t in texts) and all(p == 0 and len(x) == 1 for _, p, x in found)
    assert all(g in texts[x[0]] for g, _, x in found[:: len(found) // 50])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance,share", [(1, 4096), (2, 4096), (2, 2)])
def test_near_keys_equal_the_plain_form(spark, distance, share):
    rnd = random.Random(distance)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randrange(7)))
    misses, names = [None, *(word() for _ in range(40))], [None, "", *(word() for _ in range(60))]
    got = nk.near_pairs(spark.createDataFrame([(x,) for x in misses], "key string"), spark.createDataFrame([(x,) for x in names], "key string"), distance, share).collect()
    want = {(a, b, edits(a, b)) for a in misses if a is not None for b in names if b is not None and edits(a, b) <= distance}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    best = nk.nearest(spark.createDataFrame([("zzzzzz",), (None,), ("ab",)], "key string"), spark.createDataFrame([("ac",), ("abb",), ("aa",)], "key string")).collect()
    assert {r["key"]: (r["near"], r["distance"]) for r in best} == {"zzzzzz": (None, None), None: (None, None), "ab": ("aa", 1)}


@pytest.mark.parametrize("keys,stretch", [(["k"], 1024), (["k"], 3), ([], 5)])
def test_overlaps_equal_the_plain_form(spark, keys, stretch):
    rnd = random.Random(stretch)

    def some(n):
        out = []
        for i in range(n):
            a = rnd.choice([None, *range(60)])
            out.append((i, "hot" if rnd.random() < 0.7 else rnd.choice(["x", None]), a, a if a is None or rnd.random() < 0.1 else a + rnd.choice([-1, 0, 1, 2, 40])))
        return [*out, out[0], out[0]]

    left, right = some(70), some(50)
    schema = "i int, k string, a int, b int"
    met = iv.overlaps(spark.createDataFrame(left, schema).repartition(5), spark.createDataFrame(right, schema), "a", "b", keys, stretch).select("l.*", F.col("r.i").alias("j")).collect()
    fit = lambda x: None not in (x[2], x[3]) and x[2] <= x[3] and (not keys or x[1] is not None)
    want = sorted((x[0], y[0]) for x in left for y in right if fit(x) and fit(y) and (not keys or x[1] == y[1]) and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["i"], r["j"]) for r in met) == want


def test_the_store_follows_rounds_and_touches_their_buckets_only(spark, tmp_path):
    record = lambda k, tags, n: (k, "c", [], None, tags, [(["x", k],)], [], n, 0.5)
    schema = "keyword string, category string, example array<string>, season string, tag array<string>, combo array<struct<items:array<string>>>, related array<string>, count long, importance double"
    rounds = {"r1": [record("a", ["t"], 3), record("b", ["t", "u"], 1)], "r2": [record("a", ["u"], 4)], "r3": [record(f"k{i}", ["t"], i) for i in range(30)]}
    store, all_nodes, all_edges = GraphStore(spark, f"file://{tmp_path}/g", 8), {}, {}
    assert store.nodes().count() == store.node_totals().count() == 0

    def load(r, records):
        n, e = g.build(spark.createDataFrame(records, schema), r)
        all_nodes[r], all_edges[r] = n, e
        store.load(n, e, r)

    def check():
        nodes, edges = None, None
        for r in all_nodes:
            nodes, edges = (all_nodes[r] if nodes is None else nodes.unionByName(all_nodes[r])), (all_edges[r] if edges is None else edges.unionByName(all_edges[r]))
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(store.keyword_totals()) == rows(g.keyword_totals(nodes).select("name", "count"))
        assert rows(store.edges().select(*g.EDGES.replace(" string", "").split(", "))) == rows(edges.select(*g.EDGES.replace(" string", "").split(", ")))
        assert rows(store.orphans("Tag", "Ingredient")) == rows(g.orphans(nodes, edges, "Tag", "Ingredient"))

    for r, records in rounds.items():
        load(r, records)
    check()
    load("r2", [record("a", ["v"], 9)])
    check()
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "g").rglob("*.parquet")}
    before = files()
    load("r2", [record("a", ["v"], 10)])
    touched = {p.parent.name for p, t in files().items() if before.get(p) != t}
    assert sum(n.startswith("bucket=") for n in touched) == 1 and "round=r1" not in touched and "round=r3" not in touched
    check()
    store.delete("r3")
    del all_nodes["r3"], all_edges["r3"]
    check()
    kept = sorted(map(repr, store.edge_totals().collect()))
    store.rebuild()
    assert sorted(map(repr, store.edge_totals().collect())) == kept


def test_resampled_intervals(spark):
    rows = spark.createDataFrame([("a", i, i % 4 == 0) for i in range(400)] + [("b", i, True) for i in range(5)] + [("b", 9, None)], "g string, i int, hit boolean")
    got = {r["g"]: r for r in rs.shares(rows, ["g"], F.col("hit"), F.col("i")).collect()}
    assert (got["b"]["n"], got["b"]["low"], got["b"]["high"]) == (5, 1.0, 1.0)
    a = got["a"]
    # Near the normal interval, 0.25 -+ 0.0424.
    assert a["share"] == 0.25 and abs(a["low"] - 0.2076) < 0.012 and abs(a["high"] - 0.2924) < 0.012
    again = {r["g"]: r for r in rs.shares(rows.repartition(7), ["g"], F.col("hit"), F.col("i")).collect()}
    assert again == got
    assert rs.shares(rows.limit(0), ["g"], F.col("hit"), F.col("i")).count() == 0


def test_streamed_frequencies_restart_and_expire(spark, tmp_path):
    docs, out, state = f"{tmp_path}/docs", f"{tmp_path}/out", f"{tmp_path}/state"

    def put(words):
        spark.createDataFrame([(w,) for w in words], "token string").coalesce(1).write.mode("append").parquet(docs)
        fq.keep(fq.running(spark.readStream.schema("token string").parquet(docs), 4), out, state).awaitTermination()

    put(["a", "b", "a", None])
    put(["a", "c"])
    read = lambda: {r["token"]: r["df"] for r in fq.current(spark.read.schema("token string, df long, batch long").parquet(out)).collect()}
    assert read() == {"a": 3, "b": 1, "c": 1}
    put([])
    assert read() == {"a": 3, "b": 1, "c": 1}


def test_terms_unseen_for_long_expire():
    class Terms(dict):
        getValue = lambda self, k: self.get(k)
        updateValue = dict.__setitem__
        removeKey = dict.__delitem__
        iterator = lambda self: iter(list(self.items()))

    class Handle:
        def __init__(self):
            self.timers = []
            self.registerTimer = self.timers.append

    class Now:
        def __init__(self, ms):
            self.getCurrentProcessingTimeInMs = lambda: ms

    import pandas as pd

    p = fq.Frequencies(100)
    p.terms, p.handle = Terms(), Handle()
    rows = lambda *t: iter([pd.DataFrame({"token": list(t)})])
    assert pd.concat(p.handleInputRows((0,), rows("a", "b", "a"), Now(1000))).values.tolist() == [["a", 2], ["b", 1]]
    list(p.handleInputRows((0,), rows("b"), Now(1080)))
    assert p.handle.timers == [1100, 1180]
    assert pd.concat(p.handleExpiredTimer((0,), Now(1100), None)).values.tolist() == [["a", 0]]
    assert dict(p.terms) == {("b",): (2, 1080)}


def test_paths_equal_the_plain_forms(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(0, None), (None, 1), (3, 3)]
    edges = spark.createDataFrame(pairs * 2, "src int, dst int")
    real = {(a, b) for a, b in pairs if a is not None and b is not None}
    nodes = {x for e in real for x in e}

    reached, last, k = {0: 0, 100: 0}, {0, 100}, 0
    while last:
        k += 1
        last = {b for a, b in real if a in last} - set(reached)
        reached |= dict.fromkeys(last, k)
    got = pa.hops(edges, spark.createDataFrame([(0,), (100,), (None,)], "node int"))
    assert {r["node"]: r["hops"] for r in got.collect()} == reached

    rank = dict.fromkeys(nodes, 1 / len(nodes))
    out = {x: sum(a == x for a, _ in real) for x in nodes}
    for _ in range(8):
        lost = sum(rank[x] for x in nodes if not out[x])
        rank = {x: (0.15 + 0.85 * lost) / len(nodes) + 0.85 * sum(rank[a] / out[a] for a, b in real if b == x) for x in nodes}
    found = {r["node"]: r["rank"] for r in pa.page_rank(edges, most_rounds=8, tolerance=0.0).collect()}
    assert found.keys() == rank.keys() and all(abs(found[x] - rank[x]) < 1e-12 for x in rank) and abs(sum(found.values()) - 1) < 1e-9

    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in real:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["label"] for r in pa.communities(edges).collect()} == label
    assert pa.page_rank(edges.limit(0)).count() == pa.communities(edges.limit(0)).count() == 0
