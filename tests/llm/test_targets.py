"""Manifest, decontamination and resampling against plain versions, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trendloom.llm import common, decontam, merkle, resample

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def shipped(spark):
    common.ship(spark)


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# --- manifest


def plain_manifest(rows, arity=3):
    """[(doc_id, leaf, subroot, root, proof text)] of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))

    def tree(nodes):
        """(root, proofs by place)"""
        proofs, at = [""] * len(nodes), list(range(len(nodes)))
        while len(nodes) > 1:
            for i, a in enumerate(at):
                run = a // arity
                proofs[i] += "".join(n for k, n in enumerate(nodes[run * arity : run * arity + arity], run * arity) if k != a)
            at = [a // arity for a in at]
            nodes = [h("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        return nodes[0], proofs

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x for _, x in sorted(groups[s], key=lambda r: (r[0] is not None, r))]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, x), proof in zip(sorted(groups[s], key=lambda r: (r[0] is not None, r)), trees[s][1]):
            out.append((doc_id, x, trees[s][0], root, proof + top))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arity,part_leaves", [(3, 16384), (3, 7), (2, 5), (4, 1)])
def test_manifest_equals_the_plain_form(spark, arity, part_leaves):
    draw = random.Random(arity)
    rows = [(draw.choice([None, draw.randrange(60), i]), draw.choice([None, "", "é", "hot", "hot", "hot", "z"]), draw.choice([None, "en"]), draw.choice([None, 3]), draw.choice([None, "", "a\nb" * draw.randrange(4)])) for i in range(130)]
    rows += [rows[0]] * 5 + [(1000, "alone", "en", 1, "x")]
    out = merkle.manifest(clashing(spark.createDataFrame(rows, DOCS)), arity=arity, part_leaves=part_leaves)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("p"), merkle.folded(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain_manifest(rows, arity)
    assert all(r["f"] == r["root"] for r in got)


def clashing(df):
    return df.withColumns({n: F.lit("clash") for n in ("key", "leaf", "part", "tree", "place", "width", "root", "proof", "other", "spans_", "_key")})


def test_tampering_shows(spark):
    rows = spark.createDataFrame([(i, f"s{i % 4}", "en", 3, f"line {i}\nend") for i in range(40)], DOCS)
    changed = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(rows, tampered={"text": changed}, part_leaves=6)
    bad = {r["doc_id"] for r in out.where(merkle.folded(F.col("other"), F.col("proof")) != F.col("root")).collect()}
    assert bad == set(range(0, 40, 5))


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] == h("-----") and one["proof"] == []
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_manifest_hashes_whole_texts(spark):
    text = "word\n" * 400_000
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 1, text)], DOCS)).first()
    assert one["leaf"] == h(f"1:11:s2:en1:1{len(text)}:{text}")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=6), st.randoms(use_true_random=False), st.integers(2, 4))
def test_forests_merge_in_any_order(widths, draw, arity):
    nodes = [(t, w, 0, i, hashlib.sha256(f"{t}/{i}".encode()).digest(), 0, 0) for t, w in enumerate(widths) for i in range(w)]

    def forest(some):
        f = merkle.Forest(len(widths), arity)
        for n in some:
            f.add(*n)
        return f

    want = forest(nodes)
    assert want.top and not want.open
    draw.shuffle(nodes)
    cuts = sorted(draw.randrange(len(nodes) + 1) for _ in range(4))
    parts = [forest(nodes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(nodes)])]
    left = reduce(lambda a, b: a.merge(b), [merkle.Forest(len(widths), arity), *parts])
    assert left.top[4] == want.top[4] and not left.open
    assert sorted(r[:4] for r in left.closed) == sorted(r[:4] for r in want.closed)
    parts = [forest(nodes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(nodes)])]
    right = reduce(lambda a, b: b.merge(a), reversed(parts))
    assert right.top[4] == want.top[4]


# --- decontamination


def plain_hits(text, items, window=10):
    """(number of words, hit words, items)"""
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        if n:
            runs = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in runs:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), hit, sorted(str(x) for x in found if x is not None)


def cases():
    draw = random.Random(5)
    some = lambda k, v: " ".join(draw.choice(v) for _ in range(k))
    v = ["a", "b", "C", "é", "d-e", "1"]
    items = [(i, some(draw.choice([1, 2, 3, 5, 12, 25, 40]), v)) for i in range(18)] + [(3, some(14, v)), (None, some(30, v)), (99, None), (98, ""), (97, "..."), (96, "Zz"), (95, "x y z"), (94, "y z"), (93, "w x y z q")]
    docs = [(i, some(draw.randrange(0, 60), v)) for i in range(60)]
    docs += [(100 + i, f"{some(4, ['q', 'a'])} {items[draw.randrange(18)][1]}, {some(3, ['q', 'b'])}") for i in range(30)]
    docs += [(None, items[3][1]), (200, None), (201, ""), (202, "w x y z q, X! Y? Z"), (203, "zz ZZ")] + [(100, items[7][1])] * 2
    return items, docs


@pytest.mark.parametrize("shard_words,piece,chunk", [(250_000, 20_000, 2 << 20), (60, 15, 2 << 20), (250_000, 20_000, 8)])
def test_hits_equal_the_plain_form(spark, monkeypatch, shard_words, piece, chunk):
    items, docs = cases()
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "spans": F.lit(1), "kept": F.lit("stays")})
    found = decontam.contamination(rows, spark.createDataFrame(items, "item_id long, text string"), shard_words=shard_words, piece=piece).collect()
    if chunk != 2 << 20:  # in this process: how a batch is cut makes no difference
        monkeypatch.setattr(decontam, "CHUNK", chunk)
        import numpy as np

        texts = [(t or "").encode() for _, t in docs]
        low = decontam.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        hashes, starts, ends = decontam.words(low, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        assert [low[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for _, t in docs for w in words(t)]
        assert len(set(hashes.tolist())) == len({w for _, t in docs for w in words(t)})
    want = sorted(((d, *plain_hits(t, items)) for d, t in docs), key=repr)
    got = []
    for r in found:
        assert r["kept"] == "stays"
        w = (r["text"] or "").encode()
        for s in r["spans"]:
            assert len(words(w[s["start"] : s["end"]].decode())) == s["until"] - s["word"]
        got.append((r["doc_id"], r["n_words"], {i for s in r["spans"] for i in range(s["word"], s["until"])}, r["items"]))
    assert sorted(got, key=repr) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=9), min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=30), st.integers(2, 5))
def test_automaton_equals_the_plain_form(items, doc, window):
    text = lambda run: " ".join(f"w{x}" for x in run)
    lm = decontam.Automaton(window).build([(str(i), [b"w%d" % x for x in run]) for i, run in enumerate(items)])
    hit, found = set(), set()
    import numpy as np

    ids = np.array([lm.number.get(b"w%d" % x, -1) for x in doc], np.int64)
    for a, b in lm.candidates(ids, np.zeros(len(ids), np.int64)):
        for x, y, state in lm.stream(ids[a:b].tolist()):
            hit.update(range(a + x, a + y))
            found |= lm.items[state]
    assert (len(doc), hit, sorted(found)) == plain_hits(text(doc), [(i, text(run)) for i, run in enumerate(items)], window)


def test_decontaminated_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"Before. {item}! After it."), (2, item), (3, "clean text"), (4, None)]
    out = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"), most_share=0.9)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Before. ! After it.", 3: "clean text", 4: None}


def test_decontamination_of_empty_tables_and_long_texts(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items.limit(0)).first()["spans"] == []
    long = "q" * 3_000_000 + " word" * 1_000_000 + " A, b, c"
    r = decontam.contamination(spark.createDataFrame([(1, long)], "doc_id long, text string"), items).first()
    assert r["n_words"] == 1_000_004 and [(s["word"], s["until"]) for s in r["spans"]] == [(1_000_001, 1_000_004)]


# --- resampling


def plain_resample(docs, target, per_cent=25, buckets=10000):
    grams = lambda t: words(t) + [f"{a} {b}" for a, b in zip(words(t), words(t)[1:])]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in grams(x)), Counter(bucket(f) for x in target for f in grams(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for d, x in docs:
        fs = grams(x)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        u = int(h(f"7:{'' if d is None else d}")[:8], 16)
        rows.append((d, len(words(x)), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[1]))
    most = len(able) * per_cent // 100
    # Equal rows share ranks in any order.
    return sorted([(*r, k if k <= most else None) for k, r in enumerate(able, 1)] + [(*r, None) for r in rows if r[1] < 20], key=repr)


@pytest.mark.parametrize("per_cent,parts", [(25, None), (100, 3), (0, 1)])
def test_resampling_equals_the_plain_form(spark, monkeypatch, per_cent, parts):
    draw = random.Random(3)
    v = ["a", "B", "ccc", "é", "d"]
    docs = [(i, " ".join(draw.choice(v) for _ in range(draw.randrange(0, 50)))) for i in range(80)] + [(None, "a b " * 12), (None, "a b " * 12), (500, None), (501, ""), (502, "A-b. " * 500), (7, "a"), (7, "a")]
    target = [(1, "a b, a ccc"), (2, None), (3, "")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("block", "part", "data", "sums", "weight", "score", "rank", "n_words", "tokens")})
    got = resample.draw(resample.weights(rows, spark.createDataFrame(target, "item_id long, text string")), per_cent, parts=parts).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample(docs, [t for _, t in target], per_cent)


def test_resampling_of_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.draw(resample.weights(none, none), 25).count() == 0
    docs = [(1, "one two " * 300_000), (2, "three " * 30)]
    got = resample.weights(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()
    want = {r[0]: r[2:4] for r in plain_resample(docs, [])}
    assert {r["doc_id"]: (r["n_features"], r["weight"]) for r in got} == want
