"""Empty tables, repeated rows, clashing names, hot groups and long texts; brute force where SQL has none."""

import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracles import DATA, both
from trendloom.llm import common, langid, lm, media, mixing, near, packing, queries, secrets, suffixes, token_counts, topk

SCHEMA = "doc_id long, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.mark.skipif(not (DATA / "sf0.001").is_dir(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], DATA / "sf0.001")
    assert got == want


def clashing(df, *names):
    return df.withColumns({n: F.lit("clash") for n in names})


def test_empty_tables(spark):
    none = clashing(spark.createDataFrame([], SCHEMA), "n", "key", "kept", "spans", "block", "sig", "rep", "token")
    assert near.near_classes(none).count() == lm.score(none).count() == secrets.scan(none).count() == media.media_columns(none.select("doc_id", "text")).count() == 0
    assert suffixes.dedup(none).count() == packing.pack_documents(none).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    P = pytest.importorskip("public_tokenizers")
    assert token_counts.token_counts(none, P.path("piece_bpe_32k.model")).count() == 0


def test_other_columns_don_t_disturb(spark):
    rows = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "four"), (None, None)], SCHEMA)
    more = clashing(rows, "n", "key", "key2", "kept", "spans", "block", "pos", "token", "used", "c", "sig", "rep", "digest", "label", "h", "size", "lens", "part", "data", "tile", "unit")
    same = lambda f, *cols: sorted(map(repr, f(more).select(*cols).collect())) == sorted(map(repr, f(rows).select(*cols).collect()))
    assert same(lm.score, "doc_id", "n_tokens", "base_score", "score")
    assert same(near.near_classes, "doc_id", "class_id", "n_links")
    assert same(suffixes.dedup, "doc_id", "n_bytes", "kept")
    assert same(secrets.scan, "doc_id", "spans")
    assert same(packing.pack_documents, "doc_id", "piece_length")
    P = pytest.importorskip("public_tokenizers")
    assert same(lambda d: token_counts.token_counts(d, P.path("piece_bpe_32k.model")), "doc_id", "n_bytes", "n_tokens")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert topk.top_k(clashing(vectors, "id", "v", "tile", "slot", "m", "score")).collect() == topk.top_k(vectors).collect()


def test_very_long_texts(spark):
    long = "word " * 300_000
    rows = spark.createDataFrame([(1, long), (2, "word x"), (3, long + "tail")], SCHEMA)
    got = {r["doc_id"]: r for r in lm.score(rows).collect()}
    assert got[1]["n_tokens"] == 300_001 and got[3]["n_tokens"] == 300_002
    assert {r["doc_id"]: r["n"] for r in packing.pack_documents(rows).groupBy("doc_id").agg(F.sum("piece_length").alias("n")).collect()} == {1: 300_000, 2: 2, 3: 300_001}
    assert {(r["doc_id"], r["class_id"]) for r in near.near_classes(rows).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert [len(r["kept"]) for r in suffixes.dedup(rows.where("doc_id = 1")).collect()] == [0]


SHAPES = {"slashes": "a/", "underscores": "ab_", "digits": "ab1_", "letters and digits": "aZ1cQ9", "dashes": "a-b-", "segments": "abcdefghij/", "zeros": "0", "one letter": "a"}


@pytest.mark.parametrize("shape", SHAPES)
def test_secret_candidates_of_a_megabyte_end(spark, shape):
    body = SHAPES[shape] * (1_000_000 // len(SHAPES[shape])) + "1x9"
    df = spark.createDataFrame([(1, f"x {body} token=abcdefgh1 y")], SCHEMA)
    r = secrets.scan(df).first()
    assert (0, len(body) + 3) in [(s["kind"], s["start"]) for s in r["spans"]]


def test_secret_scan_takes_linear_time(spark):
    rnd = random.Random(3)

    def seconds(n):
        df = spark.createDataFrame([(1, "".join(rnd.choice(secrets.ALPHABET) for _ in range(n)))], SCHEMA)
        began = time.time()
        r = secrets.scan(df).first()
        assert r["spans"][0]["start"] < 40 and r["spans"][-1]["end"] > n - 40
        return time.time() - began

    seconds(1000)
    assert seconds(400_000) < 9 * seconds(100_000)


def test_many_matches(spark):
    text = "token=abcd12345678 " * 3000
    df = secrets.scan(spark.createDataFrame([(1, text)], SCHEMA)).select("spans", secrets.redact(F.col("text"), F.col("spans")).alias("red"))
    r = df.first()
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(19 * k, 19 * k + 18) for k in range(3000)]
    assert r["red"] == "[REDACTED] " * 3000


def test_tiles_are_all_used(spark):
    rows = spark.range(500).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    for tiles in (1, 2, 4, 6, 8):
        got = topk.query_tiles(rows, tiles, 100).collect()
        assert {r["tile"] for r in got} == set(range(tiles))
        assert sorted(i for r in got for i in np.frombuffer(r["q_ids"], np.int64)) == list(range(500))


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9])
def test_numbers_of_every_width(spark, scale):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(int(x * scale)) for x in rnd.normal(size=4) * 100]) for i in range(60)] + [(7, [0.0] * 4)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, scale=1.0, tile_rows=1, shard_rows=7, slots=3).collect()}
    own = {}
    for i, v in rows:
        own[i] = min(own.get(i, [int(x) for x in v]), [int(x) for x in v])  # repeated rows: the least vector
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    for q in (0, 50):
        best = sorted((-clip(sum(a * b for a, b in zip(own[q], v))), i) for i, v in own.items() if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in best]


def naive_pack(lengths, sizes):
    """Best fit as stated, by looking at every bin for every piece."""
    largest, sizes = max(sizes), sorted(sizes)
    pieces = sorted(((min(largest, n - s), i, k, s) for i, n in enumerate(lengths) for k, s in enumerate(range(0, n, largest))), key=lambda p: (-p[0], p[1], p[2]))
    bins = []  # size, used, when it got its room
    out = []
    for at, (n, i, k, s) in enumerate(pieces):
        ahead = [p[0] for p in pieces[at + 1 :]]
        fits = [b for b in bins if b["size"] - b["used"] >= n]
        if fits:
            b = min(fits, key=lambda b: (b["size"] - b["used"], -b["when"]))
        else:
            costs = []
            for size in (x for x in sizes if x >= n):
                room = size - n
                short = [x for x in ahead if x <= room]
                waste = max(0, room - sum(short))
                if short and not waste:
                    waste = min(room, min(short)) // 2
                costs.append((waste / size, -size if sum(ahead) >= size else size, size))
            b = {"size": min(costs)[2], "used": 0, "when": 0}
            bins.append(b)
        out.append((bins.index(b) if bins.count(b) == 1 else next(j for j, x in enumerate(bins) if x is b), i, k, s, n, b["used"]))
        b["used"] += n
        b["when"] = at + 1
    return [(j, min(x for x in sizes if x >= bins[j]["used"]), bins[j]["used"], i, k, s, n, start) for j, i, k, s, n, start in out]


def test_packing_equals_the_naive_form():
    rnd = random.Random(4)
    for _ in range(30):
        lengths = [rnd.choice([rnd.randrange(1, 60), rnd.randrange(1, 400), 17]) for _ in range(rnd.randrange(0, 80))]
        assert packing.pack(lengths, (32, 64, 128)) == naive_pack(lengths, (32, 64, 128))


def test_packing_spreads_repeated_rows(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    got = packing.pack_documents(rows, block_items=100).collect()
    blocks = Counter(r["bin_id"].split("-")[0] for r in got)
    assert len(got) == 3000 and len(blocks) == 30 and max(blocks.values()) < 200


def naive_mix(rows, weights=(5, 2, 1), share=1.5, most=2.0, seed=17):
    """rows of (doc_id, source, size, quality, salt) -> Counter of (doc_id, source, size, taken)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    size = {s: sum(r[2] for r in by[s]) for s in order}
    goal, open_, target = share * sum(size.values()), set(order), {}
    while open_:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * size[s]}
        for s in full or open_:
            target[s] = min(most * size[s], level * weight[s])
        open_ -= full or open_
    out = Counter()
    for s, some in by.items():
        def key(r):
            u = (int(hashlib.md5(":".join(["null" if r[0] is None else str(r[0]), "null" if r[4] is None else r[4], str(seed)]).encode()).hexdigest()[:12], 16) + 0.5) / 16**12
            q = r[3] if r[3] is not None and not math.isnan(r[3]) and r[3] >= mixing.LEAST_QUALITY else mixing.LEAST_QUALITY
            return (-math.log(u) / q, r[0] is None, r[0] or 0, r[2])

        epochs = math.floor(target[s] / size[s]) if size[s] else 0
        rest = math.floor(target[s] - epochs * size[s])
        for r in sorted(some, key=key):
            extra = max(0, min(r[2], rest))
            rest -= extra
            out[r[0], s, r[2], epochs * r[2] + extra] += 1
    return out


@pytest.mark.parametrize("buckets, slice_rows", [(1024, 1 << 16), (4, 3)])
def test_mixing_equals_the_naive_form(spark, buckets, slice_rows):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, i, i // 3]), rnd.choice(["a", "b", "b", "b", None]), rnd.randrange(0, 40), rnd.choice([None, float("nan"), 0.5, 1.0]), rnd.choice([None, "x", "y", f"z{i}"])) for i in range(700)]
    rows += [(5, "b", 30, 0.7, "same")] * 400  # one key of many rows
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, quality double, salt string").repartition(5)
    got = mixing.mix(df, buckets=buckets, slice_rows=slice_rows, salt="salt")
    assert Counter(map(tuple, got.select("doc_id", "source", "size", "taken").collect())) == naive_mix(rows)


def test_language_edges(spark):
    assert len({tuple(w) for w in langid.codewords(80)}) == 80
    words = langid.codewords(80).astype(int)
    assert min((words[i] != words[j]).sum() for i in range(80) for j in range(i)) >= words.shape[1] // 5
    rnd = random.Random(1)
    kinds = {"en": ["the", "thing", "with"], "fr": ["le", "château", "être"], "de": ["der", "über", "nicht"], "es": ["el", "niño", "que"]}
    mk = lambda k: " ".join(rnd.choice(kinds[k]) for _ in range(30))
    rows = [(i, mk(k), k) for i, k in enumerate(list(kinds) * 30)] + [(7, "the thing", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_language=20)
    assert model.languages == sorted(kinds)
    assert langid.predict(docs.limit(0), model).count() == 0
    for r in langid.predict(docs.limit(60), model).collect():
        x = langid.features(r["text"]).astype(float)
        margins = [sum(x[k] * float(model.weights[k, b]) for k in np.flatnonzero(x)) + float(model.bias[b]) for b in range(model.words.shape[1])]
        loss = [sum(float(t) * math.log1p(math.exp(-m * int(c))) for t, m, c in zip(model.trust, margins, word)) / float(model.trust.sum()) for word in model.words]
        share = [math.exp(-v * model.words.shape[1]) for v in loss]
        assert r["lang_pred"] == model.languages[loss.index(min(loss))]
        assert abs(r["score"] - max(share) / sum(share)) < 1e-4
    one = langid.train(docs.where("lang = 'en'"))
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(docs, one).collect()} == {("en", 1.0)}
    tied = langid.Model(["a", "b"], langid.codewords(2), np.zeros((langid.DIMS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    assert [(r["lang_pred"], r["score"], r["lang_ambiguous"]) for r in langid.predict(docs.limit(1), tied).collect()] == [("a", 0.5, True)]


def test_chained_similarity_stays_linear(spark):
    """A chain of 3000 texts, each like its neighbours only, goes to buckets and not to one component."""
    words = [f"w{i}" for i in range(3000 * 5 + 100)]
    docs = spark.createDataFrame([(k, " ".join(words[5 * k : 5 * k + 100])) for k in range(3000)], SCHEMA)
    got = {r["doc_id"]: r for r in near.near_classes(docs).collect()}
    # Shingles: 96 each; neighbours share 91 of 101, next but one 86 of 106, further ones 81 of 111.
    assert all(got[k]["n_links"] == min(2, k) + min(2, 2999 - k) for k in got) and {r["class_id"] for r in got.values()} == {0}
    usable = near.signed(docs)
    classes = common.materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"), F.first("sig").alias("sig")).withColumn("rep", F.xxhash64("digest")), "t-classes")
    units, _ = near.candidates(docs, classes, 0.8, near.RECALL)
    sizes = units.groupBy("unit").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 50 and sizes[1] < 12 * 3000


@pytest.mark.parametrize("bucket", [1024, 150])
def test_dense_group(spark, monkeypatch, bucket):
    """Units of more rows than are compared at once, whole and in tiles; some pairs are just under the threshold."""
    monkeypatch.setattr(near, "BUCKET", bucket)
    monkeypatch.setattr(near, "TILE", bucket)
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(400):
        copy = list(base)
        for _ in range(rnd.choice([1, 1, 1, 2])):
            copy[rnd.randrange(100)] = f"n{k}x{rnd.randrange(9)}"
        texts.append(" ".join(copy))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(96)} for t in texts]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r for r in near.near_classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert len(set(want)) > 30 and max(want) > 300
    short = [want[i] - got[i]["n_links"] for i in got]
    assert min(short) >= 0 and sum(short) <= 2 * math.ceil(1e-4 * sum(want)), short
    assert {r["class_id"] for r in got.values()} == {0}


def test_runs_miss_few_pairs():
    """Runs share one signature, so the share of pairs at 0.8 that no run finds is simulated, paths and all; it is stated in README."""
    rnd = np.random.default_rng(5)
    pairs, runs = 400_000, near.runs_for(near.RECALL, 0.8)
    agree = rnd.random((pairs, near.COORDINATES)) < 0.8
    met = np.zeros(pairs, bool)
    for run in range(runs):
        alive = [np.ones(pairs, bool)]  # one entry for each node that a pair still shares
        for level in range(near.LEVELS):
            following = []
            for node in alive:
                first = (run * 5 + level * 17) % near.COORDINATES
                second = rnd.integers(0, near.COORDINATES, pairs)
                two = (rnd.random(pairs) < 0.25) & (second != first)
                following += [node & agree[:, first], node & two & agree[np.arange(pairs), second]]
            alive = following
        met |= np.any(alive, axis=0)
    rough = agree.sum(1) >= math.ceil(near.ROUGHLY * near.COORDINATES)
    assert (~(met & rough)).mean() < 1e-4


def test_packing_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(i % 70, "w " * (1 + i % 40)) for i in range(400)] + [(5, "same")] * 90 + [(None, "a b")] * 3, SCHEMA)
    packed = lambda df: sorted(map(repr, packing.pack_documents(df, block_items=50).collect()))
    first = packed(rows.coalesce(1))
    assert packed(rows.repartition(7)) == first and packed(rows.orderBy("text").repartition(3, "text")) == first


def test_media_columns_of_clashing_names(spark):
    rows = spark.createDataFrame([(1, "one"), (2, None), (3, "x" * 3000)], SCHEMA)
    plain = {r["doc_id"]: r.asDict() for r in media.media_columns(rows).collect()}
    more = media.media_columns(clashing(rows, *media.ADDED, "kept")).collect()
    same = ("n_bytes", "digest", "length", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    assert all(r["kept"] == "clash" and all(r[c] == plain[r["doc_id"]][c] for c in same) for r in more) and len(more) == 3


def test_media_tokens_mixing_and_languages_of_long_texts(spark):
    text = "word " * 200_000
    docs = spark.createDataFrame([(1, text), (2, "zwei worte")], SCHEMA)
    assert {r["doc_id"]: r["n_bytes"] for r in media.media_columns(docs).collect()} == {1: 1_000_000, 2: 10}
    sizes = {r["doc_id"]: r["size"] for r in docs.select("doc_id", mixing.word_count(F.col("text")).alias("size")).collect()}
    assert sizes == {1: 200_000, 2: 2}
    model = langid.train(docs.withColumn("lang", F.when(F.col("doc_id") == 1, "en").otherwise("de")))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()} == {1: "en", 2: "de"}
    P = pytest.importorskip("public_tokenizers")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    sp = token_counts.encoder(P.path("piece_bpe_32k.model"))
    assert got[1] == sum(len(sp.encode(t)) for t in token_counts.pre_tokens(text))


def test_what_is_learned_of_languages_is_bounded_in_all(spark, monkeypatch):
    learned = []
    monkeypatch.setattr(langid, "fit", lambda rows, langs: learned.append(langs))
    rows = [(i, f"text {i} of {i % 7}", f"l{i % 7}") for i in range(140)] + [(1000, "rare", "l8"), (1001, "rare too", "l9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most, languages, want in ((35, 7, {f"l{i}": 5 for i in range(7)}), (3, 7, {f"l{i}": 1 for i in range(7)}), (1000, 8, {**{f"l{i}": 20 for i in range(7)}, "l8": 1})):
        langid.train(docs, in_all=most, languages=languages)
        got = learned.pop()
        assert {lang: got.count(lang) for lang in got} == want
