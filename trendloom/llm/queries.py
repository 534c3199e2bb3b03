"""The operators of this subpackage applied to the standard tables.

Each query takes (spark, sf_dir) and covers its whole table. ``ORACLES`` has the
SQL of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import decontam, langid, lm, media, merkle, mixing, near, packing, resample, secrets, suffixes, token_counts, topk
from .common import doc_remainder, ship

PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows  # what texts cost is worth a small move


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents")).drop("text_hash", "label")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), modulus=10, held=0)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.counted(F.col("base"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", doc_remainder(F.col("doc_id"), 4) == 2)
    model = langid.train(docs.where("not held_out").select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.letter_quality(F.col("text")).alias("quality"), F.md5(F.col("text").cast("binary")).alias("salt"))
    return mixing.mix(rows, (5, 2, 1), 1.5, 2.0, salt="salt").select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256.0)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup(table(spark, sf_dir, "documents"), length=400, words=51)
    shared = suffixes.removed(F.col("shared")).alias("n_shared_words")  # reported only: what is removed is the contract's
    rows = found.select("doc_id", "n_bytes", suffixes.removed(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"), shared, (F.size("shared") > 0).alias("shares_passage"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))  # a cut may part a character, which is then shown as U+FFFD


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return resample.draw(rows, per_cent=25).select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = F.col("doc_id").isNotNull() & (doc_remainder(F.col("doc_id"), 2) == 0)
    found = merkle.manifest(docs, tampered={"text": F.when(marked, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), merkle.folded(F.col("other"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_secret_scans, op4_language_id, op5_media_columns, op6_mixing, op7_token_counts, op8_exact_top_k, op9_suffix_array_dedup, op10_best_fit_packing, op11_decontamination, op12_importance_resampling, op13_merkle_manifest, pipeline)
}

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
), sh AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = d.doc_id), d.doc_id)) AS class_id,
       coalesce((SELECT count(*) FROM links l WHERE l.a = d.doc_id), 0) AS n_links
FROM documents d
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         greatest(1.0::DOUBLE - len(regexp_extract_all(coalesce(text, ''), '[!-@\[-`{-~]'))::DOUBLE / greatest(length(coalesce(text, '')), 1), 0.05) AS quality,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null') || ':17'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS goal FROM s
), l AS (
  SELECT *, (goal - coalesce(sum(cap) OVER up_before, 0)) / sum(weight) OVER up_after AS level FROM w
  WINDOW up_before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         up_after AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l
), r AS (
  SELECT doc_id, size, t.source_size, target, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM r
"""

OP8 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Words of a text, A-Z lower-cased.
NORMAL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (SELECT doc_id, {NORMAL} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {NORMAL} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b)),
p AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, p.n, i, item_id FROM p JOIN win ON win.n = p.n AND win.s = array_to_string(w[i:i + p.n - 1], ' ')),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) FROM hit) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

#: Unsigned CRC-32, bit by bit, of the bytes whose hex text is {0}.
CRC = r"xor(list_reduce([4294967295] || flatten(list_transform(range(0, length({0}) // 2), lambda i: list_transform(range(0, 8), lambda k: (('0x' || substr({0}, 2 * i + 1, 2))::BIGINT >> k) & 1))), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"

OP12 = rf"""
WITH a AS (SELECT doc_id, FALSE AS target, {NORMAL} AS w FROM documents UNION ALL SELECT NULL, TRUE, {NORMAL} FROM benchmark),
f AS (
  SELECT doc_id, target, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS f FROM a
), c AS (SELECT doc_id, target, f, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT f, ({CRC.format("hex(encode(f))")} % 10000)::BIGINT AS bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t FROM c GROUP BY f),
g AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM k GROUP BY bucket),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM g),
x AS (SELECT bucket, floor(1000 * ln(((g.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE) / ((g.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS gain FROM g, z),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM c JOIN k USING (f) JOIN x USING (bucket) WHERE NOT target GROUP BY doc_id),
r AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(n_features, 0) >= 39 AS able,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id
), o AS (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS place, floor(25 * count(*) FILTER (able) OVER () / 100) AS most FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= most THEN place END::BIGINT AS rank FROM o
"""

OP13 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN {CRC.format("hex(encode(doc_id::VARCHAR))")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents
), x AS (
  SELECT doc_id, source, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front,
         coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(cut) || ':' || cut, '-') AS other FROM d
), l AS (
  SELECT doc_id, leaf, other, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS width, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM (SELECT doc_id, source, sha256(front || body) AS leaf, sha256(front || other) AS other FROM x)
), n AS (
  SELECT tree, 0 AS level, place AS pos, leaf AS h, width FROM l
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (width + 2) // 3 FROM n WHERE width > 1 GROUP BY tree, level, pos // 3, width
), s AS (
  SELECT tree, h AS subroot, count(*) OVER () AS trees FROM n WHERE width = 1
), u AS (
  SELECT 0 AS level, tree AS pos, subroot AS h, trees AS width FROM s
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (width + 2) // 3 FROM u WHERE width > 1 GROUP BY level, pos // 3, width
), sib AS (
  SELECT p.tree, p.pos, 0 AS part, q.level, q.pos AS other, q.h, q.pos < p.pos // (3 ** q.level)::BIGINT AS before FROM (SELECT tree, place AS pos FROM l) p
  JOIN n q ON q.tree = p.tree AND q.width > 1 AND q.pos // 3 = p.pos // (3 ** (q.level + 1))::BIGINT AND q.pos <> p.pos // (3 ** q.level)::BIGINT
  UNION ALL SELECT p.tree, p.place, 1, q.level, q.pos, q.h, q.pos < p.tree // (3 ** q.level)::BIGINT FROM l p
  JOIN u q ON q.width > 1 AND q.pos // 3 = p.tree // (3 ** (q.level + 1))::BIGINT AND q.pos <> p.tree // (3 ** q.level)::BIGINT
), lev AS (
  SELECT place, tree, part, level FROM (SELECT l.place, l.tree, 0 AS part, n.level FROM l JOIN (SELECT DISTINCT tree, level FROM n WHERE width > 1) n ON n.tree = l.tree UNION ALL SELECT l.place, l.tree, 1, u.level FROM l, (SELECT DISTINCT level FROM u WHERE width > 1) u)
), st AS (
  SELECT lev.tree, lev.place, lev.part, lev.level, coalesce(string_agg(h, '' ORDER BY other), '') AS h,
         coalesce(string_agg(h, '' ORDER BY other) FILTER (before), '') || ':' || coalesce(string_agg(h, '' ORDER BY other) FILTER (NOT before), '') AS step
  FROM lev LEFT JOIN sib ON sib.tree = lev.tree AND sib.pos = lev.place AND sib.part = lev.part AND sib.level = lev.level GROUP BY lev.tree, lev.place, lev.part, lev.level
), pr AS (
  SELECT tree, place, string_agg(h, '' ORDER BY part, level) AS proof, list(step ORDER BY part, level) AS steps FROM st GROUP BY tree, place
), r AS (
  SELECT l.doc_id, l.leaf, s.subroot, (SELECT h FROM u WHERE width = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce([l.other] || coalesce(steps, []), lambda c, e: sha256(split_part(e, ':', 1) || c || split_part(e, ':', 2))) AS folded_root
  FROM l JOIN s ON s.tree = l.tree LEFT JOIN pr ON pr.tree = l.tree AND pr.place = l.place
)
SELECT *, folded_root = root AS verified FROM r
"""

ORACLES = {"op1_ngram_jaccard_join": OP1, "op6_mixing": OP6, "op8_exact_top_k": OP8, "op11_decontamination": OP11, "op12_importance_resampling": OP12, "op13_merkle_manifest": OP13}
