"""Language identification with error-correcting output codes.

Each language gets a codeword; one binary logistic classifier over hashed byte
n-grams predicts each bit. Decoding is loss-weighted: a codeword's loss is the
sum over bits of ``weight * log(1 + exp(-bit * margin))`` where the weight of a
bit is the accuracy of its classifier beyond chance on a validation part; the
language of least loss wins, and the gap to the second flags ambiguity.

The classifiers are fitted on the driver on at most ``per_language`` labelled
rows of each language (the rows of least hash of doc_id and text, equal rows once), whole texts,
as count vectors of ``DIMS`` features that are made on the executors, so what the driver
gets is bounded by per_language x DIMS x languages; all are parameters but the number of
languages, of which one row each goes to the driver. Prediction streams
over all texts as Arrow batches. The broadcast model has DIMS x bits numbers, whatever the input.

Defined results: null text, or text without a letter, is ``und`` with score 0
and not ambiguous; so is every text when no labelled rows exist. One language
only: it is predicted with score 1. Equal texts get equal results; of equally near codewords the
first language by name is predicted, and flagged; null labels
are not learned; other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 1 << 13
PER_LANGUAGE = 600
#: Rows learned from in all, 390 MB of features on the driver; languages that share them at the most.
IN_ALL, LANGUAGES = 12_000, 600
UNDETERMINED = "und"


def counts_of(text: str) -> np.ndarray:
    """Frequencies of hashed byte 1-, 2- and 3-grams of the lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    a = b.astype(np.uint16)
    two = a[:-1] * np.uint16(257) + a[1:] * np.uint16(31)
    three = a[:-2] * np.uint16(7919) + a[1:-1] * np.uint16(263) + a[2:] * np.uint16(17)
    counts = np.bincount(a, minlength=DIMS)
    counts += np.bincount((two ^ (two >> np.uint16(7))) & np.uint16(DIMS - 1), minlength=DIMS)
    counts += np.bincount((three ^ (three >> np.uint16(5))) & np.uint16(DIMS - 1), minlength=DIMS)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies."""
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def features(text: str) -> np.ndarray:
    return scaled(counts_of(text))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1: all distinct splits for few languages, else spread random words."""
    if n < 2:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        return np.array([[1 if (split >> i) & 1 else -1 for split in range(1, 2 ** (n - 1))] for i in range(n)], dtype=np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    found, least = None, -1
    for _ in range(max(5, min(200, 10**7 // n**2))):
        words = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        alike = words.astype(np.float32) @ words.T.astype(np.float32)
        np.fill_diagonal(alike, -bits)
        apart = int(bits - alike.max()) // 2
        if apart > least and not (abs(words.sum(0, dtype=np.int64)) == n).any():
            found, least = words, apart
    return found


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def fit(x: np.ndarray, langs: list[str], steps: int = 400, rate: float = 6.0, decay: float = 1e-5) -> Model:
    """Fit one logistic classifier for each bit on rows of features by full-batch gradient steps with momentum."""
    languages = sorted(set(langs))
    words = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, words, np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    of = {lang: i for i, lang in enumerate(languages)}
    y = words[[of[lang] for lang in langs]].astype(np.float32)
    held = np.arange(len(langs)) % 5 == 4
    sizes = Counter(langs)
    share = np.array([1 / sizes[lang] for lang in langs], dtype=np.float32)
    pull = (share / share.sum())[:, None]

    # Weights are sums of rows, so few rows are fitted by their coefficients and the rows' products, which takes fewer steps of arithmetic and gives the same weights.
    products = x @ x.T if len(x) < DIMS else None

    def descend(some: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, right = x[some], y[some]
        left, basis = (products[np.ix_(some, some)], None) if products is not None else (rows, rows.T)
        w, b = np.zeros((left.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            g = -right * pull / (1 + np.exp(right * (left @ w + b)))
            vw, vb = 0.9 * vw + (g if basis is None else basis @ g) + decay * w, 0.9 * vb + g.sum(0)
            w, b = w - rate * vw, b - rate * vb
        return (rows.T @ w if basis is None else w), b

    trust, all_rows = np.ones(words.shape[1], np.float32), np.arange(len(x))
    if held.sum() >= 20:
        w, b = descend(all_rows[~held], pull[~held] / pull[~held].sum())
        right = ((x[held] @ w + b) * y[held] > 0).mean(0)
        trust = np.maximum(2 * right - 1, 0.05).astype(np.float32)
    w, b = descend(all_rows, pull)
    return Model(languages, words, w, b, trust)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, gap) for rows of margins."""
    loss = np.logaddexp(0, -margins[:, None, :] * model.words[None]) @ model.trust / model.trust.sum()
    share = np.exp(-(loss - loss.min(1, keepdims=True)) * model.words.shape[1])
    share /= share.sum(1, keepdims=True)
    order = np.argsort(-share, axis=1, kind="stable")
    top = np.take_along_axis(share, order[:, :2], 1)
    return order[:, 0], top[:, 0], top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0)


def vectors(rows: DataFrame) -> DataFrame:
    """rows(lang, h, text) -> lang, h and the text's counts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(counts_of(t.as_py()).astype(np.uint32).tobytes()) for t in batch["text"]]
            yield pa.record_batch({"lang": batch["lang"], "h": batch["h"], "counts": pa.array(packed, pa.binary())})

    return rows.select("lang", "h", "text").mapInArrow(run, "lang string, h long, counts binary")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL, languages: int = LANGUAGES) -> Model:
    """docs(doc_id, text, lang): learn from at most ``per_language`` rows of each non-null lang, and ``in_all`` rows of all.

    Of more than ``languages`` values of lang the most frequent are learned, ties by name.
    """
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    rows_of = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    per_language = max(1, min(per_language, in_all // max(1, len(rows_of))))
    # Hashes are spread evenly, so a bound on them gives about the share of a language's rows that is wanted; some more, so that one pass is enough.
    share = {lang: min(1.0, (1.3 * per_language + 100) / n) for lang, n in rows_of.items()}
    found: dict[str, dict[int, bytes]] = {}
    while share:
        bounds = docs.sparkSession.createDataFrame([(lang, min(2**63 - 1, int(-(2**63) + s * 2**64))) for lang, s in share.items()], "lang string, most long")
        # Equal rows have one hash, and one of them is learned.
        # The bounds are a list that the driver has just made, so a broadcast is no larger; a join by language would send all texts of one to a task.
        near = vectors(labelled.join(F.broadcast(bounds), "lang").where("h <= most")).groupBy("lang", "h").agg(F.first("counts").alias("counts"))
        got: dict[str, dict[int, bytes]] = {lang: {} for lang in share}
        for r in near.collect():
            got[r["lang"]][r["h"]] = r["counts"]
        found |= got
        # Where many rows are equal, a share of the hashes holds fewer rows than expected.
        share = {lang: min(1.0, 4 * s) for lang, s in share.items() if s < 1 and len(got[lang]) < per_language}
    least = sorted((h, lang, counts) for lang, rows in found.items() for h, counts in sorted(rows.items())[:per_language])
    if not least:
        return Model([], np.ones((0, 1), np.int8), np.zeros((DIMS, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    return fit(np.stack([scaled(np.frombuffer(zlib.decompress(c), np.uint32)) for _, _, c in least]), [lang for _, lang, _ in least])


def predict(docs: DataFrame, model: Model, gap: float = 0.1) -> DataFrame:
    """docs(text, ...) -> + lang_pred, score, lang_ambiguous."""
    docs = docs.drop("lang_pred", "score", "lang_ambiguous")  # columns of the result's names give way
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch["text"]
            lang, score, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for lo in range(0, len(texts) if m.languages else 0, 256):
                some = [(i, t) for i, t in enumerate(texts[lo : lo + 256].to_pylist(), lo) if t and any(map(str.isalpha, t))]
                if some:
                    at = [i for i, _ in some]
                    best, s, d = decode(m, np.stack([features(t) for _, t in some]) @ m.weights + m.bias)
                    score[at], unsure[at] = s, d < gap
                    for i, k in zip(at, best):
                        lang[i] = m.languages[k]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=schema.names)

    return docs.mapInArrow(run, schema)


def rejected(lang_pred: Column, ambiguous: Column, text: Column) -> Column:
    """What a filter drops: texts without a letter, and texts to which no codeword is clearly nearest. Texts of which nothing was learned stay."""
    letters = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    return ambiguous | ((lang_pred == UNDETERMINED) & ~letters)


__all__ = ["Model", "codewords", "decode", "features", "fit", "predict", "rejected", "train"]
