"""Language-model scoring from a log-frequency Bloom filter.

The filter holds n-gram counts in quantised logarithmic form: an n-gram seen c
times is entered once for each level up to that of c. Counts up to ``EXACT`` have levels of their own, beyond there are
``STEPS`` levels to each doubling. A count is read back by probing level after level until one is missing, which costs a false
positive only an over-estimate by one level with small probability. All unigrams and
bigrams of the training documents are entered, those seen once too: they are nearly half of all bigrams' mass.

Building: blocks of documents send (n-gram key, count) runs, sorted and packed by key
range; each range sums its keys, counts the levels to enter and makes its own slice
of the filter, with as many bits as they need for a false-positive rate of ``RATE``
a probe round, whatever the input. A slice never leaves its range: it answers
there for all n-grams that the blocks sent (those of held-out documents too), and
only levels go back to the blocks. Nothing is collected or broadcast.
``report`` gives each slice's levels, bits and fill. A given ``bits`` fixes the size
of the whole filter instead. A block sends a message to each range of about ``RANGE_BYTES`` of text, so messages are
blocks times ranges; a range's memory follows RANGE_BYTES up to 2**18 ranges.

Scoring: log10 p(w | v) with Dirichlet smoothing, (c(v, w) + MU * p(w)) / (c(v)
+ MU), p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)). Bigram counts come from probes; a bigram of which the filter lacks a word counts 0.
c(v), c(w), N and V are the exact counts of the unigram base, so the probabilities after a context sum to 1 but for what quantisation (none up to EXACT, half a step beyond) and
false positives add. For the base blocks send their distinct tokens with their numbers,
packed by hash range, and a range adds them up and answers each block in its order. A token that
all documents hold is one entry for each block.

Defined results: null text is empty and consists of the end token; ASCII
letters are lower-cased; a null doc_id is held out; if nothing is left to train on, N and V are
0 and base scores are log10(0.1 / 0.1) = 0 for each token; equal texts get equal
scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import doc_remainder, materialize, size_hint

#: False-positive rate of a probe round, by which slices are sized.
RATE = 0.00001
#: Counts that have levels of their own, and levels to a doubling beyond.
EXACT, STEPS = 8, 4
#: Bytes of documents, as Catalyst estimates them, to a key range.
RANGE_BYTES = 8 << 20
MU = 20.0
END = "\n"  # white space, so no word
KEY_BITS = 40
HASHES = 8
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Odd multipliers of the mixing function.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
START = np.uint64(0x243F6A8885A308D3)
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str) -> list[str]:
    """Words and one end token; bytes.split parts at exactly the six white-space bytes."""
    return [*(w.decode() for w in text.encode().translate(ASCII_LOWER).split()), END]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * M3
        return x ^ (x >> np.uint64(31))


def token_keys(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), dtype=np.uint64, count=len(tokens))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * M1 + second + START)


def pairs_of(keys: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Keys of (token before or START, token) for each token of each document; every document has a token."""
    mine = keys[flat]
    before = np.empty_like(mine)
    before[1:] = mine[:-1]
    before[np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)] = START
    return pair_keys(before, mine)


def split(keys: np.ndarray, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, the KEY_BITS bits below it)."""
    low = (keys >> np.uint64(64 - range_bits - KEY_BITS)) & np.uint64((1 << KEY_BITS) - 1)
    return (keys >> np.uint64(64 - range_bits)).astype(np.int64), low


class probes:
    """Positions in a slice of ``bits`` bits for the hash functions at a level."""

    def __init__(self, low: np.ndarray, level: int, bits: int) -> None:
        with np.errstate(over="ignore"):
            self.h = mix(low * M1 + np.uint64(level) * M3)
            self.step = (mix(self.h ^ M1) << np.uint64(1)) | np.uint64(1)
        self.bits = np.uint64(bits)

    def __call__(self, i: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((self.h + np.uint64(i) * self.step) >> np.uint64(20)) % self.bits).astype(np.int64)

    def first(self, n: int) -> Iterator[np.ndarray]:
        return map(self, range(n))

    def keep(self, found: np.ndarray) -> probes:
        """The same for some of the keys."""
        if not found.all():
            self.h, self.step = self.h[found], self.step[found]
        return self


class Filter:
    """A slice of the filter; ``count`` estimates counts by probing levels."""

    def __init__(self, held: np.ndarray) -> None:
        self.held = held

    def level(self, low: np.ndarray) -> np.ndarray:
        """The last level found of each key, 0 if absent."""
        level, alive = np.zeros(len(low), np.uint8), np.arange(len(low))
        for q in range(1, 256):
            # A key leaves at the first bit that isn't set.
            at = probes(low[alive], q, len(self.held))
            for i in range(HASHES):
                found = self.held[at(i)]
                alive = alive[found]
                at = at.keep(found)
            if not len(alive):
                break
            level[alive] = q
        return level

    def fill(self) -> float:
        return float(self.held.mean())


def bounds(level: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return np.where(level <= EXACT, level, np.floor(EXACT * 2.0 ** ((level - EXACT) / STEPS)))


def typical(level: np.ndarray) -> np.ndarray:
    """Estimated counts: the mean of a level's counts; 0 if absent."""
    level = level.astype(np.float64)
    return np.where(level <= EXACT, level, (bounds(level - 1) + 1 + bounds(level)) / 2)


def bits_for(levels: int, rate: float = RATE) -> int:
    """Bits, in whole bytes, in which so many levels have that false-positive rate."""
    return max(4096, 8 * math.ceil(levels * HASHES / -math.log1p(-(rate ** (1 / HASHES))) / 8))


def quantised(counts: np.ndarray) -> np.ndarray:
    """The level of a count."""
    return np.where(counts <= EXACT, counts, EXACT + np.ceil(STEPS * np.log2(np.maximum(counts, EXACT) / EXACT) - 1e-9)).astype(np.int64)


def slice_of(low: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """Bits of a slice that holds the keys at all levels of their counts."""
    out, top = np.zeros(bits, bool), quantised(counts)
    for level in range(1, int(top.max(initial=0)) + 1):
        at = probes(low[top >= level], level, bits)
        for i in range(HASHES):
            out[at(i)] = True
    return out


def grams(row: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block's distinct keys in order, each place's position among them and their counts in flagged documents; for tokens (by the dictionary), then for pairs."""
    keys, flat, lens = token_keys(row["tokens"]), blocks.expand(row["packed"], np.uint32), np.array(row["lens"], np.int64)
    train = np.repeat(np.array(row["flags"], bool), lens)
    one, at = np.unique(mix(keys), return_inverse=True)
    two, by = np.unique(pairs_of(keys, flat, lens), return_inverse=True)
    return [(one, at, np.bincount(at[flat[train]], minlength=len(one))), (two, by, np.bincount(by[train], minlength=len(two)))]


def asked(made: DataFrame, range_bits: int) -> DataFrame:
    """blocks -> their n-grams, packed by key range: (part, block, n_one, low, n), tokens first, of which there are n_one, then pairs."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                orders = []
                for k, _, c in grams(row):
                    which, low = split(k, range_bits)
                    orders.append((low, c.astype(np.uint32), np.searchsorted(which, np.arange((1 << range_bits) + 1))))
                sizes = sum(np.diff(cuts) for _, _, cuts in orders)
                of = lambda i, r: np.concatenate([o[i][o[2][r] : o[2][r + 1]] for o in orders])  # noqa: B023, E731
                five = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
                data = np.flatnonzero(sizes).tolist()
                for lo in range(0, len(data), 64):
                    some = data[lo : lo + 64]
                    first = orders[0][2]
                    yield pa.record_batch({"part": pa.array(some, pa.int64()), "block": pa.array([row["block"]] * len(some), pa.int64()), "n_one": pa.array([int(first[r + 1] - first[r]) for r in some], pa.int64()), "low": pa.array([five(of(0, r)) for r in some], pa.binary()), "n": pa.array([blocks.squeeze(of(1, r)) for r in some], pa.binary())})

    return made.mapInArrow(runs, "part long, block long, n_one long, low binary, n binary")


def wide(data: bytes) -> np.ndarray:
    five = np.frombuffer(data, np.uint8).reshape(-1, 5)
    full = np.zeros((len(five), 8), np.uint8)
    full[:, :5] = five
    return full.reshape(-1).view(np.uint64)


def slice_for(table: pa.Table, least_pair: int, slice_bits: int | None) -> tuple[Filter, int, list[tuple[np.ndarray, np.ndarray]], list[dict]]:
    """A range's slice, the levels entered, by order the distinct keys and each asked key's position among them, and what was asked."""
    rows = [{k: r[k] for k in ("part", "block", "n_one")} | {"low": wide(r["low"]), "n": blocks.expand(r["n"], np.uint32)} for r in table.to_pylist()]
    entered, orders = [], []
    for least, cut in ((1, lambda x, k: x[:k]), (max(1, least_pair), lambda x, k: x[k:])):
        low, at = np.unique(np.concatenate([cut(r["low"], r["n_one"]) for r in rows]), return_inverse=True)
        n = np.bincount(at, np.concatenate([cut(r["n"], r["n_one"]) for r in rows]), len(low)).astype(np.int64)
        entered.append((low[n >= least], n[n >= least]))
        orders.append((low, at))
    levels = sum(int(quantised(n).sum()) for _, n in entered)
    bits = slice_bits or bits_for(levels)
    held = np.zeros(bits, bool)
    for low, n in entered:
        held |= slice_of(low, n, bits)
    return Filter(held), levels, orders, rows


def answered(made: DataFrame, range_bits: int, bits: int | None, least_pair: int) -> DataFrame:
    """blocks -> (block, n_order, part, data): the packed levels of each block's n-grams of a key range, in the order of keys."""
    slice_bits = bits and bits >> range_bits

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        lm, _, orders, rows = slice_for(table, least_pair, slice_bits)
        one, two = (lm.level(low)[at] for low, at in orders)
        data, a, b = [], 0, 0
        for r in rows:
            x, y = r["n_one"], len(r["low"]) - r["n_one"]
            data.append(r["n_one"].to_bytes(8, "little") + blocks.squeeze(np.concatenate([one[a : a + x], two[b : b + y]])))
            a, b = a + x, b + y
        n = len(rows)
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "n_order": pa.array([1] * n, pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int64()), "data": pa.array(data, pa.binary())})

    return asked(made, range_bits).groupBy("part").applyInArrow(answer, "block long, n_order long, part long, data binary")


def built(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    marked = docs.select("doc_id", "text").withColumn("train", doc_remainder(F.col("doc_id"), modulus) != held)
    return materialize(blocks.build(marked, words, flag="train"), "lm-blocks")


def report(docs: DataFrame, modulus: int = 10, held: int = 0, bits: int | None = None, least_pair: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) -> (part, levels, bits, fill) of each slice of the filter."""
    range_bits = ranges(docs)
    slice_bits = bits and bits >> range_bits

    def one(key: tuple, table: pa.Table) -> pa.Table:
        lm, levels, _, _ = slice_for(table, least_pair, slice_bits)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([levels], pa.int64()), "bits": pa.array([len(lm.held)], pa.int64()), "fill": pa.array([lm.fill()], pa.float64())})

    return asked(built(docs, modulus, held), range_bits).groupBy("part").applyInArrow(one, "part long, levels long, bits long, fill double")


def by_range(tokens: list[str], range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the hash range of each token, their order by range)."""
    part = (token_keys(tokens) >> np.uint64(64 - range_bits)).astype(np.int64)
    return part, np.argsort(part, kind="stable")


def counted(made: DataFrame, range_bits: int) -> DataFrame:
    """blocks -> (block, n_order, part, data, n, v): the packed exact counts of each block's tokens of a hash range, in the order of ``by_range``, as order 0; n and v are a range's totals, given once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, used = row["tokens"], np.array(row["used"], np.int64)
                part, order = by_range(tokens, range_bits)
                cuts = np.searchsorted(part[order], np.arange((1 << range_bits) + 1))
                data = [(r, order[a:b]) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                for lo in range(0, len(data), 64):
                    some = data[lo : lo + 64]
                    yield pa.record_batch({"part": pa.array([r for r, _ in some], pa.int64()), "block": pa.array([row["block"]] * len(some), pa.int64()), "tokens": pa.array([blocks.pack_tokens([tokens[i] for i in at]) for _, at in some], pa.binary()), "used": pa.array([blocks.squeeze(used[at]) for _, at in some], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = [blocks.unpack_tokens(r["tokens"]) for r in rows]
        code = pa.array([t for some in lists for t in some], pa.string()).dictionary_encode()
        at = code.indices.to_numpy()
        total = np.zeros(len(code.dictionary), np.int64)
        np.add.at(total, at, np.concatenate([blocks.expand(r["used"], np.int64) for r in rows]))
        ends = np.cumsum([len(some) for some in lists])
        data = [blocks.squeeze(total[at[end - len(some) : end]]) for some, end in zip(lists, ends)]
        once = [1] + [0] * (len(rows) - 1)
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()), "n_order": pa.array([0] * len(rows), pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int64()), "data": pa.array(data, pa.binary()),
            "n": pa.array([k * int(total.sum()) for k in once], pa.int64()), "v": pa.array([k * int((total > 0).sum()) for k in once], pa.int64()),
        })

    asked_for = made.select("block", "tokens", "used").mapInArrow(ask, "part long, block long, tokens binary, used binary")
    return materialize(asked_for.groupBy("part").applyInArrow(add, "block long, n_order long, part long, data binary, n long, v long"), "lm-counts")


def ranges(docs: DataFrame) -> int:
    """Bits of the key range: RANGE_BYTES to a range, at most 2**18 ranges (400 MB to a range at 100 TB)."""
    return min(18, max(5, (size_hint(docs) // RANGE_BYTES).bit_length()))


def smoothed(pair: np.ndarray, context: np.ndarray, word: np.ndarray, whole: float, mu: float = MU) -> np.ndarray:
    """Probability of words after contexts, of the counts of the pair, the context and the word."""
    return (pair + mu * (word + 0.1) / whole) / (context + mu)


def score(docs: DataFrame, modulus: int = 10, held: int = 0, bits: int | None = None, least_pair: int = 1, mu: float = MU) -> DataFrame:
    """docs(doc_id, text, ...) -> RESULT for every document; those whose remainder is not ``held`` train."""
    made = built(docs, modulus, held)
    range_bits = ranges(docs)
    counts = counted(made, range_bits)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, v = total["n"], total["v"]
    whole = n + 0.1 * (v + 1)
    levels = answered(made, range_bits, bits, least_pair)

    def scored(key: tuple, held_rows: pa.Table, got: pa.Table) -> pa.Table:
        out, found = [], {0: [], 1: [], 2: []}
        for r in got.sort_by("part").to_pylist():
            if r["n_order"]:
                levels, n_one = blocks.expand(r["data"][8:], np.uint8), int.from_bytes(r["data"][:8], "little")
                found[1].append(levels[:n_one])
                found[2].append(levels[n_one:])
            else:
                found[0].append(blocks.expand(r["data"], np.int64))
        for row in held_rows.to_pylist():
            exact = np.zeros(len(row["tokens"]), np.int64)
            exact[by_range(row["tokens"], range_bits)[1]] = np.concatenate(found[0])
            flat, lens = blocks.expand(row["packed"], np.uint32), np.array(row["lens"], np.int64)
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
            one, two = (typical(np.concatenate(found[order]))[at] for order, (_, at, _) in enumerate(grams(row), 1))
            context = np.empty(len(flat))
            context[1:] = exact[flat[:-1]]
            context[starts] = exact[row["tokens"].index(END)]  # as many starts as ends
            p = smoothed(np.where(one[flat] > 0, np.minimum(two, context), 0.0), context, exact[flat], whole, mu)
            base = np.log10((exact + 0.1) / whole)[flat]
            cols = (np.add.reduceat(x, starts) for x in ((exact[flat] > 0).astype(np.int64), base, np.log10(p)))
            known, base_sum, score_sum = cols
            out.append((row["doc_ids"], [not f for f in row["flags"]], lens, known, base_sum, score_sum))
        cat = lambda i: np.concatenate([np.asarray(o[i]) for o in out])
        return pa.table({"doc_id": pa.array([d for o in out for d in o[0]], pa.int64()), "held_out": pa.array(cat(1)), "n_tokens": pa.array(cat(2), pa.int64()), "n_known": pa.array(cat(3), pa.int64()), "train_tokens": pa.array(np.full(len(cat(2)), n), pa.int64()), "base_score": pa.array(cat(4), pa.float64()), "score": pa.array(cat(5), pa.float64())})

    both = counts.select("block", "n_order", "part", "data").union(levels.select("block", "n_order", "part", "data"))
    return made.drop("used", "n_bytes").groupBy("block").cogroup(both.groupBy("block")).applyInArrow(scored, RESULT)


__all__ = ["Filter", "quantised", "report", "score", "words"]
