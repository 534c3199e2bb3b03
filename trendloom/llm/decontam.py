"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton holds every run of words of the test items. A document's words are streamed
through it; at each word the longest run that ends there and that some item holds is known.
Where it has ``window`` words or more, all of its words are hit, and the state tells the items; an
item of fewer words is hit where it occurs whole.

Words of a batch are found and numbered with numpy: a word's bytes are hashed and looked up among the
items' words. A run of two words or more can only lie where all neighbouring pairs are pairs of an item, so
only such stretches are streamed; their words are compared as bytes first, so a collision can't make a hit.

Items are counted first. An automaton is built in a task of its own for each shard of at most ``SHARD_WORDS``
words and then broadcast; if items have more words in all, documents pass shard by shard, and each pass adds to
the spans that the ones before found. An item longer than ``PIECE`` words is cut into pieces that overlap by
``window`` - 1 words, which keeps every window.

Defined results: null text has no words; ASCII letters are lower-cased; items without
words match nothing; rows of equal item ids are one item, and an item without id hits words but is
not listed; other columns of documents stay, except those named as the new ones; repeated rows
stay; texts are taken whole; an empty table gives an empty result, and no items hit nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, parts_for
from .lm import mix

WINDOW = 10
#: Words of an automaton (some 150 bytes of it for each), and of a piece of an item.
SHARD_WORDS, PIECE = 250_000, 20_000
#: Text bytes that a task turns to words at a time, and of them at a time to numbers.
SLICE, CHUNK = 16 << 20, 2 << 20
ADDED = "n_words long, spans array<struct<word:int,until:int,start:int,end:int>>, items array<string>"
#: Bytes of words, A-Z lower-cased, by byte; 0 parts words.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))


def chunks(low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of a batch of about CHUNK bytes, cut between documents, and in a long one where no word is."""
    start, end = 0, int(offsets[-1])
    while start < end:
        stop = min(start + CHUNK, end)
        if stop < end:
            by_doc = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
            if by_doc > start:
                stop = by_doc
            else:
                gap = np.flatnonzero(low[stop : min(end, stop + 4096)] == 0)
                while not len(gap) and stop < end:
                    stop = min(end, stop + 4096)
                    gap = np.flatnonzero(low[stop : min(end, stop + 4096)] == 0)
                stop = stop + int(gap[0]) if len(gap) else end
                stop = min(stop, int(offsets[np.searchsorted(offsets, start, "right")]))  # a word of this document's end
        yield start, stop
        start = stop


def words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of all documents of a batch, in order; none crosses a document's bounds."""
    out = []
    for a, b in chunks(low, offsets):
        part = low[a:b]
        of_word = part != 0
        before = np.concatenate([[False], of_word[:-1]])
        inside = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before[inside] = False
        starts = np.flatnonzero(of_word & ~before)
        at = np.flatnonzero(of_word)
        first = np.searchsorted(at, starts)
        lens = np.diff(np.append(first, len(at)))
        if len(starts):
            with np.errstate(over="ignore"):
                place = np.arange(len(at)) - np.repeat(first, lens)
                h = np.add.reduceat(part[at].astype(np.uint64) * POWERS[place & 1023], first)
                out.append((mix(h + lens.astype(np.uint64)), starts + a, starts + a + lens))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def words_of(text: str) -> list[bytes]:
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return [w for w in low.tobytes().split(b"\x00") if w]


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def split(self, p: int, word: int, q: int) -> int:
        """The state after ``word`` from p alone, where q also holds longer runs."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def insert(self, run: list[int]) -> None:
        last = 0
        for word in run:
            p, q = last, self.next[last].get(word)
            if q is not None:  # an earlier item has this run
                last = self.split(p, word, q)
                continue
            cur = self.state(self.length[last] + 1, 0, {})
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = cur
                p = self.link[p]
            if p >= 0:
                self.link[cur] = self.split(p, word, self.next[p][word])
            last = cur

    def build(self, items: list[tuple[str | None, list[bytes]]]) -> Automaton:
        runs = [(item, [self.number.setdefault(w, len(self.number)) for w in ws]) for item, ws in items]
        for _, run in runs:
            self.insert(run)
        # The state of the last ``window`` words of each state's runs, and the next state above that is a whole short item.
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.tail, self.short = [0] * len(order), [0] * len(order)
        self.items: dict[int, set[str]] = {}
        whole: set[int] = set()
        for item, run in runs:
            at, n = 0, len(run)
            for i, word in enumerate(run):
                at = self.next[at][word]
                while self.length[self.link[at]] >= self.window if at else False:
                    at = self.link[at]
                if i >= self.window - 1 or (n < self.window and i == n - 1):
                    self.items.setdefault(at, set()).update([item] if item is not None else [])
            if n < self.window:
                whole.add(at)
        for v in order[1:]:
            up = self.link[v]
            self.tail[v] = self.tail[up] if self.length[up] >= self.window else v
            self.short[v] = up if up in whole else self.short[up]
        self.whole = whole
        lens = [len(run) for _, run in runs]
        self.least = min([n for n in lens if n > 1], default=self.window)
        self.single = {run[0] for _, run in runs if len(run) == 1}
        # What numpy looks words and pairs up in.
        self.text = list(self.number)
        raw = np.frombuffer(b"\x00".join(self.text) + b"\x00", np.uint8)
        hashes = words(raw, np.array([0, len(raw)], np.int64))[0] if self.text else np.zeros(0, np.uint64)
        self.by_hash = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.by_hash]
        if len(self.hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two words of the items share a hash")
        v = len(self.text)
        self.pairs = np.unique(np.array([a * v + b for _, run in runs for a, b in zip(run, run[1:])], np.int64))
        return self

    def stream(self, run: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first, until, state) of what is hit at each word of a run: the longest match of ``window`` words or more, and whole short items."""
        at, held = 0, 0
        for i, word in enumerate(run):
            while at and word not in self.next[at]:
                at = self.link[at]
                held = self.length[at]
            step = self.next[at].get(word)
            if step is None:
                continue
            at, held = step, held + 1
            if held >= self.window:
                yield i + 1 - held, i + 1, self.tail[at]
            up = at if at in self.whole and held == self.length[at] else self.short[at]
            while up:
                yield i + 1 - self.length[up], i + 1, up
                up = self.short[up]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words by hash, -1 if no item has them."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], -1)

    def candidates(self, ids: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches (first, until) of words whose neighbouring pairs are all items' pairs, as long as the shortest window; and words that are items."""
        if len(ids) > 1 and len(self.pairs):
            key = ids[:-1] * len(self.text) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = np.concatenate([[False], (self.pairs[at] == key) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (of[:-1] == of[1:]), [False]])
            turns = np.flatnonzero(joined[1:] != joined[:-1])
            for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
                if b + 1 - a >= min(self.least, self.window):
                    yield a, b + 1
        if self.single:
            for i in np.flatnonzero(np.isin(ids, list(self.single))).tolist():
                yield i, i + 1


def scan(docs: DataFrame, automaton, window: int, first: bool) -> DataFrame:
    """docs (with ADDED unless ``first``) -> + ADDED, with what this automaton finds added."""

    def hits_of(lm: Automaton, low: np.ndarray, offsets: np.ndarray, carried: list | None) -> tuple[list, list, list]:
        hashes, starts, ends = words(low, offsets)
        cuts = np.searchsorted(starts, offsets)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
        ids = lm.numbers(hashes)
        hit = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for a, b in lm.candidates(ids, of):
            same = [low[starts[i] : ends[i]].tobytes() == lm.text[ids[i]] for i in range(a, b)]
            for lo, hi in stretches(same):
                for x, y, state in lm.stream(ids[a + lo : a + hi].tolist()):
                    hit[a + lo + x] += 1
                    hit[a + lo + y] -= 1
                    items.setdefault(int(of[a]), set()).update(lm.items[state])
        for k, doc in enumerate(carried or []):
            for s in doc["spans"]:
                hit[cuts[k] + s["word"]] += 1
                hit[cuts[k] + s["until"]] -= 1
            if doc["items"]:
                items.setdefault(k, set()).update(doc["items"])
        found = np.cumsum(hit)[:-1] > 0
        # A span ends with its document.
        opens = np.flatnonzero(found & ~(np.concatenate([[False], found[:-1]]) & np.concatenate([[False], of[1:] == of[:-1]]))) if len(of) else []
        closes = np.flatnonzero(found & ~(np.concatenate([found[1:], [False]]) & np.concatenate([of[1:] == of[:-1], [False]]))) if len(of) else []
        spans: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for a, b in zip(opens, closes):
            k = of[a]
            spans[k].append({"word": int(a - cuts[k]), "until": int(b + 1 - cuts[k]), "start": int(starts[a] - offsets[k]), "end": int(ends[b] - offsets[k])})
        return np.diff(cuts).tolist(), spans, [sorted(items.get(k, ())) for k in range(len(offsets) - 1)]

    names = [n.split()[0] for n in ("n_words long", "spans x", "items x")]
    kinds = [pa.int64(), pa.list_(pa.struct([(c, pa.int32()) for c in ("word", "until", "start", "end")])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = automaton.value
        for batch in batches:
            text = batch["text"].cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi, held = lo, 0
                while hi < batch.num_rows and (hi == lo or held + sizes[hi] <= SLICE):
                    held += sizes[hi]
                    hi += 1
                part = batch.slice(lo, hi - lo)
                low = LOWER[np.frombuffer(b"".join(x.as_py() or b"" for x in text.slice(lo, hi - lo)), np.uint8)]
                offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                carried = None if first else [{"spans": s, "items": i} for s, i in zip(part["spans"].to_pylist(), part["items"].to_pylist())]
                added = [pa.array(x, k) for x, k in zip(hits_of(lm, low, offsets, carried), kinds)]
                kept = [c for c in part.schema.names if c not in names]
                yield pa.record_batch([*(part[c] for c in kept), *added], names=[*kept, *names])
                lo = hi

    base = docs.drop(*names)
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), ADDED]))


def stretches(same: list[bool]) -> Iterator[tuple[int, int]]:
    """Maximal runs of true."""
    lo = None
    for i, x in enumerate([*same, False]):
        if x and lo is None:
            lo = i
        elif not x and lo is not None:
            yield lo, i
            lo = None


def pieces(items: DataFrame, window: int, piece: int) -> DataFrame:
    """items(item_id, text) -> (item, words, n): items with words, long ones in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), batch["text"]):
                found = words_of(text.as_py())
                starts = range(0, len(found) - window + 1, piece - window + 1) if len(found) > piece else [0] if found else []
                for at in starts:
                    some = found[at : at + piece]
                    yield pa.record_batch({"item": pa.array([item], pa.string()), "words": pa.array([some], pa.list_(pa.binary())), "n": pa.array([len(some)], pa.int64())})

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    return rows.mapInArrow(run, "item string, words array<binary>, n long")


def automata(items: DataFrame, window: int, shard_words: int, piece: int) -> Iterator[Automaton]:
    """Automata of at most ``shard_words`` words each, built in tasks and fetched one by one."""
    made = materialize(pieces(items, window, piece), "test-items")
    total = made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = parts_for(total, shard_words // 2) if total else 0
    dealt = lambda: made.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(shards)))
    # Equal pieces fall into one shard, once.
    while shards and dealt().dropDuplicates(["item", "words"]).groupBy("shard").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(shard_words, 2 * piece):
        shards *= 2

    def build(key: tuple, table: pa.Table) -> pa.Table:
        own = sorted(zip(table["item"].to_pylist(), table["words"].to_pylist()), key=lambda r: (r[0] is None, r))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([pickle.dumps(Automaton(window).build(own))], pa.binary())})

    if shards:
        built = materialize(dealt().dropDuplicates(["item", "words"]).select("shard", "item", "words").groupBy("shard").applyInArrow(build, "shard long, data binary"), "automata")
        for shard in range(shards):
            for row in built.where(F.col("shard") == shard).select("data").collect():  # one row, bounded by shard_words
                yield pickle.loads(row["data"])
        discard(built)
    discard(made)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, piece: int = PIECE) -> DataFrame:
    """docs(text, ...) -> + n_words, spans of hit words (word numbers and UTF-8 bytes, ends exclusive), items: sorted ids of the items with occurring windows."""
    sc = docs.sparkSession.sparkContext
    docs = docs.drop("n_words", "spans", "items")
    out, last = None, None
    for automaton in automata(items, window, shard_words, min(piece, shard_words)):
        if out is not None:
            last, out = out, materialize(out, "contaminated")
        out = scan(docs if out is None else out, sc.broadcast(automaton), window, first=last is None and out is None)
    return out if out is not None else scan(docs, sc.broadcast(Automaton(window).build([])), window, first=True)


def n_hit(spans=None):
    """Number of hit words of a document."""
    return F.aggregate(F.col("spans") if spans is None else spans, F.lit(0).cast("long"), lambda n, s: n + s["until"] - s["word"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = 1, most_share: float = 1.0) -> DataFrame:
    """Documents without hit spans of ``least_words`` words or more; those of whose words more than ``most_share`` are hit go.

    The columns of docs, with the text that is left, and those of ``contamination``.
    """
    found = contamination(docs, items, window)
    found = found.where(n_hit() <= F.lit(most_share) * F.col("n_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch["text"], batch["spans"].to_pylist()):
                gone = [s for s in spans if s["until"] - s["word"] >= least_words]
                if gone:
                    raw, at, kept = text.as_py().encode(), 0, []
                    for s in gone:
                        kept.append(raw[at : s["start"]])
                        at = s["end"]
                    texts.append(b"".join([*kept, raw[at:]]).decode())
                else:
                    texts.append(text.as_py())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return found.mapInArrow(run, found.schema)


__all__ = ["Automaton", "contamination", "decontaminate", "n_hit"]
