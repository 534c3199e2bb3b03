"""Suffix-array deduplication: exact removal of long repeated strings.

Every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere is
removed. The collection's Burrows-Wheeler transform and common prefixes are built column by column:
each round inserts one symbol of every document, moving from the right. It reads the
transform and the common prefixes that the round before wrote, in sequence, finds the
new places of the suffixes from them and writes the next ones.

To build it on many machines, the texts are cut where equal strings must be cut
alike. Each window of LENGTH bytes is named by its minimiser (the leftmost least hash of
32 bytes in it); a run of windows of one minimiser is a piece. Two equal windows lie in
pieces of one minimiser at the same offset from it, so the transform falls apart into one
segment for each (minimiser, column), and a round touches its own segment only:
the total work is linear in the pieces instead of rounds times collection, and pieces
of one minimiser are the only ones that must meet.

1. Pieces are found where the texts lie; (row, minimiser, offset, content digest) rows are stored. A row
   is named by two 64-bit hashes of its id and text.
2. Equal pieces are merged before anything moves. A minimiser with one distinct piece needs no
   transform: all its windows repeat if it has two copies, none if it has one.
3. For other minimisers one copy of each distinct piece is fetched from its
   document and goes through the column-wise construction, whole minimisers in blocks of bounded bytes.
   A minimiser with more than ``CAP`` distinct pieces (a passage with many
   surroundings) would not fit a block. Its pieces are parted by offset and named by the text
   that all windows of a part hold, equal parts are merged, and the parts go the same way; at the last
   level a part is a window and nothing is left to order. That is exact at every level.
4. Spans go back to all documents that hold the piece, and the texts are cut.

Passages can be asked for as well: runs of so many words that another document holds too, whatever
white space parts the words and however few bytes they have. They are found the same way, with the words'
64-bit hashes as symbols, and are reported, not removed. Here pieces meet only if two documents
have their minimiser, and a run counts only if the documents that hold it are several; a document is known
by its row's name, so rows of one id and text are one document.

A block's files are bounded by ``BLOCK_BYTES``, so they are streams in a task's memory and nothing
is left in a machine's own folders; a task that is run again makes them again.

Defined results: null text is empty; texts of fewer than LENGTH bytes lose nothing;
repeated rows are texts that repeat each other; a run of one byte repeats
itself; a null doc_id is an ordinary row; columns beyond doc_id and text are ignored, whatever their
names; an empty table gives an empty result. Strings are bytes, so a cut may part a character; the
kept bytes are therefore binary.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, release
from .lm import mix
from .near import grouped

LENGTH = 400
GRAM = 32
CAP = 2000
#: Windows to a part, level by level; the last must be 1.
STEPS = (46, 8, 1)
BLOCK_BYTES = 8 << 20
_CHUNK = 1 << 19
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:int,end:int>>, shared array<struct<start:int,end:int>>"
#: What names a row.
ROW = ("key", "key2")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_INSIDE = np.array([not _GAP.match(bytes([b])) for b in range(256)])


class Unit(NamedTuple):
    """What strings are made of: the bytes of a stored symbol, symbols to a gram, and STEPS."""

    width: int
    gram: int
    steps: tuple[int, ...]
    kind: type
    #: Columns of ``pieces``: where a piece begins in its text and how many bytes it has there.
    place: tuple[str, str]


BYTE = Unit(1, GRAM, STEPS, np.uint8, ("start", "size"))
WORD = Unit(8, 8, (6, 1), np.uint64, ("offset", "extent"))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)


_POWERS = powers(_BASE, _CHUNK), powers(pow(_BASE, -1, 2**64), _CHUNK)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text: (hash, first byte, end). A hash is taken from running sums over a stretch."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    lo = 0
    while lo < len(data):
        gap = _GAP.search(data, lo + _CHUNK // 2)
        hi = gap.start() if gap else len(data)
        b = np.frombuffer(data, np.uint8, hi - lo, lo)
        inside = np.concatenate([[False], _INSIDE[b], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edges[::2], edges[1::2]
        up, down = _POWERS if len(b) <= _CHUNK else (powers(_BASE, len(b)), powers(pow(_BASE, -1, 2**64), len(b)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)])
            h = mix((sums[end] - sums[begin]) * down[begin])
        for col, values in zip(found, (h, begin + lo, end + lo)):
            col.append(values)
        lo = hi
    h, begin, end = (np.concatenate(c) for c in found)
    return h, begin, end


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``word_hashes`` of each text; short ones are read together."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) < _CHUNK // 2:
            size, hi = size + len(texts[hi]) + 1, hi + 1
        h, begin, end = word_hashes(b"\n".join(texts[lo:hi]))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])])
        cuts = np.searchsorted(begin, starts)
        for i, a, z in zip(starts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            yield h[a:z], begin[a:z] - i, end[a:z] - i
        lo = hi


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) symbols from each position; a symbol is given by its hash."""
    h, have, factor = symbols, 1, _BASE
    with np.errstate(over="ignore"):
        while have < gram:
            h = h[:-have] * np.uint64(factor) + h[have:]
            have, factor = 2 * have, factor * factor % 2**64
    return mix(h)


def least_of(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        a, have = np.minimum(a[:-have], a[have:]), 2 * have
    return np.minimum(a[: len(a) - (width - have)], a[width - have :]) if width > have else a


def minimisers(symbols: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows: (first start, last start, minimiser's position, minimiser)."""
    n, gram = len(symbols) - length + 1, min(gram, 1 << (length.bit_length() - 1))
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    h, width = gram_hashes(symbols, gram), length - gram + 1
    low = np.uint64((1 << 20) - 1)
    at = np.empty(n, np.int64)
    for lo in range(0, n, _CHUNK):
        part = h[lo : lo + _CHUNK + width - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        got = (least_of(key, width) & low).astype(np.int64) + lo
        at[lo : lo + len(got)] = got[: n - lo]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, at[first], h[at[first]]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(9), "text", "doc_id").alias("key2"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def pieces(rows: DataFrame, length: int = LENGTH, unit: Unit = BYTE) -> DataFrame:
    """(key, key2, text) -> (key, key2, anchor, at, start, size, digest): one row for each run of windows of one minimiser; of words also its ``place``."""
    more = unit.place if unit is WORD else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + len(more))]
            held = 0
            texts = (t.as_py().encode() for t in batch["text"])
            read = ((b"", *found) for found in words_of(list(texts))) if unit is WORD else ((d, _BYTE[np.frombuffer(d, np.uint8)], None, None) for d in texts)
            for key, key2, (data, symbols, begin, end) in zip(batch["key"].to_pylist(), batch["key2"].to_pylist(), read):
                first, last, at, anchor = minimisers(symbols, length, unit.gram)
                if not len(first):
                    continue
                size = last - first + length
                stored, w = symbols.tobytes() if unit is WORD else data, unit.width
                digests = [xxhash.xxh3_64_intdigest(stored[s * w : (s + z) * w]) for s, z in zip(first.tolist(), size.tolist())]
                place = (begin[first], end[first + size - 1] - begin[first]) if more else ()
                for col, values in zip(out, (np.full(len(first), key), np.full(len(first), key2), anchor.view(np.int64), at - first, first, size, np.array(digests, np.uint64).view(np.int64), *place)):
                    col.append(values)
                held += len(first)
                if held > 50_000:
                    yield packed(out)
                    out, held = [[] for _ in range(7 + len(more))], 0
            if held:
                yield packed(out)

    def packed(out: list[list]) -> pa.RecordBatch:
        key, key2, anchor, at, start, size, digest, *place = (np.concatenate(c) for c in out)
        return pa.record_batch({"key": key, "key2": key2, "anchor": anchor, "at": at.astype(np.int32), "start": start.astype(np.int32), "size": size.astype(np.int32), "digest": digest} | {c: v.astype(np.int32) for c, v in zip(more, place)})

    return rows.select(*ROW, "text").mapInArrow(run, "key long, key2 long, anchor long, at int, start int, size int, digest long" + "".join(f", {c} int" for c in more))


def spelled(fetched: DataFrame) -> DataFrame:
    """Pieces of text as the hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = pa.array([h.tobytes() for h, _, _ in words_of(batch["piece"].to_pylist())], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("piece"), "piece", codes)

    return fetched.mapInArrow(run, fetched.schema)


class Round:
    """A sequential file of one column: written once in order, then read once in order."""

    def __init__(self, *arrays: np.ndarray) -> None:
        self.stream = io.BytesIO()
        for a in arrays:
            self.stream.write(np.ascontiguousarray(a).tobytes())
        self.stream.seek(0)

    def read(self, n: int, kind: type) -> np.ndarray:
        return np.frombuffer(self.stream.read(n * np.dtype(kind).itemsize), kind)


def repeats(group: np.ndarray, at: np.ndarray, data: list[np.ndarray], length: int = LENGTH, holders: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """Column-wise construction over pieces: (piece, first start, last start) of the runs of windows that repeat within a group.

    With ``holders``, the least and the greatest document of each piece, windows of different pieces that several documents hold.

    Pieces are aligned at their anchors. Before round t the file holds, in the present order of
    suffixes, the transform (each suffix's preceding symbol, the one in column t; 0
    where the piece hasn't begun or is over) and the common prefixes of neighbours. The round
    reads both and sorts stably by (group, symbol), which is the order of the
    suffixes longer by one; neighbours of one symbol have as common prefix one
    more than the least one between their old places, others have none. Then it
    writes the file of the next round.
    """
    m = len(data)
    size = np.array([len(d) for d in data], np.int64)
    left, right = int(at.max()), int((size - at).max())
    flat = np.concatenate(data)
    if flat.dtype == np.uint8:
        kinds, flat = 257, flat.astype(np.uint16) + 1
    else:
        names, flat = np.unique(flat, return_inverse=True)
        kinds, flat = len(names) + 1, flat.astype(np.uint32) + 1
    table = np.zeros((left + right, m), flat.dtype)  # the pieces by columns
    for i, (n, end) in enumerate(zip(size.tolist(), np.cumsum(size).tolist())):
        lo = left - int(at[i])
        table[lo : lo + n, i] = flat[end - n : end]
    _, rank = np.unique(group, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    # A prefix is common to a suffix and the one before it; the last is a sentinel.
    file = Round(table[-1][order], np.zeros(m + 1, np.int32))
    repeated, out = np.zeros(m, bool), []
    begun = np.zeros(m, np.int64)
    for t in range(left + right - 1, -1, -1):
        symbol, prefix = file.read(m, table.dtype), file.read(m + 1, np.int32)
        key = rank[order] * kinds + symbol
        new = np.argsort(key, kind="stable")
        key = key[new]
        joined = np.zeros(m + 1, bool)
        joined[1:m] = (key[1:] == key[:-1]) & (symbol[new[1:]] > 0)
        here = np.flatnonzero(joined)
        lo, hi = new[here - 1] + 1, new[here] + 1
        fresh = np.zeros(m + 1, np.int32)
        least = prefix[hi - 1]
        wide = np.flatnonzero(hi - lo > 1)
        if len(wide):
            bounds = np.empty(2 * len(wide), np.int64)
            bounds[::2], bounds[1::2] = lo[wide], hi[wide]
            least[wide] = np.minimum.reduceat(prefix, bounds)[::2]
        fresh[here] = least + 1
        order = order[new]
        file = Round(table[max(t - 1, 0)][order], fresh)
        now = np.zeros(m, bool)
        meets = (fresh[:m] >= length) | (fresh[1:] >= length)
        if holders is not None:  # those of one window are neighbours
            cuts = np.flatnonzero(fresh[:m] < length)
            several = np.minimum.reduceat(holders[0][order], cuts) < np.maximum.reduceat(holders[1][order], cuts)
            meets &= np.repeat(several, np.diff(np.append(cuts, m)))
        now[order] = meets
        turned = np.flatnonzero(now != repeated)
        for i in turned.tolist():
            if now[i]:
                begun[i] = t
            else:
                out.append((i, t + 1 - left + int(at[i]), int(begun[i]) - left + int(at[i])))
        repeated = now
    for i in np.flatnonzero(repeated).tolist():
        out.append((i, int(at[i]) - left, int(begun[i]) - left + int(at[i])))
    return out


def transformed(fetched: DataFrame, length: int = LENGTH, unit: Unit = BYTE, apart: bool = False) -> DataFrame:
    """(anchor, digest, at, piece) -> (anchor, digest, lo, hi): runs of window starts in the piece that repeat; with ``apart`` in several documents, by (least, most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "anchor"):
            anchor = table["anchor"].to_numpy()
            sizes = np.cumsum([len(p) for p in table["piece"].to_pylist()])
            cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
            lo = 0
            while lo < len(anchor):  # whole groups, up to BLOCK_BYTES
                most = (sizes[lo - 1] if lo else 0) + BLOCK_BYTES
                hi = int(cuts[max(np.searchsorted(cuts, lo) + 1, np.searchsorted(cuts, np.searchsorted(sizes, most), side="right") - 1)])
                part = table.slice(lo, hi - lo)
                holders = (part["least"].to_numpy(), part["most"].to_numpy()) if apart else None
                found = repeats(anchor[lo:hi], part["at"].to_numpy(), [np.frombuffer(p, unit.kind) for p in part["piece"].to_pylist()], length, holders)
                if found:
                    i, a, b = (np.array(c) for c in zip(*found))
                    yield pa.record_batch({"anchor": anchor[lo:hi][i], "digest": part["digest"].to_numpy()[i], "lo": a.astype(np.int32), "hi": b.astype(np.int32)})
                lo = hi

    return fetched.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, digest long, lo int, hi int")


def parts(hot: DataFrame, step: int, length: int, unit: Unit = BYTE, apart: bool = False) -> DataFrame:
    """(anchor, digest, at, piece) -> (whole_anchor, whole_digest, shift, anchor, digest, at, piece): pieces of at most ``step`` windows; with ``apart`` (least, most) too.

    Windows are parted by their offset from the anchor, ``step`` offsets to a
    part. All windows of a part hold the same stretch of text, its core; parts are
    named by (anchor, part, core), so equal windows still meet, and the windows
    of different cores don't. With a step of 1 a part is a window.
    """
    holders, w = ("least", "most") if apart else (), unit.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for anchor, digest, at, piece, *held in zip(*(batch[c].to_pylist() for c in ("anchor", "digest", "at", "piece", *holders))):
                last = len(piece) // w - length
                for q in range(-at // step, (last - at) // step + 1):
                    lo, hi = max(0, q * step + at), min(last, q * step + step - 1 + at)
                    core = q * step + step - 1 + at
                    name = xxhash.xxh3_64_intdigest(piece[core * w : (q * step + length + at) * w], seed=(anchor + q) % 2**64)
                    part = piece[lo * w : (hi + length) * w]
                    rows.append((anchor, digest, lo, signed(name), signed(xxhash.xxh3_64_intdigest(part)), core - lo, part, *held))
            cols = list(zip(*rows)) or [()] * (7 + len(holders))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            names = ("whole_anchor", "whole_digest", "shift", "anchor", "digest", "at", "piece", *holders)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names))

    schema = "whole_anchor long, whole_digest long, shift int, anchor long, digest long, at int, piece binary" + "".join(f", {c} long" for c in holders)
    return hot.select("anchor", "digest", "at", "piece", *holders).mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def held(apart: bool) -> list[Column]:
    return [F.min("least").alias("least"), F.max("most").alias("most")] if apart else []


def several(apart: bool) -> Column:
    """Whether a piece's windows repeat whatever other pieces hold."""
    return F.col("least") < F.col("most") if apart else F.col("copies") > 1


def refined(hot: DataFrame, length: int, cap: int, steps: tuple[int, ...], unit: Unit = BYTE, apart: bool = False) -> DataFrame | None:
    """What ``transformed`` gives, for minimisers of more than ``cap`` distinct pieces; None if there are none."""
    if not steps or not hot.limit(1).count():
        return None
    subs = materialize(parts(hot, steps[0], length, unit, apart), "parts")
    contents = subs.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.first("at").alias("at"), F.first("piece").alias("piece"), *held(apart))
    contents = materialize(contents, "part-contents")
    kinds = materialize(contents.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "part-anchors")
    mixed = materialize(contents.join(kinds, "anchor"), "part-kinds")
    found = contents.where(several(apart)).select("anchor", "digest", F.lit(0).alias("lo"), ((F.length("piece") / unit.width).cast("int") - length).alias("hi"))
    found = found.union(transformed(mixed.where(F.col("kinds") <= cap), length, unit, apart))
    deeper = refined(mixed.where(F.col("kinds") > cap), length, cap, steps[1:], unit, apart)
    found = materialize(found.union(deeper) if deeper is not None else found, "part-runs")
    rows = subs.select("whole_anchor", "whole_digest", "shift", "anchor", "digest").join(found, ["anchor", "digest"])
    return rows.select(F.col("whole_anchor").alias("anchor"), F.col("whole_digest").alias("digest"), (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"))


def merged(runs: list[dict], length: int) -> list[dict[str, int]]:
    """What the windows of the runs cover: maximal spans in order."""
    out: list[dict[str, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], hi + length)
        else:
            out.append({"start": lo, "end": hi + length})
    return out


def cut(rows: DataFrame, spans: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """rows(key, key2, text, doc_id) and spans(key, key2, runs and passages: array<struct<lo, hi>>) -> RESULT."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, kept, spans = [], [], []
            for text, runs in zip(batch["text"], batch["runs"]):
                data, gone = text.as_py().encode(), merged(runs.as_py() or [], length)
                sizes.append(len(data))
                kept.append(b"".join(data[a:b] for a, b in zip([0, *(g["end"] for g in gone)], [*(g["start"] for g in gone), len(data)])))
                spans.append(gone)
            shared = [merged(runs.as_py() or [], words) for runs in batch["passages"]]
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, span), "shared": pa.array(shared, span)})

    return rows.join(spans, list(ROW), "left").select("doc_id", "text", "runs", "passages").mapInArrow(run, RESULT)


def repeated(rows: DataFrame, length: int, cap: int, unit: Unit = BYTE, apart: bool = False) -> DataFrame:
    """rows(key, key2, text) -> (key, key2, lo, hi): the runs of window starts whose windows repeat; with ``apart`` in several documents."""
    found = materialize(pieces(rows, length, unit), "pieces")
    if apart:  # most minimisers are one document's
        meet = found.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("anchor")
        meet = materialize(meet, "meet")
        every, found = found, materialize(found.join(meet, "anchor", "left_semi"), "pieces")
        discard(every, meet)
    keys = [F.min("key").alias("least"), F.max("key").alias("most")] if apart else []
    by_content = found.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), *keys, F.min(F.struct(*ROW, *dict.fromkeys((*unit.place, "size", "at")))).alias("one"))
    by_content = materialize(by_content, "contents")
    # Written, here and below, so that the next join has plain shuffles on both sides and can split a key that thousands of rows share.
    groups = materialize(by_content.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all")).where("all > 1").drop("all"), "anchors")
    shared = materialize(by_content.join(groups, "anchor"), "shared")
    discard(by_content, groups)
    holders = ("least", "most") if apart else ()
    wanted = shared.where("kinds > 1").select("anchor", "digest", "kinds", *holders, "one.*")
    fetched = rows.select(*ROW, "text").join(wanted, list(ROW))
    # A row's name may stand for repeated rows; their texts are equal, so either serves.
    body = F.substring(F.col("text").cast("binary"), F.col(unit.place[0]) + 1, F.col(unit.place[1]))
    fetched = fetched.select("anchor", "digest", "at", "kinds", *holders, body.alias("piece")).dropDuplicates(["anchor", "digest"])
    fetched = materialize(spelled(fetched) if unit is WORD else fetched, "fetched")
    release(rows)
    runs = transformed(fetched.where(F.col("kinds") <= cap), length, unit, apart)
    hot = refined(fetched.where(F.col("kinds") > cap), length, cap, unit.steps, unit, apart)
    runs = runs.union(hot) if hot is not None else runs
    whole = shared.where(several(apart)).select("anchor", "digest", F.lit(0).alias("lo"), (F.col("one.size") - length).alias("hi"))
    known = materialize(runs.union(whole).groupBy("anchor", "digest").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    discard(shared, fetched)
    spans = found.select(*ROW, "anchor", "digest", "start").join(known, ["anchor", "digest"])
    spans = spans.select(*ROW, F.explode(F.transform("runs", lambda r: F.struct((r["lo"] + F.col("start")).alias("lo"), (r["hi"] + F.col("start")).alias("hi")))).alias("run"))
    spans = materialize(spans.select(*ROW, "run.*"), "spans")
    discard(found, known)
    release(rows)
    return spans


def dedup(docs: DataFrame, length: int = LENGTH, cap: int = CAP, words: int = 0) -> DataFrame:
    """docs(doc_id, text, ...) -> RESULT: for each document its bytes, what is kept of them and the maximal removed spans.

    With ``words``, ``shared`` holds the maximal spans of its words that runs of so many words cover which another document holds too.
    """
    rows, run = keyed(docs), F.struct("lo", "hi")
    none = F.lit(None).cast("struct<lo:int,hi:int>")
    passages = repeated(rows, words, cap, WORD, apart=True).select(*ROW, none.alias("run"), run.alias("passage")) if words else None
    spans = repeated(rows, length, cap).select(*ROW, run.alias("run"), none.alias("passage"))
    spans = spans.union(passages) if passages is not None else spans
    spans = spans.groupBy(*ROW).agg(F.collect_list("run").alias("runs"), F.collect_list("passage").alias("passages"))
    return cut(rows, spans, length, words)


def removed(spans: Column) -> Column:
    """Bytes, or words, in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
