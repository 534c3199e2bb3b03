"""N-gram Jaccard join by chosen paths, and the classes it gives.

A document is the set of its five-word shingles. Documents of equal sets are one class
from the start. The sets are then split recursively: the root of each run sends
every set down the paths of sampled shared tokens (coordinates of a min-hash signature: two sets share the sampled
token with the probability of their similarity), 1 / threshold paths in
expectation, until buckets are small; small buckets are brute-forced, and runs repeat
until the target recall. A bucket looks at signatures first; members that roughly agree
with another one fetch their whole sets, and the bucket checks them exactly.

A pair that meets in several buckets belongs to the first of them, by run: each set carries the list
of its buckets, and a bucket leaves out pairs whose lists share an earlier one. So
every link is counted once, sets travel only to buckets in which they own a
pair, and nothing depends on how far similarity chains from text to text.

Scale: texts are read once for candidates, and their sets go to at most as many buckets as
there are paths. Buckets beyond ``TILE`` members after the last split (dense groups) are cut into tiles, and pairs of tiles are the
unit of work, so no task holds an unbounded group; within a unit links are summed and
a spanning forest is given out, so rows stay linear in the members of a unit
while no link is lost.

Defined results: null or empty text has no shingles, no links and a class of its own;
a text of one to four words is one shingle of its words; a null doc_id takes no part
(class null, no links); repeated rows are copies and link to each other;
an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components
from .lm import mix

SHINGLE = 5
THRESHOLD = 0.8
#: Of a run count that takes runs as independent. They share the coordinates of one signature, so a pair at exactly 0.8 is really missed with probability 3e-5 or so.
RECALL = 0.99999
COORDINATES = 48
LEVELS = 3
BUCKET = 1024
TILE = 1024
TOKENS_AT_ONCE = 1_000_000
#: Rows of a unit that are compared with the whole unit at once.
ROWS_AT_ONCE = 128
#: Signatures that agree in this share of coordinates (25 of 48) are checked; pairs at 0.8 fall below with probability 3e-6.
ROUGHLY = 0.52
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(41).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has shared a leaf with probability ``recall``, even where all levels split.

    A pair shares a node of the next level if one of the one or two paths that it takes from a shared node agrees.
    """
    second, meet = 1 / threshold - 1, 1.0
    for _ in range(levels):
        step = threshold * meet
        meet = (1 - second) * step + second * (1 - (1 - step) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(h))):
            out = out * _STEP + h[k : k + n]
        return np.unique(mix(out + np.uint64(min(SHINGLE, len(h)))))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 512):
            block = ((s[lo : lo + 512, None] * _SEEDS) >> np.uint64(32)).min(0).astype(np.uint32)
            least = np.minimum(least, block)
    return least


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, digest, size, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, sigs = [], [], []
            for text in batch["text"]:
                s = shingles(text.as_py())
                digests.append(digest(s))
                sizes.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else b"")
            yield pa.record_batch({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "digest": pa.array(digests, pa.binary()), "size": pa.array(sizes, pa.int32()), "sig": pa.array(sigs, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, digest binary, size int, sig binary")


def coordinate(sig: str, at) -> F.Column:
    return F.substring(F.col(sig), (at * 4 + 1).cast("int"), F.lit(4))


def leaves(classes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """classes(rep, sig) -> (rep, bucket, members): the buckets in which the recursion ends, of two members or more.

    A bucket's number begins with its run, so that the order of numbers is the order of runs.
    Signatures stay in ``classes`` while buckets are counted; only rows that are split further fetch them.
    """
    more = 1 / threshold - 1  # paths beyond the first, in expectation
    sigs = classes.select("rep", "sig")

    def split(nodes: DataFrame, level: int) -> DataFrame:
        first = (F.col("run") * 5 + level * 17) % COORDINATES
        draw = F.xxhash64(F.lit(level), "node")
        second = F.when(F.pmod(draw, F.lit(1000)) < int(1000 * more), F.pmod(F.shiftright(draw, 20), F.lit(COORDINATES)))
        ways = F.array_compact(F.array(first.cast("long"), F.when(second != first, second)))
        node = F.shiftleft(F.col("run").cast("long"), 56) + F.shiftrightunsigned(F.xxhash64("node", "way", coordinate("sig", F.col("way"))), 8)
        return nodes.withColumn("way", F.explode(ways)).select("rep", "run", node.alias("node"))

    nodes = sigs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("node", F.xxhash64("run"))
    ended = None
    for level in range(LEVELS):
        rows = materialize(split(nodes, level), "nodes")
        # Written, so that the join has plain shuffles on both sides and can split a hot node.
        counts = materialize(rows.groupBy("node").agg(F.count("*").alias("members")).where("members > 1"), "node-counts")
        sized = materialize(rows.join(counts, "node"), "sized")
        discard(rows, counts)
        done = sized if level == LEVELS - 1 else sized.where(F.col("members") <= BUCKET)
        done = done.select("rep", F.col("node").alias("bucket"), "members")
        ended = done if ended is None else ended.union(done)
        nodes = sized.where(F.col("members") > BUCKET).select("rep", "run", "node").join(sigs, "rep")
    return ended


def tiled(rows: DataFrame) -> DataFrame:
    """(bucket, rep, members, ...) -> + tile, unit, across: a row of a bucket beyond BUCKET members once for each pair of tiles that its tile is in, others once."""
    tiles = F.when(F.col("members") > BUCKET, F.ceil(F.col("members") / TILE).cast("int")).otherwise(F.lit(1))
    out = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    unit = F.when(F.col("members") > BUCKET, F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other"))).otherwise(F.col("bucket"))
    return out.withColumns({"unit": unit, "across": F.col("tile") != F.col("other")}).drop("other")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index connected to each of 0 .. n - 1 under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        old = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = np.minimum(label, label[label])
        if (old == label).all():
            break
    return label


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``by``; a few thousand rows each, or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[by].to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        if held and (last or held[-1][by][-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def earlier(lists: list[list[int]], bucket: int) -> np.ndarray:
    """Matrix of pairs that share a bucket before this one."""
    n = len(lists)
    out = np.zeros((n, n), bool)
    if n <= 12:
        before = [{x for x in some if x < bucket} for some in lists]
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = not before[i].isdisjoint(before[j])
        return out
    arrays = [np.array([x for x in some if x < bucket], np.uint64) for some in lists]
    return overlaps(arrays) > 0 if any(map(len, arrays)) else out


def close_pairs(key: np.ndarray, sig: np.ndarray, tile: np.ndarray, across: np.ndarray, small: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one key that agree in ``need`` coordinates, ordered by key; only rows flagged ``small`` are compared."""
    a, b, live, d = [], [], np.flatnonzero(small), 1
    while True:
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        hit = live[(sig[live] == sig[live + d]).sum(1) >= need]
        hit = hit[~across[hit] | (tile[hit] != tile[hit + d])]
        a.append(hit)
        b.append(hit + d)
        d += 1
    a, b = np.concatenate(a or [live]), np.concatenate(b or [live])
    order = np.argsort(key[a], kind="stable")
    return a[order], b[order]


def alike(sig: np.ndarray, tile: np.ndarray, across: bool, need: int, shared: np.ndarray | None = None) -> np.ndarray:
    """Which members of a unit agree in ``need`` coordinates with another one, of the other tile if the unit is across tiles, and not in a ``shared`` pair."""
    out = np.zeros(len(sig), bool)
    for lo in range(0, len(sig), ROWS_AT_ONCE):
        some = np.arange(lo, min(lo + ROWS_AT_ONCE, len(sig)))
        agree = np.zeros((len(some), len(sig)), np.uint8)
        for k in range(sig.shape[1]):
            agree += sig[some, k][:, None] == sig[:, k][None]
        hit = agree >= need
        hit[np.arange(len(some)), some] = False
        if across:
            hit &= tile[some][:, None] != tile[None]
        if shared is not None:
            hit &= ~shared[some]
        out[some] = hit.any(1)
    return out


def owners(units: DataFrame) -> DataFrame:
    """(unit, bucket, tile, across, rep, sig, buckets) -> (rep, bucket, unit, tile, across) of members that own a roughly similar pair in the unit."""
    need = math.ceil(ROUGHLY * COORDINATES)
    kept = ["rep", "bucket", "unit", "tile", "across"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "unit"):
            key, tile, across, bucket = (table[c].to_numpy() for c in ("unit", "tile", "across", "bucket"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, COORDINATES)
            lists, mine = table["buckets"], np.zeros(len(key), bool)
            units_here = list(runs_of(key))
            # Small units together, neighbour by neighbour; large ones on their own.
            small = np.concatenate([np.full(hi - lo, hi - lo <= ROWS_AT_ONCE) for lo, hi in units_here])
            a, b = close_pairs(key, sig, tile, across, small, need)
            for lo, hi in runs_of(key[a]):
                members, at = np.unique(np.concatenate([a[lo:hi], b[lo:hi]]), return_inverse=True)
                shared = earlier([lists[i].as_py() for i in members.tolist()], int(bucket[members[0]]))
                own = ~shared[at[: hi - lo], at[hi - lo :]]
                mine[a[lo:hi][own]] = mine[b[lo:hi][own]] = True
            for lo, hi in units_here:
                # Only members with a partner look at their lists; the rest of the unit is out already.
                some = lo + np.flatnonzero(alike(sig[lo:hi], tile[lo:hi], across[lo], need)) if hi - lo > ROWS_AT_ONCE else ()
                if len(some):
                    shared = earlier([lists[i].as_py() for i in some.tolist()], int(bucket[lo]))
                    mine[some] = alike(sig[some], tile[some], across[lo], need, shared)
            if mine.any():
                yield from table.select(kept).filter(pa.array(mine)).combine_chunks().to_batches()

    return units.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(run, "rep long, bucket long, unit long, tile int, across boolean")


def runs_of(key: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, int)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products over the tokens that more than one set has."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    # Ranges of token values, so that memory stays bounded however long the sets are.
    ranges = max(1, -(-sum(map(len, sets)) // TOKENS_AT_ONCE))
    cuts = [np.searchsorted(s, np.array([r * (2**64 // ranges) for r in range(1, ranges)], np.uint64)) for s in sets]
    for r in range(ranges):
        add_overlaps([s[c[r - 1] if r else 0 : c[r] if r < ranges - 1 else len(s)] for s, c in zip(sets, cuts)], out)
    return out


def add_overlaps(sets: list[np.ndarray], out: np.ndarray) -> None:
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    token, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    shared = count[code] > 1
    owner, column = owner[shared], rank[code[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = int((count > 1).sum()), 1024
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((n, min(width, total - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T


def similar(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(some rows, their matrix of pairs at or over the threshold with all), exact in whole numbers, false on the diagonal."""
    size = np.array([len(s) for s in sets], np.float64)
    both = overlaps(sets)
    for lo in range(0, len(sets), ROWS_AT_ONCE):
        some = np.arange(lo, min(lo + ROWS_AT_ONCE, len(sets)))
        part = both[some].astype(np.float64)
        hit = part >= threshold * (size[some, None] + size[None] - part) - 1e-9
        hit[np.arange(len(some)), some] = False
        yield some, hit


def checked(units: DataFrame, threshold: float) -> DataFrame:
    """(unit, bucket, tile, across, rep, copies, buckets, tokens) -> (rep, links, root): the unit's own links and their spanning forest; a rep given more than once counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "unit"):
            key, rep = table["unit"].to_numpy(), table["rep"].to_numpy()
            once = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])]))
            key, rep, copies, tile, across, bucket = (table[c].to_numpy()[once] for c in ("unit", "rep", "copies", "tile", "across", "bucket"))
            tokens, lists = table["tokens"], table["buckets"]
            links, root = np.zeros(len(key), np.int64), rep.copy()
            for lo, hi in runs_of(key):
                mine = once[lo:hi].tolist()
                before = earlier([lists[i].as_py() for i in mine], int(bucket[lo]))
                label = np.arange(hi - lo)
                for some, hit in similar([np.frombuffer(tokens[i].as_buffer(), np.uint64) for i in mine], threshold):
                    hit &= ~before[some]
                    if across[lo]:
                        hit &= tile[lo:hi][some][:, None] != tile[lo:hi][None]
                    links[lo + some] = hit @ copies[lo:hi]
                    a, b = np.nonzero(hit)
                    label = forest(hi - lo, label[some[a]], label[b])[label]
                root[lo:hi] = rep[lo:hi][label]
            yield pa.record_batch({"rep": rep, "links": links, "root": root})

    return units.repartition("unit").sortWithinPartitions("unit", "rep").mapInArrow(run, "rep long, links long, root long")


def token_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members(owner, digest, ...) -> + tokens (sorted 64-bit hashes), from the documents' whole texts.

    Where the owner's row is repeated, a member comes once from each task that read one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("owner"), "text").join(members, "owner")
    kept = members.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                meant, tokens = [], []
                for text, wanted in zip(part["text"], part["digest"].to_pylist()):
                    s = shingles(text.as_py()) if wanted not in done else None
                    # A doc_id may stand for several texts; only the one meant stays.
                    meant.append(s is not None and digest(s) == wanted)
                    tokens.append(s.tobytes() if meant[-1] else b"")
                    if meant[-1]:
                        done.add(wanted)
                out = pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(tokens, pa.binary())], names=[*kept, "tokens"])
                yield out.filter(pa.array(meant, pa.bool_()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return rows.select("text", *kept).mapInArrow(run, f"{fields}, tokens binary")


def candidates(docs: DataFrame, classes: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """classes(rep, owner, digest, copies, sig) -> (unit, bucket, tile, across, rep, copies, buckets, tokens): what each unit checks; and the tables that it reads."""
    ended = materialize(leaves(classes, runs_for(recall, threshold), threshold), "leaves")
    lists = materialize(ended.groupBy("rep").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")).join(classes.select("rep", "sig"), "rep"), "bucket-lists")
    own = materialize(owners(tiled(ended).join(lists, "rep")), "owners")
    places = own.groupBy("rep").agg(F.collect_set(F.struct("bucket", "unit", "tile", "across")).alias("places"))
    members = classes.select("rep", "owner", "digest", "copies").join(lists.select("rep", "buckets"), "rep").join(places, "rep")
    sets = token_sets(docs, members)
    return sets.withColumn("place", F.explode("places")).select("place.*", "rep", "copies", "buckets", "tokens"), [ended, lists, own]


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text_hash, class_id (least doc_id of the class), n_links (other documents at or over the threshold), label (the class itself; null for rows without shingles or doc_id, each a class of its own)."""
    signatures = materialize(signed(docs), "signatures")
    usable = signatures.where("size > 0 and doc_id is not null")
    # A class is named by its digest's hash, as one doc_id may stand for several texts.
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("rep", F.xxhash64("digest")), "classes")
    units, made = candidates(docs, classes, threshold, recall)
    found = materialize(checked(units, threshold), "links")
    discard(*made)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("v", "rep")
    known = classes.select("digest", "rep", "owner", "copies").join(linked, "rep", "left").join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    known = materialize(known.select("digest", "label", "owner", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    discard(classes, found)
    known = known.drop("owner").join(known.groupBy("label").agg(F.min("owner").alias("class_id")), "label")
    rows = usable.select("doc_id", "text_hash", "digest").join(known, "digest").select("doc_id", "text_hash", "class_id", "n_links", "label")
    rest = signatures.where("size = 0 or doc_id is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("label"))
    return rows.union(rest)


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One document of each class: the least doc_id, of equal ids the least hash of the text, of equal rows any. Null ids stay."""
    # Classes of different texts may share a class_id, where one doc_id stands for several.
    alone = F.when(F.col("label").isNull(), F.struct("doc_id", "text_hash"))
    kept = classes.groupBy("label", alone.alias("_alone")).agg(F.min(F.struct("doc_id", "text_hash")).alias("_k")).select("_k.doc_id", F.col("_k.text_hash").alias("_text_hash"))
    rows = docs.where("doc_id is not null").withColumn("_text_hash", F.xxhash64("text"))
    one = rows.join(kept, ["doc_id", "_text_hash"]).dropDuplicates(["doc_id", "_text_hash"]).select(*docs.columns)
    return one.union(docs.where("doc_id is null"))
