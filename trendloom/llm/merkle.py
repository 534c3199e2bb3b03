"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, a proof for each row.

A leaf is the SHA-256 of a row's fields. Within a group leaves are in the order of their key, and
``arity`` consecutive nodes (the last run: fewer) become the node above until one is left, the group's
subroot; subroots make the tree of the whole in the same way.

``Forest`` is the monoid: unresolved nodes by (tree, level, run). As a group's number of leaves is known,
so is the size of each run; a run that is whole becomes the node above at once. Merging is adding the nodes of
one forest to another, associative and commutative, with the empty forest as its zero.

Rows are dealt out by (group, key) range, so that a group may be as large as the table. Each part
folds its own rows in order, holding a path at a time, and writes the runs that it completes;
what it can't complete are the nodes at its two ends, a few for each level. ``treeReduce``
merges those fragments to the root. The runs that it completes come with it: at most two for each level and part, with
``MOST_PARTS`` parts at the most, so their number doesn't grow with the rows (some ten MB at the limit).
Proofs go the other way: runs, each before what is under it, and leaves pass in
order, and a leaf's proof is read off the runs above it.

Defined results: a null field counts as ``-``; null groups come first, null keys first within a group;
rows of equal keys are ordered by leaf; repeated rows are leaves of their own, with
proofs of their own; the text is hashed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, parts_for

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves of a part as long as there are fewer parts than MOST_PARTS, beyond which parts grow; a part passes through in order and isn't held.
PART_LEAVES, MOST_PARTS = 16384, 4096
TOP = -1
#: part: the one that holds it; trees below TOP are numbered by the order of groups.
RUNS = "part int, is_run boolean, tree long, width long, level int, at long, lo int, hi int, kids array<binary>"
PROOF = "array<struct<at:int,siblings:array<string>>>"


def leaf_of(fields: dict[str, Column]) -> Column:
    """SHA-256, as hex text, of the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(said, fields.values())).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to: at each level the node takes its place among its siblings."""

    def up(node: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.array_join(F.slice(step["siblings"], F.lit(1), step["at"]), ""), node, F.array_join(F.slice(step["siblings"], step["at"] + 1, F.size(step["siblings"])), "")).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """A proof's digests, level by level and left to right, as one text."""
    return F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "")


def above(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


@dataclass
class Forest:
    """Unresolved nodes of a tree of trees, and the runs completed since ``closed`` was last emptied."""

    trees: int
    arity: int = ARITY
    #: (tree, level, run) -> place -> (digest, first part, last part, leaves of the tree)
    open: dict[tuple[int, int, int], dict[int, tuple[bytes, int, int, int]]] = field(default_factory=dict)
    closed: list[tuple] = field(default_factory=list)
    top: tuple | None = None

    def add(self, tree: int, width: int, level: int, at: int, digest: bytes, lo: int, hi: int) -> None:
        """A node; ``width`` is its tree's number of leaves. Completed runs go up as far as they can."""
        while True:
            here = -(-width // self.arity**level)
            if here == 1:
                if tree == TOP:
                    self.top = (TOP, width, level, at, digest, lo, hi)
                    return
                tree, width, level, at = TOP, self.trees, 0, tree
                continue
            run = at // self.arity
            kids = self.open.setdefault((tree, level, run), {})
            kids[at] = (digest, lo, hi, width)
            if len(kids) < min(self.arity, here - run * self.arity):
                return
            del self.open[tree, level, run]
            digests = [kids[k][0] for k in sorted(kids)]
            level, at, digest = level + 1, run, above(digests)
            lo, hi = min(k[1] for k in kids.values()), max(k[2] for k in kids.values())
            self.closed.append((tree, width, level, at, lo, hi, digests))

    def nodes(self) -> Iterator[tuple]:
        """What ``add`` takes: the unresolved nodes, or the root alone."""
        if self.top:
            yield self.top
        for (tree, level, _), kids in self.open.items():
            for at, (digest, lo, hi, width) in kids.items():
                yield tree, width, level, at, digest, lo, hi

    def merge(self, other: Forest) -> Forest:
        self.closed += other.closed
        for node in other.nodes():
            self.add(*node)
        return self


def placed(leaves: DataFrame, part_leaves: int) -> tuple[DataFrame, int]:
    """leaves(_key, key, leaf, ...) -> + part, tree, width (leaves of the tree), place (in the tree), and the number of trees.

    Places come from counts of each (part, group): what a part needs of the others is one row for each of its groups.
    """
    parts = min(MOST_PARTS, parts_for(leaves.count(), part_leaves))
    order = [F.col("_key"), F.asc_nulls_first("key"), F.col("leaf"), F.col("_row")]
    dealt = materialize(leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "merkle-dealt")
    sizes = materialize(dealt.groupBy("part", "_key").agg(F.count("*").alias("_held")), "merkle-sizes")
    own = W.partitionBy("_key")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_held").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "width": F.sum("_held").over(own), "_first": F.min("part").over(own)})
    # A group's number: the groups that begin in parts before its first one, then its place among those that begin there.
    begun = sizes.where("part = _first").groupBy("_first").agg(F.count("*").alias("_n"))
    begun = begun.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    first = sizes.where("part = _first").withColumn("_nth", F.row_number().over(W.partitionBy("_first").orderBy("_key")) - 1)
    numbered = first.join(begun.select("_first", "_base"), "_first").select("_key", (F.col("_base") + F.col("_nth")).alias("tree"))
    sizes = materialize(sizes.join(numbered, "_key").select("part", "_key", "tree", "width", "_before"), "merkle-places")
    at = F.row_number().over(W.partitionBy("part", "_key").orderBy(*order[1:])) - 1
    out = materialize(dealt.join(sizes, ["part", "_key"]).withColumn("place", F.col("_before") + at).drop("_before", "_row"), "merkle-leaves")
    trees = sizes.agg(F.coalesce(F.max("tree") + 1, F.lit(0))).first()[0]
    discard(dealt, sizes)
    return out, trees


def fold(leaves: DataFrame, trees: int, arity: int) -> DataFrame:
    """placed leaves -> RUNS: the runs that each part completes, and its unresolved nodes (whose digest is the only one of ``kids``)."""
    names = RUNS.replace("boolean", "bool").split(", ")
    kinds = {n.split()[0]: n.split()[1] for n in names}
    arrow = {"int": pa.int32(), "long": pa.int64(), "bool": pa.bool_(), "array<binary>": pa.list_(pa.binary())}

    def rows(part: int, runs: list[tuple], nodes: list[tuple]) -> pa.RecordBatch:
        every = [(part, True, *r) for r in runs] + [(part, False, t, w, lv, at, lo, hi, [d]) for t, w, lv, at, d, lo, hi in nodes]
        return pa.record_batch([pa.array([r[i] for r in every], arrow[k]) for i, k in enumerate(kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now = Forest(trees, arity), None
        for batch in batches:
            for part, tree, width, place, leaf in zip(*(batch[c].to_pylist() for c in ("part", "tree", "width", "place", "leaf"))):
                if part != now:
                    if now is not None:
                        yield rows(now, forest.closed, list(forest.nodes()))
                    forest, now = Forest(trees, arity), part
                forest.add(tree, width, 0, place, leaf, part, part)
            if now is not None and forest.closed:
                yield rows(now, forest.closed, [])
                forest.closed = []
        if now is not None:
            yield rows(now, [], list(forest.nodes()))

    ordered = leaves.select("part", "tree", "width", "place", "leaf").repartition("part").sortWithinPartitions("part", "tree", "place")
    return materialize(ordered.mapInArrow(run, RUNS), "merkle-runs")


def reduced(runs: DataFrame, trees: int, arity: int) -> Forest:
    """Fragments of all parts merged by a tree of merges: the root, and the runs that no part could complete alone."""

    def fragment(rows: Iterator) -> Iterator[Forest]:
        forest = Forest(trees, arity)
        for r in rows:
            forest.add(r.tree, r.width, r.level, r.at, bytes(r.kids[0]), r.lo, r.hi)
        yield forest

    return runs.where("not is_run").rdd.mapPartitions(fragment).treeReduce(lambda a, b: a.merge(b))


def proofs(leaves: DataFrame, runs: DataFrame, straddling: DataFrame, root: str, arity: int) -> DataFrame:
    """(key, leaf, other, subroot, root, proof) of each leaf: runs and leaves of a part pass in order, each run before what is under it."""
    level, first = F.col("level"), F.col("at") * F.pow(F.lit(arity), F.col("level")).cast("long")
    top = F.col("tree") == TOP
    spread = straddling.withColumn("part", F.explode(F.sequence("lo", "hi")))
    kept = runs.where("is_run").drop("is_run").unionByName(spread.select("part", "tree", "width", "level", "at", "lo", "hi", "kids"))
    kept = kept.select("part", F.when(top, first).otherwise(F.col("tree")).alias("_tree"), F.when(top, 0).otherwise(1).alias("_below"), F.when(top, 0).otherwise(first).alias("_from"), (-level).alias("_up"), "at", "kids", F.lit(0).cast("long").alias("width"))
    none = lambda kind: F.lit(None).cast(kind)
    own = leaves.schema
    kept = kept.select("*", none(own["key"].dataType).alias("key"), none("binary").alias("leaf"), none("binary").alias("other"))
    rows = leaves.select("part", F.col("tree").alias("_tree"), F.lit(1).alias("_below"), F.col("place").alias("_from"), F.lit(0).alias("_up"), F.col("place").alias("at"), none("array<binary>").alias("kids"), "width", "key", "leaf", "other")
    ordered = kept.unionByName(rows).repartition("part").sortWithinPartitions("part", "_tree", "_below", "_from", "_up")
    proof_type = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))]))

    def steps(at: int, width: int, held: dict[int, list[str]]) -> list[dict]:
        out, lv = [], 0
        while width > 1:
            lv += 1
            kids, mine = held[lv], at % arity
            out.append({"at": mine, "siblings": kids[:mine] + kids[mine + 1 :]})
            at, width = at // arity, -(-width // arity)
        return out

    trees = leaves.agg(F.max("tree") + 1).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over: dict[int, list[str]] = {}
        under: dict[int, list[str]] = {}
        subroot = ""
        for batch in batches:
            cols = {c: batch[c].to_pylist() for c in ("_tree", "_below", "_up", "at", "kids", "width", "leaf")}
            places, found, subroots = [], [], []
            for i, kids in enumerate(cols["kids"]):
                if kids is not None:
                    lv = -cols["_up"][i]
                    (under if cols["_below"][i] else over)[lv] = [k.hex() for k in kids]
                    continue
                width, tree = cols["width"][i], cols["_tree"][i]
                depth, w = 0, width
                while w > 1:
                    depth, w = depth + 1, -(-w // arity)
                subroot = hashlib.sha256("".join(under[depth]).encode()).hexdigest() if depth else cols["leaf"][i].hex()
                places.append(i)
                subroots.append(subroot)
                found.append(steps(cols["at"][i], width, under) + steps(tree, trees, over))
            if places:
                at = pa.array(places)
                yield pa.record_batch([batch["key"].take(at), batch["leaf"].take(at), batch["other"].take(at), pa.array(subroots, pa.string()), pa.array([root] * len(places), pa.string()), pa.array(found, proof_type)], names=["key", "leaf", "other", "subroot", "root", "proof"])

    return ordered.mapInArrow(run, f"key {own['key'].dataType.simpleString()}, leaf binary, other binary, subroot string, root string, proof {PROOF}")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, arity: int = ARITY, part_leaves: int = PART_LEAVES) -> DataFrame:
    """docs -> key, leaf, subroot, root, proof and ``other``: the leaf of the row with ``tampered`` in place of its fields (the same leaf if none is).

    ``siblings`` gives a proof's digests as text and ``folded`` the root that a leaf and a proof lead to.
    """
    spark = docs.sparkSession
    own = {f: docs[f] for f in fields}
    leaf = leaf_of(own)
    other = leaf_of(own | tampered) if tampered else leaf
    # Null groups first, then by the bytes of their names.
    named = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))
    made = docs.select(named.alias("_key"), docs[key].alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("_o"))
    made = materialize(made.select("_key", "key", "leaf", F.when(F.col("_o") != F.col("leaf"), F.col("_o")).alias("other")), "merkle-rows")
    leaves, trees = placed(made, part_leaves)
    discard(made)
    text = lambda c: F.lower(F.hex(c))
    if trees == 0:
        return leaves.select(F.col("key").alias(key), text("leaf").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(PROOF).alias("proof"), text("other").alias("other"))
    runs = fold(leaves, trees, arity)
    forest = reduced(runs, trees, arity)
    shared = spark.createDataFrame([(t, w, lv, at, lo, hi, kids) for t, w, lv, at, lo, hi, kids in forest.closed], "tree long, width long, level int, at long, lo int, hi int, kids array<binary>")
    out = proofs(leaves, runs, shared, forest.top[4].hex(), arity)
    return out.select(F.col("key").alias(key), text("leaf").alias("leaf"), "subroot", "root", "proof", text(F.coalesce("other", "leaf")).alias("other"))


__all__ = ["Forest", "folded", "leaf_of", "manifest", "siblings"]
