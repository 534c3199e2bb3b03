"""Candidate phrases: weights, priorities, the whitelist, and the enrichment of kept ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import banned, clean_related, clean_tags, ngrams, nouns, priority
from ..schemas import SEASONS, combos, sentences
from ..session import cut, spread


def phrase_weights(keywords: DataFrame, analyzer=nouns, ban=banned) -> DataFrame:
    """keywords(keyword) -> (phrase, weight): over distinct unbanned keywords of two nouns or more, a noun counts 1 and a run of 2 or 3 counts 2."""
    parts = keywords.select("keyword").where(~ban(F.col("keyword"))).distinct().select(analyzer(F.col("keyword")).alias("n")).where(F.size("n") >= 2)
    one = F.transform("n", lambda x: F.struct(x.alias("phrase"), F.lit(1).alias("w")))
    many = F.transform(F.concat(ngrams(F.col("n"), 2), ngrams(F.col("n"), 3)), lambda x: F.struct(x.alias("phrase"), F.lit(2).alias("w")))
    return parts.select(F.explode(F.concat(one, many)).alias("p")).select("p.*").where(~ban(F.col("phrase"))).groupBy("phrase").agg(F.sum("w").alias("weight"))


def top_phrases(weights: DataFrame, top: int = 500) -> DataFrame:
    """The ``top`` phrases by priority (ties by phrase) with their rank; the rank window runs over ``top`` rows only."""
    cut = weights.withColumn("priority", priority(F.col("phrase"), F.col("weight"))).orderBy(F.desc("priority"), "phrase").limit(top)
    return cut.withColumn("rank", F.row_number().over(W.orderBy(F.desc("priority"), "phrase")))


def whitelist(picks: DataFrame, weights: DataFrame) -> DataFrame:
    """picks(pos, phrase) that have a weight, in the order picked."""
    return picks.join(weights, "phrase").select("pos", F.col("phrase").alias("keyword"), F.col("weight").alias("count"))


#: Characters of keywords to an automaton (some 100 bytes of it for each).
AUTOMATON_CHARS = 2 << 20


def automata(base: DataFrame, limit: int = AUTOMATON_CHARS) -> list[tuple[Column, int]]:
    """base(part, count, times) -> a condition on ``part`` and a number of characters for each automaton needed.

    Keywords are split by their first characters until each range of them has ``limit`` characters at the most;
    a range of keywords that share as many as they have is the one that may be larger.
    """
    out, open_ranges, depth = [], [F.lit(True)], 0
    while open_ranges:
        depth += 1
        head = F.substring("part", 1, depth)
        todo = []
        for within in open_ranges:
            sizes = base.where(within).groupBy(head.alias("head")).agg(F.sum(F.length("part")).alias("n"), F.max(F.length("part")).alias("longest")).orderBy("head")
            run, held = [], 0
            # As many rows as there are first characters beyond the ones shared so far.
            for r in sizes.toLocalIterator():
                if r["n"] > limit and r["longest"] > depth:
                    todo.append(within & (head == r["head"]))
                    continue
                if run and held + r["n"] > limit:
                    out.append((within & head.isin(run), held))
                    run, held = [], 0
                run.append(r["head"])
                held += r["n"]
            if run:
                out.append((within & head.isin(run), held))
        open_ranges = todo
    return out


def substring_matches(new: DataFrame, base: DataFrame, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """new(keyword, ...) + new_count and matched_parts of the base(keyword, count) keywords contained in each; a null keyword contains none, and the empty one is in none.

    The base keywords make a trie with failure links, through which a text passes once, however many keywords there
    are and however long its words. Keywords are counted first: they are fetched and broadcast in shares of ``limit`` characters at the most, by their
    first characters, and texts pass automaton by automaton; what one finds is a column that the next adds to.
    """
    spark = new.sparkSession
    b = cut(base.where("keyword <> ''").groupBy(F.col("keyword").alias("part")).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"), F.count("*").cast("int").alias("times")))
    names = [c for c in new.columns if c not in ("new_count", "matched_parts")]
    out = new.select(*names, F.lit(0).cast("long").alias("new_count"), F.array().cast("array<string>").alias("matched_parts"))
    schema = out.schema
    shares = automata(b, limit)
    for k, (within, _) in enumerate(shares):
        held = spark.sparkContext.broadcast([tuple(r) for r in b.where(within).select("part", "count", "times").toLocalIterator()])
        out = (spread(out) if k == 0 else cut(out)).mapInArrow(finder(held), schema)
    return out


def finder(held):
    """Adds to new_count and matched_parts of each row what the broadcast (part, count, times) rows find in its keyword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        trie, rows = ahocorasick.Automaton(), held.value
        for i, (part, _, _) in enumerate(rows):
            trie.add_word(part, i)
        trie.make_automaton()
        for batch in batches:
            counts, parts = [], []
            for text, n, before in zip(batch["keyword"], batch["new_count"].to_pylist(), batch["matched_parts"].to_pylist()):
                text = text.as_py()
                found = {i for _, i in trie.iter(text)} if text else ()
                counts.append(n + sum(rows[i][1] for i in found))
                parts.append(sorted([*before, *(rows[i][0] for i in found for _ in range(rows[i][2]))]) if found else before)
            columns = {"new_count": pa.array(counts, pa.int64()), "matched_parts": pa.array(parts, pa.list_(pa.string()))}
            yield pa.record_batch([columns[c] if c in columns else batch[c] for c in batch.schema.names], names=batch.schema.names)

    return run


def importance(counts: DataFrame, count: str = "count") -> DataFrame:
    """+ importance: the share of the largest count, 4 digits, half to even."""
    return counts.crossJoin(F.broadcast(counts.agg(F.max(count).alias("_top")))).withColumn("importance", F.bround(F.col(count) / F.nullif(F.col("_top"), F.lit(0)), 4)).drop("_top")


def enriched(rows: DataFrame) -> DataFrame:
    """Raw enrichment fields, cleaned: combos, two examples, tags, season within its domain, five related."""
    season: Column = F.when(F.col("season").isin(*SEASONS), F.col("season"))
    return importance(rows.withColumns({"combo": combos(F.col("combo")), "example": sentences(F.col("example")), "tag": clean_tags(F.col("tag")), "season": season, "related": clean_related(F.col("related"), F.col("keyword"))}))
