r"""Secret scans with DataFrame functions only.

Three patterns are matched over whole texts, leftmost and non-overlapping, and
matches that are too short are dropped afterwards. Beyond them, candidate
strings (runs of 20 or more token characters that hold a digit) are scanned
with a sliding window: the Shannon entropy of a window is kept up to date by
adding the entering character's count and taking off the leaving one's, and the
stretch covered by windows whose entropy reaches the threshold of the string's
character class is a span. Counts are packed into whole numbers, so a step costs
the same whatever the candidate, and long candidates are scanned ``CHUNK`` windows at a
time, so memory is bounded by the text itself. Where patterns' spans, placeholders or a leading
repetition cut a candidate, what is left on either side is a candidate of its own,
without the separators at the cut. An allow-list suppresses UUIDs, labelled digests,
dates, versions and paths.

Positions come from the (gap, match) pairs of a text, whose lengths
are summed, ``GROUP`` matches at a time, so that the work follows the number of matches. The gap is
lazy and the pattern ends with an alternative for the end of the text. A pattern passes over a text once to see whether it
matches at all, and twice more, for pairs and gaps, if it does. What lies between spans is read from pieces of ``PIECE``
characters, so that no step counts characters from the text's start; spans of patterns are masked in a copy
of the text, from which each candidate learns what of it they cover. So scanning and redacting take time in
proportion to text and spans.

Defined results: null text is empty and has no spans; spans count code points,
end exclusive; added spans never overlap a pattern's span; the
result is a function of the text alone; other columns stay; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns' kinds in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]+)"
HEX = r"()([0-9a-f]{32,})"
#: A whole run of token characters that holds a digit, 20 or more of them.
CANDIDATE = r"((?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]))([A-Za-z0-9+/_=-]{20,})"

#: The characters of a candidate, by which counts are kept.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Windows of a candidate scanned together.
CHUNK = 4096
#: Counters to a whole number, and bits to a counter (a count is at most WINDOW).
FIELDS, BITS = 12, 5
#: Matches whose positions are summed together, and characters to a piece of a text.
GROUP, PIECE = 256, 4096
#: Fixed value: stands for masked characters; no token character.
MASK = "\x01"
#: Least entropy, in bits, of a window of 20 characters by class.
THRESHOLDS = {"hex": 2.9, "alnum": 3.6, "base64": 3.7}
#: Candidates that are no secrets, matched against the whole candidate. A last segment of letters and digits is bounded, so that no key passes as one.
#: Repeated groups are possessive: they are matched in a loop instead of by recursion, however long the candidate is.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]++",
    r"(?:[sS][hH][aA](?:1|224|256|384|512)|[mM][dD]5|[cC][oO][mM][mM][iI][tT]|[rR][eE][vV]|[eE][tT][aA][gG])[=_-](?:[0-9a-fA-F]{7,128}|[a-zA-Z0-9+/]{22}==|[a-zA-Z0-9+/]{27}=|[a-zA-Z0-9+/]{38}==|[a-zA-Z0-9+/]{43}=|[a-zA-Z0-9+/]{64}|[a-zA-Z0-9+/]{86}==)",
    r"(?:[A-Za-z]++[/_-])*+(?:[A-Za-z]++|(?<=[A-Za-z][/_-]))[0-9]{1,4}+(?:[/_-][A-Za-z]++)*+",
    r"/?(?:[a-z0-9_-]{1,12}+/){2,}+(?:[a-z0-9_-]{0,12}|(?:[a-z]{1,16}+[_-])*+(?:[a-z]{1,16}+|(?<=[a-z][_-]))[0-9]{0,4})",
    r"(?:[a-z]++[0-9]?+_)++(?:[a-z0-9]{1,12}|[a-z]{1,16}[0-9]{0,4})",
)
#: Stretches of a candidate that are no secrets; the rest of it is scanned.
FILLER = r"()(^(?<r>.{1,4})\k<r>{4,}|(?i:example|placeholder|changeme|dummy|sample|x{4,}|0{7,}|1234567))"


def segments(text: Column, pattern: str) -> Column:
    """array<struct<gap, hit>> over the text: hit is what the pattern matches and gap the text before; the last has an empty match."""
    whole = F.lit(rf"(?s)(.*?)(?:{pattern}|\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, whole, 0).alias("both"), F.regexp_extract_all(text, whole, 1).alias("gap"))
    return F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.substring(p["both"], F.length(p["gap"]) + 1, F.length(p["both"])).alias("hit")))


def groups(items: Column) -> Column:
    """The array in runs of GROUP elements, so that no step appends to an array of unbounded length."""
    one = F.array(F.struct(items.alias("all")))  # a field, which a lambda reads without evaluating it anew
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x["all"]) - 1) / GROUP).cast("int")), lambda k: F.slice(x["all"], k * GROUP + 1, F.lit(GROUP)))
    return F.element_at(F.transform(one, cut), 1)


def grouped(items: Column, width: Column, start: Column, add, kind: str) -> Column:
    """array<struct<parts, at>>: ``items`` in groups with the running value before each; ``width`` of a group's items and ``add`` give the next."""
    sized = F.transform(groups(items), lambda g: F.struct(g.alias("parts"), width(g).alias("width")))
    seed = F.struct(start.alias("at"), F.array().cast(f"array<struct<parts:array<{kind}>,at:int>>").alias("out"))
    step = lambda acc, g: F.struct(add(acc["at"], g["width"]).alias("at"), F.concat(acc["out"], F.array(F.struct(g["parts"].alias("parts"), acc["at"].alias("at")))).alias("out"))
    return F.aggregate(sized, seed, step, lambda acc: acc["out"])


def matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, body>> of the non-overlapping matches in order; body is all that matched."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>")
    width = lambda s: s["gap"] + F.length(s["hit"])

    def placed(run: Column) -> Column:
        seed = F.struct(run["at"].alias("at"), none.alias("found"))

        def step(acc: Column, s: Column) -> Column:
            start = acc["at"] + s["gap"]
            end = acc["at"] + width(s)
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), s["hit"].alias("body")))
            return F.struct(end.alias("at"), F.when(end > start, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(run["parts"], seed, step, lambda acc: acc["found"])

    # Each group's start first, from the groups' lengths; then the matches of each group.
    runs = grouped(segments(text, pattern), lambda g: F.aggregate(g, F.lit(0), lambda n, s: n + width(s)), F.lit(0), lambda at, w: at + w, "struct<gap:int,hit:string>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.flatten(F.transform(runs, placed))).otherwise(none)


def gaps(spans: Column, start: Column) -> Column:
    """array<struct<start, end>>: the stretch before each maximal run of overlapping or touching sorted spans, from ``start`` on (a span at ``start`` has an empty one)."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(run: Column) -> Column:
        seed = F.struct(run["at"].alias("at"), none.alias("out"))

        def step(acc: Column, s: Column) -> Column:
            one = F.array(F.struct(F.greatest(acc["at"], start).alias("start"), s["start"].alias("end")))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run["parts"], seed, step, lambda acc: acc["out"])

    bare = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    runs = grouped(bare, lambda g: F.array_max(F.transform(g, lambda s: s["end"])), start - 1, lambda at, top: F.greatest(at, top), "struct<start:int,end:int>")
    return F.when(F.size(spans) > 0, F.flatten(F.transform(runs, placed))).otherwise(none)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(held: Column, start: Column, end: Column) -> Column:
    """Characters start .. end of a text in pieces; only the pieces that they lie in are read."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    near = F.array_join(F.slice(held, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def filled(text: Column, spans: Column, mark) -> Column:
    """The text with each maximal stretch of overlapping or touching sorted spans replaced by ``mark(length)``."""
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    # Fields first: a lambda would evaluate an expression anew for each element.
    one = F.array(F.struct(pieces(text).alias("held"), gaps(spans, F.lit(0)).alias("gaps"), last.alias("last"), F.length(text).alias("n")))

    def whole(x: Column) -> Column:
        ends = F.concat(F.transform(F.slice(x["gaps"], F.lit(2), F.size(x["gaps"])), lambda g: g["start"]), F.array(x["last"]))
        parts = F.zip_with(x["gaps"], ends, lambda g, to: F.concat(between(x["held"], g["start"], g["end"]), mark(to - g["end"])))
        return F.concat(F.array_join(parts, ""), between(x["held"], x["last"], x["n"]))

    return F.when(F.size(spans) > 0, F.element_at(F.transform(one, whole), 1)).otherwise(text)


def entropy_span(body: Column, threshold: Column) -> Column:
    """struct<first, last>: the stretch of ``body`` that windows of at least the threshold cover; last is -1 if there is none.

    The entropy of a window is log2(WINDOW) - sum(c * log2(c)) / WINDOW over its
    characters' counts c. Counts and sum are updated for the entering and the
    leaving character; the sum is kept in whole millionths, so it can't drift.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(body) - WINDOW) / CHUNK).cast("int")))
    # The threshold becomes a field first: as an expression it would be evaluated for each character.
    chunks = F.transform(starts, lambda k: F.struct((k * CHUNK).alias("at"), threshold.alias("most"), F.substring(body, k * CHUNK + 1, F.lit(CHUNK + WINDOW - 1)).alias("body")))
    found = F.filter(F.transform(chunks, chunk_span), lambda s: s["last"] > 0)
    least = F.array_min(F.transform(found, lambda s: s["first"]))
    return F.struct(F.coalesce(least, F.lit(2**30)).alias("first"), F.coalesce(F.array_max(F.transform(found, lambda s: s["last"])), F.lit(-1)).alias("last"))


def chunk_span(chunk: Column) -> Column:
    """struct<first, last> of a stretch of a candidate, as positions in the candidate."""
    weigh = F.array(*[F.lit(weight(c)) for c in range(WINDOW + 1)])
    # A character's counter: the whole number it is in, its unit there, and the bits below it; no counter for the place before the first window.
    places = F.array(*[F.struct(F.lit(i // FIELDS if i >= 0 else -1).alias("word"), F.lit(1 << BITS * (i % FIELDS)).cast("long").alias("unit"), F.lit(BITS * (i % FIELDS)).alias("low")) for i in range(-1, len(ALPHABET))])
    codes = F.transform(F.filter(F.split(chunk["body"], ""), lambda ch: ch != ""), lambda ch: F.call_function("locate", ch, F.lit(ALPHABET)))
    # Zipped with itself shifted by a window; a lambda that indexed the codes would build them anew for each character.
    late = F.concat(F.array_repeat(F.lit(0), WINDOW), F.slice(codes, F.lit(1), F.greatest(F.length(chunk["body"]) - WINDOW, F.lit(0))))
    steps = F.zip_with(codes, late, lambda c, o: F.struct(F.get(places, c).alias("into"), F.get(places, o).alias("out"), (c != o).alias("moved")))
    none = F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // FIELDS))
    seed = F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"), F.lit(2**30).alias("first"), F.lit(-1).alias("last"))
    count = lambda acc, p: F.call_function("shiftright", F.get(acc["counts"], p["word"]), p["low"]).bitwiseAND(F.lit(2**BITS - 1)).cast("int")

    def slide(acc: Column, s: Column) -> Column:
        had, lost = count(acc, s["into"]), F.when(s["out"]["word"] >= 0, count(acc, s["out"])).otherwise(F.lit(0))
        change = F.get(weigh, had + 1) - F.get(weigh, had) - F.get(weigh, lost) + F.when(lost > 0, F.get(weigh, lost - 1)).otherwise(F.lit(0).cast("long"))
        total = F.when(s["moved"], acc["sum"] + change).otherwise(acc["sum"])
        unit = lambda p, i: F.when(p["word"] == i, p["unit"]).otherwise(F.lit(0).cast("long"))
        end = acc["end"] + 1
        hot = (end >= WINDOW) & (total <= chunk["most"])
        return F.struct(
            F.transform(acc["counts"], lambda c, i: c + unit(s["into"], i) - unit(s["out"], i)).alias("counts"),
            total.alias("sum"),
            end.alias("end"),
            F.when(hot, F.least(acc["first"], chunk["at"] + end - WINDOW)).otherwise(acc["first"]).alias("first"),
            F.when(hot, chunk["at"] + end).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(steps, seed, slide, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def weight(count: int) -> int:
    """count * log2(count) in whole millionths."""
    return round(1e6 * count * math.log2(count)) if count else 0


def most_sum(entropy: float) -> int:
    """The largest sum of ``weight`` over a window with at least that entropy."""
    return round(1e6 * WINDOW * (math.log2(WINDOW) - entropy))


def stretches(c: Column, cuts: Column) -> Column:
    """array<struct<start, end, body>>: what sorted ``cuts`` leave of a candidate, without the separators at a cut."""
    last = F.coalesce(F.array_max(F.transform(cuts, lambda s: s["end"])), c["start"])
    left = F.concat(gaps(cuts, c["start"]), F.array(F.struct(last.alias("start"), c["end"].alias("end"))))

    def trimmed(s: Column) -> Column:
        body = between(c["held"], s["start"] - c["start"], s["end"] - c["start"])
        front = F.when(s["start"] > c["start"], F.length(F.regexp_extract(body, r"^[+/_=-]*", 0))).otherwise(F.lit(0))
        back = F.when(s["end"] < c["end"], F.length(F.regexp_extract(body, r"(?<![+/_=-])[+/_=-]*$", 0))).otherwise(F.lit(0))
        return F.struct((s["start"] + front).alias("start"), (s["end"] - back).alias("end"), F.substring(body, front + 1, s["end"] - s["start"] - front - back).alias("body"))

    parts = F.transform(F.filter(left, lambda s: s["end"] - s["start"] >= WINDOW), trimmed)
    return F.filter(parts, lambda s: (F.length(s["body"]) >= WINDOW) & F.regexp_like(s["body"], F.lit("[0-9]")))


def entropy_spans(candidates: Column, base: Column, text: Column) -> Column:
    """Spans of kind entropy within what ``base`` and fillers leave of candidates, off the allow-list."""
    allowed = "^(?:" + "|".join(f"(?:{p})" for p in ALLOWED) + ")$"
    off = lambda c: F.regexp_like(c["body"], F.lit(allowed))

    def left(c: Column) -> Column:
        moved = lambda m: F.struct((m["start"] + c["start"]).alias("start"), (m["end"] + c["start"]).alias("end"))
        cuts = F.concat(F.transform(matches(c["masked"], f"(){MASK}+", 3), moved), F.transform(matches(c["body"], FILLER, 3), moved))
        one = F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), pieces(c["body"]).alias("held"), F.sort_array(cuts).alias("cuts")))
        return F.element_at(F.transform(one, lambda x: stretches(x, x["cuts"])), 1)

    # Each candidate beside the same stretch of the text in which base spans are masked.
    masked = F.array(F.struct(pieces(filled(text, base, lambda n: F.repeat(F.lit(MASK), n))).alias("held"), F.filter(candidates, lambda c: ~off(c)).alias("found")))
    beside = lambda x: F.transform(x["found"], lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["body"].alias("body"), between(x["held"], c["start"], c["end"]).alias("masked")))
    bare = F.transform(F.filter(candidates, lambda c: ~off(c)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["body"].alias("body"), c["body"].alias("masked")))
    found = F.when(F.size(base) > 0, F.element_at(F.transform(masked, beside), 1)).otherwise(bare)
    kept = F.filter(F.flatten(F.transform(found, left)), lambda c: ~off(c))

    def one(c: Column) -> Column:
        limit = F.when(F.regexp_like(c["body"], F.lit("^[0-9a-fA-F]+$")), most_sum(THRESHOLDS["hex"])).when(F.regexp_like(c["body"], F.lit("^[A-Za-z0-9]+$")), most_sum(THRESHOLDS["alnum"])).otherwise(most_sum(THRESHOLDS["base64"]))
        return F.struct(c["start"].alias("at"), entropy_span(c["body"], limit).alias("w"))

    spans = F.filter(F.transform(kept, one), lambda s: s["w"]["last"] > 0)
    return F.transform(spans, lambda s: F.struct((s["at"] + s["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (s["at"] + s["w"]["last"]).alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """docs(text, ...) -> + base, spans: array<struct<start:int, kind:int, end:int>> by start, then kind."""
    docs = docs.drop("base", "spans", "_text", "_a", "_k", "_h", "_c")  # columns of the result's names give way
    kept = docs.columns
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = df.withColumns({"_a": matches(F.col("_text"), ASSIGN, 0), "_k": matches(F.col("_text"), ACCESS, 1), "_h": matches(F.col("_text"), HEX, 2), "_c": matches(F.col("_text"), CANDIDATE, 3)})
    enough = F.concat(F.filter("_a", lambda m: F.length(F.regexp_extract(m["body"], ASSIGN, 2)) >= 8), F.filter("_k", lambda m: m["end"] - m["start"] >= 16), F.col("_h"))
    bare = F.transform(enough, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    df = df.withColumn("base", F.sort_array(bare))
    df = df.withColumn("spans", F.when(F.size("_c") > 0, F.sort_array(F.concat("base", entropy_spans(F.col("_c"), F.col("base"), F.col("_text"))))).otherwise(F.col("base")))
    return df.select(*kept, "base", "spans")


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each maximal stretch of overlapping or touching spans replaced by a mark."""
    return filled(text, spans, lambda n: F.lit(mark))
