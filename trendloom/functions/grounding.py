"""Checks of externally generated recommendations against their candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squashed

ITEM = "struct<name:string,description:string>"


def norm_all(candidates: Column) -> Column:
    return F.transform(F.filter(candidates, lambda c: c.isNotNull() & (c != "")), squashed)


def grounded_strict(name: Column, candidates: Column) -> Column:
    return F.array_contains(norm_all(candidates), squashed(name))


def grounded(name: Column, candidates: Column) -> Column:
    """A candidate that isn't empty is part of the name; no candidates: false."""
    n = squashed(name)
    return F.exists(norm_all(candidates), lambda c: (c != "") & F.contains(n, c))


def strip_fence(text: Column) -> Column:
    """Without a surrounding ``` fence, which may be unclosed and may carry an alphabetic tag on its first line."""
    bare = F.trim(text)
    body = F.substring(bare, F.lit(4), F.length(bare))
    body = F.regexp_replace(body, r"(?s)\A[ \t]*\p{L}+[ \t]*\n", "")
    return F.when(bare.startswith("```"), F.regexp_replace(body, r"(?s)```(?!.*```).*\z", "")).otherwise(text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def parsed(text: Column) -> Column:
    """VARIANT of the text without its fence; null if it isn't JSON."""
    return F.try_parse_json(strip_fence(text))


def named(v: Column) -> Column:
    """The names of a parsed answer's items: array<string>, null elements where an item has none; null if it isn't a list."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.transform(items, lambda i: F.when(F.schema_of_variant(i).startswith("OBJECT"), F.nullif(F.try_variant_get(i, "$.name", "string"), F.lit(""))))


def names_of(text: Column) -> Column:
    return let(parsed(text), named)


def read(text: Column) -> Column:
    """struct<kind, names> of an answer, parsed once; kind is null if it isn't JSON."""
    return let(parsed(text), lambda v: F.struct(F.schema_of_variant(v).alias("kind"), named(v).alias("names")))


def no_list(p: Column) -> Column:
    return ~p["kind"].startswith("ARRAY") | (F.coalesce(F.size(p["names"]), F.lit(0)) <= 0)


def nameless(p: Column) -> Column:
    return F.exists(p["names"], lambda n: n.isNull())


def validation(text: Column, candidates: Column) -> Column:
    """'ok' or the first reason: json_parse_error, not_a_list, missing_name_field, ungrounded:<three names at most>."""

    def reason(p: Column) -> Column:
        loose = let(F.filter(p["names"], lambda n: ~grounded(n, candidates)), lambda xs: F.when(F.size(xs) > 0, F.concat(F.lit("ungrounded:"), F.array_join(F.slice(xs, 1, 3), ","))).otherwise("ok"))
        return F.when(p["kind"].isNull(), F.lit("json_parse_error")).when(no_list(p), F.lit("not_a_list")).when(nameless(p), F.lit("missing_name_field")).otherwise(loose)

    return let(read(text), reason)


def skip_reason(text: Column, candidates: Column) -> Column:
    """Why an answer isn't counted: absent, prose, not_list, item_without_name, no_candidates; 'ok' if it is."""
    none = F.coalesce(F.size(candidates), F.lit(0)) <= 0
    why = lambda p: F.when(p["kind"].isNull(), F.lit("prose")).when(no_list(p), F.lit("not_list")).when(nameless(p), F.lit("item_without_name")).when(none, F.lit("no_candidates")).otherwise(F.lit("ok"))
    return F.when(text.isNull(), F.lit("absent")).otherwise(let(read(text), why))


def answer_items(answer: Column) -> Column:
    """A JSON answer as items; what doesn't parse is one [FORMAT ERROR] item with the raw text."""
    failed = F.array(F.struct(F.lit("[FORMAT ERROR]").alias("name"), answer.alias("description")))
    return F.when(F.try_parse_json(answer).isNull(), failed).otherwise(F.from_json(answer, f"array<{ITEM}>"))
