"""Cleaning, tokens, normalised names, phrases: pure Column functions, no Python UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker patterns and word lists of the source data's language.
TEMPERATURE = r"(?U)(?:\(?\s*(?:ICE|HOT|아이스|핫|따뜻한|차가운)\s*\)?)"
OPTION = r"(?U)(?:샷\s*추가|연하게|휘핑\s*추가|시럽\s*추가|디카페인|무설탕|저당|1\s*\+\s*1|리필)"
QUANTITY = r"(?U)(?:\d+\s*(?:ml|ML|oz|OZ|g|G|개|잔|인분))"
SIZE = r"(?U)(?:^|\s)(?:\(?\s*(?:[LRSML]|라지|톨|그란데|벤티|숏|레귤러|스몰|미디움|라rge)\s*\)?)(?=\s|$)"
PUNCTUATION = r"""[\[\](){}<>/,+_*·•\-–—~!?"'`]"""
PARTICLE = r"(?:은|는|이|가|을|를|의|에|에서|으로|로|와|과|도|만|까지|부터)$"
BAN_WORDS = ("먹방", "만들기", "레시피", "리뷰", "정보", "도전", "쇼츠", "타이틀", "브이로그")
COMMON_WORDS = ("초코", "케이크", "우유", "빵", "쿠키", "디저트", "치즈", "도넛", "음료")
BAN_ENDING = " 디저트"


def blank_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, "[/,+]", " ")


def tokens(text: Column, drop_empty: bool = False) -> Column:
    """Lower-cased words, split at each single white-space character; empty tokens stay unless dropped, but not at the end."""
    lower = F.lower(text)
    words = F.split(lower, r"\s")
    if drop_empty:
        return F.filter(words, lambda w: w != "")
    # Trailing empty words vanish; an empty text is one empty word.
    full = F.regexp_replace(lower, r"\s+$", "")
    return F.when(lower == "", F.array(F.lit(""))).when(full == "", F.array().cast("array<string>")).otherwise(F.split(full, r"\s"))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n neighbouring words, joined by a blank; none if there are fewer words."""
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, 1, many)
    for k in range(2, n + 1):  # zipped, as a lambda that indexes the words would build them anew for each run
        out = F.zip_with(out, F.slice(words, k, many), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def terms(text: Column, drop_empty: bool = False) -> Column:
    """Distinct words and word pairs in order of first sight."""
    words = tokens(text, drop_empty)
    return F.array_union(words, ngrams(words, 2))


def strip_markers(text: Column, bounded_markers: bool = False) -> Column:
    """Without temperature, option, quantity and size marks and punctuation; blanks collapsed.

    Temperature marks go inside words too, as the data's producers do;
    ``bounded_markers`` takes them as whole tokens only.
    """
    temperature = rf"{TEMPERATURE}(?=\s|$)".replace("(?U)", r"(?U)(?:^|(?<=\s))", 1) if bounded_markers else TEMPERATURE
    out = F.coalesce(text, F.lit(""))
    for pattern in (temperature, OPTION, QUANTITY, SIZE, PUNCTUATION):
        out = F.regexp_replace(out, pattern, " ")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\s+", " "), r"^ | $", "")


def nouns(text: Column) -> Column:
    """Approximate nouns: one trailing particle off, letters and digits only, two characters or more."""
    words = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, PARTICLE, ""), "[^0-9A-Za-z가-힣]", ""))
    return F.filter(words, lambda w: F.length(w) >= 2)


def normal_key(text: Column, bounded_markers: bool = False, analyzer: Callable[[Column], Column] = nouns) -> Column:
    """The join key of a name: its nouns, else the stripped text in lower case; '' for null or empty.

    ``analyzer`` gives the nouns of a text: a morphological one can be a pandas UDF; where it gives
    null, as for a text it fails on, the approximation stands in.
    """
    bare = strip_markers(text, bounded_markers)
    found = F.coalesce(analyzer(bare), nouns(bare))
    return F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.lower(bare))


def display_name(name: Column, value: Column) -> Column:
    """The name, else the value; null if both are empty."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(value, F.lit("")))


def prompt(question: Column, candidates: Column, ingredient: Column, heads: tuple[str, str], feedback: Column | None = None) -> Column:
    """A request for recommendations: the head of the route with the question at ``{}``, a bullet for each candidate, the answer's form, and what was wrong before."""
    head = F.when(ingredient, F.replace(F.lit(heads[0]), F.lit("{}"), question)).otherwise(F.replace(F.lit(heads[1]), F.lit("{}"), question))
    bullets = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("- "), c)), "\n")
    asked = F.concat(head, F.lit("\n\n"), bullets, F.lit('\n\n[{"name": "", "description": ""}]'))
    return asked if feedback is None else F.concat(asked, F.when(feedback.isNotNull(), F.concat(F.lit("\n\n"), feedback)).otherwise(F.lit("")))


def banned(phrase: Column) -> Column:
    return phrase.isin(*COMMON_WORDS) | phrase.rlike("|".join(BAN_WORDS)) | phrase.endswith(BAN_ENDING) | (F.length(F.trim(phrase)) <= 1)


def priority(phrase: Column, weight: Column) -> Column:
    return F.when(phrase.contains(" "), weight * 1.5).otherwise(weight * 1.0)


def squashed(text: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def clean_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda t: F.length(t) > 1)))


def clean_related(related: Column, keyword: Column, most: int = 5) -> Column:
    """Trimmed, distinct, other than the keyword itself (compared before trimming), in order, the first few."""
    kept = F.filter(related, lambda r: (r != keyword) & (F.trim(r) != ""))
    return F.slice(F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.trim(x)))), 1, most)


def json_rescue(text: Column, schema: str) -> Column:
    """The text as JSON, else its first brace-to-brace stretch."""
    # What doesn't parse gives a struct of nulls, not null, so it is tested apart.
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)).otherwise(F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema))


def list_rescue(text: Column) -> Column:
    """A JSON array of strings, else the lines that are numbered."""
    numbered = F.regexp_extract_all(text, F.lit(r"(?m)\d+\.\s*(.+)$"), 1)
    return F.coalesce(F.from_json(text, "array<string>"), numbered)


def decode_label(text: Column) -> Column:
    """True, false, or null for blank and unknown labels."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("y", "yes", "1", "o", "예"), True).when(low.isin("n", "no", "0", "x", "아니오"), False)
