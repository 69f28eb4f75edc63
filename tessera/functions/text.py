"""Text expressions: all native, so they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not indexed.
STOPWORDS = ("the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "is", "are", "be", "as", "that", "this", "these", "those", "with", "by", "at", "from", "it", "its", "we", "they", "you")
#: Beginnings that a heading's concept does not include.
CONCEPT_PREFIXES = ("what is ", "what is the ", "definition of ", "introduction to ", "overview of ")


def tokens(text: Column) -> Column:
    """Lower-case words of [a-z0-9_] longer than two characters that are no stopwords, in order; null text has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's variable is not evaluated again where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def first_of(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def slug(text: Column, empty: str = "core") -> Column:
    """Lower-case; runs outside [a-z0-9] become one hyphen; at most 80 characters without hyphens at the ends."""
    dashed = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80), "-+$", "")
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def topic_key(subject: Column, topic: Column, empty: str = "core") -> Column:
    return F.concat(subject, F.lit(":"), slug(topic, empty))


def display_name(key: Column) -> Column:
    """The tail of a topic key in title case, with hyphens and underscores as spaces."""
    return F.initcap(F.translate(F.element_at(F.split(key, ":"), -1), "-_", "  "))


def last_header(path: Column) -> Column:
    return F.trim(F.element_at(F.split(path, ">"), -1))


def main_concept(path: Column) -> Column:
    """The last heading without leading numbering and without the first matching prefix."""
    segment = F.regexp_replace(last_header(path), r"^[0-9.\s]+", "")
    low = F.lower(segment)
    return F.trim(first_of(*((F.startswith(low, F.lit(p)), F.substr(segment, F.lit(len(p) + 1))) for p in CONCEPT_PREFIXES), otherwise=segment))


def snippet(text: Column, n: int, more: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(more))).otherwise(text)


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
