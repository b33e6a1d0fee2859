"""Text as columns: normalised forms, names, labels, quality.

`normalised` is the one form in which texts are compared: NFKC, case folded, white space collapsed and trimmed. Spark has
no Unicode normalisation or case folding, so it runs in Arrow batches where a text is not ASCII; ASCII texts stay in
the JVM, where lower case and collapsed blanks give the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that are never a concept, openings that are no noun phrase.
STOP_TERMS = (
    "example solution note remark figure table answer given sol hence therefore where here thus so proof case step let now then for from "
    "this that these those it we they there which what the a an is are and or of in on to such same above below following"
).split() + ["circuit shown", "network shown", "figure shown"]
PREPOSITIONS = "in on at of by to for from with into as under between".split()
BLANKS = r"(?U)\s+"


def fold(text: str) -> str:
    """NFKC, case folded, white space collapsed and trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


def collapse(text: Column) -> Column:
    """White space of any kind as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def normalised_ascii(text: Column) -> Column:
    """The normal form of ASCII texts, within the JVM; null for others."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.trim(F.regexp_replace(F.lower(text), r"[\x09-\x0D\x1C-\x1F ]+", " ")))


def normalised(text: Column) -> Column:
    """The one normal form that names and statements are compared in: NFKC, case folded, white space collapsed. Only texts that are not ASCII leave the JVM."""
    return F.coalesce(normalised_ascii(text), _fold(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)))


def alpha_ratio(text: Column) -> Column:
    """Letters over characters; 0 for the empty text."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(text)), F.lit(0.0))


def page_quality(text: Column) -> Column:
    """struct(origin, reason): a page is usable if it has 24 characters and over a third letters and digits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    ratio = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]+", "")) / F.length(t)
    reason = F.when(F.length(t) == 0, "empty").when(F.length(t) < 24, "too short").when(ratio < 0.35, "too few letters and digits")
    return F.struct(F.when(reason.isNull(), "NATIVE_TEXT").otherwise("UNKNOWN").alias("origin"), reason.alias("reason"))


def concept_name(text: Column) -> Column:
    """A noun phrase without leading junk, discourse marker and article, its first letter upper-case."""
    t = collapse(text)
    t = F.regexp_replace(t, r"^[^\p{L}\p{N}(]+", "")
    t = F.regexp_replace(t, r"(?i)^(?:hence|thus|therefore|so|now|here|then|also|similarly|moreover|however)\s*,?\s+", "")
    t = F.regexp_replace(t, r"(?i)^(?:an?|the)\s+", "")
    t = F.regexp_replace(t, r"[\s,;:.]+$", "")
    return let(t, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_term(text: Column) -> Column:
    """A concept name, or null where it can't be one: 2 to 46 characters, at most 6 words, a letter, no stop term, no preposition first."""

    def checked(t: Column) -> Column:
        spaces = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
        ok = F.length(t).between(2, 46) & (spaces <= 5) & ~F.lower(t).isin(STOP_TERMS) & ~F.lower(F.substring_index(t, " ", 1)).isin(PREPOSITIONS) & t.rlike(r"\p{L}")
        return F.when(ok, t)

    return let(concept_name(text), checked)


def label(prefix: str, text: Column, limit: int = 60) -> Column:
    """`prefix: text…`, cut at `limit` characters."""
    flat = collapse(text)
    return F.concat(F.lit(prefix + ": "), F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("…"))))


def singular(name: Column) -> Column:
    """The regular English singular of the last word; null where there is none."""
    return (
        F.when((F.length(F.substring_index(name, " ", -1)) < 4) | name.rlike("(?:ss|us|is)$"), F.lit(None))
        .when(name.rlike("ies$"), F.regexp_replace(name, "ies$", "y"))
        .when(name.rlike("(?:ss|sh|ch|x|z)es$"), F.regexp_replace(name, "es$", ""))
        .when(name.rlike("s$"), F.regexp_replace(name, "s$", ""))
    )


def name_key(text: Column) -> Column:
    """Lower-case, collapsed, without punctuation and leading article."""
    t = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]+", " ")
    return F.regexp_replace(collapse(t), r"^(?:an?|the)\s+", "")


def passages(text: Column, term: Column, limit: int = 3, size: int = 240) -> Column:
    """The first sentences or lines that contain a term, each once, trimmed to `size` characters."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), collapse)
    return F.slice(F.array_distinct(F.transform(F.filter(parts, lambda p: F.contains(F.lower(p), F.lower(term))), lambda p: F.substring(p, 1, size))), 1, limit)
