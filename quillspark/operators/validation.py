"""What makes a text unreliable: lost glyphs, broken equations. Reported, never repaired."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs of a lost glyph, in order.
GLYPHS = {
    "a Unicode replacement character": "\ufffd",
    "an empty box where a symbol (typically Ω) was": "□",
    "a backslash where a mathematical sign (typically ∴) was": r"\\(?![A-Za-z]{2,}|[{},;:!\\])",
    "'a' between two symbols, where ∝ was": r"\b[A-Z]\s+a\s+[A-Z]\b",
}


def glyph_loss(text: Column) -> Column:
    """The first sign of a lost glyph; null if there is none."""
    return reduce(lambda c, s: c.when(text.rlike(GLYPHS[s]), s), GLYPHS, F)


def page_glyph_loss(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, sign, excerpt): each sign once for a page, with the line where it first stands, 300 characters at most. pages: (document_id, page_number, text)."""
    found = []
    for sign, pattern in GLYPHS.items():
        before = F.get(F.split("text", pattern, 2), F.lit(0))
        rest = F.substring("text", F.length(before) + 1, F.length("text"))
        hit = F.regexp_extract(rest, f"^({pattern})", 1)
        line = F.concat(F.substring_index(before, "\n", -1), hit, F.substring_index(F.substring(rest, F.length(hit) + 1, F.length(rest)), "\n", 1))
        found.append(F.when(F.col("text").rlike(pattern), F.struct(F.lit(sign).alias("sign"), F.substring(F.trim(line), 1, 300).alias("excerpt"))))
    signs = F.filter(F.array(*found), lambda x: x.isNotNull())
    return pages.select("document_id", "page_number", F.explode(signs).alias("x")).select("document_id", "page_number", "x.*")


def equation_problem(expression: Column) -> Column:
    """Why an equation's text can't be presented as one, by the first of 16 reasons that holds; null if none does."""
    e = expression
    n = lambda x: F.length(e) - F.length(F.replace(e, F.lit(x), F.lit("")))
    lhs = F.substring_index(e, "=", 1)
    rhs = F.trim(F.when(e.contains("="), F.substring(e, F.length(lhs) + 2, F.length(e))).otherwise(F.lit("")))
    fraction = rhs.contains("/") | e.rlike(r"\\[dt]?frac\b")
    integral = rhs.contains("∫") | e.rlike(r"\\(?:i{1,3}nt|oint)\b")
    lone = rhs.rlike(r"(?<![A-Za-z])d[A-Za-zα-ω](?![A-Za-z])") & ~fraction & ~integral & ~lhs.rlike(r"^\s*d[A-Za-z]")
    return (
        F.when(glyph_loss(e).isNotNull(), F.concat(F.lit("contains "), glyph_loss(e)))
        .when(n("{") != n("}"), "unbalanced braces")
        .when(e.contains("=="), "two equality signs run together")
        .when(n("(") != n(")"), "unbalanced parentheses")
        .when(n("[") != n("]"), "unbalanced brackets")
        .when(e.contains("()"), "empty parentheses")
        .when(e.rlike(r"[+\-−–]\s+[+\-−–]"), "two operators in a row")
        .when(e.rlike(r"[.;]\s+[A-Z][a-z]{2,}\s"), "a sentence runs on")
        .when(rhs == "", "nothing on the right-hand side")
        .when(rhs.rlike(r"^[⋅×*/^]"), "the right-hand side opens with an operator")
        .when(rhs.rlike(r"[+\-−×*/^=.]\s*$"), "the right-hand side ends in an operator")
        .when(rhs.rlike(r"(?i)\b(?:and|or|where|then|with|of)\s*$"), "the line ends mid-clause")
        .when(lone, "a differential without a denominator or an integral sign")
        .when(rhs == "d", "the right-hand side is a lone d")
        .when(rhs.rlike(r"[A-Za-z]d\s+t\b") & ~fraction & ~integral, "a split differential without a denominator or an integral sign")
        .when(rhs.rlike(r"^[A-Z][a-z]{3,}$"), "the right-hand side is a single word")
    )
