"""Identifiers: a prefix, a dash and a counter of eight digits or more. Order is by counter, never by string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^[A-Z]{1,4}-[0-9]{8,}$"


def format_id(prefix: str, number: Column) -> Column:
    """prefix-00000042; counters beyond eight digits keep all their digits."""
    n = number.cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(n) >= 8, n).otherwise(F.lpad(n, 8, "0")))


def counter(identifier: Column | str) -> Column:
    """The number of an identifier; null for anything that is not one."""
    c = F.col(identifier) if isinstance(identifier, str) else identifier
    return F.when(c.rlike(PATTERN), F.substring_index(c, "-", -1).cast("long"))


def is_id(identifier: Column, prefix: str | None = None) -> Column:
    ok = identifier.rlike(PATTERN)
    return ok & identifier.startswith(prefix + "-") if prefix else ok


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair in its stored order, which is string order."""
    return F.least(a, b), F.greatest(a, b)


def next_ids(prefix: str, last: Column, rank: Column) -> Column:
    """Identifiers after `last`, by a rank that counts from 1 in a deterministic order."""
    return format_id(prefix, F.coalesce(last, F.lit(0)) + rank)
