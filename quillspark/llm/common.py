"""What the operators share: reading tables, cutting lineage in the shared folder, joins with hot keys, stable splits and counts of words."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import ship
from quillspark.storage import new_path, shared_dir, written

__all__ = ["GAP", "WORD", "crc_mod", "cut", "join_hot", "n_words", "new_path", "resident", "shared_dir", "ship", "table", "words_of"]
T = TypeVar("T")

#: Fixed values of the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RESIDENT: dict[object, object] = {}


def resident(key: object, build: Callable[[], T]) -> T:
    """What a worker keeps between tasks: one large object at a time, so stages that follow one another don't add up."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    return written(df, name)


#: A key is hot if it has more than one in so many of all rows; there are fewer hot keys than this.
HOT = 1000


def join_hot(rows: DataFrame, named: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with named, which has each key of rows once and in `n` how many rows have it; rows of hot keys stay where they are and meet the fewer than HOT hot keys by broadcast, so no key is a hot spot of the shuffle."""
    total = named.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = named.where(F.col(n) * HOT > total).drop(n)
    rest = named.where(F.col(n) * HOT <= total).drop(n)
    near = rows.join(F.broadcast(hot), key)
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, GAP), "")).cast("long"), F.lit(0).cast("long"))


def words_of(text: Column) -> Column:
    """The words in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
