"""The normal form of a text with the raw characters that each of its characters comes from."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillspark.functions.text import fold
from quillspark.session import ship

Aligned = tuple[str, list[int], list[int]]


def _apart(held: str, c: str) -> bool:
    """Whether NFKC treats c by itself after what is held."""
    nfkc = lambda x: unicodedata.normalize("NFKC", x)
    return not unicodedata.combining(c) and nfkc(held + c) == nfkc(held) + nfkc(c)


def aligned(raw: str | None) -> Aligned | None:
    """The normal form, and for each of its characters where the raw characters that gave it begin and end.

    Raw characters that are normalised together share a span: a letter with its marks, a ligature, jamo. White space
    that becomes one blank has the span of the run. None for texts without a normal form, and where the parts put
    together are not the whole text's normal form, so no place is ever claimed that isn't proved.
    """
    if raw is None or not raw.strip():
        return None
    out: list[str] = []
    begins: list[int] = []
    ends: list[int] = []
    at, n = 0, len(raw)
    while at < n:
        end = at + 1
        if raw[at] >= "\x80" or end < n and raw[end] >= "\x80":
            while end < n and not _apart(raw[at:end], raw[end]):
                end += 1
        for c in unicodedata.normalize("NFKC", raw[at:end]).casefold():
            if not c.isspace():
                out.append(c)
                begins.append(at)
                ends.append(end)
            elif out and out[-1] == " ":
                ends[-1] = end
            elif out:
                out.append(" ")
                begins.append(at)
                ends.append(end)
        at = end
    if out and out[-1] == " ":
        out.pop(), begins.pop(), ends.pop()
    text = "".join(out)
    return (text, begins, ends) if text == fold(raw) else None


def with_alignment(rows: DataFrame, column: str) -> DataFrame:
    """rows with norm, begins and ends of a text column; all three null where the text has no proved alignment."""
    ship(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [aligned(t) or (None, None, None) for t in b.column(names.index(column)).to_pylist()]
            more = [pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "norm", "begins", "ends"])

    places = ArrayType(IntegerType())
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("norm", StringType()), StructField("begins", places), StructField("ends", places)]))
