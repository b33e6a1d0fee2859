"""SimHash near-duplicates: fingerprints are embedded as bit counts of segments and joined on a grid.

The embedding of a fingerprint is the vector of bit counts of its 32 two-bit segments. The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so pairs further apart than the radius can be
ruled out by counts alone. The vectors are kept in unary code (0: 00, 1: 01, 2: 11), in which Manhattan distance is the
number of differing bits and a block of coordinates is a bit mask.

Grid: the coordinates are split into `blocks` groups. Vectors at distance 2 or less agree on all groups but two, so
they share the cell of at least one choice of groups left out. Cells with few fingerprints give pairs, checked by
Manhattan and then by Hamming distance. Fuller cells (groups of near copies) are split by a finer grid: of the segments
left out, made into four parts, all parts but two must agree too, for each choice of two. Counts can't tell 01 from 10,
so a cell of the finer grid may still be full; the fingerprints there list the 65 values within one bit of them, and two
fingerprints within two bits always list a common value, which at most 65 different fingerprints can do.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, join_hot, ship
from quillspark.llm.components import connected_components

RADIUS = 2
SHINGLE = 3
#: Cells with more fingerprints than PAIRED_CELL are split further; cells of the finer grid with more than FINER_CELL are linked through common values.
PAIRED_CELL, FINER_CELL = 16, 64
#: Parts that the segments left out are split in by the finer grid.
FINER = 4
_EVEN = 0x5555555555555555
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash (unsigned) of the word shingles, repeats included; 0 if there is no word."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, h long, fp long): a hash of the text and the fingerprint, as signed 64-bit numbers, of each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(run, "doc_id long, h long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def counts_code(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary code."""
    even = F.lit(_EVEN)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(even), 1))


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _left(parts: list[list[int]]) -> list[tuple[list[int], int]]:
    """For each choice of RADIUS parts of segments left out: these segments, and the bits of all others as a signed number."""
    out = []
    for some in combinations(parts, RADIUS):
        free = [i for part in some for i in part]
        out.append((free, _signed(sum(3 << (2 * i) for i in range(32) if i not in free))))
    return out


def _parted(segments: list[int], n: int) -> list[list[int]]:
    edges = [round(len(segments) * i / n) for i in range(n + 1)]
    return [segments[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _masks(blocks: int) -> list[tuple[int, list[int]]]:
    """For each choice of RADIUS blocks left out, the bits that must agree; and the same for each choice of RADIUS of FINER parts of what is left out."""
    return [(mask, [m for _, m in _left(_parted(free, FINER))]) for free, mask in _left(_parted(list(range(32)), blocks))]


def blocks_for(n: int) -> int:
    """As many blocks as give a cell enough bits (1.5 for each two-bit segment) to tell n fingerprints apart, and four more."""
    need = max(n, 2).bit_length() + 4
    return next((b for b in (4, 5, 6, 8, 12) if 48 * (b - RADIUS) / b >= need), 12)


def _pairs(cells: DataFrame) -> DataFrame:
    """(u, v) of the fingerprints within RADIUS that share (g, cell), checked by their counts first."""
    a, b = cells.alias("a"), cells.alias("b")
    return (
        a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")))
        .where(F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code"))) <= RADIUS)
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    )


def _met(cells: DataFrame, name: str) -> DataFrame:
    """The cells that more than one fingerprint is in, each row with the number `n` of these."""
    full = cells.groupBy("g", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return cut(cells.join(full, ["g", "cell"]), name)


def links(nodes: DataFrame, blocks: int | None = None) -> DataFrame:
    """(u, v): rep values that connect all fingerprints within RADIUS bits. nodes: (fp, rep), each fp once."""
    code = counts_code(F.col("fp"))
    if blocks is None:
        blocks = blocks_for(nodes.count())
    masks = _masks(blocks)
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("g"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for i, (m, _) in enumerate(masks)))
    cells = nodes.withColumn("code", code).select("fp", "rep", "code", F.explode(keys).alias("k")).select("fp", "rep", "code", "k.g", "k.cell")
    met = _met(cells, "cells")
    finer = F.get(F.array(*(F.array(*map(F.lit, two)) for _, two in masks)), F.col("g").cast("int"))
    full = met.where(F.col("n") > PAIRED_CELL).select("fp", "rep", "code", F.explode(finer).alias("g")).distinct()
    split = _met(full.withColumn("cell", F.col("code").bitwiseAND(F.col("g"))), "finer-cells")
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    common = (
        split.where(F.col("n") > FINER_CELL).select("fp", "rep").distinct().select("rep", F.explode(flips).alias("value"))
        .groupBy("value").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
        .select(F.array_min("reps").alias("u"), F.explode("reps").alias("v"))
    )
    return _pairs(met.where(F.col("n") <= PAIRED_CELL)).union(_pairs(split.where(F.col("n") <= FINER_CELL))).union(common).where("u <> v")


def _named(fps: DataFrame) -> DataFrame:
    """(fp, n, component_id, keep_id, keep_h) of each fingerprint: its rows, the smallest doc_id of its component, and the row that stands for the component, which is the one with the smallest doc_id (null last) and then the smallest hash of its text."""
    nodes = cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")), "nodes")
    root = connected_components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    rooted = cut(nodes.join(root, nodes.fp == root.node, "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    roots = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.count("*").alias("times"))
    named = join_hot(rooted.select("fp", "n", "root"), roots, "root", "times")
    return cut(named.select("fp", "n", F.col("keep.doc_id").alias("component_id"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.h").alias("keep_h")), "named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: (doc_id, fp, component_id), component_id the smallest doc_id reachable over links.

    Empty and null texts have fingerprint zero and link like any other. Repeated rows and exact copies share a
    fingerprint and thus a component. A row without doc_id keeps its fingerprint and gets the component of what it
    links to, null if no row there has a doc_id. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs), "fingerprints")
    return join_hot(fps.select("doc_id", "fp"), _named(fps).select("fp", "n", "component_id"), "fp", "n").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component one row stays, that with the smallest doc_id, or with the smallest hash of its text where none has a doc_id; once if it is repeated.

    A doc_id with texts that are no near copies of one another stays with each of them. All columns stay as they are;
    an empty table stays empty.
    """
    keep = _named(cut(fingerprints(docs), "fingerprints")).select("keep_id", "keep_h").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("h"))
    kept = rows.join(keep, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")), "left_semi")
    return kept.dropDuplicates(["id", "h"]).select("row.*")
