"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; only words under a 1 enter its hash, so words under a 0 may differ. The
hashes of all benchmark positions are joined with those of all document positions. Each hit names a diagonal (place in
the document less place in the item); on it, a stretch of the item around the hit is compared word by word with the
document, so substituted words are tolerated up to the threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

#: Fixed masks, each with the least and the most words of the items that it is used for (0: no limit). Items of fewer
#: words than the shortest spaced mask must occur whole; those of a few words more have closer masks besides.
MASKS = (
    ("111011", 6, 0), ("1101101", 7, 0), ("11001011", 8, 0), ("11011", 6, 9), ("1011", 6, 9), ("1101", 6, 9),
    ("11111", 5, 5), ("1111", 4, 4), ("111", 3, 3), ("11", 2, 2), ("1", 1, 1),
)
#: Words of an item that are compared around a hit (fewer in shorter items) and the share of them that must agree.
STRETCH = 20
THRESHOLD = 0.8
#: Benchmark hashes that are broadcast at once; a larger benchmark is joined in blocks of this size, each of which reads the documents again.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-case; an empty array for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(mask: str) -> Column:
    """Hash of the words under the mask from `pos` on; null where they reach past the last word."""
    under = [F.get("hashes", F.col("pos") + i) for i, x in enumerate(mask) if x == "1"]
    return F.when(F.get("hashes", F.col("pos") + (len(mask) - 1)).isNotNull(), F.xxhash64(F.lit(mask), *under))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, words(F.col("text")).alias("words")).select(key, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def used_masks(benchmark: DataFrame) -> list[int]:
    """The numbers of the masks that some item is long or short enough for."""
    n = F.size(words(F.col("text")))
    fits = [F.coalesce(F.max((n >= least) & ((n <= most) if most else F.lit(True))), F.lit(False)).alias(m) for m, least, most in MASKS]
    return [i for i, x in enumerate(benchmark.where("item_id is not null").agg(*fits).first()) if x]


def seeds(benchmark: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, seed, item_id, item_pos, size): the hashes of all positions of the items under the masks (by number) that fit their size."""
    at = _hashed(benchmark.where("item_id is not null"), "item_id").select("item_id", F.size("words").alias("size"), "hashes", F.posexplode("hashes").alias("pos", "_"))
    fits = lambda i: (F.col("size") >= MASKS[i][1]) & ((F.col("size") <= MASKS[i][2]) if MASKS[i][2] else F.lit(True))
    each = F.array(*(F.struct(F.lit(i).alias("mask"), F.when(fits(i), _seed(MASKS[i][0])).alias("seed")) for i in masks))
    return at.select("item_id", "size", F.col("pos").alias("item_pos"), F.explode(each).alias("s")).where("s.seed is not null").select("s.mask", "s.seed", "item_id", "item_pos", "size")


def _stretch() -> Column:
    """Of a hit: where the stretch of the item around it starts, its length, and the document's words there; null where the document ends too early."""
    diagonal = F.col("pos") - F.col("item_pos")
    stretch = F.least("size", F.lit(STRETCH))
    first = F.greatest(F.least(F.greatest(F.col("item_pos") - 6, -diagonal, F.lit(0)), F.col("size") - stretch, F.col("n_words") - diagonal - stretch), F.lit(0))
    return F.when((first + diagonal >= 0) & (first + diagonal + stretch <= F.col("n_words")), F.struct(first.alias("first"), stretch.alias("stretch"), F.slice("near", first + diagonal - F.col("base") + 1, stretch).alias("words")))


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, agree, stretch) of each verified hit.

    Only distinct hashes are broadcast, in blocks of a fixed size, to find the positions that hit at all. These few
    carry the words around them, all that a stretch can reach, to the join with the places in the benchmark.
    """
    masks = used_masks(benchmark)
    spark = docs.sparkSession
    if not masks:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, agree int, stretch int")
    places = cut(seeds(benchmark, masks), "places")
    known = cut(places.select("mask", "seed").distinct(), "seeds")
    blocks = max(1, -(-known.count() // broadcast_rows))
    at = _hashed(docs.select("doc_id", "text"), "doc_id").select("doc_id", "words", "hashes", F.posexplode("hashes").alias("pos", "_"))
    at = at.select("doc_id", "words", "pos", *(_seed(MASKS[i][0]).alias(f"s{i}") for i in masks))
    found = []
    for block in range(blocks):
        part = known.where(F.pmod("seed", F.lit(blocks)) == block)
        joined = at
        for i in masks:
            joined = joined.join(F.broadcast(part.where(F.col("mask") == i).select(F.col("seed").alias(f"s{i}"), F.lit(i).alias(f"m{i}"))), f"s{i}", "left")
        some = reduce(lambda a, b: a | b, (F.col(f"m{i}").isNotNull() for i in masks))
        hit = F.array(*(F.struct(F.col(f"m{i}").alias("mask"), F.col(f"s{i}").alias("seed")) for i in masks))
        base = F.greatest(F.col("pos") - STRETCH, F.lit(0))
        near = joined.where(some).select("doc_id", "pos", F.size("words").alias("n_words"), base.alias("base"), F.slice("words", base + 1, 2 * STRETCH + 1).alias("near"), F.explode(hit).alias("h"))
        found.append(near.where("h.mask is not null").select("doc_id", "pos", "n_words", "base", "near", "h.mask", "h.seed"))
    near = reduce(DataFrame.union, found).join(places, ["mask", "seed"]).select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), _stretch().alias("s"))
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("item_words"))
    agree = F.size(F.filter(F.zip_with("s.words", F.slice("item_words", F.col("s.first") + 1, F.col("s.stretch")), lambda a, b: a == b), lambda x: x))
    checked = near.where("s is not null").join(items, "item_id").select("doc_id", "item_id", agree.alias("agree"), "s.stretch")
    return checked.where(F.col("agree") >= THRESHOLD * F.col("stretch"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, items, share) of each document that holds a benchmark passage: the item ids and the best share of agreeing words."""
    each = hits(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.col("agree") / F.col("stretch")).alias("share"))
    return each.groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.max("share").alias("share"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: (doc_id, contaminated, n_items, items, share).

    Null and empty texts and documents shorter than an item's stretch hold nothing. Items of one to five words are
    found where they occur whole, longer ones where at least THRESHOLD of the words of a stretch agree. Items without a
    word or an id are never found; items that share an id are each looked for. Rows that share a doc_id, null included,
    share a verdict; repeated rows get a row each. Either table may be empty.
    """
    found = leaks(docs, benchmark).withColumnRenamed("doc_id", "hit_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(found, rows.doc_id.eqNullSafe(found.hit_id), "left").select(
        "doc_id",
        F.col("share").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("share"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage; repeated rows stay or go together, rows without words stay, all columns stay as they are."""
    found = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_hit_id")), "leaks")
    return docs.join(found, docs.doc_id.eqNullSafe(found._hit_id), "left_anti")
