"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a row of slots of `block` words, in this order: whoever reads a part of it from the start reads every source
near its share. Each source owns as many slots as its target fills, the last one in part.
Slot i has the point frac(i * golden ratio), which the cumulative shares of the sources map to a source; a source that
the points gave more slots than it owns hands the surplus to those that got fewer. The r-th slot of a source takes the
r-th block of words of that source, whose documents stand in shuffled order and are read at most twice over. Points meet
sources by a merge within the cells of a grid on the unit interval, and blocks meet slots by (source, rank), so no
source, however large, is one join key, and a cell with many sources costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import cut, n_words

#: Weights of the sources in order, repeating; words of the mix against all words; readings of a source.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
_GOLDEN = 0.6180339887498949
#: Cells of the grid on the unit interval, shuffle buckets of a source, slots counted together.
GRID = 4096
BUCKETS = 4096
CHUNK = 4096
#: The most words in a block, and about how many slots smaller inputs have; each source has one at least.
MOST_BLOCK = 8192
SLOTS = 1 << 16


def running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with, for each name, the sum of the value over all rows before in the order; ties in the order are broken at random, so there must be none.

    Rows are dealt by ranges of the order and written; sums run within a range and over the ranges, so no task holds all.
    """
    dealt = cut(df.repartitionByRange(*order).select("*", *(v.alias(f"_{n}") for n, v in values.items()), F.spark_partition_id().alias("_part")), "ranges")
    run = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in values))
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_all_{n}").over(run), F.lit(0)).alias(f"_before_{n}") for n in values))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.select("*", *(F.coalesce(F.sum(f"_{n}").over(within), F.lit(0)).alias(f"_within_{n}") for n in values)).join(F.broadcast(parts), "_part")
    return placed.select(*df.columns, *((F.col(f"_before_{n}") + F.col(f"_within_{n}")).alias(n) for n in values))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, sid, source_size, target) for each source, sid its number in code point order, null last; sizes: (source, size).

    Sources take the weights in turn. Targets stop at `epochs` times the source's size and the rest is reshared by
    weight: with sources in order of size over weight, the capped ones come first, and the others get the level that
    is left.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = running(totals, [F.col("source").asc_nulls_last()], sid=F.lit(1).cast("long"))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.lit(float(epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = cut(running(t, [F.col("ratio"), F.col("sid")], caps=F.col("cap"), weights=F.col("weight")), "caps")
    whole = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight")).first()
    level = (F.lit(share * whole["size"]) - F.col("caps")) / (F.lit(whole["weight"]) - F.col("weights"))
    found = t.where(level * F.col("weight") <= F.col("cap")).agg(F.min_by(level, F.struct("ratio", "sid"))).first()[0]
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("weight"))
    return t.select("source", "sid", "source_size", target.alias("target"))


def owned(targets: DataFrame, block: int) -> DataFrame:
    """targets with `words`, the whole words that the mix takes of the source, and `slots`, as many as these fill, the last in part."""
    words = F.floor(F.col("target") + 0.5)
    return targets.withColumn("words", words).withColumn("slots", F.ceil(F.col("words") / block))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, sid, rank): the source of each slot and the number of the slot among those of its source; each source has as many as it owns. targets: (sid, target)."""
    spark = targets.sparkSession
    few = owned(targets, block).where("slots > 0").select("sid", "slots")
    bounds = cut(running(few, [F.col("sid")], lo=F.col("slots")), "bounds")
    n = bounds.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    width = max(1, -(-n // GRID))
    cells = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("lo") + F.col("slots") - 1) / width)))
    marks = bounds.withColumn("cell", cells).select("cell", F.greatest(F.col("lo"), F.col("cell") * width).alias("at"), F.lit(None).cast("long").alias("slot"), "sid")
    turn = F.col("id") * F.lit(_GOLDEN)
    at = F.least(F.floor((turn - F.floor(turn)) * n), F.lit(n - 1))
    points = spark.range(n).select(F.floor(at / width).alias("cell"), at.alias("at"), F.col("id").alias("slot"), F.lit(None).cast("long").alias("sid"))
    upto = W.partitionBy("cell").orderBy("at", F.col("slot").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    met = marks.union(points).withColumn("sid", F.last("sid", ignorenulls=True).over(upto)).where("slot is not null").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    met = cut(met, "slots")
    per = met.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    run = W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("sid", "chunk", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before")).join(few, "sid")
    ranked = met.withColumn("r", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(per, ["sid", "chunk"])
    ranked = cut(ranked.select("slot", "sid", (F.col("before") + F.col("r")).alias("rank"), "slots"), "ranks")
    # the points miss the shares by a few slots for each source: surplus slots go to the sources that lack some, in order
    spare = running(ranked.where("rank >= slots").select("slot"), [F.col("slot")], j=F.lit(1).cast("long"))
    got = ranked.groupBy("sid").agg(F.count("*").alias("got"))
    lack = few.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < slots")
    lack = running(lack.select("sid", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")), [F.col("sid"), F.col("rank")], j=F.lit(1).cast("long"))
    return ranked.where("rank < slots").select("slot", "sid", "rank").union(spare.join(lack, "j").select("slot", "sid", "rank"))


def block_words(words: float) -> int:
    """Words in a block: SLOTS blocks in all, at most MOST_BLOCK words each, so the number of sources only adds their last slots."""
    return int(min(MOST_BLOCK, max(1, SHARE * words // SLOTS)))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _row_key() -> Column:
    return F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), F.col("text"), F.col("source").cast("string"))


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sized with its source's columns and `start`, the words of the source before this row in shuffled order: running sums over the hash buckets of a source, then within a bucket."""
    d = sized.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = d.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    named = targets.withColumnRenamed("source", "s")
    buckets = buckets.join(named, _same("source", "s")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "sid", "source_size", "target", "words", "slots")
    within = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return d.join(buckets, _same("source", "s") & (F.col("bucket") == F.col("b"))).drop("s", "b").withColumn("start", F.col("before") + F.col("within"))


def _laid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of docs with their place in their source, and the mix: pieces of rows with words in the slots that the schedule gives them (slot null: not taken)."""
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _row_key().alias("h")), "sizes")
    targets = source_targets(sized)
    block = block_words(sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"])
    targets = cut(owned(targets, block), "targets")
    d = cut(_placed(sized, targets), "placed")
    # readings of a row: its words in the first and in the second pass over the source, as far as the source is taken
    read = d.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size"))
    end = F.least(F.col("at") + F.col("size"), F.col("words"))
    first, last = F.floor(F.col("at") / block), F.floor((end - 1) / block)
    pieces = read.withColumn("rank", F.explode(F.when(end > F.col("at"), F.sequence(first, last)).otherwise(F.array(F.lit(None).cast("long")))))
    begin = F.greatest(F.col("at"), F.col("rank") * block)
    pieces = pieces.withColumn("offset", begin - F.col("at")).withColumn("part", F.least(end, (F.col("rank") + 1) * block) - begin)
    slots = schedule(targets, block).select(F.col("sid").alias("s"), F.col("rank").alias("k"), "slot")
    return d, pieces.join(slots, (F.col("sid") == F.col("s")) & (F.col("rank") == F.col("k")), "left").drop("s", "k")


def mix_slots(docs: DataFrame) -> DataFrame:
    """(slot, source, doc_id, epoch, offset, words): the mix itself. Slot by slot in the order of the schedule, which words of which row stand there: `words` words from word `offset` on, in reading `epoch` of the source. A slot holds one source's words."""
    return _laid(docs)[1].where("slot is not null").select("slot", "source", "doc_id", "epoch", "offset", F.col("part").alias("words"))


def mixed(docs: DataFrame) -> DataFrame:
    """mix, with the row's key `h` and the slots where its readings begin besides."""
    d, pieces = _laid(docs)
    columns = ("doc_id", "source", "size", "source_size", "target", "h")
    begin = [F.min(F.when(F.col("epoch") == e, F.col("slot"))).alias(f"slot{e}") for e in range(EPOCHS)]
    taken = pieces.groupBy("sid", "start").agg(*(F.first(c).alias(c) for c in columns), F.sum(F.when(F.col("slot").isNotNull(), F.col("part")).otherwise(0)).cast("long").alias("taken"), F.min("slot").alias("first_slot"), *begin)
    none = F.lit(None).cast("long")
    empty = d.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumns({c: none for c in ("first_slot", *(f"slot{e}" for e in range(EPOCHS)))})
    order = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "source", "h", *(f"slot{e}" for e in range(EPOCHS))]
    return taken.select(*order).union(empty.select(*order))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, source): (doc_id, size, source_size, target, taken, first_slot, source).

    size counts words (null: 0); taken counts the words that stand in slots of the schedule, repeats included, at most
    twice the row's size; first_slot is where the row first comes, null if it doesn't. The words taken of a source are its target, rounded to a whole word. A null source is a source of
    its own. Rows without words take nothing. Rows that are equal throughout are interchangeable. An empty table gives
    no rows. The same rows give the same mix again.
    """
    return mixed(docs).drop("h", *(f"slot{e}" for e in range(EPOCHS)))


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs as often as the mix takes them: each row zero, one or two times, the words taken over its words, rounded half up.

    A source is taken as a run of its shuffled rows, so rounding touches one row of each source at most. Of rows that
    are equal in doc_id, text and source each comes as often as the one that is taken most; rows without words go; an
    empty table gives no rows; all columns stay as they are. Rows come, and are written, in the order of the schedule.
    """
    copies = F.floor((F.col("taken") * 2 + F.col("size")) / F.greatest(F.col("size") * 2, F.lit(1)))
    begins = F.slice(F.array_sort(F.array(*(F.coalesce(f"slot{e}", "first_slot") for e in range(EPOCHS)))), F.lit(1), copies.cast("int"))
    found = mixed(docs).where("size > 0").withColumn("begins", begins).where(F.size("begins") > 0)
    taken = found.groupBy(F.col("h").alias("taken_h"), F.col("doc_id").alias("taken_id")).agg(F.max_by("begins", F.struct(F.size("begins"), -F.col("first_slot"))).alias("begins"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _row_key().alias("key"), F.col("doc_id").cast("long").alias("id"))
    joined = keyed.join(taken, (F.col("key") == F.col("taken_h")) & F.col("id").eqNullSafe(F.col("taken_id")))
    placed = joined.select("row", F.explode("begins").alias("slot"), "key")
    return placed.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key").select("row.*")
