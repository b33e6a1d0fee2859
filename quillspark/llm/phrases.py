"""Phrase collocations: two or three words that stand together far more often than their parts would by chance.

Level by level, as in Apriori: words that are frequent, then pairs of neighbours that are, then pairs of overlapping
pairs, which are phrases of three words. Texts become rows of word numbers once, by a table of distinct words (see
wordtable); a phrase's key is the pair of its parts' numbers, exact in 64 bits. A level works in two rounds:

1. Each block sends its distinct keys with their counts, none above LEAST, to the bucket of their hash; keys whose
   capped counts reach LEAST are the candidates. No frequent phrase is lost, and no other one is kept.
2. The candidates get slots by a minimal perfect hash that stores their keys. Tasks look up every pair of neighbours,
   count slots in arrays with bincount, and the arrays of all tasks are summed in a tree. The same pass writes each
   text's slots, which are the numbers that the next level pairs.

A hash holds at most about SHARD candidates, so what is broadcast is bounded; more candidates mean more passes over the
numbers, one for each SHARD of them. Cuts of a phrase are read by the slots of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import wordtable
from quillspark.llm.common import cut, ship
from quillspark.llm.slots import CHUNK, PerfectHash, chunks_of, mixed, tree_sum, unsqueeze

#: Fixed values of the report: least count of a phrase, phrases of a language, share of a phrase's count at which a longer one replaces it, scale of scores.
LEAST = 10
TOP = 2000
COVERED = (100, 50)
SCALE = 1_000_000
UNKNOWN = "und"
#: Candidates of one perfect hash.
SHARD = 1 << 22
#: Kinds of bytes: of a word, between words, between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A to Z) words of the bytes of texts; a run of marks between pieces is a word of its own. See wordtable.Split."""
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    kind = _KIND[data]
    starts = np.ones(len(data), bool)
    starts[1:] = kind[1:] != kind[:-1]
    return data, starts, kind != 1


def numbered(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts as word numbers (codes binary), the frequent words (id, lang, word, f) and all words counted (lang, n).

    Frequent words have numbers from 1 (by their bucket, so not all are in use); other words, marks and the ends of texts
    are 0. Words of different languages are different. docs are read twice, as in bpe.encode.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("realm"), F.col("text").alias("text"))
    n_buckets = wordtable.n_buckets(spark)

    def frequent(group: pa.Table) -> pa.Table:
        realms = pc.fill_null(group["realm"], UNKNOWN).to_pylist()
        out, next_no = [], 0
        for realm in sorted(set(realms)):
            few = group.filter(pa.array([x == realm for x in realms]))
            found, sizes = wordtable.unpack_words(few["words"].to_pylist())
            coded = found.dictionary_encode()
            distinct, codes = coded.dictionary, coded.indices.to_numpy()
            counts = np.zeros(len(distinct), np.int64)
            np.add.at(counts, codes, np.concatenate([*map(wordtable.unpack, few["counts"].to_pylist())]).astype(np.int64))
            ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct)]
            real = _KIND[np.frombuffer(distinct.buffers()[2], np.uint8)[ends]] == 0
            kept = real & (counts >= least)
            ids = (next_no + np.cumsum(kept) - 1) * n_buckets + group["bucket"][0].as_py() + 1
            next_no += int(kept.sum())
            if next_no * n_buckets >= 1 << 32:
                raise OverflowError("more frequent words than 32-bit numbers")
            numbers = np.where(kept, ids, 0)[codes]
            at = np.concatenate(([0], np.cumsum(sizes)))
            out += [(block, mark, realm, wordtable.pack(numbers[a:b]), None, None, None, None) for block, mark, a, b in zip(few["block"].to_pylist(), few["mark"].to_pylist(), at[:-1], at[1:], strict=True)]
            out.append((None, None, realm, None, ids[kept].tolist(), distinct.filter(pa.array(kept)).to_pylist(), counts[kept].tolist(), int(counts[real].sum())))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64()]
        found = {name: pa.array(x, k) for name, x, k in zip(("block", "mark", "realm", "numbers", "ids", "words", "counts", "n"), zip(*out, strict=True), kinds, strict=True)}
        return pa.table(found | {"bucket": pa.array([group["bucket"][0].as_py()] * len(out), pa.int32())})

    schema = "block long, mark long, realm string, numbers binary, ids array<long>, words array<string>, counts array<long>, n long, bucket int"
    met = cut(wordtable.sent(wordtable.blocks(rows, words, "sent counts")).groupBy("bucket").applyInArrow(frequent, schema), "words")
    per = met.where("block is null").withColumnRenamed("realm", "lang")
    known = per.select("lang", F.explode(F.arrays_zip("ids", "words", "counts")).alias("w")).select(F.col("w.ids").alias("id"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    totals = per.groupBy("lang").agg(F.sum("n").alias("n"))

    def back(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        row = rows.to_pylist()[0] if rows.num_rows == 1 else {}
        wordtable.same(found, row)
        numbers = np.concatenate([np.zeros(0, np.uint32), *map(wordtable.unpack, found["numbers"].to_pylist())])
        numbers = numbers[wordtable.in_order(wordtable.unpack(row["buckets"]))[wordtable.unpack(row["codes"])]]
        ends = np.cumsum(np.array(row["sizes"], np.int64))
        return pa.table({"codes": pa.array([wordtable.pack(np.insert(numbers, ends, 0))], pa.binary())})

    sent = met.where("block is not null").select("block", "mark", "bucket", "numbers")
    held = wordtable.held(wordtable.blocks(rows, words, "held")).select("block", "mark", "sizes", "codes", "buckets")
    return cut(held.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(back, "codes binary"), "numbers"), known, totals


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two numbers stand side by side, and the keys of the pairs."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    wide = codes.astype(np.uint64)
    return at, (wide[at] << np.uint64(32)) | wide[at + 1]


def candidates(numbers: DataFrame, least: int = LEAST) -> DataFrame:
    """(bucket, n, keys binary): the pairs of neighbours that come at least `least` times, by the bucket of their hash; numbers: (codes)."""
    spark = numbers.sparkSession
    n_buckets = wordtable.n_buckets(spark)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                keys, counts = np.unique(_pairs(wordtable.unpack(raw))[1], return_counts=True)
                buckets = (mixed(keys, 1000) % np.uint64(n_buckets)).astype(np.int32)
                order = np.argsort(buckets, kind="stable")
                ends = np.searchsorted(buckets[order], np.arange(n_buckets + 1))
                keys, counts = keys[order], np.minimum(counts[order], least)
                full = np.flatnonzero(np.diff(ends))
                packed = [[wordtable.pack(x[ends[i] : ends[i + 1]]) for i in full] for x in (keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], ["bucket", "high", "low", "counts"])

    def supported(group: pa.Table) -> pa.Table:
        high, low, counts = (np.concatenate([*map(wordtable.unpack, group[c].to_pylist())]) for c in ("high", "low", "counts"))
        keys = (high.astype(np.uint64) << np.uint64(32)) | low
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        kept = keys[at][np.add.reduceat(counts, at) >= least]
        return pa.table({"bucket": group["bucket"].slice(0, 1), "n": pa.array([len(kept)], pa.int64()), "keys": pa.array([kept.astype("<u8").tobytes()], pa.binary())})

    sent = numbers.select("codes").mapInArrow(local, "bucket int, high binary, low binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(supported, "bucket int, n long, keys binary")


def hashes(found: DataFrame, shards: int) -> DataFrame:
    """(shard, n, levels, sizes, keys): a minimal perfect hash for each shard of the buckets of candidates."""

    def build(group: pa.Table) -> pa.Table:
        made = PerfectHash.build(np.concatenate([np.frombuffer(x, "<u8") for x in group["keys"].to_pylist()]))
        levels, sizes, keys = made.to_bytes()
        return pa.table({"shard": group["shard"].slice(0, 1), "n": pa.array([len(made.keys)], pa.int64()), "levels": pa.array([levels], pa.list_(pa.binary())), "sizes": pa.array([sizes], pa.list_(pa.int64())), "keys": pa.array([keys], pa.binary())})

    sharded = found.where("n > 0").select((F.col("bucket") % shards).alias("shard"), "keys")
    return cut(sharded.groupBy("shard").applyInArrow(build, "shard int, n long, levels array<binary>, sizes array<long>, keys binary"), "hashes")


def paired(numbers: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The frequent pairs of neighbours (slot, left, right, f), slots from 1, and the texts as slots (codes): place i holds the slot of the pair at i, 0 if it isn't frequent.

    numbers: (codes), 0 where nothing is to be paired.
    """
    spark = numbers.sparkSession
    found = cut(candidates(numbers, least), "candidates")
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    built = hashes(found, max(1, -(-n // SHARD)))
    grams = spark.createDataFrame([], "slot long, left long, right long, f long")
    rows, before = numbers.select("codes", F.lit(None).cast("binary").alias("slots")), 0
    for shard in sorted(r[0] for r in built.select("shard").collect()):
        row = built.where(F.col("shard") == shard).first()
        table = spark.sparkContext.broadcast((list(map(bytes, row["levels"])), list(row["sizes"]), bytes(row["keys"])))
        done = cut(_count(rows, table, before), "counts")
        arrays = tree_sum(done.where("task is not null").select("task", "chunk", "data"))
        grams = grams.union(_grams(arrays, table, before))
        rows, before = done.where("task is null").select("codes", "slots"), before + row["n"]
    return grams, rows.where("slots is not null").select(F.col("slots").alias("codes"))


def _count(rows: DataFrame, table, before: int) -> DataFrame:
    """Each text's numbers with the slots of the pairs that the hash has, and the task's counts by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = PerfectHash.from_bytes(*table.value)
        counts = np.zeros(len(found.keys), np.int64)
        kinds, names = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["task", "chunk", "data", "codes", "slots"]

        def batch(task, chunk, data, codes, slots) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((task, chunk, data, codes, slots), kinds, strict=True)], names)

        for b in batches:
            for raw, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                codes = wordtable.unpack(raw)
                slots = np.zeros(len(codes), np.uint32) if held is None else wordtable.unpack(held).copy()
                at, keys = _pairs(codes)
                slot = found.find(keys)
                at, slot = at[slot >= 0], slot[slot >= 0]
                counts += np.bincount(slot, minlength=len(counts))
                slots[at] = slot + np.uint32(before + 1)
                yield batch(None, None, None, raw, wordtable.pack(slots))
        for task, chunk, data in chunks_of(TaskContext.get().partitionId(), counts):
            yield batch(task, chunk, data, None, None)

    return rows.mapInArrow(run, "task int, chunk int, data binary, codes binary, slots binary")


def _grams(arrays: DataFrame, table, before: int) -> DataFrame:
    """(slot, left, right, f): the counts by slot with the stored keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.frombuffer(table.value[2], "<u8")
        for b in batches:
            for chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = unsqueeze(data)
                own = keys[chunk * CHUNK : chunk * CHUNK + len(f)]
                slot = np.arange(len(f)) + (chunk * CHUNK + before + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (slot, own >> np.uint64(32), own & np.uint64(0xFFFFFFFF), f)], ["slot", "left", "right", "f"])

    return arrays.mapInArrow(run, "slot long, left long, right long, f long")


def _scored(rows: DataFrame) -> DataFrame:
    """rows (lang, phrase, a, cuts array<struct<l, r>>) as (lang, phrase, a, l, r, score) of the cut with the lowest score, the first of equal ones. Python's whole numbers have no bound."""
    kinds = {"lang": pa.string(), "phrase": pa.string(), "a": pa.int64(), "l": pa.int64(), "r": pa.int64(), "score": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases, counts, cuts = b.columns
            best = [min((SCALE * a * a // (c["l"] * c["r"]), k, c["l"], c["r"]) for k, c in enumerate(x)) for a, x in zip(counts.to_pylist(), cuts.to_pylist(), strict=True)]
            columns = [langs, phrases, counts, *(pa.array([x[i] for x in best], pa.int64()) for i in (2, 3, 0))]
            yield pa.RecordBatch.from_arrays(columns, list(kinds))

    return rows.mapInArrow(run, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of two and three words of docs (text, lang), best first; `top` for each language, or all.

    Texts are lower-cased (A to Z), divided at marks and line ends into pieces and at spaces and tabs into words. A
    phrase counts wherever it stands within a piece, overlaps included. a is its count, l and r those of the two parts
    of its worst cut, n all words of the language. A phrase of two words that a longer one with at least half its count
    holds is left out. Null texts are empty, a null language is `und`, other columns are not looked at, repeated rows
    count as often as they are there, an empty table has no phrases. docs are read twice and must come in the same
    partitions and order, as files do; if they don't, an error says so.
    """
    numbers, known, totals = numbered(docs, least)
    two, slots = paired(numbers, least)
    three, _ = paired(slots, least)
    left = known.select(F.col("id").alias("left"), "lang", F.col("word").alias("w1"), F.col("f").alias("f1"))
    right = known.select(F.col("id").alias("right"), F.col("word").alias("w2"), F.col("f").alias("f2"))
    two = cut(two.join(left, "left").join(right, "right").select("slot", "lang", "w1", "f1", "w2", "f2", F.col("f").alias("f12")), "pairs")
    tail = two.select(F.col("slot").alias("right"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("f12").alias("f23"))
    three = cut(three.join(two.withColumnRenamed("slot", "left"), "left").join(tail, "right"), "triples")
    longer = three.select(F.explode(F.array("left", "right")).alias("slot"), "f").groupBy("slot").agg(F.max("f").alias("longer"))
    share, of = COVERED
    covered = F.coalesce(F.col("longer").cast("decimal(25,0)") * share >= F.col("f12").cast("decimal(25,0)") * of, F.lit(False))
    pairs = two.join(longer, "slot", "left").where(~covered)
    part = lambda l, r: F.struct(F.col(l).alias("l"), F.col(r).alias("r"))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f12").alias("a"), F.array(part("f1", "f2")).alias("cuts"))
    triples = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.array(part("f1", "f23"), part("f12", "f3")).alias("cuts"))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = _scored(pairs.union(triples)).withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
