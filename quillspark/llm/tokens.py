"""Token-ID files: ids of all documents one after another, and Elias-Fano coded document ends to find them by.

A file set is a Parquet folder whose rows are blocks in document order. A block holds
  part, block      place of the block: partitions in ascending doc_id order, blocks counted within each
  first            ids in the partition before this block
  ids              the ids of its documents, little-endian, 2 bytes each if the vocabulary has at most 65,536, else 4
  width            2 or 4
  n_docs, universe number of documents and of ids
  low_bits, low, high, hints   the ends of the documents as an Elias-Fano sequence
  n_null, first_id, last_id, id_bits, id_low, id_high, id_hints   doc_ids: how many are null, which come first, and the others,
                   less the first of them, as an Elias-Fano sequence too
No part of a block is a table of 64-bit numbers.
Spark's writer commits whole tasks only, so a lost executor leaves no half-written file.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm import bpe, wordtable
from quillspark.llm.common import resident, ship

#: Ids after which a block is closed; a longer document has a block of its own.
BLOCK_IDS = 1 << 19
#: Words whose ids a worker keeps, the first that it meets; later ones are encoded each time.
CACHE = 1_000_000
END_ID = 0
#: Texts that a worker encodes together.
TOGETHER = 1024
HINT_EVERY = 256
SCHEMA = "part int, block int, first long, width int, n_docs int, universe long, low_bits int, low binary, high binary, hints binary, n_null int, first_id long, last_id long, id_bits int, id_low binary, id_high binary, id_hints binary, ids binary"


def _short(places: np.ndarray) -> bytes:
    """Places in a code as 32-bit numbers: a code has about three bits for each number of a block."""
    if len(places) and int(places[-1]) >= 1 << 32:
        raise OverflowError("a block of more than a billion documents")
    return places.astype("<u4").tobytes()


class EliasFano:
    """An ascending sequence of n numbers up to `universe`, in about 2 + log2(universe / n) bits each.

    The low bits are packed side by side; the high bits are in unary: number i sets bit (high + i). Every HINT_EVERY-th
    set bit's place is kept, so select(i) looks at a bounded stretch.
    """

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, hints: bytes):
        self.n, self.universe, self.low_bits, self.low, self.high, self.hints = n, universe, low_bits, low, high, hints

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << bits) - 1)
        lows = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if bits else np.zeros((n, 0), np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros((universe >> bits) + n + 1 if n else 0, dtype=np.uint8)
        unary[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, universe, bits, pack(lows.ravel()), pack(unary), _short(places[::HINT_EVERY]))

    def some(self, first: int, last: int) -> np.ndarray:
        """Numbers `first` to `last` - 1, by select: only the stretches of the code that hold them are read."""
        if not 0 <= first <= last <= self.n:
            raise IndexError(last)
        if first == last:
            return np.zeros(0, np.uint64)
        hints = np.frombuffer(self.hints, "<u4")
        start = int(hints[first // HINT_EVERY])
        end = int(hints[h]) if (h := -(-last // HINT_EVERY)) < len(hints) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :]
        skip = first % HINT_EVERY
        places = start + np.flatnonzero(bits)[skip : skip + last - first]
        high = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        at = first * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[at // 8 : -(-last * self.low_bits // 8)], bitorder="little")[at % 8 :][: (last - first) * self.low_bits]
        return high | (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def decode(self) -> np.ndarray:
        """All numbers."""
        return self.some(0, self.n).astype(np.int64)

    def select(self, i: int) -> int:
        """Number i, counted from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.some(i, i + 1)[0])


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes.

    Texts are cut into words where the file's pre-tokenizer always divides them (see bpe.words), so the ids of a text are
    those of its words. The distinct words of some texts are looked up among those that the worker has kept, new ones
    are encoded, and the words' ids are put together by their places.
    """

    #: Characters that no words are encoded beside: white space, what engines disagree on, and the start of a special token.
    ODD = re.compile("[\\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]|<\\||^  |^ *$")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.kept: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words: of plain ones as of one text with a line end after each, of others one by one."""
        odd = [self.ODD.search(w) is not None for w in words]
        plain = [w for w, o in zip(words, odd, strict=True) if not o]
        found: list[bytes] = []
        if plain and len(self.line_end) == 1:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
            ends = [*np.flatnonzero(ids == self.line_end[0]).tolist(), len(ids)]
            if len(ends) == len(plain):
                raw, w = ids.tobytes(), self.width
                found = [raw[a * w : b * w] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]
        if len(found) != len(plain):  # the tokenizer joined or split a line end
            found = [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        others = iter([self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast([w for w, o in zip(words, odd, strict=True) if o], add_special_tokens=False)])
        own = iter(found)
        return [next(others) if o else next(own) for o in odd]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text with the end id; a null text is empty."""
        words, sizes = wordtable.found(pc.fill_null(texts, ""), bpe.words)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = list(map(self.kept.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            names = [distinct[i] for i in new]
            learnt = self._new(names)
            for i, x in zip(new, learnt, strict=True):
                ids[i] = x
            if len(self.kept) < CACHE:
                self.kept.update(zip(names, learnt, strict=True))
        placed = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(placed.buffers()[1], np.int64)[placed.offset : placed.offset + len(placed) + 1] if len(placed) else np.zeros(1, np.int64)
        raw, end = memoryview(placed.buffers()[2] or b"") if len(placed) else b"", self._bytes([END_ID])
        at = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [bytes(raw[a:b]) + end for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder_of(path: str) -> Encoder:
    """The worker's own encoder; workers serve many tasks, so what it has kept is used again."""
    return resident(("encoder", path), lambda: Encoder(path))


def _block(part: int, block: int, first: int, width: int, ids: list[bytes], doc_ids: list[int | None]) -> pa.RecordBatch:
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    ef = EliasFano.encode(ends, int(ends[-1]))
    known = [x for x in doc_ids if x is not None]
    low, high = (known[0], known[-1]) if known else (0, 0)
    ids_of = EliasFano.encode(np.array([x - low for x in known], dtype=np.uint64), high - low)
    row = [part, block, first, width, ef.n, ef.universe, ef.low_bits, ef.low, ef.high, ef.hints, len(doc_ids) - len(known), low, high, ids_of.low_bits, ids_of.low, ids_of.high, ids_of.hints, b"".join(ids)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode (doc_id, text) and write the file set to a new folder `path`, in ascending doc_id order (null first, ties by a hash of the text).

    Null and empty texts give the end id alone; repeated rows are written as often as they come; an empty table writes
    a file set without blocks. Partitions are ranges of doc_id, so none depends on the number of documents of a source.
    """
    ship(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        part, block, first, size, ids, doc_ids = TaskContext.get().partitionId(), 0, 0, 0, [], []
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                few = b.slice(at, TOGETHER)
                for doc_id, raw in zip(few.column(0).to_pylist(), encoder.encode(few.column(1)), strict=True):
                    ids.append(raw)
                    doc_ids.append(doc_id)
                    size += len(raw) // encoder.width
                    if size >= BLOCK_IDS:
                        yield _block(part, block, first, encoder.width, ids, doc_ids)
                        block, first, size, ids, doc_ids = block + 1, first + size, 0, [], []
        if ids:
            yield _block(part, block, first, encoder.width, ids, doc_ids)

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def _offsets(blocks: DataFrame) -> DataFrame:
    """(part, before): ids in all partitions before; a row for each partition."""
    sizes = blocks.groupBy("part").agg(F.sum("universe").alias("size"))
    return sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids binary) of each document in a file set, with its place in the whole id array."""
    ship(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    return _documents(blocks, "ids binary", bytes, 0)


def read_checksums(spark, path: str) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids_crc32 long) of each document; the crc is of its ids as 4-byte little-endian numbers."""
    ship(spark)
    blocks = spark.read.schema(SCHEMA).parquet(path)
    return _documents(blocks, "ids_crc32 long", zlib.crc32, 4)


def _documents(blocks: DataFrame, column: str, value: Callable[[memoryview], object], width: int) -> DataFrame:
    """The documents of blocks with `value` of each one's ids, as numbers of `width` bytes (0: as written). Ids are widened once for a block, and offsets are selected for HINT_EVERY documents at a time."""
    name, kind = column.split()
    arrow = pa.binary() if kind == "binary" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ends = EliasFano(r["n_docs"], r["universe"], r["low_bits"], r["low"], r["high"], r["hints"])
                doc_ids = EliasFano(r["n_docs"] - r["n_null"], r["last_id"] - r["first_id"], r["id_bits"], r["id_low"], r["id_high"], r["id_hints"])
                w = width or r["width"]
                raw = memoryview(r["ids"] if w == r["width"] else np.frombuffer(r["ids"], f"<u{r['width']}").astype(f"<u{w}").tobytes())
                start = 0
                for at in range(0, ends.n, HINT_EVERY):  # as many documents at a time as share a hint
                    to = min(at + HINT_EVERY, ends.n)
                    found = ends.some(at, to).astype(np.int64)
                    starts = np.concatenate(([start], found[:-1]))
                    start = int(found[-1])
                    got = [value(raw[s * w : e * w]) for s, e in zip(starts.tolist(), found.tolist(), strict=True)]
                    null = max(0, min(to, r["n_null"]) - at)
                    numbers = doc_ids.some(max(at, r["n_null"]) - r["n_null"], to - r["n_null"]).tolist() if null < to - at else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None] * null + [x + r["first_id"] for x in numbers], pa.int64()), pa.array(starts + r["before"] + r["first"], pa.int64()), pa.array(found - starts, pa.int64()), pa.array(got, arrow)],
                        ["doc_id", "start", "n_tokens", name],
                    )

    return blocks.join(F.broadcast(_offsets(blocks)), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
