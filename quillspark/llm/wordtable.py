"""Distinct words of a table, each handled once in one place, and the way back to where they stand.

Rows are taken together in blocks. A block names its distinct words by their rank of frequency and keeps the rows as
such numbers; its words go, with how often they occur, to the bucket of their hash. There each distinct word of all
blocks meets once, whatever its frequency: a word that makes up a third of the table is one entry of each block. What
the bucket has made of a word returns to the block in the order in which its words were sent, so it is joined back by
position. A word has a realm (such as a language) that keeps words of the same spelling apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import ship

#: Words after which a block is closed; a longer row has a block of its own.
BLOCK_WORDS = 1_000_000
#: Rows whose words a task finds at a time.
TOGETHER = 256
#: Buckets of words for each shuffle partition, so that a bucket stays small as input and partitions grow.
BUCKETS = 4
SCHEMA = "block long, realm string, mark long, bucket int, words binary, counts binary, ids array<long>, sizes array<int>, codes binary, buckets binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^32 - 1, compressed by planes of bytes."""
    x = np.ascontiguousarray(numbers, dtype="<u4")
    return len(x).to_bytes(8, "little") + (_ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True) if len(x) else b"")


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: pa.Array) -> bytes:
    """Words as lengths in bytes and all their bytes, compressed."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = bytes(memoryview(words.buffers()[2] or b"")[ends[0] : ends[-1]])
    lengths = pack(np.diff(ends))
    return b"".join((len(lengths).to_bytes(8, "little"), lengths, len(data).to_bytes(8, "little"), _ZSTD.compress(data, asbytes=True)))


def unpack_words(packed: list[bytes]) -> tuple[pa.Array, list[int]]:
    """The words of all, one after another, and how many each has."""
    lengths, data = [], []
    for raw in packed:
        n = 8 + int.from_bytes(raw[:8], "little")
        lengths.append(unpack(raw[8:n]))
        data.append(_ZSTD.decompress(raw[n + 8 :], int.from_bytes(raw[n : n + 8], "little"), asbytes=True))
    ends = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))))
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(data)))
    return words, [len(x) for x in lengths]


#: Takes the bytes of texts that stand one after another, and gives them as they are to count, where a word begins, and which of the words are kept (None: all).
Split = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def found(texts: pa.Array, split: Split) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has. Words are views of the texts' bytes."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data, starts, kept = split(data)
    starts = starts.copy()
    starts[ends[:-1][ends[:-1] < len(data)]] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data))
    if kept is not None:
        keep = kept[at]
        words, at = words.filter(pa.array(keep)), at[keep]
    return words, np.diff(np.searchsorted(at, ends))


def _rows(block: int, realm: str | None, ids: list[pa.Array], sizes: list[np.ndarray], words: list[pa.Array], n_buckets: int, parts: str) -> Iterator[pa.RecordBatch]:
    """The rows of a block: one that holds its rows as numbers, and one for each bucket that gets words."""
    coded = pa.chunked_array(words, pa.string()).dictionary_encode().unify_dictionaries()
    distinct = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
    codes = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in coded.chunks)])
    words.clear()
    counts = np.bincount(codes, minlength=len(distinct))
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    distinct, counts = distinct.take(pa.array(order)), counts[order]
    salt = zlib.crc32((realm or "").encode())
    buckets = np.fromiter((zlib.crc32(w, salt) for w in distinct.cast(pa.binary()).to_pylist()), np.uint32, len(distinct)) % n_buckets
    by_bucket = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[by_bucket], np.arange(n_buckets + 1))
    mark = zlib.crc32(distinct.buffers()[2] or b"", len(codes))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(*columns: list | pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    if "held" in parts:
        yield batch([block], [realm], [mark], [None], [None], [None], one(pa.concat_arrays(ids)), one(pa.array(np.concatenate(sizes), pa.int32())), [pack(rank[codes])], [pack(buckets)])
    if "sent" in parts:
        full = np.flatnonzero(np.diff(ends))
        distinct = distinct.take(pa.array(by_bucket))
        words = [pack_words(distinct.slice(ends[b], ends[b + 1] - ends[b])) for b in full]
        often = [pack(counts[by_bucket[ends[b] : ends[b + 1]]]) if "counts" in parts else None for b in full]
        n = len(full)
        yield batch([block] * n, [realm] * n, [mark] * n, full.tolist(), words, often, *[[None] * n] * 4)


def blocks(rows: DataFrame, split: Split, parts: str = "held sent counts") -> DataFrame:
    """Blocks of rows (id long, realm string, text string): see SCHEMA.

    A row with `bucket` null holds rows of the table: their ids, numbers of words, and all their words as ranks; others
    hold the words of a bucket in order of rank, and how often each occurs in the block. `parts` names what is wanted of
    these; the blocks are the same whatever is wanted, if the rows come in the same partitions and order, as they do
    from files. `mark` is a checksum of the block's words, by which blocks of two readings that differ are found out.
    Null and empty texts have no word, a null realm is a realm of its own. A table without rows has no blocks.
    """
    spark = rows.sparkSession
    ship(spark)
    buckets = n_buckets(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        held: dict[str | None, tuple[list, list, list]] = {}
        size = 0
        for b in (whole.slice(i, TOGETHER) for whole in batches for i in range(0, whole.num_rows, TOGETHER)):
            realms = b.column(1).dictionary_encode(null_encoding="encode")
            for code, realm in enumerate(realms.dictionary.to_pylist()):
                few = b.filter(pc.equal(realms.indices, code)) if len(realms.dictionary) > 1 else b
                words, sizes = found(pc.fill_null(few.column(2), ""), split)
                ids, all_sizes, all_words = held.setdefault(realm, ([], [], []))
                ids.append(few.column(0))
                all_sizes.append(sizes)
                all_words.append(words)
                size += len(words)
            if size >= BLOCK_WORDS:
                for realm, of in held.items():
                    yield from _rows(at, realm, *of, buckets, parts)
                    at += 1
                held, size = {}, 0
        for realm, of in held.items():
            yield from _rows(at, realm, *of, buckets, parts)
            at += 1

    return rows.select("id", "realm", "text").mapInArrow(run, SCHEMA)


def n_buckets(spark: SparkSession) -> int:
    return BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(found: pa.Table, row: dict) -> None:
    """Raise if what came back belongs to a block that had other words when the rows were read again."""
    if {*found["mark"].to_pylist()} - {row.get("mark")}:
        raise RuntimeError("docs came in other partitions or another order when they were read again; write them to files first")


def in_order(buckets: np.ndarray) -> np.ndarray:
    """For each rank of a block, the place of its word when the words of all buckets stand one after another."""
    place = np.empty(len(buckets), np.int64)
    place[np.argsort(buckets, kind="stable")] = np.arange(len(buckets))
    return place


def sent(table: DataFrame) -> DataFrame:
    """(block, realm, mark, bucket, words, counts): the words of the blocks by bucket."""
    return table.where(F.col("bucket").isNotNull()).select("block", "realm", "mark", "bucket", "words", "counts")


def held(table: DataFrame) -> DataFrame:
    """(block, realm, mark, ids, sizes, codes, buckets): the rows of the blocks."""
    return table.where(F.col("bucket").isNull()).select("block", "realm", "mark", "ids", "sizes", "codes", "buckets")
