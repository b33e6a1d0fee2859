"""Byte-pair encoding through a table of distinct words, and decoding through the pieces of ids.

Texts are split into words where the file's pre-tokenizer always divides them, so the ids of a text are
those of its words one after another. Each distinct word of the whole table is encoded once, in the task that its hash
falls to, and its ids return to the places of the word by position (see wordtable). Decoding looks at ids alone: id i
meets piece i of the vocabulary, and the pieces' bytes make the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.llm import wordtable
from quillspark.llm.common import resident, ship

#: Bytes before which a text is divided, if the character before is surely not white space: the pre-tokenizer never joins them to it.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
#: ASCII characters that are not white space to any engine, and the first two bytes of longer characters that some engine may take for white space or ignore.
_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = True
_UNSURE = [(0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80), (0xEF, 0xBB)]
#: Words that the library gets at a time.
TOGETHER = 20_000
#: Words whose ids a task puts together at a time, but at least one text's.
SLICE = 1 << 17


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    """Where words begin in the bytes of texts: at white space after a character that is surely none. See wordtable.Split."""
    starts = np.zeros(len(data), bool)
    starts[1:] = _SPACE[data[1:]]
    at = np.flatnonzero(starts)
    last = data[at - 1]
    sure = _SURE[last]
    wide = np.flatnonzero(last >= 0x80)  # the last byte of a longer character
    second, third = data[np.maximum(at[wide] - 2, 0)], data[np.maximum(at[wide] - 3, 0)]
    two = (second >= 0xC3) & (second <= 0xDF)
    three = (third >= 0xE0) & (third <= 0xEF)
    for a, b in _UNSURE:
        three &= (third != a) | (second != b)
    four = (second >= 0x80) & (second < 0xC0) & (third >= 0x80) & (third < 0xC0)
    sure[wide] = np.where(second >= 0xC0, two, np.where(third >= 0xC0, three, four))
    starts[at[~sure]] = False
    return data, starts, None


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pieces(path: str) -> pa.Array:
    """The bytes of each id's piece, in order of ids: a byte-level vocabulary writes bytes as characters of its own."""
    tokenizer = _tokenizer(path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    pieces = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        pieces[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return pa.array(pieces, pa.large_binary())


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs (doc_id, text), as the library encodes the whole text without adding special tokens.

    Special tokens written out in a text get their ids, as in the library. Null and empty texts have no ids; repeated
    rows come as often as they are there; a null doc_id stays null; other columns are not looked at; an empty table
    gives no rows. A text of any length is one row of one block. docs are read twice and must come in the same partitions
    and order, as files do; if they don't, an error says so.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.lit("").alias("realm"), F.col("text").alias("text"))

    def distinct(group: pa.Table) -> pa.Table:
        found, sizes = wordtable.unpack_words(group["words"].to_pylist())
        coded = found.dictionary_encode()
        sizes = np.concatenate(([0], np.cumsum(sizes)))
        encoder = resident(("bpe", tokenizer), lambda: _tokenizer(tokenizer))
        flat, lengths = [], []
        for at in range(0, len(coded.dictionary), TOGETHER):
            found = [e.ids for e in encoder.encode_batch_fast(coded.dictionary.slice(at, TOGETHER).to_pylist(), add_special_tokens=False)]
            lengths += map(len, found)
            flat.append(np.array([i for ids in found for i in ids], np.uint32))
        lengths = np.array(lengths, np.int64)
        ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths)))), pa.array(np.concatenate([np.zeros(0, np.uint32), *flat])))
        codes, out = coded.indices.to_numpy(), ([], [])
        for a, b in zip(sizes[:-1], sizes[1:], strict=True):
            out[0].append(wordtable.pack(lengths[codes[a:b]]))
            out[1].append(wordtable.pack(ids.take(pa.array(codes[a:b])).flatten().to_numpy()))
        return pa.table({"block": group["block"], "mark": group["mark"], "bucket": group["bucket"], "lengths": pa.array(out[0], pa.binary()), "word_ids": pa.array(out[1], pa.binary())})

    def back(rows: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        row = rows.to_pylist()[0] if rows.num_rows == 1 else {}
        wordtable.same(found, row)
        lengths = np.concatenate([np.zeros(0, np.uint32), *map(wordtable.unpack, found["lengths"].to_pylist())])
        flat = np.concatenate([np.zeros(0, np.uint32), *map(wordtable.unpack, found["word_ids"].to_pylist())]).view(np.int32)
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))), pa.array(flat))
        codes, place = wordtable.unpack(row["codes"]), wordtable.in_order(wordtable.unpack(row["buckets"]))
        ends = np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64))))
        out, at = [], 0
        while at < len(row["ids"]):  # a few rows at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            places = place[codes[ends[at] : ends[to]]]
            counts = np.concatenate(([0], np.cumsum(lengths[places], dtype=np.int64)))[ends[at : to + 1] - ends[at]]
            out.append(pa.RecordBatch.from_arrays([pa.array(row["ids"][at:to], pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), table.take(pa.array(places)).flatten())], ["doc_id", "ids"]))
            at = to
        return pa.Table.from_batches(out)

    known = wordtable.sent(wordtable.blocks(texts, words, "sent")).select("block", "mark", "bucket", "words").groupBy("bucket").applyInArrow(distinct, "block long, mark long, bucket int, lengths binary, word_ids binary")
    rows = wordtable.held(wordtable.blocks(texts, words, "held")).select("block", "mark", "ids", "sizes", "codes", "buckets")
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(back, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """rows with `decoded`, the text that the library makes of their `ids` (array<int>) when special tokens stay: the pieces of the ids one after another, with U+FFFD for what is not UTF-8. Null ids give null; ids that the vocabulary lacks are left out."""
    ship(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = resident(("pieces", tokenizer), lambda: _pieces(tokenizer))
        for b in batches:
            ids = b.column(names.index("ids"))
            flat = pc.list_flatten(ids)
            inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
            joined = pieces.take(pc.if_else(inside, flat, None))
            joined = pc.fill_null(joined, b"")
            ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
            raw = memoryview(joined.buffers()[2] or b"")
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
            null = ids.is_null().to_pylist()
            texts = [None if no else str(raw[x:y], "utf-8", "replace") for x, y, no in zip(at[:-1], at[1:], null, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
