"""Byte-pair encoding through distinct words against the library's own encoding of whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quillspark.llm import bpe, wordtable
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = [chr(x) for x in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1F, 0x20, 0x20, 0x20, 0x85, 0xA0, 0xAD, 0x1680, 0x180E, 0x2003, 0x200B, 0x2028, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0)]
PARTS = [*SPACES, "a", "b", "\u00e9", "\u00df", "the", "  ", "'s", "'ll", "1", "23", ".", "!!", "\u4e2d", "\u6587", "<|endoftext|>", "<|", chr(0x1D11E), chr(0x301), "_", "\u0928\u092e"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_texts(spark, library):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(None, None, 7, "x"), (None, "twice", 7, "x"), (None, "twice", 7, "x"), (5000, "", 7, "x"), (5001, "y" * 60_000, 7, "x"), (5002, "word " * 60_000, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int, words string").repartition(3)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_small_blocks(spark, library, monkeypatch):
    """Each word is encoded once over many blocks and returns to every place, also when a block holds one row."""
    monkeypatch.setattr(wordtable, "BLOCK_WORDS", 3)
    texts = ["the cat and the dog", "the the the", "", "a dog", "cat\nthe dog"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    with spark_batches(spark, 2):
        got = {r[0]: r[1] for r in bpe.encode(docs, PATH).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def spark_batches(spark, n):
    from contextlib import contextmanager

    @contextmanager
    def held():
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(name)
        spark.conf.set(name, n)
        yield
        spark.conf.set(name, before)

    return held()


def test_decode_any_ids(spark, library):
    """Ids that no text gives: broken UTF-8 becomes U+FFFD as in the library; null stays null."""
    r = random.Random(5)
    rows = [(i, [r.randrange(50257) for _ in range(r.randint(0, 12))]) for i in range(500)] + [(900, None), (901, [])]
    got = {x["n"]: x["decoded"] for x in bpe.decode(spark.createDataFrame(rows, "n int, ids array<int>"), PATH).collect()}
    assert got == {i: None if ids is None else library.decode(ids, skip_special_tokens=False) for i, ids in rows}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_pack():
    r = np.random.default_rng(1)
    for x in (np.zeros(0, int), r.integers(0, 2**32, 1000), np.zeros(7, int)):
        assert wordtable.unpack(wordtable.pack(x)).tolist() == x.tolist()


def test_other_texts_are_found_out(spark):
    """Texts that are others when they are read again end in an error, never in wrong ids."""
    stamp = F.udf(lambda x: f"{x} {random.random()}").asNondeterministic()
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string").withColumn("text", stamp("text"))
    with pytest.raises(Exception, match="read again"):
        bpe.encode(docs, PATH).collect()
