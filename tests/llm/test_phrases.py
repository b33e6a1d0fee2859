"""Collocations against counts of a plain program, and the perfect hash and sums of arrays beneath."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from quillspark.llm import phrases, queries, slots, wordtable

SCHEMA = "doc_id long, text string, lang string, words string, id int, realm string"


def plain(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in found.items():
        lang, *w = p
        if any(q[0] == lang and len(q) == 4 and w in (list(q[1:3]), list(q[2:4])) and 100 * b >= 50 * a for q, b in found.items()) and len(w) == 2:
            continue
        score, k = min((1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return {(lang, i, w.decode(), -a, left, right, n[lang], -score) for lang, x in out.items() for i, (score, a, w, left, right) in enumerate(sorted(x)[:top], 1)}


def made(seed, n, vocabulary):
    r = random.Random(seed)
    langs = ["en", "fr", None, "und"]
    text = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(r.randint(0, 40)))
    return [(text(), r.choice(langs)) for _ in range(n)]


ODD = [(None, "en"), ("", None), (" \t.\n!!", "en"), ("x" * 100_000, "en"), ("one two three. " * 5000, "fr"), ("Été été " * 30, "fr"), ("same words again", "en"), ("same words again", "en")]


@pytest.mark.parametrize(("rows", "least", "top", "shard"), [(made(1, 60, ["a", "B", "b", "c", "éß"]), 10, 2000, 1 << 22), (made(2, 80, [f"w{i}" for i in range(12)]) + ODD, 3, 7, 40), ([("alone", "en")], 10, 2000, 4)])
def test_collocations(spark, monkeypatch, rows, least, top, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(wordtable, "BLOCK_WORDS", 500)
    df = spark.createDataFrame([(i, t, lang, "x", 1, "y") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least, top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, least, top)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_counts_past_64_bits(spark):
    rows = [("en", "a b", 4_000_000_000, [(4_000_000_000, 4_000_000_001), (4_000_000_000, 4_000_000_000)]), ("en", "c d", 10, [(10, 30), (30, 10)])]
    df = spark.createDataFrame(rows, "lang string, phrase string, a long, cuts array<struct<l: long, r: long>>")
    got = {r[1]: tuple(r)[2:] for r in phrases._scored(df).collect()}
    assert got == {"a b": (4_000_000_000, 4_000_000_000, 4_000_000_001, 999_999), "c d": (10, 10, 30, 333_333)}


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as from '{d}/documents.parquet'")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = c.sql(f"select {', '.join(names)} from ({queries.oracle_sql()['op12_collocations']})").fetchall()
    assert want and set(map(tuple, queries.queries()["op12_collocations"](spark, d).select(*names).collect())) == set(want)


def test_perfect_hash():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    made = slots.PerfectHash.from_bytes(*slots.PerfectHash.build(keys).to_bytes())
    assert sorted(made.find(keys).tolist()) == list(range(len(keys))) and (made.keys[made.find(keys)] == keys).all()
    others = np.setdiff1d(r.integers(0, 2**63, 50_000).astype(np.uint64), keys)
    assert (made.find(others) == -1).all()
    none = slots.PerfectHash.from_bytes(*slots.PerfectHash.build(keys[:0]).to_bytes())
    assert none.find(keys).tolist() == [-1] * len(keys)


def test_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(slots, "FAN_IN", 2)
    monkeypatch.setattr(slots, "CHUNK", 10)
    r = np.random.default_rng(3)
    arrays = [r.integers(0, 2**40, 35) * (r.random(35) < 0.5) for _ in range(9)]
    rows = [x for task, a in enumerate(arrays) for x in slots.chunks_of(task, a)]
    got = {c: slots.unsqueeze(d).tolist() for c, d in slots.tree_sum(spark.createDataFrame([(t, c, bytearray(d)) for t, c, d in rows], slots.ARRAYS)).collect()}
    want = sum(arrays)
    assert got == {i: want[10 * i : 10 * i + 10].tolist() for i in range(4)}
