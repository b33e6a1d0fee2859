"""The trie of conversation prefixes against a plain one, on odd rows, and its registered query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from quillspark.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, digest string"


def plain(rows):
    """Nodes as (depth, path) of whole turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, d, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = set()
    for v, m in members.items():
        below = [w for w in members if w[: len(v)] == v]
        children = lambda x: [w for w in members if len(w) == len(x) + 1 and w[: len(x)] == x]
        saved = sum((len(members[w]) - 1) * len(w[-1][1].encode()) for w in below if w)
        ids = ",".join(map(str, sorted(ends.get(v, []))))
        out.add((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(children(v)), sum(not children(w) for w in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


def made(seed, n, hot=0):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["a", "é", "long text", ""])))
    rows += [(1000 + 5 * i, t, "user", f"same {t}") for i in range(hot) for t in range(12)]
    return rows


ODD = [(None, 0, "user", "nobody"), (900, None, None, None), (900, 0, "user", "x"), (901, 3, "user", "tie b"), (901, 3, "user", "tie a"), (901, 3, "assistant", "tie"), (902, 1, "user", "twice"), (902, 1, "user", "twice"), (-7, 0, "user", "below zero"), (-5, 0, "user", "below zero"), (905, 0, "user", "é" * 200_000)]


@pytest.mark.parametrize(("rows", "piece", "hot"), [(made(1, 40), 8192, 1000), (made(2, 30, 25) + ODD, 3, 2), ([(7, 0, "user", "alone")], 8192, 1000)])
def test_nodes(spark, monkeypatch, rows, piece, hot):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "HOT", hot)
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r)[:8] for r in trie.shared_prefixes(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_empty_table(spark):
    assert trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversation_stays_linear(spark):
    """A conversation of n turns makes n + 1 nodes, and what is exploded for sums is at most one row for each prefix."""
    rows = [(5 * c, t, "user", str(t if t < 150 else (c, t))) for c in range(3) for t in range(300)]
    got = trie.shared_prefixes(spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)).collect()
    assert {tuple(r)[:8] for r in got} == plain(rows)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view conversations as from '{d}/conversations.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = c.sql(f"select {', '.join(names)} from ({queries.oracle_sql()['op13_prefix_trie']})").fetchall()
    assert set(map(tuple, queries.queries()["op13_prefix_trie"](spark, d).select(*names).collect())) == set(want)
