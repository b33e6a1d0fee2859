"""Chains and shared hierarchies against enumeration, and graphs with more ways than can be listed."""

import random
import time

from quillspark.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def nodes(spark, names, column="node"):
    return spark.createDataFrame([(n,) for n in sorted(names)], f"{column} string")


def plain_chains(pairs, available, target):
    out = []

    def walk(path):
        for a, b in pairs:
            if a == path[-1] and b not in path:
                if b in available:
                    out.append([*path, b][::-1])
                walk([*path, b])

    walk([target])
    return sorted(out, key=lambda p: [int(n.split("-")[1]) for n in p])


def test_chains_against_enumeration(spark):
    r = random.Random(4)
    name = lambda i: f"CPT-{i:08}"
    pairs = {(name(r.randint(1, 12)), name(r.randint(1, 12))) for _ in range(26)}
    available = {name(i) for i in (2, 5, 9, 11)}
    targets = {name(i) for i in range(1, 13)}
    got = {}
    for x in graph.chains_of(edges(spark, pairs), nodes(spark, available), nodes(spark, targets, "target")).collect():
        assert x["complete"]
        got.setdefault(x["target"], {})[x["place"]] = x["path"]
    for t in targets:
        assert [got.get(t, {})[i] for i in sorted(got.get(t, {}))] == plain_chains(pairs, available, t)
    few = graph.chains_of(edges(spark, pairs), nodes(spark, available), nodes(spark, targets, "target"), limit=2).collect()
    for t in targets:
        rows = sorted((x["place"], x["path"], x["complete"]) for x in few if x["target"] == t)
        every = plain_chains(pairs, available, t)
        assert len(rows) == min(2, len(every)) and all(p in every for _, p, _ in rows)
        assert all(c == (len(every) <= 2) for _, _, c in rows) or len(every) > 2 and not any(c for _, _, c in rows)


def ladder(n):
    """n diamonds one after the other: 2^n ways from the first node to the last."""
    name = lambda i, side="": f"N-{3 * i + {'': 0, 'a': 1, 'b': 2}[side]:06}"
    return {p for i in range(n) for p in ((name(i), name(i, "a")), (name(i), name(i, "b")), (name(i, "a"), name(i + 1)), (name(i, "b"), name(i + 1)))}, name(0), name(n)


def test_more_chains_than_can_be_listed(spark):
    pairs, first, last = ladder(20)
    began = time.time()
    rows = graph.chains_of(edges(spark, pairs), nodes(spark, {last}), nodes(spark, {first}, "target"), limit=50).collect()
    assert len(rows) == 50 and not any(x["complete"] for x in rows) and len({tuple(x["path"]) for x in rows}) == 50
    assert all(x["path"][0] == last and x["path"][-1] == first for x in rows) and time.time() - began < 240


def test_shared_hierarchy(spark):
    r = random.Random(7)
    pairs = {(f"h{a:02}", f"h{b:02}") for a, b in ((r.randint(0, 14), r.randint(0, 14)) for _ in range(24)) if a < b}
    tops = {a for a, _ in pairs} - {b for _, b in pairs}
    want = {}

    def walk(root, at, depth):
        n, least, most = want.get((root, at), (0, depth, depth))
        want[root, at] = (n + 1, min(least, depth), max(most, depth))
        for a, b in pairs:
            if a == at:
                walk(root, b, depth + 1)

    for t in tops:
        walk(t, t, 0)
    got = {(x["root"], x["node"]): (int(x["n_paths"]), x["least_depth"], x["most_depth"]) for x in graph.shared_hierarchy(edges(spark, pairs)).collect()}
    assert got == want
    rungs, first, last = ladder(12)
    rows = {x["node"]: int(x["n_paths"]) for x in graph.shared_hierarchy(edges(spark, rungs)).collect()}
    assert len(rows) == 37 and rows[last] == 2**12


def test_cycles_are_reported(spark):
    pairs = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("x", "a"), ("d", "d"), ("p", "q"), ("q", "p"), ("c", "p")}
    got = {x["component"]: x["path"] for x in graph.hierarchy_cycles(edges(spark, pairs)).collect()}
    assert got == {"a": ["a", "b", "c", "a"], "d": ["d", "d"], "p": ["p", "q", "p"]}
    assert graph.hierarchy_cycles(edges(spark, {("a", "b")})).collect() == []
    assert {(x["root"], x["node"]): int(x["n_paths"]) for x in graph.shared_hierarchy(edges(spark, pairs)).collect()} == {("x", "x"): 1, ("x", "a"): 1, ("c", "c"): 1, ("c", "p"): 1}
