"""Statements absorbed in batches end in the same tables, however they are cut, and whatever is run again."""

import random

from quillspark.streaming import statements as S

SCHEMA = "id string, knowledge_type string, norm string, location string, alias string"


def made(n):
    r = random.Random(12)
    rows = []
    for i in range(1, n + 1):
        kind = r.choice(["RULE", "DEFINITION", "EQUATION"])
        norm = r.choice(["the limit is 5 volts", "the limit is 6 volts", "the limit is 5.0 volts", "a b c", "x = 1", "x = 2"])
        rows.append((f"K-{i:08}", kind, norm, r.choice(["p1", "p2", None]), r.choice(["limit", "x", None])))
    return rows


def tables(spark, folder):
    now = S.current(spark, folder)
    return {k: sorted(map(tuple, df.collect()), key=str) for k, df in vars(now).items()}


def test_any_cut_gives_the_same_tables(spark, tmp_path):
    rows = made(60)
    df = lambda some: spark.createDataFrame(some, SCHEMA)
    S.absorb(df(rows), 0, str(tmp_path / "whole"))
    want = tables(spark, str(tmp_path / "whole"))
    assert all(want[k] for k in want) and len(want["decision"]) == 60 and len(want["conflict"]) == len(want["issue"])
    shuffled = random.Random(3).sample(rows, len(rows))
    cut = str(tmp_path / "cut")
    S.absorb(df(shuffled[:7]), 0, cut)
    S.absorb(df(shuffled[7:40]), 1, cut)
    S.absorb(df(shuffled[7:40]), 1, cut)  # run again after a failure
    S.absorb(df(shuffled[30:]), 2, cut)  # some of it for the second time
    assert tables(spark, cut) == want


def test_as_a_stream(spark, tmp_path):
    rows = made(24)
    source = str(tmp_path / "in")
    for some in (rows[:10], rows[10:]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    out = str(tmp_path / "out")
    q = S.stream(spark, source, spark.createDataFrame([], SCHEMA).schema, out, str(tmp_path / "checkpoint"), 1)
    q.awaitTermination(300)
    S.absorb(spark.createDataFrame(rows, SCHEMA), 0, str(tmp_path / "whole"))
    assert tables(spark, out) == tables(spark, str(tmp_path / "whole"))
