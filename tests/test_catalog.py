"""Every query with SQL gives the rows that DuckDB gives on the same files."""

import glob
import os
import unicodedata

import duckdb
import pytest

from quillspark.plans import lookups  # noqa: F401, queries register on import
from quillspark.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain([c[0] for c in want.description], want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_core_needs_no_llm():
    """Nothing outside the subpackage imports it, apart from the guarded entry."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for f in glob.glob(f"{root}/quillspark/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert "quillspark.llm" not in open(f).read(), f


def test_texts_of_all_documents(spark, tmp_path):
    texts = ["Plain  text\t here ", "ﬁne\u00a0 Straße\u2003ÉCOLE ", "\u3000Ｆｕｌｌ　width\u2028é", "日本 語" * 30, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {n: {r[0]: r[1] for r in QUERIES[n](spark, str(tmp_path)).collect()} for n in ("t1_normalised", "t2_collapsed", "t4_labels")}
    flat = [t if t is None else " ".join(t.split()) for t in texts]
    assert got["t1_normalised"] == {i: t if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for i, t in enumerate(texts)}
    assert got["t2_collapsed"] == dict(enumerate(flat))
    assert got["t4_labels"] == {i: f if f is None else "Note: " + (f if len(f) <= 60 else f[:60].rstrip() + "…") for i, f in enumerate(flat)}
