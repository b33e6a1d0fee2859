"""Evidence rows, and what of them a request may see.

Authorisation and scope are judged on evidence rows. An item is visible if one of its rows is in scope; everything that
is withheld is counted.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import counter

NOT_AUTHORIZED, OUT_OF_SCOPE, FILTERED, IN_SCOPE = "NOT_AUTHORIZED", "OUT_OF_SCOPE", "FILTERED", "IN_SCOPE"
#: The categories of a user's own books, and the states that retrieval leaves out.
OWN_BOOKS = ("USER_PROVIDED_SOURCE", "LOCAL_SOURCE")
LEFT_OUT = ("ARCHIVED", "DELETED")
PLACE = ("document_id", "source_id", "extraction_run_id", "page_number", "char_start", "char_end", "segment_id", "text")


def evidence(kb: SimpleNamespace) -> DataFrame:
    """The three occurrence tables as one, told apart by subject_kind."""
    parts = [(kb.source_occurrence, "knowledge_id", "KNOWLEDGE"), (kb.concept_occurrence, "concept_id", "CONCEPT"), (kb.edge_occurrence, "relationship_id", "RELATIONSHIP")]
    each = [df.select("id", F.lit(kind).alias("subject_kind"), F.col(key).alias("subject_id"), *PLACE) for df, key, kind in parts]
    return each[0].unionByName(each[1]).unionByName(each[2])


def source_verdict(own_books: bool) -> Column:
    """Of an evidence row joined with its source: not authorised before out of scope before in scope."""
    denied = F.col("authorization").isNull() | (F.col("authorization") != "AUTHORIZED") | (F.col("source_category") == "UNAUTHORIZED_SOURCE")
    outside = ~F.col("source_category").isin(*OWN_BOOKS) if own_books else F.lit(False)
    return F.when(denied, NOT_AUTHORIZED).when(outside, OUT_OF_SCOPE).otherwise(IN_SCOPE)


def filters(**wanted: list) -> Column:
    """AND across filters, OR within one; a filter without values doesn't narrow."""
    out = F.lit(True)
    for name, values in wanted.items():
        if values:
            out = out & F.coalesce(F.col(name).isin(*values), F.lit(False))
    return out


def judged(kb: SimpleNamespace, rows: DataFrame, own_books: bool = False, narrow: Column | None = None) -> DataFrame:
    """Evidence rows with their verdict: the source's, then FILTERED by document, page, run and the like."""
    sources = kb.source.select(F.col("id").alias("source_id"), "authorization", "source_category")
    runs = kb.run.select(F.col("id").alias("extraction_run_id"), F.col("status").alias("run_status"), "extractor_version")
    joined = rows.join(sources, "source_id", "left").join(runs, "extraction_run_id", "left")
    verdict = source_verdict(own_books)
    if narrow is not None:
        verdict = F.when((verdict == IN_SCOPE) & ~narrow, FILTERED).otherwise(verdict)
    return joined.withColumn("verdict", verdict)


def lifecycle_allows(include_superseded: bool = False, wanted: list | None = None) -> Column:
    """Archived and deleted rows never, superseded ones only if asked for; an explicit list overrides both."""
    status = F.col("lifecycle_status")
    if wanted:
        return status.isin(*wanted)
    return ~status.isin(*LEFT_OUT, *([] if include_superseded else ["SUPERSEDED"]))


def judge_items(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """items (item_id) with n_in_scope and reason: null if visible, else no evidence, filtered, or not authorized."""
    per = verdicts.groupBy(F.col("subject_id").alias("item_id")).agg(F.sum((F.col("verdict") == IN_SCOPE).cast("long")).alias("n_in_scope"), F.max((F.col("verdict") == FILTERED).cast("int")).alias("filtered"))
    seen = F.coalesce(F.col("n_in_scope"), F.lit(0))
    reason = F.when(seen > 0, F.lit(None)).when(F.col("n_in_scope").isNull(), "no evidence").when(F.col("filtered") == 1, "filtered").otherwise("not authorized")
    return items.join(per, "item_id", "left").select(*items.columns, seen.alias("n_in_scope"), reason.alias("reason"))


def withheld(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """One row of six counts: evidence rows by verdict, items by reason."""
    count = lambda c, v: F.coalesce(F.sum((F.col(c) == v).cast("long")), F.lit(0))
    rows = verdicts.agg(count("verdict", NOT_AUTHORIZED).alias("rows_not_authorized"), count("verdict", OUT_OF_SCOPE).alias("rows_out_of_scope"), count("verdict", FILTERED).alias("rows_filtered"))
    kept = items.agg(count("reason", "not authorized").alias("items_not_authorized"), count("reason", "no evidence").alias("items_no_evidence"), count("reason", "filtered").alias("items_filtered"))
    return rows.join(F.broadcast(kept))


def position(rows: DataFrame) -> DataFrame:
    """Per subject, where its first evidence stands: document, page, place, number; missing places last."""
    last = F.lit(1 << 40)
    key = F.struct(counter("document_id").alias("document_n"), F.coalesce(F.col("page_number").cast("long"), last).alias("page"), F.coalesce(F.col("char_start").cast("long"), last).alias("start"), counter("id").alias("n"))
    return rows.groupBy("subject_id").agg(F.min(key).alias("at")).select("subject_id", "at.*")


def on_page(kb: SimpleNamespace, document_id: str, page: int) -> DataFrame:
    """Evidence on a page with the language of its segment, by place; rows without a segment come last."""
    rows = evidence(kb).where((F.col("document_id") == document_id) & (F.col("page_number") == page))
    segments = kb.segment.select(F.col("id").alias("segment_id"), F.col("lang").alias("segment_lang"))
    return rows.join(segments, "segment_id", "left").orderBy(F.asc_nulls_last("segment_id"), "char_start", counter("id"))
