"""Answers in scope: labels of edges, closures over visible edges, pages, items with their first evidence, provenance, merges."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import counter
from quillspark.operators import evidence as E
from quillspark.functions.text import normalised
from quillspark.operators.graph import reachable
from quillspark.operators.validation import equation_problem

Base = SimpleNamespace


def visible_edges(kb: Base, own_books: bool = False) -> DataFrame:
    """(id, src, dst, relation_type, label) of active edges that an occurrence or a basis in scope shows: EXPLICIT, the rule's name, or INFERRED."""
    rows = E.judged(kb, E.evidence(kb), own_books).where(F.col("verdict") == E.IN_SCOPE)
    seen = rows.where("subject_kind = 'RELATIONSHIP'").select(F.col("subject_id").alias("id")).distinct().withColumn("own", F.lit(True))
    based = kb.basis.join(rows.select(F.col("id").alias("basis_occurrence_id")), "basis_occurrence_id", "left_semi").groupBy(F.col("relationship_id").alias("id")).agg(F.min("rule").alias("rule"))
    e = kb.edge.where("lifecycle_status = 'ACTIVE'").join(seen, "id", "left").join(based, "id", "left").where("own or rule is not null")
    label = F.when(F.col("origin") == "EXPLICIT", "EXPLICIT").otherwise(F.coalesce("rule", F.lit("INFERRED")))
    return e.select("id", F.col("from_concept_id").alias("src"), F.coalesce("to_concept_id", "to_knowledge_id").alias("dst"), "relation_type", label.alias("label"))


def scoped_closure(kb: Base, seeds: DataFrame, types: list[str], upward: bool = False, own_books: bool = False) -> DataFrame:
    """(seed, node) over edges that may be seen; a seed is never in its own closure."""
    e = visible_edges(kb, own_books).where(F.col("relation_type").isin(*types)).select("src", "dst").distinct()
    e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if upward else e
    return reachable(e, seeds).where("seed <> node")


def by_id(kb: Base, identifiers: list[str]) -> DataFrame:
    """(id, kind, title, status) of documents, concepts, statements and edges with these identifiers."""
    of = [(kb.document, "DOCUMENT", "filename", "processing_status"), (kb.concept, "CONCEPT", "canonical_name", "lifecycle_status"), (kb.knowledge, "KNOWLEDGE", "statement", "lifecycle_status"), (kb.edge, "RELATIONSHIP", "relation_type", "lifecycle_status")]
    return reduce(DataFrame.union, (df.where(F.col("id").isin(*identifiers)).select("id", F.lit(k).alias("kind"), F.col(t).alias("title"), F.col(s).alias("status")) for df, k, t, s in of))


def page_answer(kb: Base, document_id: str, page: int) -> DataFrame:
    """Evidence on a page by verdict, with the number of different subjects: what is shown and what is withheld."""
    rows = E.evidence(kb).where((F.col("document_id") == document_id) & (F.col("page_number") == page))
    return E.judged(kb, rows).groupBy("verdict").agg(F.count("*").alias("n_rows"), F.countDistinct("subject_id").alias("n_subjects"))


def document_sources(kb: Base) -> DataFrame:
    """Sources of each document that may be seen, and how many share its content."""
    shared = kb.source.groupBy("file_hash").agg(F.count("*").alias("n_same_content"))
    seen = kb.source.withColumn("verdict", E.source_verdict(False)).where(F.col("verdict") == E.IN_SCOPE)
    return seen.join(shared, "file_hash").select("document_id", F.col("id").alias("source_id"), "source_category", "n_same_content")


def items(kb: Base, own_books: bool = False, quote: int = 400) -> DataFrame:
    """Statements that may be seen, with their first evidence in scope, number of sources, owners and doubt."""
    rows = E.judged(kb, E.evidence(kb).where("subject_kind = 'KNOWLEDGE'"), own_books).where(F.col("verdict") == E.IN_SCOPE)
    place = F.struct(counter("document_id").alias("d"), "page_number", "char_start", counter("id").alias("n"), "id", F.substring("text", 1, quote).alias("quote"))
    per = rows.groupBy(F.col("subject_id").alias("id")).agg(F.min(place).alias("p"), F.countDistinct("source_id").alias("n_sources"))
    owners = kb.edge.where("lifecycle_status = 'ACTIVE' and to_knowledge_id is not null").groupBy(F.col("to_knowledge_id").alias("id")).agg(F.count("*").alias("n_owners"), F.min("from_concept_id").alias("first_owner"))
    k = kb.knowledge.where(E.lifecycle_allows()).join(per, "id").join(owners, "id", "left")
    return k.select("id", "knowledge_type", "n_sources", F.col("p.id").alias("evidence_id"), F.col("p.quote").alias("quote"), F.coalesce("n_owners", F.lit(0)).alias("n_owners"), "first_owner", (F.col("certainty") == "UNCERTAIN").alias("doubtful"))


def provenance(kb: Base, subjects: DataFrame, least_version: int = 4) -> DataFrame:
    """Runs behind the evidence of subjects (subject_id), with notes on partial ones and old extractors."""
    used = E.evidence(kb).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi").groupBy(F.col("extraction_run_id").alias("id")).agg(F.count("*").alias("n_evidence"))
    notes = F.concat_ws("; ", F.when(F.col("status") == "PARTIAL", "partial run"), F.when(F.col("extractor_version") < least_version, "old extractor"))
    return kb.run.join(used, "id").select("id", "document_id", "n_evidence", notes.alias("notes"))


def merged(statements: DataFrame, groups: DataFrame) -> DataFrame:
    """statements (id, lifecycle_status) after a merge: members other than the canonical one of their group (id, canonical_id) are superseded and point to it."""
    g = statements.join(groups, "id", "left")
    over = F.coalesce(F.col("canonical_id") != F.col("id"), F.lit(False)) & (F.col("lifecycle_status") == "ACTIVE")
    return g.select("id", F.when(over, "SUPERSEDED").otherwise(F.col("lifecycle_status")).alias("lifecycle_status"), F.when(over, F.col("canonical_id")).alias("superseded_by"))


def index_status(now: DataFrame, then: DataFrame) -> DataFrame:
    """Per table of two state markers (table_name, n_rows, last_number): FRESH, STALE where they differ, MISSING where there was none."""
    t = then.select("table_name", F.col("n_rows").alias("r"), F.col("last_number").alias("l"))
    status = F.when(F.col("r").isNull(), "MISSING").when((F.col("r") == F.col("n_rows")) & (F.col("l") == F.col("last_number")), "FRESH").otherwise("STALE")
    return now.join(t, "table_name", "left").select("table_name", status.alias("status"))


def superseded_pointers(kb: Base) -> DataFrame:
    """(id, canonical_id) of statements that an exact-duplicate record points from; the first by number."""
    return kb.equivalence.where("outcome = 'EXACT_DUPLICATE'").groupBy(F.col("other_knowledge_id").alias("id")).agg(F.min(F.struct(counter("canonical_knowledge_id").alias("n"), F.col("canonical_knowledge_id").alias("c"))).alias("m")).select("id", F.col("m.c").alias("canonical_id"))


def endpoints_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates (document_id, subject, object) with `broken`: whether one of the two is no concept that the document defines (document_id, name), as names are compared."""
    k = known.select("document_id", normalised(F.col("name")).alias("name")).distinct()
    one = lambda c: k.select("document_id", F.col("name").alias(f"_{c}"), F.lit(True).alias(f"_has_{c}"))
    d = candidates.withColumn("_subject", normalised(F.col("subject"))).withColumn("_object", normalised(F.col("object")))
    d = d.join(one("subject"), ["document_id", "_subject"], "left").join(one("object"), ["document_id", "_object"], "left")
    return d.select(*candidates.columns, (F.col("_has_subject").isNull() | F.col("_has_object").isNull()).alias("broken"))


def readiness(equations: DataFrame, top: int = 6) -> DataFrame:
    """The most frequent reasons why equations (expression) are unreadable, with counts, ties by reason."""
    found = equations.select(equation_problem(F.col("expression")).alias("reason")).where("reason is not null")
    return found.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def unknown_symbols(equations: DataFrame, introduced: DataFrame) -> DataFrame:
    """Left-hand symbols of a document (document_id, page_number, symbol) that nothing introduces (document_id, symbol), once each by normal form, where they first stand."""
    left = equations.withColumn("key", normalised(F.col("symbol"))).join(introduced.select("document_id", normalised(F.col("symbol")).alias("key")).distinct(), ["document_id", "key"], "left_anti")
    w = W.partitionBy("document_id", "key").orderBy("page_number", "symbol")
    return left.withColumn("r", F.row_number().over(w)).where("r = 1").select("document_id", "page_number", "symbol")




def quantity(piece: Column) -> Column:
    """struct(name, value, unit) of `the voltage is 10 volts`; null for anything else."""
    p = r"(?i)^(?:the\s+)?([a-z][a-z ]*?)\s+(?:is|=|equals)\s+([+-]?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-zΩμ°%/^0-9-]*)$"
    return F.when(piece.rlike(p), F.struct(F.regexp_extract(piece, p, 1).alias("name"), F.regexp_extract(piece, p, 2).alias("value"), F.regexp_extract(piece, p, 3).alias("unit")))
