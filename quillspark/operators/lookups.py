"""Look-ups by key, run, document and side, each over all rows at once; views of a concept and what an answer rests on."""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import counter
from quillspark.operators import evidence as E

Base = SimpleNamespace

#: Issues that mean that something was discarded, so that a run is partial.
DISCARDING = ("MISSING_SOURCE_REFERENCE", "INVALID_EQUATION_STRUCTURE", "UNKNOWN_UNIT", "BROKEN_RELATIONSHIP", "OCR_UNCERTAINTY")
COMPANIONS = ("equation", "variable", "rule", "procedure")
#: The most items of a list, sources of an answer and passages that mention something.
MAX_ITEMS, MAX_SOURCES, MAX_MENTIONS = 5000, 5, 8


def equations_of_concepts(kb: Base) -> DataFrame:
    """(concept_id, relation_type, equation_id, expression) of the equations that active edges attach to concepts."""
    e = kb.edge.where("lifecycle_status = 'ACTIVE'").select(F.col("from_concept_id").alias("concept_id"), "relation_type", F.col("to_knowledge_id").alias("knowledge_id"))
    return e.join(kb.equation.select("knowledge_id", F.col("id").alias("equation_id"), "expression"), "knowledge_id").drop("knowledge_id")


def stated_pairs(kb: Base, *types: str) -> DataFrame:
    """(id, name_a, name_b) of the active explicit edges of some types between concepts, with both names."""
    e = kb.edge.where(F.col("relation_type").isin(*types) & (F.col("lifecycle_status") == "ACTIVE") & (F.col("origin") == "EXPLICIT"))
    name = lambda side: kb.concept.select(F.col("id").alias(f"{side}_id"), F.col("canonical_name").alias(f"name_{side}"))
    return e.join(name("a"), F.col("from_concept_id") == F.col("a_id")).join(name("b"), F.col("to_concept_id") == F.col("b_id")).select(e.id, "name_a", "name_b")


def claims_by_name_and_method(kb: Base, method_prefix: str) -> DataFrame:
    """(canonical_name, knowledge_id, occurrence_id) of what was obtained by a method, by the name of the object."""
    o = kb.source_occurrence.where(F.startswith("extraction_method", F.lit(method_prefix))).select("knowledge_id", F.col("id").alias("occurrence_id"))
    return o.join(kb.knowledge.select(F.col("id").alias("knowledge_id"), "canonical_name"), "knowledge_id").select("canonical_name", "knowledge_id", "occurrence_id")


def evidence_for_many(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject_id, n, evidence) of the evidence rows of all subjects (subject_id) at once, evidence the ids in document order."""
    found = rows.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    key = F.struct(counter("document_id").alias("d"), F.coalesce("page_number", F.lit(1 << 30)).alias("p"), F.coalesce("char_start", F.lit(1 << 30)).alias("c"), counter("id").alias("n"), "id")
    return found.groupBy("subject_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("x")).select("subject_id", "n", F.array_join("x.id", ",").alias("evidence"))


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with `place`, their number within the group in the order."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def companions(kb: Base) -> DataFrame:
    """(knowledge_id, kind, id, lifecycle_status): the rows that stand beside knowledge objects."""
    parts = [getattr(kb, t).select("knowledge_id", F.lit(t.upper()).alias("kind"), "id", "lifecycle_status") for t in COMPANIONS]
    return reduce(DataFrame.union, parts)


def active_companions(kb: Base) -> DataFrame:
    """Companions whose object is active, with its statement."""
    k = kb.knowledge.where("lifecycle_status = 'ACTIVE'").select(F.col("id").alias("knowledge_id"), "statement")
    return companions(kb).where("lifecycle_status = 'ACTIVE'").join(k, "knowledge_id").select("knowledge_id", "kind", "id", "statement")


def run_states(kb: Base) -> DataFrame:
    """(run_id, document_id, n_issues, partial, run_state, document_state): a run is partial if an issue discarded something; its document is then lowered from PROCESSED, and never raised."""
    issues = kb.issue.groupBy(F.col("extraction_run_id").alias("run_id")).agg(F.count("*").alias("n_issues"), F.max(F.col("issue_type").isin(*DISCARDING)).alias("partial"))
    rows = kb.run.select(F.col("id").alias("run_id"), "document_id", "status").join(issues, "run_id", "left").withColumn("partial", F.coalesce("partial", F.lit(False)))
    lowered = rows.groupBy("document_id").agg(F.max("partial").alias("any_partial"))
    docs = kb.document.select(F.col("id").alias("document_id"), "processing_status").join(lowered, "document_id", "left")
    state = F.when((F.col("processing_status") == "PROCESSED") & F.col("any_partial"), "PARTIALLY_PROCESSED").otherwise(F.col("processing_status"))
    rows = rows.join(docs.select("document_id", state.alias("document_state")), "document_id", "left")
    return rows.select("run_id", "document_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), "partial", F.when((F.col("status") == "COMPLETED") & F.col("partial"), "PARTIAL").otherwise(F.col("status")).alias("run_state"), "document_state")


def why_uncertain(method: Column) -> Column:
    """What makes a claim uncertain by the tags of its method; null if nothing does."""
    return (
        F.when(method.contains("+ocr"), "recognised from an image").when(method.contains("+weak"), "a general sentence shape, no defining verb").when(method.contains("+layout?"), "rebuilt from the layout of a page, with a doubt")
        .when(method.contains("EquationCandidate"), "a text layer can lose the layout of an equation")
    )


def withheld_status(items: DataFrame, group: str) -> DataFrame:
    """(group, status) for groups of judged items of which none may be shown: NOT_FOUND if a filter hid one, else INSUFFICIENT_AUTHORIZED_INFORMATION."""
    per = items.groupBy(group).agg(F.max(F.col("reason").isNull()).alias("some"), F.max(F.coalesce(F.col("reason") == "filtered", F.lit(False))).alias("filtered"))
    return per.where(~F.col("some")).select(group, F.when(F.col("filtered"), "NOT_FOUND").otherwise("INSUFFICIENT_AUTHORIZED_INFORMATION").alias("status"))


def concept_views(kb: Base) -> DataFrame:
    """Per concept, how many active aliases, definitions, equations, other edges and prerequisites it has, and where it occurs."""
    e = kb.edge.where("lifecycle_status = 'ACTIVE'")
    kinds = kb.knowledge.select(F.col("id").alias("to_knowledge_id"), "knowledge_type")
    out = e.join(kinds, "to_knowledge_id", "left").groupBy(F.col("from_concept_id").alias("id")).agg(
        F.count_if(F.col("relation_type") == "DEFINED_BY").alias("n_definitions"), F.count_if(F.col("knowledge_type") == "EQUATION").alias("n_equations"),
        F.count_if(F.col("to_concept_id").isNotNull()).alias("n_relationships"), F.count_if(F.col("relation_type") == "REQUIRES").alias("n_prerequisites"))
    names = kb.alias.where("lifecycle_status = 'ACTIVE'").groupBy(F.col("concept_id").alias("id")).agg(F.countDistinct("normalized_alias").alias("n_aliases"))
    seen = kb.concept_occurrence.groupBy(F.col("concept_id").alias("id")).agg(F.count("*").alias("n_occurrences"))
    rows = kb.concept.select("id").join(names, "id", "left").join(out, "id", "left").join(seen, "id", "left")
    return rows.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_aliases", "n_definitions", "n_equations", "n_relationships", "n_prerequisites", "n_occurrences")))


def traces(kb: Base, own_books: bool = False) -> DataFrame:
    """(concept_id, links, evidence, n_withheld): what an answer about each concept rests on: its links in order, the first ids of evidence in scope of what they lead to, and how many rows were withheld."""
    e = kb.edge.where("lifecycle_status = 'ACTIVE' and to_knowledge_id is not null").select(F.col("from_concept_id").alias("concept_id"), F.col("id").alias("link"), F.col("to_knowledge_id").alias("subject_id"))
    verdicts = E.judged(kb, E.evidence(kb), own_books).select("subject_id", "id", "verdict")
    per = verdicts.groupBy("subject_id").agg(F.min(F.when(F.col("verdict") == E.IN_SCOPE, F.struct(counter("id").alias("n"), "id"))).alias("first"), F.count_if(F.col("verdict") != E.IN_SCOPE).alias("withheld"))
    rows = e.join(per, "subject_id", "left").groupBy("concept_id").agg(F.sort_array(F.collect_set(F.struct(counter("link").alias("n"), "link"))).alias("l"), F.sort_array(F.collect_set("first")).alias("f"), F.sum(F.coalesce("withheld", F.lit(0))).alias("n_withheld"))
    return rows.select("concept_id", F.array_join("l.link", ",").alias("links"), F.array_join("f.id", ",").alias("evidence"), "n_withheld")


def capped(rows: DataFrame, group: str, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows of each group, with `truncated` where there were more."""
    w = W.partitionBy(group)
    counted = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > limit)
    return counted.where(F.col("place") <= limit)


def id_key(identifier: Column) -> Column:
    """Mixed identifiers in order: by prefix, then by number."""
    return F.struct(F.split_part(identifier, F.lit("-"), F.lit(1)).alias("prefix"), counter(identifier).alias("n"))


def distinct_in_order(values: Column) -> Column:
    """Each value where it stands first."""
    return F.array_distinct(values)


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as one JSON object, fields in the order of the columns, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
