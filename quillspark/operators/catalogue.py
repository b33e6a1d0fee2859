"""Look-ups, joins and counts over the knowledge base."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import counter, pair
from quillspark.operators.evidence import LEFT_OUT, evidence

Base = SimpleNamespace


def _active(df: DataFrame) -> DataFrame:
    return df.where(F.col("lifecycle_status") == "ACTIVE")


def concepts_by_alias(kb: Base, name: str) -> DataFrame:
    """Concepts with an active alias of that normalised name: all of them, by number, with the alias."""
    a = _active(kb.alias).where(F.col("normalized_alias") == name).select(F.col("concept_id").alias("id"), "alias")
    return kb.concept.join(a, "id").select("id", "canonical_name", "lifecycle_status", "alias")


def attached_knowledge(kb: Base, inactive: bool = False) -> DataFrame:
    """Concepts with the statements that an edge attaches to them."""
    e = kb.edge if inactive else _active(kb.edge)
    k = kb.knowledge.where(~F.col("lifecycle_status").isin(*LEFT_OUT)).select(F.col("id").alias("to_knowledge_id"), "knowledge_type", "canonical_name", F.col("lifecycle_status").alias("knowledge_status"))
    return e.join(k, "to_knowledge_id").select(F.col("from_concept_id").alias("concept_id"), "relation_type", F.col("to_knowledge_id").alias("knowledge_id"), "knowledge_type", "canonical_name", "knowledge_status")


def concepts_only_in_run(kb: Base) -> DataFrame:
    """(run, concept) where all of a concept's occurrences are from that one run."""
    per = kb.concept_occurrence.groupBy("concept_id").agg(F.min("extraction_run_id").alias("lo"), F.max("extraction_run_id").alias("hi"))
    return per.where("lo = hi").select(F.col("lo").alias("extraction_run_id"), "concept_id")


def integrity(kb: Base) -> DataFrame:
    """Counts of what the graph must not hold: explicit edges without an occurrence, aliases without a concept, inferred edges without a basis, statements without evidence."""
    one = lambda name, df: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    e = kb.edge
    bare = e.where("origin = 'EXPLICIT'").join(kb.edge_occurrence.select(F.col("relationship_id").alias("id")), "id", "left_anti")
    orphan = kb.alias.join(kb.concept.select(F.col("id").alias("concept_id")), "concept_id", "left_anti")
    baseless = e.where("origin = 'INFERRED'").join(kb.basis.select(F.col("relationship_id").alias("id")), "id", "left_anti")
    unseen = kb.knowledge.join(kb.source_occurrence.select(F.col("knowledge_id").alias("id")), "id", "left_anti")
    return one("explicit_without_occurrence", bare).union(one("alias_without_concept", orphan)).union(one("inferred_without_basis", baseless)).union(one("knowledge_without_evidence", unseen))


def definitions(kb: Base) -> DataFrame:
    """Definitions seen in a run, with their number of definers and occurrences there."""
    definers = kb.edge.where("relation_type = 'DEFINED_BY'").groupBy(F.col("to_knowledge_id").alias("id")).agg(F.count("*").alias("n_definers"))
    seen = kb.source_occurrence.groupBy("extraction_run_id", F.col("knowledge_id").alias("id")).agg(F.count("*").alias("n_occurrences"))
    return kb.knowledge.where("knowledge_type = 'DEFINITION'").select("id").join(seen, "id").join(definers, "id", "left").select("extraction_run_id", F.col("id").alias("knowledge_id"), F.coalesce("n_definers", F.lit(0)).alias("n_definers"), "n_occurrences")


def edges_among(kb: Base, concepts: DataFrame, types: list[str]) -> DataFrame:
    """Active edges of some types with both ends among concepts (id)."""
    e = _active(kb.edge).where(F.col("relation_type").isin(*types))
    return e.join(concepts.select(F.col("id").alias("from_concept_id")), "from_concept_id", "left_semi").join(concepts.select(F.col("id").alias("to_concept_id")), "to_concept_id", "left_semi").select("id", "relation_type", "from_concept_id", "to_concept_id")


def linked_objects(kb: Base) -> DataFrame:
    """Per run, statements that another run has evidence of as well. A statement's runs are counted once, so no pairs of rows arise."""
    runs = kb.source_occurrence.select("knowledge_id", "extraction_run_id").distinct()
    shared = runs.groupBy("knowledge_id").agg(F.count("*").alias("n")).where("n > 1")
    return runs.join(shared, "knowledge_id").groupBy("extraction_run_id").agg(F.countDistinct("knowledge_id").alias("n_linked"))


def edges_between(kb: Base, relation: str) -> DataFrame:
    """Active edges of a type by unordered pair of concepts."""
    lo, hi = pair(F.col("from_concept_id"), F.col("to_concept_id"))
    e = _active(kb.edge).where((F.col("relation_type") == relation) & F.col("to_concept_id").isNotNull())
    return e.groupBy(lo.alias("concept_a"), hi.alias("concept_b")).agg(F.count("*").alias("n_edges"), F.min("id").alias("first_id"))


def concept_links(kb: Base) -> DataFrame:
    """(concept name, relation, statement) of active links between active concepts and statements."""
    c = _active(kb.concept).select(F.col("id").alias("from_concept_id"), F.col("canonical_name").alias("concept_name"))
    k = _active(kb.knowledge).select(F.col("id").alias("to_knowledge_id"), "statement")
    return _active(kb.edge).join(c, "from_concept_id").join(k, "to_knowledge_id").select("concept_name", "relation_type", "statement")


def active_aliases(kb: Base) -> DataFrame:
    c = _active(kb.concept).select(F.col("id").alias("concept_id"))
    return _active(kb.alias).join(c, "concept_id").select("concept_id", "normalized_alias")


def located(kb: Base) -> DataFrame:
    """Statements, active, with evidence that has a segment and a span."""
    k = _active(kb.knowledge).select(F.col("id").alias("knowledge_id"), "knowledge_type")
    return kb.source_occurrence.where("segment_id is not null and char_start is not null").join(k, "knowledge_id").select("knowledge_id", "knowledge_type", "segment_id", "page_number", "char_start", "char_end")


#: Parts that the rows of a name are dealt into, and tasks of the join of names.
_DEALT, _TASKS = 16, 200


def name_pairs(named: DataFrame, fits: Column) -> DataFrame:
    """Pairs of rows a and b of named (concept_id, name, ...) that share a name and that fits holds for: all columns of a and b, each pair of concepts once, at the first name that it shares.

    fits reads a.* and b.*. A pair that shares several names is dropped where it meets, by the names that each concept
    carries, so no task holds pairs. The rows of a name are dealt out, since a few names may make nearly all pairs.
    """
    names = named.groupBy("concept_id").agg(F.collect_set("name").alias("names"))
    rows = named.join(names, "concept_id")
    a = rows.withColumn("dealt", F.pmod(F.xxhash64("concept_id"), F.lit(_DEALT)).cast("int")).repartition(_TASKS, "name", "dealt").alias("a")
    b = rows.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1)))).repartition(_TASKS, "name", "dealt").alias("b")
    met = a.hint("merge").join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.dealt") == F.col("b.dealt")) & (F.col("a.concept_id") != F.col("b.concept_id")) & fits)
    several = (F.size("a.names") > 1) & (F.size("b.names") > 1)
    return met.where(~several | (F.col("a.name") == F.array_min(F.array_intersect("a.names", "b.names"))))


def equivalent_pairs(kb: Base, recorded: DataFrame | None = None) -> DataFrame:
    """Unordered pairs of active concepts that share an active alias and no run, less those that are recorded (a, b) in either order: (concept_a, concept_b, shared_name), the first alias."""
    runs = kb.concept_occurrence.groupBy("concept_id").agg(F.collect_set("extraction_run_id").alias("runs"))
    named = active_aliases(kb).select("concept_id", F.col("normalized_alias").alias("name")).distinct().join(runs, "concept_id")
    fits = (F.col("a.concept_id") < F.col("b.concept_id")) & ~F.arrays_overlap("a.runs", "b.runs")
    if recorded is not None:
        known = recorded.select(F.least("a", "b").alias("concept_id"), F.greatest("a", "b").alias("other")).groupBy("concept_id").agg(F.collect_set("other").alias("recorded"))
        named = named.join(known, "concept_id", "left").withColumn("recorded", F.coalesce("recorded", F.array().cast("array<string>")))
        fits = fits & ~F.array_contains("a.recorded", F.col("b.concept_id"))
    return name_pairs(named, fits).select(F.col("a.concept_id").alias("concept_a"), F.col("b.concept_id").alias("concept_b"), F.col("a.name").alias("shared_name"))


def evidence_context(kb: Base, subjects: DataFrame) -> DataFrame:
    """Sources, documents and runs that the evidence of subjects (subject_id) names, each once."""
    e = evidence(kb).join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    one = lambda kind, c: e.select(F.lit(kind).alias("kind"), F.col(c).alias("id")).where("id is not null").distinct()
    return one("source", "source_id").union(one("document", "document_id")).union(one("run", "extraction_run_id"))


def issue_counts(kb: Base) -> DataFrame:
    return kb.issue.groupBy("extraction_run_id", "issue_type").agg(F.count("*").alias("n"))


def knowledge_type_counts(kb: Base) -> DataFrame:
    """Per run and type, the distinct statements that it has evidence of."""
    k = kb.knowledge.select(F.col("id").alias("knowledge_id"), "knowledge_type")
    return kb.source_occurrence.join(k, "knowledge_id").groupBy("extraction_run_id", "knowledge_type").agg(F.countDistinct("knowledge_id").alias("n"))


def edge_counts(kb: Base) -> DataFrame:
    e = kb.edge.select(F.col("id").alias("relationship_id"), "relation_type", "origin")
    return kb.edge_occurrence.join(e, "relationship_id").groupBy("extraction_run_id", "relation_type", "origin").agg(F.countDistinct("relationship_id").alias("n"))


def concept_counts(kb: Base) -> DataFrame:
    return kb.concept_occurrence.groupBy("extraction_run_id").agg(F.countDistinct("concept_id").alias("n_concepts"))


def next_run_numbers(kb: Base) -> DataFrame:
    """Per document, the number of its next run; 1 for documents without runs."""
    last = kb.run.groupBy("document_id").agg(F.max("run_number").alias("last"))
    return kb.document.select(F.col("id").alias("document_id")).join(last, "document_id", "left").select("document_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("next_run"))


def duplicate_counts(kb: Base) -> DataFrame:
    """Per run, possible duplicates and contradictions."""
    e = kb.equivalence.where(~F.col("outcome").isin("EXACT_DUPLICATE"))
    return e.groupBy("extraction_run_id").agg(F.sum((F.col("outcome") == "POSSIBLE_DUPLICATE").cast("long")).alias("possible"), F.sum((F.col("outcome") == "CONTRADICTORY").cast("long")).alias("contradictory"))


def state_marker(kb: Base) -> DataFrame:
    """Rows and last number of each table that the index covers."""
    tables = [("knowledge", kb.knowledge), ("source_occurrence", kb.source_occurrence), ("concept_occurrence", kb.concept_occurrence), ("alias", kb.alias.withColumnRenamed("concept_id", "id")), ("segment", kb.segment)]
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.coalesce(F.max(counter("id")), F.lit(0)).alias("last_number")) for name, df in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def text_volume(kb: Base) -> DataFrame:
    """Rows and bytes of the texts that the index covers."""
    texts = kb.knowledge.select("statement").union(kb.source_occurrence.select("text")).union(kb.alias.select("normalized_alias")).union(kb.segment.select("text"))
    return texts.agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("statement").cast("long")).alias("n_bytes"))


def first_evidence(kb: Base) -> DataFrame:
    """Per statement: its rows of evidence, distinct sources, and the first row by document, page, place and number."""
    w = W.partitionBy("knowledge_id").orderBy(counter("document_id"), "page_number", "char_start", counter("id"))
    e = kb.source_occurrence
    first = e.withColumn("r", F.row_number().over(w)).where("r = 1").select("knowledge_id", F.col("id").alias("first_id"), F.col("text").alias("quote"))
    return e.groupBy("knowledge_id").agg(F.count("*").alias("n_evidence"), F.countDistinct("source_id").alias("n_sources")).join(first, "knowledge_id")


def review(kb: Base) -> DataFrame:
    """Occurrences and distinct sources of a statement and of everything superseded into it."""
    into = kb.equivalence.where("outcome = 'EXACT_DUPLICATE'").select(F.col("other_knowledge_id").alias("knowledge_id"), F.col("canonical_knowledge_id").alias("id"))
    members = kb.knowledge.select(F.col("id").alias("knowledge_id"), "id").union(into)
    o = kb.source_occurrence.select("knowledge_id", "source_id")
    return members.join(o, "knowledge_id").groupBy(F.col("id").alias("canonical_id")).agg(F.count("*").alias("n_occurrences"), F.countDistinct("source_id").alias("n_sources"))


def inventory(kb: Base) -> DataFrame:
    """Statements by type: all, uncertain, and in an active conflict."""
    in_conflict = kb.conflict.where(F.col("lifecycle_status") == "ACTIVE").select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("id")).distinct().withColumn("open", F.lit(1))
    k = kb.knowledge.where(~F.col("lifecycle_status").isin(*LEFT_OUT)).join(in_conflict, "id", "left")
    return k.groupBy("knowledge_type").agg(F.count("*").alias("n"), F.sum((F.col("certainty") == "UNCERTAIN").cast("long")).alias("n_uncertain"), F.sum(F.coalesce("open", F.lit(0)).cast("long")).alias("n_in_conflict"))


def document_summaries(kb: Base) -> DataFrame:
    """Per document with runs: its latest run and status, statements of that run, issues of all its runs."""
    latest = kb.run.groupBy("document_id").agg(F.max(F.struct("run_number", "id", "status")).alias("r")).select("document_id", F.col("r.id").alias("run_id"), F.col("r.status").alias("run_status"))
    stored = kb.source_occurrence.groupBy(F.col("extraction_run_id").alias("run_id")).agg(F.countDistinct("knowledge_id").alias("n_stored"))
    issues = kb.issue.groupBy("document_id").agg(F.count("*").alias("n_issues"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return latest.join(stored, "run_id", "left").join(issues, "document_id", "left").select("document_id", "run_id", "run_status", zero("n_stored"), zero("n_issues"))


def issue_examples(kb: Base, k: int = 4) -> DataFrame:
    """The first k issues of each type and document, by page and number."""
    w = W.partitionBy("document_id", "issue_type").orderBy("page_number", counter("id"))
    return kb.issue.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("document_id", "issue_type", F.col("place").cast("long").alias("place"), "id", "detail")


def ingestion(kb: Base, least_version: int = 4) -> DataFrame:
    """Per document: parsed, extracted by a completed run of a version, and the reasons if it is not ready."""
    done = kb.run.groupBy("document_id").agg(F.max(((F.col("status") == "COMPLETED") & (F.col("extractor_version") >= least_version)).cast("int")).alias("done"))
    d = kb.document.select(F.col("id").alias("document_id"), (F.col("processing_status") == "PROCESSED").alias("parsed")).join(done, "document_id", "left")
    done_now = F.coalesce(F.col("done"), F.lit(0)) == 1
    reasons = F.concat_ws("; ", F.when(~F.col("parsed"), "not fully parsed"), F.when(~done_now, "no completed run"))
    return d.select("document_id", (F.col("parsed") & done_now).alias("ready"), reasons.alias("reasons"))


def conflicts(kb: Base) -> DataFrame:
    """Active conflicts with the statements of both claims."""
    k = kb.knowledge
    a, b = k.select(F.col("id").alias("claim_a_id"), F.col("statement").alias("claim_a")), k.select(F.col("id").alias("claim_b_id"), F.col("statement").alias("claim_b"))
    return kb.conflict.where(F.col("lifecycle_status") == "ACTIVE").join(a, "claim_a_id").join(b, "claim_b_id").select("id", "claim_a_id", "claim_a", "claim_b_id", "claim_b")


def concept_conflicts(kb: Base) -> DataFrame:
    """(concept_id, conflict_id, claim_a_id, claim_a, claim_b_id, claim_b): the conflicts in force about what a concept's edges lead to.

    Rows are judged by lifecycle alone; for a scope, pass tables of what is in it. A conflict stands once for each concept. A claim that is archived, deleted or unknown keeps its id and shows no
    statement. Only active edges count, and conflicts that are neither archived nor deleted. Nothing linked gives no rows.
    """
    usable = kb.knowledge.where(~F.col("lifecycle_status").isin(*LEFT_OUT)).select(F.col("id").alias("knowledge_id"), "statement")
    linked = kb.edge.where((F.col("lifecycle_status") == "ACTIVE") & F.col("to_knowledge_id").isNotNull()).select(F.col("from_concept_id").alias("concept_id"), F.col("to_knowledge_id").alias("knowledge_id"))
    linked = linked.distinct().join(usable, "knowledge_id", "left_semi")
    held = kb.conflict.where(~F.col("lifecycle_status").isin(*LEFT_OUT)).select(F.col("id").alias("conflict_id"), "claim_a_id", "claim_b_id")
    sides = held.withColumn("knowledge_id", F.explode(F.array_distinct(F.array("claim_a_id", "claim_b_id"))))
    found = linked.join(sides, "knowledge_id").select("concept_id", "conflict_id", "claim_a_id", "claim_b_id").distinct()
    for side in ("a", "b"):
        found = found.join(usable.toDF(f"claim_{side}_id", f"claim_{side}"), f"claim_{side}_id", "left")
    return found.select("concept_id", "conflict_id", "claim_a_id", "claim_a", "claim_b_id", "claim_b")


def compared_pairs(kb: Base) -> DataFrame:
    lo, hi = pair(F.col("canonical_knowledge_id"), F.col("other_knowledge_id"))
    return kb.equivalence.select(lo.alias("a"), hi.alias("b")).distinct()


def objects_of_types(kb: Base, types: list[str]) -> DataFrame:
    return kb.knowledge.where(F.col("knowledge_type").isin(*types) & ~F.col("lifecycle_status").isin(*LEFT_OUT)).select("id", "knowledge_type", "canonical_name")


def touching(kb: Base, concept_id: str) -> DataFrame:
    """Edges at a concept, with the end where it stands."""
    e = kb.edge
    ends = [(F.col("from_concept_id"), "FROM"), (F.col("to_concept_id"), "TO")]
    parts = [e.where(c == concept_id).select("id", "relation_type", F.lit(end).alias("at")) for c, end in ends]
    return parts[0].union(parts[1])


def exact_duplicate_groups(statements: DataFrame, key: Column) -> DataFrame:
    """statements (id, statement) with canonical_id, the first of those with the same key by number, and whether it is superseded."""
    g = statements.withColumn("key", key)
    first = g.groupBy("key").agg(F.min(F.struct(counter("id").alias("n"), "id")).alias("m"))
    return g.join(first, "key").select("id", F.col("m.id").alias("canonical_id"), (F.col("m.id") != F.col("id")).alias("superseded"))
