"""What may be used in a derivation: which nodes are available, which requirements may be seen, what they lead to."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import evidence as E
from quillspark.operators.answers import visible_edges
from quillspark.operators.catalogue import concept_conflicts
from quillspark.operators.graph import derivable, derivation_steps, missing_nodes, states

Base = SimpleNamespace
#: The types that a requirement has.
REQUIREMENTS = ("REQUIRES", "DEPENDS_ON")


def availability(kb: Base, own_books: bool = False) -> DataFrame:
    """(id, status, n_in_scope) of every knowledge object that a request may name: AVAILABLE, or why not: NO_EVIDENCE, OUT_OF_SCOPE, NOT_AUTHORIZED, EXCLUDED_BY_LIFECYCLE, the first that holds."""
    rows = E.judged(kb, E.evidence(kb), own_books).where("subject_kind = 'KNOWLEDGE'").groupBy(F.col("subject_id").alias("id")).agg(F.count_if(F.col("verdict") == E.IN_SCOPE).alias("seen"), F.count_if(F.col("verdict") == E.OUT_OF_SCOPE).alias("out"))
    k = kb.knowledge.select("id", "lifecycle_status").join(rows, "id", "left")
    status = F.when(F.col("seen").isNull(), "NO_EVIDENCE").when((F.col("seen") == 0) & (F.col("out") > 0), "OUT_OF_SCOPE").when(F.col("seen") == 0, "NOT_AUTHORIZED").when(F.col("lifecycle_status").isin("ARCHIVED", "DELETED"), "EXCLUDED_BY_LIFECYCLE").otherwise("AVAILABLE")
    return k.select("id", status.alias("status"), F.coalesce("seen", F.lit(0)).alias("n_in_scope"))


def requirements(kb: Base, own_books: bool = False) -> DataFrame:
    """(src, dst) of the requirements that may be used: active, and shown by evidence in scope."""
    return visible_edges(kb, own_books).where(F.col("relation_type").isin(*REQUIREMENTS)).select("src", "dst").distinct()


def requirement_counts(kb: Base, own_books: bool = False) -> DataFrame:
    """(node, n_usable, n_withheld, n_excluded) of every concept with requirements: seen, active but not to be seen, and no longer active."""
    seen = visible_edges(kb, own_books).select("id", F.lit(True).alias("seen"))
    e = kb.edge.where(F.col("relation_type").isin(*REQUIREMENTS)).join(seen, "id", "left")
    active = F.col("lifecycle_status") == "ACTIVE"
    return e.groupBy(F.col("from_concept_id").alias("node")).agg(F.count_if(active & F.col("seen").isNotNull()).alias("n_usable"), F.count_if(active & F.col("seen").isNull()).alias("n_withheld"), F.count_if(~active).alias("n_excluded"))


def evaluated(kb: Base, available: DataFrame, own_books: bool = False) -> DataFrame:
    """(node, state, round) of derivation over the requirements that may be used; nodes in conflict come first, and nodes of which a requirement is withheld or excluded are blocked."""
    counts = requirement_counts(kb, own_books)
    lacking = counts.where("n_withheld + n_excluded > 0").select("node")
    clash = concept_conflicts(kb).select(F.col("concept_id").alias("node")).distinct()
    return states(requirements(kb, own_books), available, clash, lacking)


def answer(kb: Base, available: DataFrame, own_books: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The numbered steps, the missing nodes with what requires them, and all that can be derived from what is available."""
    edges = requirements(kb, own_books)
    found = evaluated(kb, available, own_books)
    return derivation_steps(found), missing_nodes(found, edges), derivable(edges, available)
