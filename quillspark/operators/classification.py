"""Which concepts a run's definitions name, with the exact raw characters, and the relations that follow.

Names are met by their first word, never by all stretches of a text; each text's matches are then chosen longest first.
A match counts only if the raw characters it comes from normalise to the name again.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.alignment import with_alignment
from quillspark.functions.ids import pair
from quillspark.functions.text import normalised

Base = SimpleNamespace

#: A rule and its version as recorded, and the states of runs that nothing is classified from.
RULE, RULE_VERSION = "R1", 1
REFUSED = ("RUNNING", "FAILED", "CANCELLED")
_WORD = r"[\p{L}\p{N}]+"


def selected_runs(kb: Base, asked: DataFrame) -> DataFrame:
    """(request_id, run_id, problem) of requests (request_id, run_id, document_id): the named run, or the only one of the named document.

    Nothing is chosen for the user: BOTH_NAMED, NOTHING_NAMED, NO_SUCH_RUN, NO_RUN, SEVERAL_RUNS, or REFUSED_STATE for a
    run that did not end well.
    """
    runs = kb.run.select(F.col("id").alias("_run"), F.col("document_id").alias("_document"), "status")
    per = runs.groupBy("_document").agg(F.count("*").alias("n"), F.min("_run").alias("_only"))
    a = asked.select("request_id", "run_id", "document_id")
    a = a.join(per, a["document_id"] == per["_document"], "left").drop("_document")
    chosen = F.coalesce("run_id", F.when(F.col("n") == 1, F.col("_only")))
    a = a.withColumn("chosen", chosen).join(runs.select("_run", "status"), F.col("chosen") == F.col("_run"), "left")
    problem = (
        F.when(F.col("run_id").isNotNull() & F.col("document_id").isNotNull(), "BOTH_NAMED").when(F.col("run_id").isNull() & F.col("document_id").isNull(), "NOTHING_NAMED")
        .when(F.col("run_id").isNotNull() & F.col("status").isNull(), "NO_SUCH_RUN").when(F.col("n").isNull() & F.col("run_id").isNull(), "NO_RUN")
        .when(F.col("run_id").isNull() & (F.col("n") > 1), "SEVERAL_RUNS").when(F.col("status").isin(*REFUSED), "REFUSED_STATE")
    )
    return a.select("request_id", F.when(problem.isNull(), F.col("chosen")).alias("run_id"), problem.alias("problem"))


def definition_texts(kb: Base) -> DataFrame:
    """(run_id, knowledge_id, concept_id, occurrence_id, text, state) of the definitions of each run.

    READ if a definition has one active DEFINED_BY edge and one occurrence, and the run itself knows the concept;
    AMBIGUOUS with more edges or occurrences, OUTSIDE if the run doesn't know the concept. Only READ ones have a concept
    and a text.
    """
    edges = kb.edge.where("relation_type = 'DEFINED_BY' and lifecycle_status = 'ACTIVE'").groupBy(F.col("to_knowledge_id").alias("knowledge_id")).agg(F.count("*").alias("n_edges"), F.min("from_concept_id").alias("concept_id"))
    places = kb.source_occurrence.groupBy("knowledge_id").agg(F.count("*").alias("n_places"), F.min("id").alias("occurrence_id"), F.min_by("text", "id").alias("text"))
    of_run = kb.source_occurrence.select(F.col("extraction_run_id").alias("run_id"), "knowledge_id").distinct()
    d = of_run.join(kb.knowledge.where("knowledge_type = 'DEFINITION'").select(F.col("id").alias("knowledge_id")), "knowledge_id").join(edges, "knowledge_id").join(places, "knowledge_id")
    known = kb.concept_occurrence.select(F.col("extraction_run_id").alias("run_id"), "concept_id").distinct().withColumn("known", F.lit(True))
    d = d.join(known, ["run_id", "concept_id"], "left")
    state = F.when((F.col("n_edges") != 1) | (F.col("n_places") != 1), "AMBIGUOUS").when(F.col("known").isNull(), "OUTSIDE").otherwise("READ")
    read = lambda c: F.when(state == "READ", F.col(c)).alias(c)
    return d.select("run_id", "knowledge_id", read("concept_id"), read("occurrence_id"), read("text"), state.alias("state"))


def name_table(aliases: DataFrame) -> DataFrame:
    """(name, concepts, first, lead) from (concept_id, normalized_alias): each normal form with its concepts, its first word and what stands before that."""
    n = aliases.where("normalized_alias <> ''").groupBy(F.col("normalized_alias").alias("name")).agg(F.sort_array(F.collect_set("concept_id")).alias("concepts"))
    return n.withColumn("first", F.regexp_extract("name", _WORD, 0)).withColumn("lead", F.expr("instr(name, first) - 1")).where("first <> ''")


def located(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text_id, own, name, concepts, start, end, raw_start, raw_end, matched, outcome) of the names (see name_table) in texts (text_id, own, text).

    A match has no letter or digit at either side; longer names come first, then smaller ones, then earlier places, and
    what overlaps a chosen match is dropped, whatever becomes of it: AMBIGUOUS if several concepts bear the name, OWN if
    it is the text's own concept, UNMAPPABLE if its raw characters don't normalise to the name, else MENTION. start and
    end count in the normal form, raw_start and raw_end in the text, which only mentions have. Texts without a proved
    alignment are matched all the same.
    """
    t = with_alignment(texts.select("text_id", "own", "text"), "text").withColumn("norm", F.coalesce("norm", normalised(F.col("text"))))
    words = t.select("text_id", "own", "norm", F.explode(_words(F.col("norm"))).alias("w")).select("text_id", "own", "norm", F.col("w.at").alias("at"), F.col("w.word").alias("first"))
    met = words.join(known, "first").withColumn("start", F.col("at") - F.col("lead")).withColumn("end", F.col("start") + F.length("name")).where("start >= 0")
    side = lambda at: F.regexp_like(F.substring(F.col("norm"), at, F.lit(1)), F.lit(r"^[\p{L}\p{N}]$"))
    met = met.where(F.substring("norm", F.col("start") + 1, F.length("name")) == F.col("name")).where(~((F.col("start") > 0) & side(F.col("start"))) & ~side(F.col("end") + 1))
    per = met.groupBy("text_id", "own").agg(F.array_sort(F.collect_set(F.struct((F.col("start") - F.col("end")).alias("longest"), "name", "start", "end", "concepts"))).alias("m"))

    def choose(a: Column, x: Column) -> Column:
        clash = F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return F.when(clash, a).otherwise(F.concat(a, F.array(x)))

    chosen = per.select("text_id", "own", F.explode(F.aggregate("m", F.slice("m", 1, 0), choose)).alias("x")).select("text_id", "own", "x.name", "x.concepts", "x.start", "x.end")
    # merged, since the places of a text's characters take far more than the text that Spark measures
    d = chosen.join(t.select("text_id", "text", "begins", "ends").hint("merge"), "text_id")
    d = d.withColumn("_a", F.get("begins", F.col("start"))).withColumn("_b", F.get("ends", F.col("end") - 1))
    d = d.withColumn("_raw", F.substring(F.col("text"), F.col("_a") + 1, F.col("_b") - F.col("_a")))
    proved = F.coalesce(normalised(F.col("_raw")) == F.col("name"), F.lit(False))
    outcome = F.when(F.size("concepts") > 1, "AMBIGUOUS").when(F.get("concepts", F.lit(0)).eqNullSafe(F.col("own")), "OWN").when(~proved, "UNMAPPABLE").otherwise("MENTION")
    d = d.withColumn("outcome", outcome)
    only = lambda c, name: F.when(F.col("outcome") == "MENTION", F.col(c)).alias(name)
    return d.select("text_id", "own", "name", "concepts", "start", "end", only("_a", "raw_start"), only("_b", "raw_end"), only("_raw", "matched"), "outcome")


def _words(text: Column) -> Column:
    """array<struct<at, word>>: the runs of letters and digits with their places."""
    gaps = F.split(text, _WORD, -1)
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    step = lambda a, x: F.struct((a["at"] + F.length(x["gap"]) + F.length(x["word"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("at"), x["word"].alias("word")))).alias("out"))
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(words)).alias("gap"), words.alias("word"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,word:string>>").alias("out")), step, lambda a: a["out"])


def outcomes(found: DataFrame, edges: DataFrame, recorded: DataFrame) -> DataFrame:
    """(concept_a, concept_b, outcome, n_bases, n_added) of each unordered pair of a text's concept and one that it mentions.

    found: see located, with text_id the occurrence; edges: (id, origin, concept_a, concept_b) of active RELATED_TO edges
    in either order; recorded: (relationship_id, basis_occurrence_id, matched_text) of what this rule has written before.
    EXPLICIT_EXISTS writes nothing; else CREATED, or BASIS_ADDED to the inferred edge, or ALREADY_RECORDED.
    """
    lo, hi = pair(F.col("own"), F.get("concepts", F.lit(0)))
    bases = found.where("outcome = 'MENTION'").select(lo.alias("concept_a"), hi.alias("concept_b"), F.col("text_id").alias("basis_occurrence_id"), F.col("matched").alias("matched_text")).distinct()
    elo, ehi = pair(F.col("concept_a"), F.col("concept_b"))
    e = edges.select("id", "origin", elo.alias("concept_a"), ehi.alias("concept_b"), (F.col("concept_a") == elo).alias("in_order"))
    per = e.groupBy("concept_a", "concept_b").agg(F.max(F.col("origin") == "EXPLICIT").alias("explicit"), F.min_by("id", F.struct(~F.col("in_order"), F.col("id"))).alias("edge_id"))
    have = recorded.select(F.col("relationship_id").alias("edge_id"), "basis_occurrence_id", "matched_text").distinct().withColumn("had", F.lit(True))
    b = bases.join(per, ["concept_a", "concept_b"], "left").join(have, ["edge_id", "basis_occurrence_id", "matched_text"], "left")
    sums = b.groupBy("concept_a", "concept_b", "edge_id", "explicit").agg(F.count("*").alias("n_bases"), F.count_if(F.col("had").isNull()).alias("n_new"))
    stated = F.coalesce("explicit", F.lit(False))
    outcome = F.when(stated, "EXPLICIT_EXISTS").when(F.col("edge_id").isNull(), "CREATED").when(F.col("n_new") > 0, "BASIS_ADDED").otherwise("ALREADY_RECORDED")
    return sums.select("concept_a", "concept_b", outcome.alias("outcome"), "n_bases", F.when(stated, 0).otherwise(F.col("n_new")).cast("long").alias("n_added"))


def promoted(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges (id, origin, lifecycle_status) with new_origin and problem: inferred ones that a source states (evidence: relationship_id) become EXPLICIT; explicit ones without evidence have the problem NO_EVIDENCE, inferred ones that are not active NOT_ACTIVE."""
    stated = evidence.select(F.col("relationship_id").alias("id")).distinct().withColumn("stated", F.lit(True))
    d = edges.join(stated, "id", "left")
    has, inferred = F.col("stated").isNotNull(), F.col("origin") == "INFERRED"
    active = F.col("lifecycle_status") == "ACTIVE"
    new = F.when(inferred & has & active, "EXPLICIT").otherwise(F.col("origin"))
    problem = F.when(inferred & has & ~active, "NOT_ACTIVE").when(~inferred & ~has, "NO_EVIDENCE")
    return d.select(*edges.columns, new.alias("new_origin"), problem.alias("problem"))
