"""Queries of classification and verification: names in definitions with raw places, and recorded answers checked again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.adapter import knowledge_base, with_tables
from quillspark.functions.ids import counter
from quillspark.operators import classification as K
from quillspark.operators import graph as G
from quillspark.operators import solving as S
from quillspark.operators import verification as V
from quillspark.plans.catalog import _DENIED, _DOWN, _EVIDENCE, _N, query, simple
from quillspark.plans.solving import _THREE, _forms, _problems
from quillspark.storage import written

_REFUSED = ", ".join(repr(x) for x in K.REFUSED)


def _asked_runs(kb):
    """A request for each document: the document alone, one of its runs, both, or nothing."""
    d = kb.document.select("id", counter("id").alias("n"))
    run = F.concat(F.lit("RUN-"), F.lpad((F.col("n") * 10 + 1).cast("string"), 8, "0"))
    return d.select(F.col("n").alias("request_id"), F.when(F.col("n") % 4 != 0, run).alias("run_id"), F.when(F.col("n") % 4 < 2, F.col("id")).alias("document_id")).withColumn("run_id", F.when(F.col("request_id") % 4 >= 2, F.col("run_id")).when(F.col("request_id") % 4 == 1, F.col("run_id"))).withColumn("document_id", F.when(F.col("request_id") % 8 == 4, None).otherwise(F.col("document_id")))


simple("cl6_selected_runs", lambda kb: K.selected_runs(kb, _asked_runs(kb)), ("document", "run"), (
    f"select request_id, case when problem is null then coalesce(run_id, one) end as run_id, problem from (select a.*, p.one, case when a.run_id is not null and a.document_id is not null then 'BOTH_NAMED' when a.run_id is null and a.document_id is null then 'NOTHING_NAMED' when a.run_id is not null and r.id is null then 'NO_SUCH_RUN' when a.run_id is null and p.n is null then 'NO_RUN' when a.run_id is null and p.n > 1 then 'SEVERAL_RUNS' when coalesce(r.status, o.status) in ({_REFUSED}) then 'REFUSED_STATE' end as problem"
    f" from (select {_N.format('id')} as request_id, case when {_N.format('id')} % 4 <> 0 then 'RUN-' || lpad(cast({_N.format('id')} * 10 + 1 as varchar), 8, '0') end as run_id, case when {_N.format('id')} % 4 < 2 and {_N.format('id')} % 8 <> 4 then id end as document_id from kb_document) a left join kb_run r on r.id = a.run_id left join (select document_id, count(*) as n, min(id) as one from kb_run group by 1) p on p.document_id = a.document_id left join kb_run o on o.id = p.one) x"))  # fmt: skip
simple("cl4_definition_texts", K.definition_texts, ("edge", "knowledge", "source_occurrence", "concept_occurrence"), (
    "select run_id, knowledge_id, case when state = 'READ' then concept_id end as concept_id, case when state = 'READ' then occurrence_id end as occurrence_id, case when state = 'READ' then text end as text, state from (select o.run_id, o.knowledge_id, e.concept_id, p.occurrence_id, p.text, case when e.n <> 1 or p.n <> 1 then 'AMBIGUOUS' when c.concept_id is null then 'OUTSIDE' else 'READ' end as state"
    " from (select distinct extraction_run_id as run_id, knowledge_id from kb_source_occurrence) o join kb_knowledge k on k.id = o.knowledge_id and k.knowledge_type = 'DEFINITION' join (select to_knowledge_id, count(*) as n, min(from_concept_id) as concept_id from kb_edge where relation_type = 'DEFINED_BY' and lifecycle_status = 'ACTIVE' group by 1) e on e.to_knowledge_id = o.knowledge_id join (select knowledge_id, count(*) as n, min(id) as occurrence_id, arg_min(text, id) as text from kb_source_occurrence group by 1) p on p.knowledge_id = o.knowledge_id"
    " left join (select distinct extraction_run_id as run_id, concept_id from kb_concept_occurrence) c on c.run_id = o.run_id and c.concept_id = e.concept_id) x"))  # fmt: skip


def _titles(kb):
    """Statements with their type's first word in wide letters, which normalise to plain ones, and the types as names."""
    k = kb.knowledge
    wide = F.translate(F.upper("canonical_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    texts = k.select(F.col("id").alias("text_id"), F.col("knowledge_type").alias("own"), F.concat(F.lit("  The "), wide, F.lit("\t is rated, says "), F.substring_index("statement", " by ", -1)).alias("text"))
    names = k.select(F.col("canonical_name").alias("normalized_alias"), F.col("canonical_name").alias("concept_id")).distinct()
    return K.located(texts, K.name_table(names)).select("text_id", "name", "start", "end", "raw_start", "raw_end", "matched", "outcome")


_WIDE = "translate(upper(canonical_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + "".join(chr(0xFF21 + i) for i in range(26)) + "')"
simple("cl3_located_names", _titles, ("knowledge",), f"select id as text_id, canonical_name as name, 4 as \"start\", 4 + length(canonical_name) as \"end\", 6 as raw_start, 6 + length(canonical_name) as raw_end, {_WIDE} as matched, 'MENTION' as outcome from kb_knowledge")
simple("cl7_promotions", lambda kb: K.promoted(kb.edge.select("id", "origin", "lifecycle_status"), kb.edge_occurrence.select("relationship_id")), ("edge", "edge_occurrence"), (
    "select e.id, e.origin, e.lifecycle_status, case when e.origin = 'INFERRED' and o.r is not null and e.lifecycle_status = 'ACTIVE' then 'EXPLICIT' else e.origin end as new_origin, case when e.origin = 'INFERRED' and o.r is not null and e.lifecycle_status <> 'ACTIVE' then 'NOT_ACTIVE' when e.origin <> 'INFERRED' and o.r is null then 'NO_EVIDENCE' end as problem from kb_edge e left join (select distinct relationship_id as r from kb_edge_occurrence) o on o.r = e.id"))


def _recorded(found, known, targets):
    """Steps of the answers to the problems over three laws, every seventh with a wrong value and every eleventh with a step that takes what no step gave."""
    plans = written(S.plans(found, known, targets).where("place = 0"), "plans")
    bound = known.groupBy("problem_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("value", "dimension")))).alias("bound"))
    steps = S.worked(plans.select("problem_id", F.transform("steps", lambda s: s["formula"]).alias("formulas")).join(bound, "problem_id"))
    wrong = (F.col("problem_id") % 7 == 0) & (F.col("number") == 3)
    other = F.transform("inputs", lambda x: x.withField("from_step", F.when((F.col("problem_id") % 11 == 0) & x["from_step"].isNotNull(), x["from_step"] + 5).otherwise(x["from_step"])))
    return written(steps.select(F.col("problem_id").alias("answer_id"), "number", "symbol", "formula", other.alias("inputs"), F.when(wrong, F.concat(F.lit("1"), F.col("value"))).otherwise(F.col("value")).alias("value"), "dimension"), "steps")


_SEVENTH = "problem_id % 7 = 0"


@query("vr2_verdicts", flat=True, sql=f"{with_tables('law')}, {_THREE} select problem_id as answer_id, case when problem_id % 7 = 0 or problem_id % 11 = 0 then 'FAILED' else 'VERIFIED' end as status, case when problem_id % 11 = 0 then 'CHAIN' when problem_id % 7 = 0 then 'INDEPENDENT' else 'CHAIN' end as kind from found")
def _verdicts(spark, d):
    kb = knowledge_base(spark, d)
    known, targets = _problems(kb, spark, d)
    found = _forms(kb)
    steps = _recorded(found, known, targets)
    answers = steps.where("number = 3").select("answer_id", F.col("symbol").alias("target"), F.lit("CALCULATED").alias("status"), "value", "dimension", F.lit(False).alias("given"))
    # the request is run again from the equations as they were read; reading them is no part of it
    again = S.answers(found, known, targets).select(F.col("problem_id").alias("answer_id"), "status", "value", "dimension")
    return V.verdicts(V.calculations(answers, steps, again)).select("answer_id", "status", "kind")


@query("vr1_second_evaluation", flat=True, sql=f"{with_tables('law')}, {_THREE} select problem_id as answer_id, unnest(['step 1', 'step 2', 'step 3']) as subject, unnest(['VERIFIED', 'VERIFIED', case when {_SEVENTH} then 'FAILED' else 'VERIFIED' end]) as status from found")
def _second(spark, d):
    kb = knowledge_base(spark, d)
    return V.independent(_recorded(_forms(kb), *_problems(kb, spark, d))).select("answer_id", "subject", "status")


def _derived(kb):
    """A step for each concept with requirements: what it needs by which edges; every fifth forgets its smallest edge."""
    e = kb.edge.where("relation_type in ('REQUIRES', 'DEPENDS_ON') and lifecycle_status = 'ACTIVE' and to_concept_id is not null")
    per = e.groupBy(F.col("from_concept_id").alias("concept_id")).agg(F.sort_array(F.collect_set("to_concept_id")).alias("requirements"), F.sort_array(F.collect_set("id")).alias("relationships"))
    n = counter("concept_id")
    return per.select(n.alias("answer_id"), F.lit(1).alias("number"), "concept_id", "requirements", F.when(n % 5 == 0, F.expr("slice(relationships, 2, size(relationships))")).otherwise(F.col("relationships")).alias("relationships"))


_SEEN = f"select subject_id as id from ({_EVIDENCE}) e left join kb_source s on s.id = e.source_id where not ({_DENIED}) and subject_kind = 'RELATIONSHIP' union select b.relationship_id from kb_basis b join kb_source_occurrence o on o.id = b.basis_occurrence_id left join kb_source s on s.id = o.source_id where not ({_DENIED})"
simple("vr3_derivation_checks", lambda kb: V.derivations(kb, _derived(kb)).select("answer_id", "status", "detail"), ("edge", "source", "basis", "source_occurrence", "concept_occurrence", "edge_occurrence"), (
    f"select answer_id, case when bad is null and n % 5 <> 0 then 'VERIFIED' else 'FAILED' end as status, case when bad is not null then bad || ': not in scope' when n % 5 = 0 then least_id || ': left out' end as detail from (select {_N.format('e.from_concept_id')} as answer_id, {_N.format('e.from_concept_id')} as n, min(e.id) as least_id, min(case when v.id is null and not ({_N.format('e.from_concept_id')} % 5 = 0 and e.id = f.first_id) then e.id end) as bad from kb_edge e"
    f" join (select from_concept_id, min(id) as first_id from kb_edge where relation_type in ('REQUIRES', 'DEPENDS_ON') and lifecycle_status = 'ACTIVE' and to_concept_id is not null group by 1) f on f.from_concept_id = e.from_concept_id left join ({_SEEN}) v on v.id = e.id where e.relation_type in ('REQUIRES', 'DEPENDS_ON') and e.lifecycle_status = 'ACTIVE' and e.to_concept_id is not null group by 1, 2) x"))  # fmt: skip


# chains to concepts and what parts share
_SHARED = f"edges as ({_DOWN}), tree as (select src as root, src as node, 0 as depth from (select distinct src from edges where src not in (select dst from edges)) r union all select t.root, e.dst, t.depth + 1 from tree t join edges e on e.src = t.node)"


@query("g6_shared_hierarchy", flat=True, sql=f"{with_tables('edge')}, {_SHARED} select root, node, cast(count(*) as bigint) as n_paths, min(depth) as least_depth, max(depth) as most_depth from tree group by 1, 2")
def _shared(spark, d):
    found = G.shared_hierarchy(G.hierarchy_edges(knowledge_base(spark, d)))
    return found.withColumn("n_paths", F.col("n_paths").cast("long"))


_NEEDED = "select distinct from_concept_id as src, to_concept_id as dst from kb_edge where lifecycle_status = 'ACTIVE' and to_concept_id is not null and relation_type in ('REQUIRES', 'DEPENDS_ON')"
_GIVEN = "select id from kb_concept where {0} % 3 = 0 and {0} > 1000".format(_N.format("id"))
_WAYS = f"ways as (select id as target, id as here, [id] as path from kb_concept where {_N.format('id')} > 1000 and {_N.format('id')} % 2 = 1 union all select w.target, e.dst, list_prepend(e.dst, w.path) from ways w join ({_NEEDED}) e on e.src = w.here where not list_contains(w.path, e.dst))"


@query("r6_chains", flat=True, sql=(
    f"{with_tables('edge', 'concept')}, {_WAYS}, found as (select target, path from ways where len(path) > 1 and here in ({_GIVEN})), counted as (select target, path, row_number() over (partition by target order by list_transform(path, lambda x: {_N.format('x')})) as place, count(*) over (partition by target) as n from found)"
    f" select target, place, array_to_string(path, ',') as path, n <= {G.MAX_PATHS} as complete from counted where place <= {G.MAX_PATHS}"))  # fmt: skip
def _chains(spark, d):
    kb = knowledge_base(spark, d)
    given = kb.concept.where((counter("id") % 3 == 0) & (counter("id") > 1000)).select(F.col("id").alias("node"))
    targets = kb.concept.where((counter("id") > 1000) & (counter("id") % 2 == 1)).select(F.col("id").alias("target"))
    found = G.chains_of(G.edges_of(kb, "REQUIRES", "DEPENDS_ON"), given, targets)
    return found.select("target", "place", F.array_join("path", ",").alias("path"), "complete")
