"""Typed requests over the whole knowledge base: one for each statement, concept and document, and one for each size that a statement may name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import counter
from quillspark.operators import typed as T
from quillspark.plans.catalog import _DENIED, _OCC, _PLACED, _TOKENS, _N, simple


def _asked(kb) -> DataFrame:
    """Requests by number: statements by identifier (with a filter of types, pages or lifecycle in turn, every thirteenth with a name too many), concepts by name, pages of documents, sizes as keywords."""
    n = counter("id")
    only = lambda k, *values: F.when(n % 4 == k, F.array(*values))
    exact = kb.knowledge.select(n.alias("request_id"), F.lit("EXACT").alias("mode"), F.col("id").alias("identifier"), F.when(n % 13 == 0, "x").alias("name"), F.when(n % 3 == 0, "AUTHORIZED").alias("scope"), only(1, F.lit("RULE"), F.lit("EQUATION")).alias("knowledge_types"), only(2, F.lit("1"), F.lit("2")).alias("pages"), only(3, F.lit("ACTIVE"), F.lit("ARCHIVED")).alias("lifecycle_statuses"), (n % 2 == 0).alias("include_superseded"))
    concept = kb.concept.select((n + 100_000_000).alias("request_id"), F.lit("CONCEPT").alias("mode"), F.upper("canonical_name").alias("name"), F.lit("AUTHORIZED").alias("scope"))
    page = kb.document.select((n + 200_000_000).alias("request_id"), F.lit("PAGE").alias("mode"), F.col("id").alias("document_id"), (n % 3 + 1).cast("int").alias("page_number"))
    size = kb.knowledge.select(F.split_part("statement", F.lit(" "), F.lit(-3)).cast("long").alias("s")).distinct()
    word = size.select((F.col("s") + 300_000_000).alias("request_id"), F.lit("KEYWORD").alias("mode"), F.concat(F.lit("Rated "), F.col("s").cast("string")).alias("term"), (F.col("s") % 2 == 0).alias("prefix"), F.lit("AUTHORIZED").alias("scope"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (concept, page, word), exact)


_ID = _N.format("id")
_SIZE = "cast(split_part(statement, ' ', -3) as bigint)"
_MET = (
    f"asked as (select {_ID} as request_id, id, {_ID} % 3 = 0 as wide, {_ID} % 4 as k, {_ID} % 2 = 0 as old, {_ID} % 13 = 0 as bad from kb_knowledge),"
    f" sizes as (select distinct {_SIZE} as s from kb_knowledge), placed as ({_PLACED}),"
    " met as (select request_id, id as item_id, wide, k, old from asked where not bad"
    f" union all select distinct {_N.format('c.id')} + 100000000, a.concept_id, true, 0, true from kb_concept c join kb_alias a on a.normalized_alias = lower(c.canonical_name) and a.lifecycle_status = 'ACTIVE'"
    f" union all select distinct {_N.format('d.id')} + 200000000, p.subject_id, false, 0, true from kb_document d join placed p on p.document_id = d.id and p.page_number = {_N.format('d.id')} % 3 + 1"
    f" union all select s + 300000000, k.id, true, 0, true from sizes join kb_knowledge k on contains({_TOKENS.format('k.statement')}, ' rated ' || cast(s as varchar) || case when s % 2 = 0 then '' else ' ' end)),"
    " items as (select id, 'KNOWLEDGE' as kind, knowledge_type, lifecycle_status from kb_knowledge union all select id, 'CONCEPT', null, lifecycle_status from kb_concept union all select id, 'RELATIONSHIP', null, lifecycle_status from kb_edge),"
    " shown as (select m.*, i.kind, case when m.k = 3 then i.lifecycle_status in ('ACTIVE', 'ARCHIVED') else i.lifecycle_status not in ('ARCHIVED', 'DELETED') and (m.old or i.lifecycle_status <> 'SUPERSEDED') end and (m.k <> 1 or coalesce(i.knowledge_type in ('RULE', 'EQUATION'), false)) as alive from met m join items i on i.id = m.item_id),"
    f" seen as (select s.request_id, s.item_id, count(p.source_id) as n, count(*) filter (p.source_id is not null and not ({_DENIED.replace('s.', 'o.')}) and (s.wide or o.source_category in ('USER_PROVIDED_SOURCE', 'LOCAL_SOURCE')) and (s.k <> 2 or p.page_number in (1, 2))) as n_in_scope, bool_or(p.source_id is not null and not ({_DENIED.replace('s.', 'o.')}) and (s.wide or o.source_category in ('USER_PROVIDED_SOURCE', 'LOCAL_SOURCE')) and not (s.k <> 2 or p.page_number in (1, 2))) as filtered from shown s left join placed p on p.subject_id = s.item_id left join kb_source o on o.id = p.source_id where s.alive group by 1, 2),"
    " every as (select request_id, case when bad then 'OTHER_FIELDS_THAN_ITS_MODE' end as problem from asked union all select cast(split_part(id, '-', 2) as bigint) + 100000000, null from kb_concept union all select cast(split_part(id, '-', 2) as bigint) + 200000000, null from kb_document union all select s + 300000000, null from sizes)"
)
simple("q1_typed_requests", lambda kb: T.answered(kb, _asked(kb)), ("knowledge", "concept", "alias", "document", "edge", "source", "basis", *_OCC), (
    f", {_MET} select e.request_id, e.problem, s.item_id, s.kind, case when s.item_id is not null then coalesce(v.n_in_scope, 0) end as n_in_scope, case when s.item_id is null then null when not s.alive then 'LEFT_OUT' when v.n_in_scope > 0 then null when v.n = 0 then 'no evidence' when v.filtered then 'filtered' else 'not authorized' end as reason from every e left join shown s on s.request_id = e.request_id left join seen v on v.request_id = s.request_id and v.item_id = s.item_id"))
