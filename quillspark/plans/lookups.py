"""Look-ups, views and orders as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.adapter import knowledge_base, with_tables
from quillspark.functions.ids import counter
from quillspark.operators import answers as A
from quillspark.operators import calculation as K
from quillspark.operators import catalogue as C
from quillspark.operators import dedup as D
from quillspark.operators import detectors as X
from quillspark.operators import evidence as E
from quillspark.operators import graph as G
from quillspark.operators import lookups as L
from quillspark.operators import manuals as M
from quillspark.operators import reasoning as R
from quillspark.operators import requests as Q
from quillspark.operators import validation as V
from quillspark.operators import writer as W
from quillspark.plans.catalog import _DENIED, _EDGE_TABLES, _EVIDENCE, _ITEMS, _N, _LINKS, _OCC, _SECTION_TABLES, _VISIBLE, _items, _section_sql, query, simple
from quillspark.storage import spread

_LIST = "string_agg({v}, ',' order by {o})"
_ORDERED = f"{_N.format('document_id')}, coalesce(page_number, 1073741824), coalesce(char_start, 1073741824), {_N.format('id')}"

simple("j3_equations_of_concepts", L.equations_of_concepts, ("edge", "equation"), "select e.from_concept_id as concept_id, e.relation_type, q.id as equation_id, q.expression from kb_edge e join kb_equation q on q.knowledge_id = e.to_knowledge_id where e.lifecycle_status = 'ACTIVE'")
simple("j14_stated_equivalences", lambda kb: L.stated_pairs(kb, "EQUIVALENT_TO", "REQUIRES"), ("edge", "concept"), "select e.id, a.canonical_name as name_a, b.canonical_name as name_b from kb_edge e join kb_concept a on a.id = e.from_concept_id join kb_concept b on b.id = e.to_concept_id where e.relation_type in ('EQUIVALENT_TO', 'REQUIRES') and e.lifecycle_status = 'ACTIVE' and e.origin = 'EXPLICIT'")
simple("j15_claims_by_method", lambda kb: L.claims_by_name_and_method(kb, "deterministic/RuleCandidate"), ("source_occurrence", "knowledge"), "select k.canonical_name, o.knowledge_id, o.id as occurrence_id from kb_source_occurrence o join kb_knowledge k on k.id = o.knowledge_id where starts_with(o.extraction_method, 'deterministic/RuleCandidate')")
simple("j17_evidence_of_many", lambda kb: L.evidence_for_many(E.evidence(kb), kb.knowledge.where("knowledge_type = 'EQUATION'").select(F.col("id").alias("subject_id"))), (*_OCC, "knowledge"), f"select subject_id, count(*) as n, {_LIST.format(v='id', o=_ORDERED)} as evidence from ({_EVIDENCE}) e where subject_id in (select id from kb_knowledge where knowledge_type = 'EQUATION') group by 1")
simple("l3_structure_of_documents", lambda kb: L.placed(kb.structure, "document_id", F.col("ordinal"), F.col("title"), F.col("depth")).select("document_id", "id", "title", "depth", "place"), ("structure",), "select document_id, id, title, depth, row_number() over (partition by document_id order by ordinal, title, depth) as place from kb_structure")
simple("l4_segments_in_order", lambda kb: L.placed(kb.segment.select(F.coalesce("lang", F.lit("none")).alias("lang"), "id"), "lang", counter("id")).select("lang", "id", "place"), ("segment",), f"select coalesce(lang, 'none') as lang, id, row_number() over (partition by coalesce(lang, 'none') order by {_N.format('id')}) as place from kb_segment")
simple("l5_all_aliases", lambda kb: kb.alias.select("concept_id", "alias", (F.col("lifecycle_status") == "ACTIVE").alias("active")), ("alias",), "select concept_id, alias, lifecycle_status = 'ACTIVE' as active from kb_alias")
simple("l7_evidence_of_subjects", lambda kb: L.placed(E.evidence(kb).where("subject_kind = 'CONCEPT'"), "subject_id", counter("document_id"), F.col("page_number"), F.col("char_start"), counter("id")).select("subject_id", "id", "place"), _OCC, f"select subject_id, id, row_number() over (partition by subject_id order by {_N.format('document_id')}, page_number, char_start, {_N.format('id')}) as place from ({_EVIDENCE}) e where subject_kind = 'CONCEPT'")
simple("l11_the_active_edge", lambda kb: kb.edge.where("lifecycle_status = 'ACTIVE'").groupBy("relation_type", "from_concept_id", F.coalesce("to_concept_id", "to_knowledge_id").alias("target")).agg(F.count("*").alias("n"), F.min("id").alias("id")), ("edge",), "select relation_type, from_concept_id, coalesce(to_concept_id, to_knowledge_id) as target, count(*) as n, min(id) as id from kb_edge where lifecycle_status = 'ACTIVE' group by 1, 2, 3")
_COMPANIONS = " union all ".join(f"select knowledge_id, '{t.upper()}' as kind, id, lifecycle_status from kb_{t}" for t in L.COMPANIONS)
simple("l16_companions", L.companions, L.COMPANIONS, _COMPANIONS)
simple("l18_editions", lambda kb: kb.document.join(kb.edition.select("file_hash", F.col("id").alias("edition_id"), "work_id", "label"), "file_hash").select(F.col("id").alias("document_id"), "edition_id", "work_id", "label"), ("document", "edition"), "select d.id as document_id, n.id as edition_id, n.work_id, n.label from kb_document d join kb_edition n on n.file_hash = d.file_hash")
simple("l20_documents_by_number", lambda kb: L.placed(kb.document.withColumn("all", F.lit(1)), "all", counter("id")).select("id", "filename", "place"), ("document",), f"select id, filename, row_number() over (order by {_N.format('id')}) as place from kb_document")
simple("l22_active_companions", L.active_companions, (*L.COMPANIONS, "knowledge"), f"select c.knowledge_id, c.kind, c.id, k.statement from ({_COMPANIONS}) c join kb_knowledge k on k.id = c.knowledge_id where c.lifecycle_status = 'ACTIVE' and k.lifecycle_status = 'ACTIVE'")
simple("l25_occurrences_by_method", lambda kb: kb.source_occurrence.where(F.startswith("extraction_method", F.lit("deterministic/Equation"))).select("document_id", "id", "extraction_method"), ("source_occurrence",), "select document_id, id, extraction_method from kb_source_occurrence where starts_with(extraction_method, 'deterministic/Equation')")
_DISCARDING = ", ".join(repr(x) for x in L.DISCARDING)
simple(
    "v7_run_states", L.run_states, ("run", "issue", "document"),
    f"select r.id as run_id, r.document_id, coalesce(i.n, 0) as n_issues, coalesce(i.p, false) as partial, case when r.status = 'COMPLETED' and coalesce(i.p, false) then 'PARTIAL' else r.status end as run_state, case when d.processing_status = 'PROCESSED' and m.p then 'PARTIALLY_PROCESSED' else d.processing_status end as document_state from kb_run r left join (select extraction_run_id, count(*) as n, bool_or(issue_type in ({_DISCARDING})) as p from kb_issue group by 1) i on i.extraction_run_id = r.id left join kb_document d on d.id = r.document_id left join (select x.document_id, bool_or(coalesce(y.p, false)) as p from kb_run x left join (select extraction_run_id, bool_or(issue_type in ({_DISCARDING})) as p from kb_issue group by 1) y on y.extraction_run_id = x.id group by 1) m on m.document_id = r.document_id",
)
_WHY = "case when contains({c}, '+ocr') then 'recognised from an image' when contains({c}, '+weak') then 'a general sentence shape, no defining verb' when contains({c}, '+layout?') then 'rebuilt from the layout of a page, with a doubt' when contains({c}, 'EquationCandidate') then 'a text layer can lose the layout of an equation' end"
simple("an4_why_uncertain", lambda kb: kb.source_occurrence.select("id", L.why_uncertain(F.col("extraction_method")).alias("reason")), ("source_occurrence",), f"select id, {_WHY.format(c='extraction_method')} as reason from kb_source_occurrence")


def _named_items(kb):
    return _items(kb).join(kb.knowledge.select(F.col("id").alias("item_id"), "canonical_name"), "item_id")


simple("q7_withheld_status", lambda kb: L.withheld_status(_named_items(kb), "canonical_name"), (*_OCC, "source", "knowledge"), f"select canonical_name, case when bool_or(coalesce(reason = 'filtered', false)) then 'NOT_FOUND' else 'INSUFFICIENT_AUTHORIZED_INFORMATION' end as status from (select i.*, k.canonical_name from ({_ITEMS}) i join kb_knowledge k on k.id = i.item_id) x group by 1 having not bool_or(reason is null)")
simple("q26_traces", L.traces, (*_OCC, "source", "edge"), f"select e.from_concept_id as concept_id, {_LIST.format(v='e.id', o=_N.format('e.id'))} as links, coalesce({_LIST.format(v='distinct p.first', o='p.first')}, '') as evidence, cast(sum(coalesce(p.withheld, 0)) as bigint) as n_withheld from kb_edge e left join (select subject_id, arg_min(case when not bad then id end, case when not bad then {_N.format('id')} end) as first, sum(case when bad then 1 else 0 end) as withheld from (select x.*, ({_DENIED}) as bad from ({_EVIDENCE}) x left join kb_source s on s.id = x.source_id) y group by 1) p on p.subject_id = e.to_knowledge_id where e.lifecycle_status = 'ACTIVE' and e.to_knowledge_id is not null group by 1")
simple("q27_concept_views", L.concept_views, ("concept", "alias", "edge", "knowledge", "concept_occurrence"), "select c.id, coalesce(a.n, 0) as n_aliases, coalesce(e.d, 0) as n_definitions, coalesce(e.q, 0) as n_equations, coalesce(e.r, 0) as n_relationships, coalesce(e.p, 0) as n_prerequisites, coalesce(o.n, 0) as n_occurrences from kb_concept c left join (select concept_id, count(distinct normalized_alias) as n from kb_alias where lifecycle_status = 'ACTIVE' group by 1) a on a.concept_id = c.id left join (select from_concept_id as id, count(*) filter (relation_type = 'DEFINED_BY') as d, count(*) filter (k.knowledge_type = 'EQUATION') as q, count(*) filter (to_concept_id is not null) as r, count(*) filter (relation_type = 'REQUIRES') as p from kb_edge x left join kb_knowledge k on k.id = x.to_knowledge_id where x.lifecycle_status = 'ACTIVE' group by 1) e on e.id = c.id left join (select concept_id, count(*) as n from kb_concept_occurrence group by 1) o on o.concept_id = c.id")
simple("o2_mixed_ids", lambda kb: L.placed(kb.concept.select("id").union(kb.document.select("id")).union(kb.run.select("id")).withColumn("all", F.lit(1)), "all", L.id_key(F.col("id"))).select("id", "place"), ("concept", "document", "run"), f"select id, row_number() over (order by split_part(id, '-', 1), {_N.format('id')}) as place from (select id from kb_concept union all select id from kb_document union all select id from kb_run) x")
simple("o5_capped_items", lambda kb: L.capped(kb.knowledge.select("knowledge_type", "id"), "knowledge_type", L.MAX_ITEMS, counter("id")).select("knowledge_type", "id", "truncated"), ("knowledge",), f"select knowledge_type, id, n > {L.MAX_ITEMS} as truncated from (select knowledge_type, id, row_number() over (partition by knowledge_type order by {_N.format('id')}) as place, count(*) over (partition by knowledge_type) as n from kb_knowledge) x where place <= {L.MAX_ITEMS}")
simple("o7_sources_of_items", lambda kb: L.capped(kb.source_occurrence.select("knowledge_id", "source_id").distinct(), "knowledge_id", L.MAX_SOURCES, counter("source_id")).select("knowledge_id", "source_id", "place", "truncated"), ("source_occurrence",), f"select knowledge_id, source_id, place, n > {L.MAX_SOURCES} as truncated from (select knowledge_id, source_id, row_number() over (partition by knowledge_id order by {_N.format('source_id')}) as place, count(*) over (partition by knowledge_id) as n from (select distinct knowledge_id, source_id from kb_source_occurrence) y) x where place <= {L.MAX_SOURCES}")
simple("o8_words_in_order", lambda kb: kb.knowledge.select("id", F.array_join(L.distinct_in_order(F.split("statement", " ")), " ").alias("words")), ("knowledge",), "select id, (select string_agg(w, ' ' order by i) from (select w, min(i) as i from (select unnest(string_split(statement, ' ')) as w, generate_subscripts(string_split(statement, ' '), 1) as i) a group by w) b) as words from kb_knowledge")
simple("s30_items_as_json", lambda kb: L.as_json(kb.knowledge.select("id", "knowledge_type", "statement")), ("knowledge",), "select '{\"id\":\"' || id || '\",\"knowledge_type\":\"' || knowledge_type || '\",\"statement\":\"' || statement || '\"}' as json from kb_knowledge")

# validation, steps and menus
_PROBLEM = "case when contains(expression, '==') then 'two equality signs run together' when contains(expression, '(') then 'unbalanced parentheses' when regexp_matches(expression, '[*] *$') then 'the right-hand side ends in an operator' end"
simple("v3_equation_problems", lambda kb: kb.equation.select("id", V.equation_problem(F.col("expression")).alias("problem")), ("equation",), f"select id, {_PROBLEM} as problem from kb_equation")
simple("a14_readiness", lambda kb: A.readiness(kb.equation), ("equation",), f"select * from (select {_PROBLEM} as reason, count(*) as n from kb_equation group by 1) x where reason is not null order by n desc, reason limit 6")
_SIGNS = {"a Unicode replacement character": "contains(text, chr(65533))", "an empty box where a symbol (typically Ω) was": "contains(text, '□')", "a backslash where a mathematical sign (typically ∴) was": r"regexp_matches(text, '\\([^A-Za-z{},;:!\\]|[A-Za-z]([^A-Za-z]|$)|$)')", "'a' between two symbols, where ∝ was": r"regexp_matches(text, '\b[A-Z]\s+a\s+[A-Z]\b')"}
_pages = lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
query("v2_page_signs", flat=True, sql=" union all ".join("select cast(doc_id as varchar) as document_id, '{}' as sign from documents where {}".format(s.replace("'", "''"), w) for s, w in _SIGNS.items()))(lambda spark, d: V.page_glyph_loss(_pages(spark, d)).select("document_id", "sign"))
_part = lambda spark, d: spark.read.parquet(f"{d}/part.parquet")
query("t19_step_checks", flat=True, sql="select p_partkey, case when p_size % 3 = 0 then 'the steps and the quote disagree' when p_size % 3 = 1 then 'the quote does not split into steps' end as problem from part")(
    lambda spark, d: _part(spark, d).select("p_partkey", M.step_problem(F.concat(F.lit("Open "), F.col("p_type"), F.lit(" / Save it")), F.when(F.col("p_size") % 3 == 1, F.lit("Open and save it")).otherwise(F.concat(F.lit("Step 1: Open "), F.col("p_type"), F.lit("\n Step 2. Save "), F.when(F.col("p_size") % 3 == 0, "them").otherwise("it")))).alias("problem")))
query("t20_menu_elements", flat=True, sql="select p_partkey, case when p_size % 2 = 0 then 'File|Save as...|Size ' || cast(p_size as varchar) end as path from part")(
    lambda spark, d: _part(spark, d).select("p_partkey", F.when(M.menu_elements(F.concat(F.when(F.col("p_size") % 2 == 0, "File -> Save as... → Size ").otherwise("File -> save it now -> Size "), F.col("p_size").cast("string"))).isNotNull(), F.array_join(M.menu_elements(F.concat(F.lit("File -> Save as... → Size "), F.col("p_size").cast("string"))), "|")).alias("path")))
query("t21_combos", flat=True, sql="select p_partkey, 'Ctrl+Shift+' || case when p_size % 2 = 0 then 'F' || cast(p_size % 12 + 1 as varchar) else upper(left(p_name, 1)) end as combo from part")(lambda spark, d: _part(spark, d).select("p_partkey", M.combo(F.concat(F.lit(" control + shift+ "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("f"), (F.col("p_size") % 12 + 1).cast("string"))).otherwise(F.lower(F.left("p_name", F.lit(1)))))).alias("combo")))
query("t22_parameters", flat=True, sql="select p_partkey, p_name || ',size' as names, 'Save ' || p_brand || ' as <size>' as done from part")(
    lambda spark, d: _part(spark, d).select("p_partkey", F.array_join(M.parameters(F.array(F.concat(F.lit("Save <"), F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("> as <size>")), F.concat(F.lit("Close <"), F.upper("p_name"), F.lit(">")))), ",").alias("names"), M.substituted(F.concat(F.lit("Save <"), F.initcap("p_name"), F.lit("> as <size>")), F.create_map(F.lower("p_name"), F.col("p_brand"))).alias("done")))
query("e14_menu_paths", flat=True, sql="select r_regionkey as page_number, 'Menu ' || cast(r_regionkey as varchar) || '|' || string_agg('Item ' || cast(n_nationkey as varchar), '|' order by n_nationkey) as path from region join nation on n_regionkey = r_regionkey group by r_regionkey")(lambda spark, d: _menus(spark, d))
_SAID = "The ' || p_type || ' must not' || chr(10) || 'exceed ' || cast(p_size as varchar) || ' units."
_SAVES = "It saves ' || p_name || ' as *.txt and .CSV files."
_PRESSED = "' Use CTRL + s  to keep ' || p_brand || '. '"
_FLAT = _SAID.replace("' || chr(10) || '", " ")
query("e15_sentence_items", flat=True, sql=(
    f"select page_number, kind, \"start\", \"start\" + size as \"end\", statement, name from (select p_partkey as page_number, unnest(['SHORTCUT', 'CONSTRAINT', 'FILE_FORMAT']) as kind, unnest([1, 25 + length(p_brand), 26 + length(p_brand) + length('{_SAID}')]) as \"start\", unnest([23 + length(p_brand), length('{_SAID}'), length('{_SAVES}')]) as size,"
    f" unnest(['Press Ctrl+S', '{_FLAT}', '{_SAVES}']) as statement, unnest(['Keyboard shortcut Ctrl+S', 'Constraint', 'File format .csv, .txt']) as name from part) x"))(
    lambda spark, d: M.sentence_items(_part(spark, d).select(F.lit("p").alias("document_id"), F.col("p_partkey").alias("page_number"), F.expr(f"concat({_PRESSED.replace(' || ', ', ')}, '{_SAID} {_SAVES}')".replace("' || ", "', ").replace(" || '", ", '").replace("varchar", "string").replace(" || ", ", ")).alias("text"))).select("page_number", "kind", "start", "end", "statement", "name"))
query("e16_step_inputs", flat=True, sql="select p_partkey, case when p_size % 2 = 0 then lower(p_type) end as input from part")(lambda spark, d: _part(spark, d).select("p_partkey", M.step_input(F.concat(F.when(F.col("p_size") % 2 == 0, " Select the ").otherwise("Look at the "), F.col("p_type"), F.lit("."))).alias("input")))


def _menus(spark, d):
    """Pages whose first line heads the lines below it."""
    region, nation = spark.read.parquet(f"{d}/region.parquet"), spark.read.parquet(f"{d}/nation.parquet")
    page = [F.lit("m").alias("document_id"), F.col("r").cast("int").alias("page_number")]
    head = region.select(F.col("r_regionkey").alias("r"), F.lit(-1).cast("long").alias("line"), F.concat(F.lit(" Menu "), F.col("r_regionkey").cast("string")).alias("text"))
    lines = head.union(nation.select("n_regionkey", F.col("n_nationkey").cast("long"), F.concat(F.lit("  -> Item "), F.col("n_nationkey").cast("string"))))
    return M.menu_paths(lines.select(*page, "line", "text")).select(F.col("page_number").cast("long").alias("page_number"), F.array_join("elements", "|").alias("path"))


def _written(spark, d):
    """What the detectors find in the documents, stored."""
    pages = _pages(spark, d)
    return W.write(X.detect(pages), pages)


query("v8_run_report", flat=True)(lambda spark, d: W.report(_written(spark, d)))
query("v10_written_knowledge", flat=True)(lambda spark, d: _written(spark, d).knowledge)
query("v12_written_edges", flat=True)(lambda spark, d: _written(spark, d).edge)



def _planted(spark, d):
    """A page for each part that states its type's definition twice, an equation, a variable, a property, a rule that parts of its size share, and a relation to the next part; every fifth equation is broken and every seventh relation has no end."""
    p = spread(_part(spark, d).select("p_partkey", "p_type", "p_size"), "p_partkey")
    n, key = F.col("p_partkey").cast("string"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string"))
    one = lambda at, category, **more: F.struct(F.lit(at).alias("char_start"), F.lit(at + 5).alias("char_end"), F.lit(category).alias("category"), *(more.get(c, F.lit(None)).cast("string").alias(c) for c in X.FIELDS), F.lit(False).alias("numeric"), F.lit(category == "PROPERTY").alias("weak"))
    said = F.concat(key, F.lit(" is a  "), F.col("p_type"))
    rows = F.array(
        one(0, "CONCEPT", name=key), one(0, "DEFINITION", name=key, statement=said), one(10, "DEFINITION", name=F.upper(key), statement=F.upper(said)),
        one(20, "EQUATION", statement=F.concat(F.lit("V"), n, F.when(F.col("p_partkey") % 5 == 0, " = (I").otherwise(" = I * R"))), one(30, "VARIABLE", symbol=F.concat(F.lit("V"), n), name=key, unit=F.lit("V"), statement=F.concat(F.lit("where V"), n, F.lit(" is it"))),
        one(40, "PROPERTY", owner=key, subject=key, statement=F.concat(F.lit("the size of "), key)), one(50, "RULE", statement=F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" must not change"))), one(60, "RELATIONSHIP", subject=key, object=F.when(F.col("p_partkey") % 7 == 0, "nothing").otherwise(key), relation_type=F.lit("USES")),
    )
    doc = F.concat(F.lit("DOC-"), F.lpad(n, 8, "0"))
    c = p.select(doc.alias("document_id"), F.lit(1).alias("page_number"), F.explode(rows).alias("r")).select("document_id", "page_number", "r.char_start", "r.char_end", "r.category", F.coalesce("r.statement", "r.name", F.lit("t")).alias("text"), *(f"r.{x}" for x in (*X.FIELDS, "numeric", "weak")))
    return W.write(c, p.select(doc.alias("document_id"), F.lit(1).alias("page_number"), F.lit("text").alias("text")))


_OF = "cast(p_partkey as varchar)"
_KNOWN_PARTS = (
    f"select 'DEFINITION' as knowledge_type, 'Definition: Part ' || {_OF} as label, 'Part ' || {_OF} || ' is a ' || p_type as statement, 'REPORTED_BY_SOURCE' as certainty, null as kind, null as symbol from part"
    f" union all select 'EQUATION', 'Equation: V' || {_OF} || ' = I * R', 'V' || {_OF} || ' = I * R', 'UNCERTAIN', 'EQUATION', null from part where p_partkey % 5 <> 0"
    f" union all select 'VARIABLE', 'Variable: where V' || {_OF} || ' is it', 'where V' || {_OF} || ' is it', 'REPORTED_BY_SOURCE', 'VARIABLE', 'V' || {_OF} from part"
    f" union all select 'PROPERTY', 'Property of Part ' || {_OF} || ': the size of Part ' || {_OF}, 'the size of Part ' || {_OF}, 'UNCERTAIN', null, null from part"
    " union all select distinct 'RULE', 'Rule: size ' || cast(p_size as varchar) || ' must not change', 'size ' || cast(p_size as varchar) || ' must not change', 'REPORTED_BY_SOURCE', 'RULE', null from part"
)
query("v10_planted_knowledge", flat=True, sql=_KNOWN_PARTS)(lambda spark, d: (lambda t: t.knowledge.join(t.companion.select(F.col("knowledge_id").alias("id"), "kind", "symbol"), "id", "left").select("knowledge_type", "label", "statement", "certainty", "kind", "symbol"))(_planted(spark, d)))
query("v8_planted_report", flat=True, sql=(
    "select 'DOC-' || lpad(cast(p_partkey as varchar), 8, '0') as document_id, c.category, cast(case c.category when 'RULE' then case when first then 1 else 0 end else 1 end as bigint) as n_stored, cast(case c.category when 'DEFINITION' then 1 when 'RULE' then case when first then 0 else 1 end else 0 end as bigint) as n_linked, case when p_partkey % 5 = 0 or p_partkey % 7 = 0 then 'PARTIAL' else 'COMPLETED' end as status"
    " from (select *, p_partkey = min(p_partkey) over (partition by p_size) as first from part) p cross join (values ('DEFINITION'), ('EQUATION'), ('VARIABLE'), ('PROPERTY'), ('RULE')) c(category) where not (c.category = 'EQUATION' and p_partkey % 5 = 0)"))(
    lambda spark, d: (lambda t: W.report(t).join(t.run, "document_id"))(_planted(spark, d)))
query("v12_planted_edges", flat=True, sql=(
    f"select 'DEFINED_BY' as relation_type, 'Part ' || {_OF} as name, cast(2 as bigint) as n from part union all select 'HAS_PROPERTY', 'Part ' || {_OF}, 1 from part union all select 'USES', 'Part ' || {_OF}, 1 from part where p_partkey % 7 <> 0"))(
    lambda spark, d: (lambda t: t.edge.join(t.concept.select(F.col("id").alias("from_concept_id"), F.col("canonical_name").alias("name")), "from_concept_id").join(t.edge_occurrence.groupBy(F.col("relationship_id").alias("id")).agg(F.count("*").alias("n")), "id").select("relation_type", "name", "n"))(_planted(spark, d)))

# derivations
_K_ROWS = f"select subject_id, sum(case when v = 'IN_SCOPE' then 1 else 0 end) as seen, sum(case when v = 'OUT_OF_SCOPE' then 1 else 0 end) as out from (select e.subject_id, case when {_DENIED} then 'NOT_AUTHORIZED' when s.source_category not in ('USER_PROVIDED_SOURCE', 'LOCAL_SOURCE') then 'OUT_OF_SCOPE' else 'IN_SCOPE' end as v from ({_EVIDENCE}) e left join kb_source s on s.id = e.source_id where e.subject_kind = 'KNOWLEDGE') x group by 1"
simple("r2_availability", lambda kb: R.availability(kb, own_books=True), (*_OCC, "source", "knowledge"), f"select k.id, case when r.seen is null then 'NO_EVIDENCE' when r.seen = 0 and r.out > 0 then 'OUT_OF_SCOPE' when r.seen = 0 then 'NOT_AUTHORIZED' when k.lifecycle_status in ('ARCHIVED', 'DELETED') then 'EXCLUDED_BY_LIFECYCLE' else 'AVAILABLE' end as status, cast(coalesce(r.seen, 0) as bigint) as n_in_scope from kb_knowledge k left join ({_K_ROWS}) r on r.subject_id = k.id")
simple("r3_requirement_counts", R.requirement_counts, _EDGE_TABLES, f"select e.from_concept_id as node, count(*) filter (e.lifecycle_status = 'ACTIVE' and v.id is not null) as n_usable, count(*) filter (e.lifecycle_status = 'ACTIVE' and v.id is null) as n_withheld, count(*) filter (e.lifecycle_status <> 'ACTIVE') as n_excluded from kb_edge e left join ({_VISIBLE}) v on v.id = e.id where e.relation_type in ('REQUIRES', 'DEPENDS_ON') group by 1")
_given = lambda kb: kb.concept.where((counter("id") % 3 == 0) & (counter("id") > 1000)).select(F.col("id").alias("node"))
_all_edges = lambda kb: G.edges_of(kb, "REQUIRES", "DEPENDS_ON")
_NEEDS = "select distinct from_concept_id as src, to_concept_id as dst from kb_edge where lifecycle_status = 'ACTIVE' and to_concept_id is not null and relation_type in ('REQUIRES', 'DEPENDS_ON')"
simple("r5_missing", lambda kb: G.missing_nodes(G.states(_all_edges(kb), _given(kb)), _all_edges(kb)), ("edge", "concept"), f"select dst as node, {_LIST.format(v='src', o=_N.format('src'))} as required_by from ({_NEEDS}) e where dst not in (select src from ({_NEEDS}) x) and not ({_N.format('dst')} % 3 = 0 and {_N.format('dst')} > 1000 and dst in (select id from kb_concept)) group by dst")
query("r5_steps", flat=True)(lambda spark, d: (lambda kb: G.derivation_steps(G.states(_all_edges(kb), _given(kb))))(knowledge_base(spark, d)))
query("r7_derivable", flat=True)(lambda spark, d: (lambda kb: G.derivable(_all_edges(kb), _given(kb)))(knowledge_base(spark, d)))
query("r1_evaluated", flat=True)(lambda spark, d: (lambda kb: R.evaluated(kb, _given(kb)))(knowledge_base(spark, d)))

# values of symbols: each order line is a problem with its own known values
_EQUATIONS = (("E1", "gross", "gross = quantity * price", ["quantity", "price"]), ("E2", "net", "net = gross * (1 - discount)", ["gross", "discount"]), ("E3", "net", "net = gross - gross * discount", ["gross", "discount"]), ("E4", "margin", "margin = net - cost", ["net", "cost"]), ("E5", "a", "a = b + 1", ["b"]), ("E6", "b", "b = a - 1", ["a"]))


def _equations(spark):
    return spark.createDataFrame([list(e) for e in _EQUATIONS], "equation_id string, target string, formula string, needs array<string>")


def _solved(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("problem_id"))
    one = lambda s, v: o.select("problem_id", F.lit(s).alias("symbol"), v.cast("string").alias("value"), F.lit(None).cast("array<int>").alias("dimension"))
    known = one("quantity", F.col("problem_id") % 7 + 1).union(one("price", F.col("problem_id") % 11)).union(one("discount", F.lit("1/4")))
    return K.solved(_equations(spark), known).select("problem_id", "symbol", "state", F.when(F.col("state") == "DERIVED", F.col("value")).alias("value"), "n_methods")


_KNOWN_SYMBOLS = "union all select o_orderkey, 'quantity', 'AVAILABLE', null, 0 from orders union all select o_orderkey, 'price', 'AVAILABLE', null, 0 from orders union all select o_orderkey, 'discount', 'AVAILABLE', null, 0 from orders union all select o_orderkey, 'cost', 'MISSING', null, 0 from orders union all select o_orderkey, 'margin', 'BLOCKED', null, 0 from orders union all select o_orderkey, 'a', 'BLOCKED', null, 0 from orders union all select o_orderkey, 'b', 'BLOCKED', null, 0 from orders"
query("c7_solved_symbols", flat=True, sql=f"select o_orderkey as problem_id, 'gross' as symbol, 'DERIVED' as state, cast((o_orderkey % 7 + 1) * (o_orderkey % 11) as varchar) as value, cast(1 as bigint) as n_methods from orders union all select o_orderkey, 'net', 'DERIVED', case when n % 4 = 0 then cast(n // 4 as varchar) when n % 2 = 0 then cast(n // 2 as varchar) || '/2' else cast(n as varchar) || '/4' end, 2 from (select o_orderkey, 3 * (o_orderkey % 7 + 1) * (o_orderkey % 11) as n from orders) x {_KNOWN_SYMBOLS}")(_solved)
_IN_TEN = "'p' || lpad(cast({} as varchar), 9, '0')"
query("c8_symbol_cycles", flat=True, sql=f"select {_IN_TEN.format('p_partkey')} as node, {_IN_TEN.format('p_partkey - p_partkey % 10 + case when p_partkey % 2 = 1 then 1 else 2 end')} as component from part where p_partkey % 10 not in (0, 5)")(lambda spark, d: K.symbol_cycles(_thirds(spark, d)))


def _thirds(spark, d):
    """A symbol for each part, which needs the part that three times its last digit names, and one that no part has."""
    p, name = F.col("p_partkey"), lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 9, "0"))
    return _part(spark, d).select(p.cast("string").alias("equation_id"), name(p).alias("target"), F.array(name(p - p % 10 + (p * 3) % 10), F.concat(F.lit("q"), p.cast("string"))).alias("needs"))


_POWER = "case when {e} = 0 then '' when {e} = 1 then '{u}' else '{u}^' || cast({e} as varchar) end"
query("c5_coherent_units", flat=True, sql=f"select p_partkey, case when a = 0 and b = -1 then 'Hz' when a <> 0 and b <> 0 then {_POWER.format(e='a', u='m')} || '·' || {_POWER.format(e='b', u='s')} else {_POWER.format(e='a', u='m')} || {_POWER.format(e='b', u='s')} end as unit from (select p_partkey, p_size % 5 - 2 as a, p_partkey % 5 - 2 as b from part) x")(
    lambda spark, d: _part(spark, d).select("p_partkey", K.coherent_unit(F.array((F.col("p_size") % 5 - 2).cast("int"), F.lit(0), (F.col("p_partkey") % 5 - 2).cast("int"), *map(F.lit, (0, 0, 0, 0)))).alias("unit")))
_DIVIDED = "value = (a + b) / (a - b)"
query("c3_exact_values", flat=True, sql="select p_partkey, case when a = b then null when (a + b) % (a - b) = 0 then cast((a + b) // (a - b) as varchar) else cast((a + b) // gcd(a + b, a - b) * sign(a - b) as bigint) || '/' || cast(abs((a - b) // gcd(a + b, a - b)) as bigint) end as value, case when a = b then 'DIVISION_BY_ZERO' end as problem from (select p_partkey, cast(p_size as bigint) as a, cast(p_partkey % 10 as bigint) as b from part) x")(
    lambda spark, d: K.evaluated(_part(spark, d).select("p_partkey", F.lit(_DIVIDED).alias("formula"), F.create_map(F.lit("a"), _fraction(F.col("p_size")), F.lit("b"), _fraction(F.col("p_partkey") % 10)).alias("bound"))).select("p_partkey", "value", "problem"))


def _fraction(c):
    return F.struct(c.cast("string").alias("value"), F.lit(None).cast("array<int>").alias("dimension"))

# exact duplicates: statements without their brand, places and names by number
_ITEM = f"select id, {_N.format('id')} as n, knowledge_type as kt, regexp_replace(statement, ' by .*$', '') as norm, 'p' || cast({_N.format('id')} % 3 as varchar) as loc, case when knowledge_type = 'DEFINITION' then 'a' || cast({_N.format('id')} % 2 as varchar) end as al from kb_knowledge"


def _exact(kb):
    n = counter("id")
    items = kb.knowledge.select("id", "knowledge_type", F.regexp_replace("statement", " by .*$", "").alias("norm"), F.concat(F.lit("p"), (n % 3).cast("string")).alias("location"), F.when(F.col("knowledge_type") == "DEFINITION", F.concat(F.lit("a"), (n % 2).cast("string"))).alias("alias"))
    return items, D.exact_groups(items)


query("d4_exact_groups", flat=True, sql=f"{with_tables('knowledge')}, items as ({_ITEM}), links as (select a.n as a, b.n as b from items a join items b on a.kt = b.kt and a.norm = b.norm and (a.kt not in ('EQUATION', 'DEFINITION') or a.loc = b.loc or coalesce(a.al = b.al, false))), reach as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b) select i.id, j.id as canonical_id from items i join (select a, min(b) as b from reach group by a) m on m.a = i.n join items j on j.n = m.b")(lambda spark, d: _exact(knowledge_base(spark, d))[1])
query("d5_decisions", flat=True)(lambda spark, d: D.decisions(*_exact(knowledge_base(spark, d))))
query("d6_statement_peers", flat=True)(lambda spark, d: D.statement_peers(*_exact(knowledge_base(spark, d))))
query("d10_unrecorded_pairs", flat=True)(lambda spark, d: (lambda kb: C.equivalent_pairs(kb, kb.edge.where("relation_type = 'EQUIVALENT_TO'").select(F.col("from_concept_id").alias("a"), F.col("to_concept_id").alias("b"))).select("concept_a", "concept_b"))(knowledge_base(spark, d)))

# requests in words


_ASKS = (  # text before and after the target, intent, rule, part
    ("Please,  what is the ", "?", "QUERY_CONCEPT", "query.what_is", "definition"), ("What does ", " require?", "REASON", "reason.requires", "dependencies"), ("search my books for ", "", "KEYWORD_SEARCH", "query.keyword", None), ("State ", ".", "QUERY_CONCEPT", "query.state_law", "explanation"),
    ("which properties does ", " have?", "QUERY_CONCEPT", "query.properties", "properties"), ("Compare the two definitions of ", " given in my books", "QUERY_CONCEPT", "query.compare_definitions", "definitions_all"), ("where was ", " mentioned in my notes?", "QUERY_CONCEPT", "query.where_stated", "locations"),
    ("Explain the ", "!", "QUERY_CONCEPT", "query.what_is", "explanation"), ("draw a diagram of ", "", "IMAGE_REQUEST", "image.request", None), ("If the load is 5 ohms, what is ", "?", "CALCULATE", "calculate.given_first", "value"),
)


def _requests(spark, d):
    """Requests about each part's type and name; every twelfth is nothing that a rule knows, and every twelfth one asks twice."""
    p, t = _part(spark, d), F.concat_ws(" ", "p_type", "p_name")
    single = [F.concat(F.lit(before), t, F.lit(after)) for before, after, *_ in _ASKS]
    text = F.element_at(F.array(*single, F.concat(F.lit("sing of "), t), F.concat(F.lit("what are the prerequisites of "), t, F.lit(" and then find everything about "), t)), (F.col("p_partkey") % 12 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("request_id"), text.alias("text"))


_ASKED = "select p_partkey as request_id, {c} as clause, '{i}' as intent, '{r}' as rule, 'INTERPRETED' as status, p_type || ' ' || p_name as target, cast(null as varchar) as scope, {p} as part from part where p_partkey % 12 = {k}"
query("n1_interpreted", flat=True, sql=" union all ".join([
    *(_ASKED.format(c=0, i=i, r=r, p="null" if p is None else f"'{p}'", k=k) for k, (_, _, i, r, p) in enumerate(_ASKS)), "select p_partkey, 0, null, '', 'UNRECOGNIZED', null, null, null from part where p_partkey % 12 = 10",
    _ASKED.format(c=0, i="QUERY_CONCEPT", r="query.prerequisites", p="'prerequisites'", k=11), _ASKED.format(c=1, i="QUERY_CONCEPT", r="query.everything", p="'everything'", k=11)]))(
    lambda spark, d: Q.interpreted(_requests(spark, d)).select("request_id", "clause", "intent", "rule", "status", "target", "scope", "part"))
query("n3_scopes", flat=True, sql="select p_partkey as request_id, case p_size % 3 when 0 then 'MY_BOOKS' when 1 then 'AUTHORIZED' end as scope, p_type as target from part")(
    lambda spark, d: Q.interpreted(_part(spark, d).select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("Explain the "), F.col("p_type"), F.when(F.col("p_size") % 3 == 0, " according to my books").when(F.col("p_size") % 3 == 1, " from authorised sources").otherwise(""), F.lit(" please.")).alias("text"))).select("request_id", "scope", "target"))


def _concept_requests(kb):
    n = counter("id")
    return kb.concept.select(n.alias("request_id"), F.concat(F.when(n % 2 == 0, "Show everything about ").otherwise("What are the prerequisites of "), F.col("canonical_name")).alias("text"))


_WANTED = "case when " + _N.format("c.id") + " % 2 = 0 then 'everything' else 'prerequisites' end"
_FOUND = (
    f"with_found as (select {_N.format('s.section_id')} as request_id, s.group_no, s.group_name, s.position, s.item_id, coalesce(case when right(s.group_name, 1) = 's' then left(s.group_name, length(s.group_name) - 1) end || ': ' || k.statement, e.relation_type || ': ' || coalesce(o.names, '')) as text,"
    f" case when k.certainty = 'UNCERTAIN' then coalesce({_WHY.format(c='m.methods')}, 'stored as uncertain') end as uncertain"
    f" from ({_section_sql(False)}) s join kb_concept c on c.id = s.section_id left join kb_knowledge k on k.id = s.item_id left join kb_edge e on e.id = s.item_id"
    f" left join (select section_id, edge_id, string_agg(distinct canonical_name, ', ') as names from ({_LINKS}) l join kb_concept n on n.id = l.other where l.k is null group by 1, 2) o on o.section_id = s.section_id and o.edge_id = s.item_id"
    f" left join (select knowledge_id, string_agg(distinct extraction_method, ' ') as methods from kb_source_occurrence group by 1) m on m.knowledge_id = s.item_id where {_N.format('c.id')} % 2 = 0 or s.group_name = 'Prerequisites')"
).removeprefix("with_found as ")
_ANSWERED = f"select request_id, cast(0 as int) as clause, 'FOUND' as status, row_number() over (partition by request_id order by group_no, position) as line, group_name, item_id, text, uncertain from {_FOUND} f"
simple("an1_answers", lambda kb: Q.answers(kb, _concept_requests(kb)), _SECTION_TABLES, f"{_ANSWERED} union all select {_N.format('id')}, 0, 'UNKNOWN', 0, null, null, null, null from kb_concept where {_N.format('id')} not in (select request_id from {_FOUND} g)")
simple("an1_sources", lambda kb: Q.answer_sources(kb, Q.answers(kb, _concept_requests(kb))), _SECTION_TABLES, (
    f"select request_id, clause, place, document_id, page_number, text from (select request_id, clause, document_id, page_number, text, row_number() over (partition by request_id, clause order by first) as place from (select a.request_id, a.clause, p.document_id, p.page_number, p.text, min(row(a.line, {_N.format('p.document_id')}, p.page_number, p.char_start, {_N.format('p.id')})) as first"
    f" from ({_ANSWERED}) a join (select subject_id, id, document_id, page_number, char_start, text from ({_EVIDENCE}) e union all select b.relationship_id, o.id, o.document_id, o.page_number, o.char_start, o.text from kb_basis b join kb_source_occurrence o on o.id = b.basis_occurrence_id) p on p.subject_id = a.item_id group by 1, 2, 3, 4, 5) x) y where place <= {Q.MOST_SOURCES}"))  # fmt: skip
simple("an1_conflicts", lambda kb: Q.answer_conflicts(kb, _concept_requests(kb)), ("edge", "knowledge", "concept", "conflict"), (
    f"select distinct {_N.format('e.from_concept_id')} as request_id, cast(0 as int) as clause, c.id as conflict_id, c.claim_a_id, a.statement as claim_a, c.claim_b_id, b.statement as claim_b from kb_edge e join kb_concept p on p.id = e.from_concept_id join kb_knowledge k on k.id = e.to_knowledge_id and k.lifecycle_status not in ('ARCHIVED', 'DELETED') join kb_conflict c on e.to_knowledge_id in (c.claim_a_id, c.claim_b_id) and c.lifecycle_status not in ('ARCHIVED', 'DELETED')"
    " left join kb_knowledge a on a.id = c.claim_a_id and a.lifecycle_status not in ('ARCHIVED', 'DELETED') left join kb_knowledge b on b.id = c.claim_b_id and b.lifecycle_status not in ('ARCHIVED', 'DELETED') where e.lifecycle_status = 'ACTIVE'"))  # fmt: skip
