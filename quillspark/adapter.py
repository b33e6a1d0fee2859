"""The driver's tables read as a knowledge base: documents, sources, runs, concepts, statements, edges and evidence.

Each table is one SELECT that Spark and other engines read alike, so checks can repeat it word for word.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import SparkSession

from quillspark.session import small_broadcasts


def _id(prefix: str, n: str) -> str:
    return f"'{prefix}-' || lpad(cast({n} as string), cast(greatest(8, length(cast({n} as string))) as int), '0')"


DOC, SRC, K = _id("DOC", "{}"), _id("SRC", "{}"), _id("K", "{}")
_CATEGORY = "case s_suppkey % 7 when 0 then 'USER_PROVIDED_SOURCE' when 1 then 'LOCAL_SOURCE' when 2 then 'AUTHORIZED_EXTERNAL_SOURCE' when 3 then 'SYSTEM_DERIVED' when 4 then 'USER_STATED' when 5 then 'UNKNOWN_SOURCE' else 'UNAUTHORIZED_SOURCE' end"
_KIND = "case p_size % 6 when 0 then 'DEFINITION' when 1 then 'PROPERTY' when 2 then 'EQUATION' when 3 then 'RULE' when 4 then 'EXAMPLE' else case when p_partkey % 2 = 0 then 'VARIABLE' else 'PROCEDURE' end end"
_RUN = "l_suppkey * 10 + 1 + l_orderkey % (1 + l_suppkey % 3)"
_PLACE = f"{_id('DOC', 'l_suppkey')} as document_id, {_id('SRC', 'l_suppkey')} as source_id, {_id('RUN', _RUN)} as extraction_run_id, cast(l_linenumber as int) as page_number, cast(l_quantity * 10 as int) as char_start, cast(l_quantity * 10 as int) + 20 as char_end, case when l_partkey % 5 = 0 then cast(null as string) else {_id('SEG', 'l_suppkey * 100 + l_linenumber')} end as segment_id, l_returnflag || ' ' || l_linestatus as text, case when l_linenumber = 3 then 'deterministic/RuleCandidate@v6+weak' when l_linenumber = 2 then 'deterministic/EquationCandidate@v6+ocr' else 'deterministic/DefinitionCandidate@v6' end as extraction_method"



def _braced(text: str) -> str:
    """The text between braces, which stand as numbers so that no format string takes them for names."""
    return f"chr(123) || {text} || chr(125)"


_S_HALF = "'S_' || " + _braced("cast(cast(floor(p_partkey / 2) as bigint) as string)")
_K_SEVENTH = "'K_' || " + _braced("cast(p_partkey % 7 as string)")

#: In order: a table may use those before it.
TABLES: dict[str, str] = {
    "kb_document": f"select {_id('DOC', 's_suppkey')} as id, s_name || '.pdf' as filename, md5(s_name) as file_hash, case when s_suppkey % 4 = 0 then 'PARTIALLY_PROCESSED' else 'PROCESSED' end as processing_status, 'PDF' as source_type from supplier",
    "kb_source": f"select {_id('SRC', 's_suppkey')} as id, s_name as name, {_CATEGORY} as source_category, case when s_suppkey % 5 = 4 then 'NOT_AUTHORIZED' else 'AUTHORIZED' end as authorization, 'AVAILABLE' as availability, {_id('DOC', 's_suppkey')} as document_id, md5(s_name) as file_hash from supplier",
    "kb_run": " union all ".join(f"select {_id('RUN', f's_suppkey * 10 + {n}')} as id, {_id('DOC', 's_suppkey')} as document_id, {n} as run_number, case when (s_suppkey + {n}) % 5 = 0 then 'PARTIAL' when (s_suppkey + {n}) % 11 = 0 then 'FAILED' else 'COMPLETED' end as status, {n} + 2 as extractor_version from supplier where {n} <= 1 + s_suppkey % 3" for n in (1, 2, 3)),
    "kb_issue": f"select {_id('XIS', 'event_id')} as id, {_id('RUN', '(user_id % 10 + 1) * 10 + 1')} as extraction_run_id, {_id('DOC', 'user_id % 10 + 1')} as document_id, case event_type when 'click' then 'UNKNOWN_VARIABLE' when 'view' then 'BROKEN_RELATIONSHIP' when 'error' then 'MALFORMED_METADATA' else 'POTENTIAL_CONTRADICTION' end as issue_type, cast(event_id % 9 + 1 as int) as page_number, event_type || ' ' || cast(user_id as string) as detail from events",
    "kb_concept": f"select {_id('CPT', 'r_regionkey + 1')} as id, r_name as canonical_name, 'ACTIVE' as lifecycle_status from region union all select {_id('CPT', 'n_nationkey + 101')}, n_name, 'ACTIVE' from nation union all select {_id('CPT', 's_suppkey + 1000')}, s_name, case when s_suppkey % 11 = 0 then 'SUPERSEDED' else 'ACTIVE' end from supplier",
    "kb_alias": f"select id as concept_id, lower(canonical_name) as normalized_alias, canonical_name as alias, 'ACTIVE' as lifecycle_status from kb_concept union all select {_id('CPT', 's_suppkey + 1000')}, 'supplier ' || cast(s_suppkey % 40 as string), 'Supplier ' || cast(s_suppkey % 40 as string), case when s_suppkey % 13 = 0 then 'DEPRECATED' else 'ACTIVE' end from supplier",
    "kb_knowledge": f"select {_id('K', 'p_partkey')} as id, {_KIND} as knowledge_type, lower(p_type) as canonical_name, lower(p_type) || ' is rated ' || cast(p_size as string) || ' by ' || p_brand as statement, case p_partkey % 13 when 0 then 'ARCHIVED' when 1 then 'SUPERSEDED' when 2 then 'DELETED' when 3 then 'UNCERTAIN' else 'ACTIVE' end as lifecycle_status, case when p_partkey % 3 = 0 then 'UNCERTAIN' else 'REPORTED_BY_SOURCE' end as certainty from part",
    "kb_edge": (
        f"select {_id('REL', 'n_nationkey + 1')} as id, 'PARENT_OF' as relation_type, 'EXPLICIT' as origin, 'ACTIVE' as lifecycle_status, {_id('CPT', 'n_regionkey + 1')} as from_concept_id, {_id('CPT', 'n_nationkey + 101')} as to_concept_id, cast(null as string) as to_knowledge_id from nation"
        f" union all select {_id('REL', 's_suppkey + 1000')}, 'PARENT_OF', 'EXPLICIT', case when s_suppkey % 9 = 0 then 'INVALID' else 'ACTIVE' end, {_id('CPT', 's_nationkey + 101')}, {_id('CPT', 's_suppkey + 1000')}, cast(null as string) from supplier"
        f" union all select {_id('REL', 's_suppkey + 1000000')}, 'REQUIRES', 'EXPLICIT', 'ACTIVE', {_id('CPT', 's_suppkey + 1000')}, {_id('CPT', 'cast(floor(s_suppkey / 2) as bigint) + 1000')}, cast(null as string) from supplier where s_suppkey > 1"
        f" union all select {_id('REL', 's_suppkey + 2000000')}, 'DEPENDS_ON', 'INFERRED', 'ACTIVE', {_id('CPT', 's_suppkey + 1000')}, {_id('CPT', '(s_suppkey * 7) % 50 + 1001')}, cast(null as string) from supplier where s_suppkey % 10 = 3 and s_suppkey <> (s_suppkey * 7) % 50 + 1"
        f" union all select {_id('REL', 's_suppkey + 3000000')}, 'EQUIVALENT_TO', 'EXPLICIT', 'ACTIVE', {_id('CPT', 's_suppkey + 1000')}, {_id('CPT', 's_suppkey + 994')}, cast(null as string) from supplier where s_suppkey > 6 and s_suppkey % 17 = 5"
        f" union all select {_id('REL', 's_suppkey + 4000000')}, 'PART_OF', 'EXPLICIT', 'ACTIVE', {_id('CPT', 's_suppkey + 1000')}, {_id('CPT', 's_suppkey + 1003')}, cast(null as string) from supplier where s_suppkey % 10 in (1, 4)"
        f" union all select {_id('REL', 's_suppkey + 5000000')}, 'PREREQUISITE_OF', 'EXPLICIT', 'ACTIVE', {_id('CPT', 's_suppkey + 1000')}, {_id('CPT', '(s_suppkey * 3) % 60 + 1001')}, cast(null as string) from supplier where s_suppkey % 6 = 2"
        f" union all select {_id('REL', 'l_suppkey * 10000000 + l_partkey')}, case {_KIND} when 'DEFINITION' then 'DEFINED_BY' when 'PROPERTY' then 'HAS_PROPERTY' when 'RULE' then 'APPLIES_TO' when 'PROCEDURE' then 'USES' else 'RELATED_TO' end, 'EXPLICIT', 'ACTIVE', {_id('CPT', 'l_suppkey + 1000')}, cast(null as string), {_id('K', 'l_partkey')} from (select distinct l_suppkey, l_partkey from lineitem where l_linenumber = 1) as l join part on p_partkey = l_partkey"
    ),
    "kb_source_occurrence": f"select {_id('S', 'l_orderkey * 10 + l_linenumber')} as id, {_id('K', 'l_partkey')} as knowledge_id, {_PLACE} from lineitem where l_linenumber <= 3",
    "kb_concept_occurrence": f"select {_id('CO', 'l_orderkey * 10 + l_linenumber')} as id, {_id('CPT', 'l_suppkey + 1000')} as concept_id, {_PLACE} from lineitem where l_linenumber = 4",
    "kb_edge_occurrence": f"select {_id('RO', 'l_orderkey * 10 + l_linenumber')} as id, {_id('REL', 'l_suppkey + 1000000')} as relationship_id, {_PLACE} from lineitem where l_linenumber = 5",
    "kb_basis": f"select {_id('REL', 's_suppkey + 2000000')} as relationship_id, 'R1' as rule, 1 as rule_version, {_id('S', 's_suppkey * 10 + 1')} as basis_occurrence_id, s_name as matched_text from supplier where s_suppkey % 20 = 3",
    "kb_equivalence": f"select {_id('K', 'p_partkey')} as canonical_knowledge_id, {_id('K', 'p_partkey + 1')} as other_knowledge_id, case when p_partkey % 3 = 0 then 'CONTRADICTORY' when p_partkey % 3 = 1 then 'POSSIBLE_DUPLICATE' else 'EXACT_DUPLICATE' end as outcome, 'P8-12' as rule, 1 as rule_version, {_id('RUN', '(p_partkey % 20 + 1) * 10 + 1')} as extraction_run_id from part where p_partkey % 7 = 0",
    "kb_conflict": f"select {_id('CON', 'p_partkey')} as id, {_id('K', 'p_partkey')} as claim_a_id, {_id('K', 'p_partkey + 1')} as claim_b_id, 'UNDETERMINED' as cause, case when p_partkey % 2 = 0 then 'ACTIVE' else 'ARCHIVED' end as lifecycle_status from part where p_partkey % 21 = 0",
    "kb_equation": f"select {_id('EQN', 'p_partkey')} as id, {_id('K', 'p_partkey')} as knowledge_id, 'x' || cast(p_size as string) || case when p_partkey % 4 = 0 then ' == y' when p_partkey % 4 = 1 then ' = (y + 2' when p_partkey % 4 = 2 then ' = y * ' else ' = y / z' end as expression, 'ACTIVE' as lifecycle_status from part where p_size % 6 = 2",
    "kb_variable": f"select {_id('VAR', 'p_partkey')} as id, {_id('K', 'p_partkey')} as knowledge_id, 'x' || cast(p_size as string) as symbol, 'ACTIVE' as lifecycle_status from part where p_size % 6 = 1",
    "kb_rule": f"select {_id('RUL', 'p_partkey')} as id, {_id('K', 'p_partkey')} as knowledge_id, p_name as name, case when p_partkey % 9 = 0 then 'ARCHIVED' else 'ACTIVE' end as lifecycle_status from part where p_size % 6 = 3",
    "kb_procedure": f"select {_id('PRC', 'p_partkey')} as id, {_id('K', 'p_partkey')} as knowledge_id, p_name as name, 'ACTIVE' as lifecycle_status from part where p_size % 6 = 5",
    "kb_edition": f"select {_id('EDN', 's_suppkey')} as id, md5(s_name) as file_hash, {_id('WRK', 'cast(floor(s_suppkey / 3) as bigint) + 1')} as work_id, 'edition ' || cast(s_suppkey % 3 + 1 as string) as label from supplier where s_suppkey % 4 <> 0",
    "kb_structure": f"select {_id('STR', 'l_orderkey')} as id, {_id('DOC', 'l_suppkey')} as document_id, cast(l_orderkey as bigint) as ordinal, 'Section ' || cast(cast(l_quantity as int) as string) as title, cast(l_quantity as int) % 4 + 1 as depth from lineitem where l_linenumber = 6",
    "kb_law": (
        f"select {_id('K', 'p_partkey')} as id, cast(p_partkey as bigint) as n, cast(floor(p_partkey / 2) as bigint) as m, cast(p_partkey % 7 as bigint) as q, 'S_' || {_braced('cast(p_partkey as string)')} ||"
        f" case p_partkey % 5 when 0 then ' = ' || chr(92) || 'frac' || {_braced(_S_HALF)} || {_braced(_K_SEVENTH)} when 1 then ' = ' || {_S_HALF} || ' + 2 W' when 2 then ' = ' || {_S_HALF} || {_K_SEVENTH} when 3 then '^' || {_braced("'2'")} || ' = ' || {_S_HALF} else ' = ' || chr(92) || 'int ' || {_S_HALF} || ' dt' end as expression from part where p_partkey > 0"
    ),
    "kb_segment": f"select {_id('SEG', 'doc_id + 1')} as id, {_id('DOC', 'doc_id + 1')} as document_id, text, source, lang from documents",
}

_BASE = ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents")


def knowledge_base(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """The tables as DataFrames: document, source, run, issue, concept, alias, knowledge, edge, the occurrences, basis, equivalence, conflict, segment."""
    small_broadcasts(spark)
    known = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _BASE}
    for name, text in TABLES.items():
        used = {t: df for t, df in known.items() if f" {t}" in text}
        for t in sorted(used, key=len, reverse=True):
            text = _named(text, t)
        known[name] = spark.sql(text, **used)
    return SimpleNamespace(**{name.removeprefix("kb_"): df for name, df in known.items() if name.startswith("kb_")})


def _named(text: str, table: str) -> str:
    """Table names after from and join as arguments of spark.sql."""
    for word in ("from ", "join "):
        for end in (" ", ")", ""):
            target = f"{word}{table}{end}"
            if end:
                text = text.replace(target, f"{word}{{{table}}}{end}")
            elif text.endswith(target):
                text = text[: -len(table)] + f"{{{table}}}"
    return text


def with_tables(*names: str) -> str:
    """A WITH clause that defines the tables named, and those that they use."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in TABLES:
            if other != name and f" {other} " in TABLES[name] + " ":
                add(other)
        if name not in need:
            need.append(name)

    for n in names:
        add(n if n.startswith("kb_") else f"kb_{n}")
    return "with recursive " + ", ".join(f"{n} as ({TABLES[n]})" for n in need)
