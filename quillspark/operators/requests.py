"""Requests in words, as rows: what each clause asks for, and the answer that stored knowledge gives.

Rules are a table of patterns. A clause takes the most specific rules that match it; if these ask for different things
it is ambiguous, if none matches it is not recognised. Nothing is guessed and nothing is run.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import counter
from quillspark.functions.text import normalised, singular
from quillspark.operators import evidence as E
from quillspark.operators.catalogue import concept_conflicts
from quillspark.operators.lookups import why_uncertain
from quillspark.operators.retrieval import GROUPS, links, placed, section, tokens
from quillspark.storage import spread, written

Base = SimpleNamespace

#: Rules of requests that read knowledge: name, priority (3 specific, 2 a verb, 1 general), pattern with the target in group 1, what is asked for, the part of the answer.
RULES = (
    ("source.where_did_you_get", 3, r"^where did you get (.+?)(?: from)?$", "SOURCE_QUERY", "provenance"),
    ("source.come_from", 3, r"^where (?:does|do|did) (.+?) come from$", "SOURCE_QUERY", "provenance"),
    ("source.source_of", 3, r"^(?:what is|what's|what are|show(?: me)?) the (?:source|sources|provenance) (?:of|for) (.+)$", "SOURCE_QUERY", "provenance"),
    ("query.look_up", 3, r"^(?:look up|lookup|show(?: me)?) ([A-Za-z]{1,4}-[0-9]+)$", "QUERY_ITEM", None),
    ("query.everything", 3, r"^(?:find|show(?: me)?|list|get|give me) (?:everything|all(?: the)? knowledge|all) (?:about|on|for) (.+)$", "QUERY_CONCEPT", "everything"),
    ("query.equations", 3, r"^(?:which|what) equations (?:are )?(?:associated with|for|of|about|related to|relate to|involve) (.+)$", "QUERY_CONCEPT", "equations"),
    ("query.prerequisites", 3, r"^what are the prerequisites (?:of|for) (.+)$", "QUERY_CONCEPT", "prerequisites"),
    ("reason.requires", 3, r"^what (?:does|do) (.+?) (?:require|depend on|need)$", "REASON", "dependencies"),
    ("reason.needed_for", 3, r"^what (?:is|are) (?:needed|required) (?:for|to (?:find|determine|calculate)) (.+)$", "REASON", "dependencies"),
    ("query.keyword", 3, r"^search (?:(?:in )?my books |my documents |the library )?for (.+)$", "KEYWORD_SEARCH", None),
    ("calculate.verb", 2, r"^(?:calculate|compute|evaluate|determine|work out|find) (?:the value of )?(?!everything\b|all\b)(.+)$", "CALCULATE", "value"),
    ("query.explain_principle", 3, r"^(?:explain|describe)(?: to me)?(?: the)? (?:operating principle|working principle|principle of operation|principle|working|operation|functioning|concept|basics|theory|mechanism|meaning)(?: of| behind)? (.+)$", "QUERY_CONCEPT", "explanation"),
    ("query.how_used", 3, r"^how (?:is|are) (.+?) used$", "QUERY_CONCEPT", "applications"),
    ("query.how_works", 3, r"^how (?:does|do|is|are) (.+?) (?:work|operate|function)$", "QUERY_CONCEPT", "explanation"),
    ("query.applications", 3, r"^(?:what are|list|describe)(?: the)? applications (?:of|for) (.+)$", "QUERY_CONCEPT", "applications"),
    ("query.explain_how_works", 3, r"^(?:explain|describe)(?: to me)? how (.+?) works?$", "QUERY_CONCEPT", "explanation"),
    ("query.equations_given", 3, r"^(?:which|what) (?:equations|formulas|formulae|relations) (?:are )?(?:given|provided|stated|listed|available|there|found) (?:for|about|on|in|of|with) (.+)$", "QUERY_CONCEPT", "equations"),
    ("query.equations_short", 3, r"^(?:the )?(?:equations|formulas|formulae) (?:for|of|about) (.+)$", "QUERY_CONCEPT", "equations"),
    ("query.variables", 3, r"^(?:what|which) (?:variables|quantities|symbols) (?:are )?(?:associated with|used in|in|of|appear in|involved in|related to|belong to) (.+)$", "QUERY_CONCEPT", "variables"),
    ("query.summarize", 3, r"^(?:summari[sz]e|give (?:me )?(?:a )?summary of|give (?:me )?an overview of|(?:an )?overview of) (?:what (?:my|the) (?:documents|books) say about )?(.+)$", "QUERY_CONCEPT", "summary"),
    ("query.state_law", 3, r"^(?:state (?=.)|what (?:does|do) (?=.+ state$))(.+?)(?: state)?$", "QUERY_CONCEPT", "explanation"),
    ("query.properties", 3, r"^(?:what|which) (?:are )?(?:the )?(?:properties|characteristics|features) (?:of|does|do) (.+?)(?: have)?(?: (?:are|is|do|does)(?: \w+)*?)?(?: (?:stated|given|listed|found|mentioned|there))?$", "QUERY_CONCEPT", "properties"),
    ("query.compare_definitions", 3, r"^compare (?:the )?(?:(?:two|different|all|various|both) )?definitions(?: (?:of|for) (.+?))?(?: (?:found|given|stated) in (?:my|the) (?:books|documents|notes))?$", "QUERY_CONCEPT", "definitions_all"),
    ("query.where_stated", 3, r"^where (?:is|are|was|were) (.+?) (?:stated|defined|mentioned|described|given|explained|found|discussed)(?:\s+(?:in|from) (?:my|the) (?:documents|books|notes|files|sources))?$", "QUERY_CONCEPT", "locations"),
    ("web.search", 3, r"^(?:search|look) (?:on )?(?:the )?(?:web|internet|online) for (.+)$", "WEB_SEARCH", None),
    ("image.request", 3, r"^(?:draw|generate|create|make|produce) (?:a |an |the )?(?:diagram|image|picture|drawing|schematic|block diagram)(?: of| for| showing)? (.+)$", "IMAGE_REQUEST", None),
    ("calculate.what_is_given", 3, r"^what (?:is|are|would be|will be) (.+?),? (?:given|if|when|where|with|for|at|assuming|knowing) (?=.*[0-9]).+$", "CALCULATE", "value"),
    ("calculate.given_first", 3, r"^(?:if|given|with|when|assuming|knowing|suppose|for)\s+(?=.*[0-9].*,).+?,\s*(?:then\s+)?(?:calculate|compute|find|determine|evaluate|work out|what is|what's|what are|what would be)\s+(.+)$", "CALCULATE", "value"),
    ("query.what_is", 1, r"^(?:what is|what's|what are|define|tell me about) (.+)$", "QUERY_CONCEPT", "definition"),
    ("query.what_is", 1, r"^(?:explain|describe) (.+)$", "QUERY_CONCEPT", "explanation"),
)
POLITE = r"(?i)^(?:(?:please|kindly|can you|could you|would you)[,\s]+)+"
SCOPES = {"AUTHORIZED": r"(?i)\s+(?:in|from|using) (?:all )?authori[sz]ed sources$", "MY_BOOKS": r"(?i)\s+(?:in|from|using|according to|based on|with) my (?:books|documents|notes|files|sources)$"}
CLAUSES = r"(?i)\s*(?:,\s*)?\b(?:and then|and|then)\s+(?=(?:open|launch|start|run|close|quit|exit|calculate|compute|evaluate|determine|type|press|take|capture|create|make|copy|move|rename|delete|remove|save|search|find|what|where|draw|generate|paste|look)\b)"
REFERENCES = r"(?i)^(?:it|this|that|these|those|them|(?:the|that|this|my) (?:project|file|document|folder|application|app|program|answer|result|window)|(?:this|that|these|those) \w+|(?:the )?(?:section|chapter|topic|page|paragraph|passage|part|document|book|text|above|following|previous|same|figure|table|example|subject|one))$"
#: The groups that each part of an answer shows, the most sources of an answer.
PARTS = {
    "definition": ("Definitions",), "explanation": ("Definitions", "Properties", "Relationships", "Dependencies"), "equations": ("Equations", "Variables"), "variables": ("Variables", "Equations"), "properties": ("Properties",), "applications": ("Applications",), "definitions_all": ("Definitions",),
    "summary": ("Definitions", "Properties", "Equations", "Variables", "Applications", "Examples", "Prerequisites", "Dependencies", "Relationships"), "locations": ("Definitions", "Properties", "Equations", "Variables", "Examples", "Applications"), "prerequisites": ("Prerequisites",), "everything": GROUPS, "dependencies": ("Prerequisites", "Dependencies"),
}
MOST_SOURCES = 5


def cleaned(text: Column) -> Column:
    """A request for the rules: one blank between words, no opening courtesy, no mark at the end. No word is changed."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, POLITE, ""), r"(?i)(?:\s+please)?[.!?]+$", ""))


def scope_of(text: Column) -> Column:
    """The scope that the end of a text names; null if it names none."""
    return reduce(lambda c, s: c.when(text.rlike(SCOPES[s]), s), SCOPES, F)


def without_scope(text: Column) -> Column:
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, SCOPES[s], ""), SCOPES, text))


def interpreted(requests: DataFrame) -> DataFrame:
    """(request_id, clause, text, intent, rule, status, target, scope, part) of requests (request_id, text), one row for each clause.

    A request is parted only if every clause is recognised. Empty ones are UNRECOGNIZED; a target that only points
    (`this`) is INCOMPLETE.
    """
    any_rule = lambda t: reduce(lambda a, b: a | b, (t.rlike("(?i)" + r[2]) for r in RULES))
    # what is used more than once is a column of its own, so that it is worked out once
    c = spread(requests.select("request_id", F.coalesce("text", F.lit("")).alias("text")), "request_id").withColumn("whole", cleaned(F.col("text")))
    c = c.withColumn("pieces", F.filter(F.transform(F.split("whole", CLAUSES), cleaned), lambda x: x != ""))
    clauses = F.when((F.size("pieces") > 1) & F.forall("pieces", any_rule), F.col("pieces")).otherwise(F.array("whole"))
    c = c.select("request_id", F.posexplode(clauses).alias("clause", "text"))
    hit = lambda r: F.when(F.col("text").rlike("(?i)" + r[2]), F.struct(F.lit(r[1]).alias("priority"), F.lit(r[0]).alias("rule"), F.lit(r[3]).alias("intent"), F.regexp_extract("text", "(?i)" + r[2], 1).alias("x"), F.lit(r[4]).cast("string").alias("part")))
    c = c.withColumn("hits", F.array_compact(F.array(*map(hit, RULES)))).withColumn("most", F.array_max(F.transform("hits", lambda h: h["priority"])))
    c = c.withColumn("best", F.filter("hits", lambda h: h["priority"] == F.col("most")))
    c = c.withColumn("kinds", F.array_distinct(F.col("best.intent"))).withColumn("one", F.get("best", F.lit(0)))
    c = c.withColumn("target", F.trim(F.regexp_replace(without_scope(F.col("one.x")), r"(?i)^(?:the|a|an)\s+", "")))
    status = F.when(F.size("best") == 0, "UNRECOGNIZED").when(F.size("kinds") > 1, "AMBIGUOUS").when((F.col("target") == "") | F.col("target").rlike(REFERENCES), "INCOMPLETE").otherwise("INTERPRETED")
    intent = F.when(F.size("kinds") > 1, "AMBIGUOUS_REQUEST").otherwise(F.col("one.intent"))
    out = c.select("request_id", "clause", "text", intent.alias("intent"), F.array_join(F.col("best.rule"), "+").alias("rule"), status.alias("status"), F.when(F.size("kinds") == 1, F.col("target")).alias("target"), scope_of(F.col("one.x")).alias("scope"), F.col("one.part").alias("part"))
    # written, so that what callers filter by is not worked out again before it
    return written(out, "clauses")


def resolved(kb: Base, asked: DataFrame) -> DataFrame:
    """asked (…, target) with the concepts that bear the name, by its normal form; the singular counts only where the name itself is unknown. A name of several concepts gives a row for each."""
    names = kb.alias.where("lifecycle_status = 'ACTIVE'").select(F.col("normalized_alias").alias("key"), "concept_id").distinct()
    a = asked.withColumn("name", normalised(F.col("target"))).withColumn("single", singular(F.col("name")))
    direct = a.join(names.withColumnRenamed("key", "name"), "name", "left")
    unknown = direct.where("concept_id is null").drop("concept_id").join(names.withColumnRenamed("key", "single"), "single", "left")
    return direct.where("concept_id is not null").select(*asked.columns, "concept_id").union(unknown.select(*asked.columns, "concept_id"))


def _asked(kb: Base, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clauses about concepts and what they require, and the concepts that each resolves to, as members of a section for each clause."""
    asked = written(interpreted(requests).where("status = 'INTERPRETED' and intent in ('QUERY_CONCEPT', 'REASON')").select("request_id", "clause", "target", "part", F.struct("request_id", "clause").alias("section_id")), "asked")
    return asked, written(resolved(kb, asked).where("concept_id is not null").select("section_id", "concept_id").distinct(), "members")


def answers(kb: Base, requests: DataFrame, own_books: bool | None = None) -> DataFrame:
    """(request_id, clause, status, line, group_name, item_id, text, uncertain) of the requests about concepts and what they require.

    FOUND lines show the groups that the request asks for in their order: a statement after the group's name without its
    last letter s, or a relation with the names of the concepts at its other end. `uncertain` says why a statement is.
    Where nothing is found, MENTIONED statements hold the name, and one UNKNOWN row stands where there is none. No line
    and no mention is left out, however many there are.
    """
    asked, members = _asked(kb, requests)
    shown = F.create_map(*(x for p, g in PARTS.items() for x in (F.lit(p), F.array(*map(F.lit, g)))))
    lines = section(kb, members, own_books).join(asked.select("section_id", "part"), "section_id").where(F.array_contains(F.element_at(shown, F.col("part")), F.col("group_name")))
    methods = kb.source_occurrence.groupBy(F.col("knowledge_id").alias("item_id")).agg(F.array_join(F.sort_array(F.collect_set("extraction_method")), " ").alias("methods"))
    said = kb.knowledge.select(F.col("id").alias("item_id"), "statement", (F.col("certainty") == "UNCERTAIN").alias("doubt"))
    # names at the other end of an edge, those that the request itself resolves to left out
    others = links(kb, members, own_books).where("knowledge_id is null").join(members.select("section_id", F.col("concept_id").alias("neighbour_id")), ["section_id", "neighbour_id"], "left_anti")
    named = others.join(kb.concept.select(F.col("id").alias("neighbour_id"), "canonical_name"), "neighbour_id").groupBy("section_id", "item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(counter("neighbour_id").alias("n"), F.col("canonical_name").alias("name")))), lambda x: x["name"]), ", ").alias("names"))
    types = kb.edge.select(F.col("id").alias("item_id"), "relation_type", F.col("to_knowledge_id").isNull().alias("to_concept"))
    found = lines.join(said, "item_id", "left").join(methods, "item_id", "left").join(types, "item_id", "left").join(named, ["section_id", "item_id"], "left")
    flat = F.trim(F.regexp_replace("statement", r"(?U)\s+", " "))
    text = F.when(F.col("statement").isNotNull(), F.concat(F.regexp_replace("group_name", "s$", ""), F.lit(": "), flat)).otherwise(F.concat("relation_type", F.lit(": "), F.coalesce("names", F.lit(""))))
    place = F.row_number().over(W.partitionBy("section_id").orderBy("group_no", "position", counter("item_id"), "item_id", "to_concept", "relation_type"))
    reason = F.when(F.col("doubt"), F.coalesce(why_uncertain(F.coalesce("methods", F.lit(""))), F.lit("stored as uncertain")))
    found = found.select("section_id.*", F.lit("FOUND").alias("status"), place.alias("line"), "group_name", "item_id", text.alias("text"), reason.alias("uncertain"))
    silent = asked.join(found.select("request_id", "clause").distinct(), ["request_id", "clause"], "left_anti").withColumn("wanted", F.trim(tokens(F.col("target"))))
    # names without an answer are few and met by their first word, then checked as a phrase
    words = kb.knowledge.where(E.lifecycle_allows()).select(F.col("id").alias("item_id"), F.col("statement").alias("text"), tokens(F.col("statement")).alias("t"))
    words = words.select("item_id", "text", "t", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("first"))
    met = silent.withColumn("first", F.substring_index("wanted", " ", 1)).join(words, "first").where(F.expr("contains(t, concat(' ', wanted, ' '))"))
    nth = F.row_number().over(W.partitionBy("request_id", "clause").orderBy(counter("item_id"), "item_id"))
    none = F.lit(None).cast("string")
    mentioned = met.select("request_id", "clause", F.lit("MENTIONED").alias("status"), nth.alias("line"), F.lit("Mentions").alias("group_name"), "item_id", "text", none.alias("uncertain"))
    unknown = silent.join(mentioned.select("request_id", "clause").distinct(), ["request_id", "clause"], "left_anti").select("request_id", "clause", F.lit("UNKNOWN").alias("status"), F.lit(0).alias("line"), none.alias("group_name"), none.alias("item_id"), none.alias("text"), none.alias("uncertain"))
    return found.union(mentioned).union(unknown)


def answer_sources(kb: Base, lines: DataFrame, own_books: bool | None = None) -> DataFrame:
    """(request_id, clause, place, document_id, page_number, text): the first MOST_SOURCES places that the lines of each answer come from, each once, in the order of the lines and of the evidence."""
    rows = placed(kb, own_books).select(F.col("subject_id").alias("item_id"), "document_id", "page_number", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"), F.struct(counter("document_id").alias("d"), F.col("page_number").alias("p"), F.col("char_start").alias("c"), counter("id").alias("n")).alias("at"))
    met = lines.where("item_id is not null").select("request_id", "clause", "line", "item_id").join(rows, "item_id")
    first = met.groupBy("request_id", "clause", "document_id", "page_number", "text").agg(F.min(F.struct("line", "at")).alias("first"))
    place = F.row_number().over(W.partitionBy("request_id", "clause").orderBy("first")).alias("place")
    return first.select("request_id", "clause", place, "document_id", "page_number", "text").where(F.col("place") <= MOST_SOURCES)


def answer_conflicts(kb: Base, requests: DataFrame) -> DataFrame:
    """(request_id, clause, conflict_id, claim_a_id, claim_a, claim_b_id, claim_b): the conflicts in force about what the asked concepts' edges lead to, each once for a clause; none is resolved."""
    _, members = _asked(kb, requests)
    return members.join(concept_conflicts(kb), "concept_id").select("section_id.*", "conflict_id", "claim_a_id", "claim_a", "claim_b_id", "claim_b").distinct()


__all__ = ["GROUPS", "RULES", "answer_conflicts", "answer_sources", "answers", "cleaned", "interpreted", "resolved", "scope_of"]
