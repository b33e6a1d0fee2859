"""Typed requests as rows: what each asks for, whether it may be asked so, and what it finds within its scope and filters.

A request has one of four modes and only that mode's fields. Its filters are arrays: a value must be in each array that
is not empty. Any number of requests is answered at once; each mode meets the items by equality.
"""

from __future__ import annotations

from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalised
from quillspark.operators import evidence as E
from quillspark.operators.retrieval import placed, tokens
from quillspark.storage import written

Base = SimpleNamespace

#: The fields that each mode takes, the filters by what they narrow, the prefixes of identifiers that may be looked up.
MODES = {"CONCEPT": ("name",), "EXACT": ("identifier",), "PAGE": ("document_id", "page_number"), "KEYWORD": ("term",)}
ITEM_FILTERS = {"knowledge_types": "knowledge_type", "lifecycle_statuses": "lifecycle_status", "certainties": "certainty", "relation_types": "relation_type", "origins": "origin"}
ROW_FILTERS = {"document_ids": "document_id", "run_ids": "extraction_run_id", "run_statuses": "run_status", "extractor_versions": "extractor_version", "source_categories": "source_category", "pages": "page_number"}
LOOKED_UP = ("CPT", "K", "REL", "DOC")
FIELDS = "request_id long, mode string, name string, identifier string, document_id string, page_number int, term string, prefix boolean, scope string, include_superseded boolean"
SCHEMA = FIELDS + "".join(f", {f} array<string>" for f in (*ITEM_FILTERS, *ROW_FILTERS))


def requests(rows: DataFrame) -> DataFrame:
    """Rows with all columns of SCHEMA, those that are missing or null at their defaults: no filters, the scope MY_BOOKS, superseded items shown."""
    defaults = {"prefix": F.lit(False), "scope": F.lit("MY_BOOKS"), "include_superseded": F.lit(True)} | {f: F.array().cast("array<string>") for f in (*ITEM_FILTERS, *ROW_FILTERS)}
    out = []
    for field in SCHEMA.split(", "):
        name, kind = field.split(" ", 1)
        own = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(own, defaults[name]) if name in defaults else own).alias(name))
    return rows.select(*out)


def problem() -> Column:
    """Why a request can't be answered as it is asked; null if it can."""
    fields = [f for names in MODES.values() for f in names]
    given = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), f) for f in fields)))
    takes = reduce(lambda c, m: c.when(F.col("mode") == m, F.array(*map(F.lit, MODES[m]))), MODES, F)
    valid = lambda c, kinds: F.regexp_like(c, F.lit(rf"^(?:{'|'.join(kinds)})-[0-9]{{8,}}$"))
    each = lambda c, kinds: F.forall(c, lambda x: F.coalesce(valid(x, kinds), F.lit(False)))
    return (
        F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "NO_SUCH_MODE").when(F.col("prefix") & (F.col("mode") != "KEYWORD"), "PREFIX_WITHOUT_KEYWORD").when(~F.col("scope").isin("MY_BOOKS", "AUTHORIZED"), "NO_SUCH_SCOPE")
        .when(~each("document_ids", ["DOC"]) | ~each("run_ids", ["RUN"]), "FILTER_NO_IDENTIFIER").when(F.exists("pages", lambda x: F.coalesce(x.try_cast("int") < 0, F.lit(True))), "FILTER_NO_PAGE").when(F.exists("extractor_versions", lambda x: F.coalesce(F.trim(x) == "", F.lit(True))), "FILTER_EMPTY_VERSION")
        .when(given != takes, "OTHER_FIELDS_THAN_ITS_MODE").when((F.col("mode") == "CONCEPT") & (F.trim("name") == ""), "EMPTY_NAME").when((F.col("mode") == "KEYWORD") & (F.trim(tokens(F.col("term"))) == ""), "EMPTY_TERM")
        .when((F.col("mode") == "EXACT") & ~valid(F.col("identifier"), LOOKED_UP), "NO_IDENTIFIER").when((F.col("mode") == "PAGE") & (~valid(F.col("document_id"), ["DOC"]) | (F.col("page_number") < 0)), "NO_PAGE")
    )


def items(kb: Base) -> DataFrame:
    """(item_id, kind, and the columns that item filters narrow) of statements, concepts and edges."""
    none = F.lit(None).cast("string")
    k = kb.knowledge.select(F.col("id").alias("item_id"), F.lit("KNOWLEDGE").alias("kind"), "knowledge_type", "lifecycle_status", "certainty", none.alias("relation_type"), none.alias("origin"))
    c = kb.concept.select("id", F.lit("CONCEPT"), none, "lifecycle_status", none, none, none)
    return k.union(c).union(kb.edge.select("id", F.lit("RELATIONSHIP"), none, "lifecycle_status", none, "relation_type", "origin"))


def found(kb: Base, asked: DataFrame) -> DataFrame:
    """(request_id, item_id) of what valid requests are about, whether it may be seen or not."""
    mode = lambda m: asked.where(F.col("mode") == m)
    every = items(kb).select("item_id")
    exact = mode("EXACT").select("request_id", F.col("identifier").alias("item_id")).join(every, "item_id").select("request_id", "item_id")
    names = kb.alias.where("lifecycle_status = 'ACTIVE'").select(F.col("normalized_alias").alias("key"), F.col("concept_id").alias("item_id")).distinct()
    concept = mode("CONCEPT").select("request_id", normalised(F.col("name")).alias("key")).join(names, "key").select("request_id", "item_id")
    page = mode("PAGE").select("request_id", "document_id", "page_number").join(placed(kb).select("document_id", "page_number", F.col("subject_id").alias("item_id")).distinct(), ["document_id", "page_number"]).select("request_id", "item_id")
    wanted = mode("KEYWORD").select("request_id", "prefix", F.trim(tokens(F.col("term"))).alias("phrase")).withColumn("first", F.substring_index("phrase", " ", 1))
    wanted = wanted.withColumn("alone", F.col("prefix") & (F.col("phrase") == F.col("first")))
    said = kb.knowledge.select(F.col("id").alias("item_id"), tokens(F.col("statement")).alias("t"))
    words = said.select("item_id", "t", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("word"))
    # a prefix of one word meets words by its beginnings of that length, of which requests name a few
    sizes = sorted(r[0] for r in wanted.where("alone").select(F.length("first")).distinct().collect())
    starts = words.select("item_id", "t", F.explode(F.concat(F.array("word"), *(F.array(F.left("word", F.lit(n))) for n in sizes))).alias("first")).distinct()
    whole = F.concat(F.lit(" "), F.col("phrase"), F.when(F.col("prefix"), F.lit("")).otherwise(F.lit(" ")))
    keyword = wanted.join(starts, "first").where(F.contains("t", whole)).select("request_id", "item_id").distinct()
    return exact.union(concept).union(page).union(keyword)


def answered(kb: Base, rows: DataFrame) -> DataFrame:
    """(request_id, problem, item_id, kind, n_in_scope, reason) of requests (see requests): an invalid one has its problem and no item, one that finds nothing a row without item.

    Evidence is judged by the request's scope, then by its filters of documents, runs, sources and pages; an item by its
    own filters and lifecycle. reason is null for what may be shown, else LEFT_OUT by lifecycle or item filter, or what
    its evidence says: no evidence, filtered, not authorized.
    """
    asked = written(requests(rows).withColumn("problem", problem()), "requests")
    valid = asked.where("problem is null")
    met = written(found(kb, valid).join(items(kb), "item_id"), "met")
    narrow = lambda filters: reduce(lambda a, b: a & b, ((F.size(f) == 0) | F.coalesce(F.array_contains(f, F.col(c).cast("string")), F.lit(False)) for f, c in filters.items()))
    d = met.join(valid.select("request_id", "scope", "include_superseded", *ITEM_FILTERS, *ROW_FILTERS), "request_id")
    status = F.col("lifecycle_status")
    alive = F.when(F.size("lifecycle_statuses") > 0, F.lit(True)).otherwise(~status.isin(*E.LEFT_OUT) & (F.col("include_superseded") | (status != "SUPERSEDED")))
    d = written(d.withColumn("shown", alive & narrow(ITEM_FILTERS)), "narrowed")
    rows_of = E.judged(kb, placed(kb).select(F.col("subject_id").alias("item_id"), "source_id", "extraction_run_id", "document_id", "page_number")).withColumnRenamed("verdict", "authorised")
    own = F.col("source_category").isin(*E.OWN_BOOKS) | (F.col("scope") == "AUTHORIZED")
    keep = d.where("shown").join(rows_of, "item_id", "left")
    seen = F.when(F.col("authorised") != E.IN_SCOPE, "no").when(~own, "no").when(narrow(ROW_FILTERS), "yes").otherwise("filtered")
    per = keep.groupBy("request_id", "item_id").agg(F.count_if(F.col("source_id").isNotNull()).alias("n"), F.count_if(F.col("source_id").isNotNull() & (seen == "yes")).alias("n_in_scope"), F.max(seen == "filtered").alias("filtered"))
    reason = F.when(~F.col("shown"), "LEFT_OUT").when(F.col("n_in_scope") > 0, None).when(F.col("n") == 0, "no evidence").when(F.col("filtered"), "filtered").otherwise("not authorized")
    judged = d.join(per, ["request_id", "item_id"], "left").select("request_id", "item_id", "kind", F.coalesce("n_in_scope", F.lit(0).cast("long")).alias("n_in_scope"), reason.alias("reason"))
    return asked.select("request_id", "problem").join(judged, "request_id", "left").select("request_id", "problem", "item_id", "kind", "n_in_scope", "reason")
