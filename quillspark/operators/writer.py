"""Candidates of detectors become stored rows: concepts, knowledge, edges and occurrences of one run for each document.

Each step is a set of rows. What a document names more than once is one concept; what it relates more than once is one
edge with several occurrences; equal statements are linked to the first object and not stored again. Numbers follow the
order of document, page, category and place.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import format_id
from quillspark.functions.text import collapse, label, normalised
from quillspark.operators.dedup import exact_groups
from quillspark.operators.lookups import DISCARDING
from quillspark.operators.structure import masked
from quillspark.operators.validation import equation_problem, page_glyph_loss
from quillspark.storage import written

#: The order in which categories are written, the types that they are stored as, the version in method tags.
ORDER = ("CONCEPT", "DEFINITION", "EQUATION", "VARIABLE", "UNIT", "PROPERTY", "RULE", "EXAMPLE", "PROCEDURE", "PREREQUISITE", "RELATIONSHIP")
STORED = ("DEFINITION", "EQUATION", "VARIABLE", "UNIT", "PROPERTY", "RULE", "EXAMPLE", "PROCEDURE")
VERSION = 6
TWO_ENDS = ("RELATIONSHIP", "PREREQUISITE")
#: Columns that say where a claim stands, and with what.
PLACE = ("page_number", "rank", "char_start", "char_end")
AT = ("document_id", *PLACE, "method", "text")
#: Readers whose text is the document's own.
EXACT_READERS = ("docx", "pptx", "xlsx", "epub", "html", "markdown", "txt", "csv", "rtf")


def numbered(df: DataFrame, prefix: str, *order: Column) -> DataFrame:
    """df with `id`, numbered from 1 in an order that has no ties: by place within sorted ranges of the order, and the sizes of the ranges before, so no task holds all rows and they are shuffled once."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("id", format_id(prefix, F.col("_n") + F.col("_before"))).drop("_at", "_part", "_n", "_before")


def method_tag(category: Column, weak: Column, ocr: Column) -> Column:
    """How a claim was obtained, with what makes it uncertain."""
    return F.concat(F.lit("deterministic/"), F.initcap(F.lower(category)), F.lit(f"Candidate@v{VERSION}"), F.when(ocr, "+ocr").otherwise(""), F.when(weak, "+weak").otherwise(""))


def certainty(category: Column, weak: Column, ocr: Column, exact: Column) -> Column:
    """Recognised text and weakly recognised claims are uncertain, and so are equations unless their reader keeps the text as it is."""
    return F.when(ocr | weak | ((category == "EQUATION") & ~exact), "UNCERTAIN").otherwise("REPORTED_BY_SOURCE")


def validated(candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of one statement or name that are kept, relations and prerequisites that are, and the issues (document_id, page_number, issue_type, detail) of those that are not.

    Relations and prerequisites need both ends among the concepts that the document defines, by the normal form of
    their names; equations must not be broken, and numeric ones are not stored. Only relations meet the names. `norm_text`
    and `norm` are what a stored statement says and its normal form, `key` that of a concept's name or a property's owner.
    """
    of = F.col("category")
    defines, stored, two = of.isin("CONCEPT", "DEFINITION"), of.isin(*STORED), of.isin(*TWO_ENDS)
    # texts are worked out once, before anything is written or sampled
    c = candidates.withColumn("problem", F.when(of == "EQUATION", equation_problem(F.col("statement")))).withColumn("norm_text", F.when(stored, collapse(F.coalesce("statement", "text"))))
    c = c.withColumn("norm", normalised(F.col("norm_text"))).withColumn("key", normalised(F.when(defines, F.col("name")).when(of == "PROPERTY", F.col("owner"))))
    c = written(c, "candidates")
    known = c.where(defines).select("document_id", "key").distinct()
    end = lambda side: known.select("document_id", F.col("key").alias(f"{side}_key"), F.lit(True).alias(f"knows_{side}"))
    ends = c.where(two).withColumn("from_key", normalised(F.coalesce("subject", "name"))).withColumn("to_key", normalised(F.col("object"))).join(end("from"), ["document_id", "from_key"], "left").join(end("to"), ["document_id", "to_key"], "left")
    broken = F.col("knows_from").isNull() | F.col("knows_to").isNull()
    single = c.where(~two & F.col("problem").isNull() & ~((F.col("category") == "EQUATION") & F.col("numeric"))).drop("problem")
    issue = lambda kind, detail: ("document_id", "page_number", F.lit(kind).alias("issue_type"), detail.alias("detail"))
    issues = c.where(~two & F.col("problem").isNotNull()).select(*issue("INVALID_EQUATION_STRUCTURE", F.col("problem")))
    issues = issues.union(ends.where(broken).select(*issue("BROKEN_RELATIONSHIP", F.concat_ws(" -> ", "from_key", "to_key"))))
    return single, ends.where(~broken).select(*single.columns, "from_key", "to_key"), issues


def labelled() -> Column:
    """What a statement is called: the type, a definition's concept, a unit or a property's subject, or an example's own label, and the beginning of the statement (a definition's: the concept)."""
    cut = lambda prefix, text: F.concat(prefix, F.substring(label("", text), 1, 1 << 16))
    kind, none = F.col("category"), F.lit("")
    statement = F.col("norm_text")
    named = lambda word, c: F.concat(F.lit(f"{word} "), F.coalesce(c, none))
    prefix = (
        F.when(kind == "UNIT", named("Unit", F.col("unit"))).when(kind == "PROPERTY", named("Property of", F.coalesce("owner", "subject", "name")))
        .when(kind == "EXAMPLE", F.coalesce("name", F.lit("Example"))).otherwise(F.initcap(F.lower(kind)))
    )
    return cut(prefix, F.when(kind == "DEFINITION", F.coalesce("name", none)).otherwise(statement))


def companions(said: DataFrame) -> DataFrame:
    """(id, kind, knowledge_id, document_id, expression, symbol, name, unit, statement, lifecycle_status): what equations, variables, rules and procedures have besides their statement, one row for each stored one."""
    kinds = {"EQUATION": "EQN", "VARIABLE": "VAR", "RULE": "RUL", "PROCEDURE": "PRC"}
    of = F.col("category")
    c = said.where(of.isin(*kinds)).withColumn("number", F.split_part("id", F.lit("-"), F.lit(2)).cast("long"))
    prefix = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), of)
    name = F.when(of == "VARIABLE", F.col("name")).when(of == "RULE", F.substring(F.coalesce("name", F.lit("Rule")), 1, 200)).when(of == "PROCEDURE", F.coalesce("name", F.lit("Procedure")))
    only = lambda kind, col: F.when(of == kind, F.col(col))
    return c.select(F.concat_ws("-", prefix, F.lpad(F.col("number").cast("string"), 8, "0")).alias("id"), of.alias("kind"), F.col("id").alias("knowledge_id"), "document_id", only("EQUATION", "norm_text").alias("expression"), only("VARIABLE", "symbol").alias("symbol"), name.alias("name"), only("VARIABLE", "unit").alias("unit"), F.when(of.isin("RULE", "PROCEDURE"), F.col("norm_text")).alias("statement"), F.lit("ACTIVE").alias("lifecycle_status"))


class Tables:
    """The tables of one run for each document: concept, alias, knowledge, companion, edge, concept_occurrence, source_occurrence, edge_occurrence, issue, run. Each is made, with what it needs, when it is first asked for."""

    def __init__(self, candidates: DataFrame, pages: DataFrame) -> None:
        self._pages = pages
        single, two, self._broken = validated(candidates)
        self._single, self._two = self._marked(single), self._marked(two)

    def _marked(self, kept: DataFrame) -> DataFrame:
        """Kept candidates with their rank, method and certainty; they meet the pages only where these say how their text was got."""
        says = {"ocr": ("text_origin", F.col("text_origin") == "OCR"), "exact": ("reader", F.col("reader").isin(*EXACT_READERS))}
        told = {name: c.alias(name) for name, (column, c) in says.items() if column in self._pages.columns}
        c = kept.join(self._pages.select("document_id", "page_number", *told.values()), ["document_id", "page_number"], "left") if told else kept
        c = c.withColumns({name: F.lit(False) for name in says if name not in told}).na.fill(False, ["ocr", "exact", "weak"])
        rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))
        c = c.withColumn("rank", rank).withColumn("method", method_tag(F.col("category"), F.col("weak"), F.col("ocr"))).withColumn("certainty", certainty(F.col("category"), F.col("weak"), F.col("ocr"), F.col("exact")))
        return written(c, "kept") if told else c

    @property
    def _known(self) -> DataFrame:
        return self._single.where("category in ('CONCEPT', 'DEFINITION')").select("document_id", "key").distinct()

    @cached_property
    def _named(self) -> DataFrame:
        """Where concepts are named, and by which name and key."""
        c, two = self._single, self._two
        owner = c.where("category = 'PROPERTY' and owner is not null").join(self._known, ["document_id", "key"], "left_semi")
        ends = [
            c.where("category in ('CONCEPT', 'DEFINITION')").select(*AT, "name", "key"), owner.select(*AT, F.col("owner").alias("name"), "key"),
            two.select(*AT, F.coalesce("subject", "name").alias("name"), F.col("from_key").alias("key")), two.select(*AT, F.col("object").alias("name"), F.col("to_key").alias("key")),
        ]
        return written(reduce(DataFrame.union, ends), "named")

    @cached_property
    def _concepts(self) -> DataFrame:
        first = self._named.groupBy("document_id", "key").agg(F.min(F.struct(*PLACE, "name")).alias("f"))
        concept = numbered(first.select("document_id", "key", "f.name", *(F.col(f"f.{p}").alias(p) for p in PLACE)), "CPT", F.col("document_id"), *(F.col(p) for p in PLACE), F.col("key"))
        return written(concept.select("document_id", "key", F.col("name").alias("canonical_name"), "id"), "concepts")

    @property
    def _ids(self) -> DataFrame:
        return self._concepts.select("document_id", "key", F.col("id").alias("concept_id"))

    @cached_property
    def _said(self) -> DataFrame:
        """Statements with their numbers, and those of the equal ones that they are linked to."""
        said = self._single.where(F.col("category").isin(*STORED))
        said = numbered(said, "K", F.col("document_id"), *(F.col(p) for p in PLACE), F.col("norm_text"), F.coalesce("name", F.lit("")), F.coalesce("symbol", F.lit("")), F.coalesce("unit", F.lit("")))
        items = said.select("id", F.col("category").alias("knowledge_type"), "norm", F.concat_ws(":", "document_id", "page_number", "char_start").alias("location"), F.when(F.col("category") == "DEFINITION", F.col("key")).alias("alias"))
        return written(said.join(exact_groups(items), "id"), "linked")

    @cached_property
    def _related(self) -> DataFrame:
        """What is related where: a concept to a statement or another concept."""
        said, ids = self._said, self._ids
        hold = said.where("category = 'DEFINITION' and name is not null").select(*AT, F.lit("DEFINED_BY").alias("relation_type"), "key", F.col("canonical_id").alias("target"))
        hold = hold.union(said.where("category = 'PROPERTY' and owner is not null").join(self._known, ["document_id", "key"], "left_semi").select(*AT, F.lit("HAS_PROPERTY"), "key", F.col("canonical_id")))
        hold = hold.join(ids, ["document_id", "key"]).select(*AT, "relation_type", F.col("concept_id").alias("source"), "target")
        pre = self._two.select(*AT, F.when(F.col("category") == "PREREQUISITE", "PREREQUISITE_OF").otherwise(F.col("relation_type")).alias("relation_type"), "from_key", "to_key")
        pre = pre.join(ids.withColumnRenamed("key", "from_key").withColumnRenamed("concept_id", "source"), ["document_id", "from_key"]).join(ids.withColumnRenamed("key", "to_key").withColumnRenamed("concept_id", "target"), ["document_id", "to_key"])
        return written(hold.union(pre.select(*AT, "relation_type", "source", "target")), "related")

    @cached_property
    def edge(self) -> DataFrame:
        single = self._related.groupBy("relation_type", "source", "target").agg(F.min(F.struct("document_id", *PLACE)).alias("f"))
        edge = numbered(single.select("relation_type", "source", "target", "f.*"), "REL", F.col("document_id"), *(F.col(p) for p in PLACE), F.col("relation_type"), F.col("source"), F.col("target"))
        return written(edge.select("id", "relation_type", F.col("source").alias("from_concept_id"), F.when(F.col("target").startswith("CPT-"), F.col("target")).alias("to_concept_id"), F.when(F.col("target").startswith("K-"), F.col("target")).alias("to_knowledge_id"), F.lit("EXPLICIT").alias("origin"), F.lit("ACTIVE").alias("lifecycle_status")), "edges")

    @cached_property
    def concept(self) -> DataFrame:
        return self._concepts.select("id", "document_id", "canonical_name", F.lit("ACTIVE").alias("lifecycle_status"))

    @cached_property
    def alias(self) -> DataFrame:
        return self._concepts.select(F.col("id").alias("concept_id"), F.col("key").alias("normalized_alias"), F.col("canonical_name").alias("alias"), F.lit("ACTIVE").alias("lifecycle_status"))

    @cached_property
    def knowledge(self) -> DataFrame:
        return self._said.where("id = canonical_id").select("id", "document_id", F.col("category").alias("knowledge_type"), labelled().alias("label"), F.col("norm_text").alias("statement"), "certainty", F.lit("ACTIVE").alias("lifecycle_status"))

    @cached_property
    def companion(self) -> DataFrame:
        return companions(self._said.where("id = canonical_id"))

    @cached_property
    def source_occurrence(self) -> DataFrame:
        return self._said.select(F.col("canonical_id").alias("knowledge_id"), (F.col("id") != F.col("canonical_id")).alias("linked"), "category", *_spot())

    @cached_property
    def concept_occurrence(self) -> DataFrame:
        return self._named.join(self._ids, ["document_id", "key"]).select("concept_id", *_spot()).dropDuplicates(["concept_id", "page_number", "char_start"])

    @cached_property
    def edge_occurrence(self) -> DataFrame:
        by_edge = self.edge.select(F.col("id").alias("relationship_id"), "relation_type", F.col("from_concept_id").alias("source"), F.coalesce("to_concept_id", "to_knowledge_id").alias("target"))
        return self._related.join(by_edge, ["relation_type", "source", "target"]).select("relationship_id", *_spot())

    @cached_property
    def issue(self) -> DataFrame:
        claims = masked(self._pages.select("document_id", "page_number", "text")).select("document_id", "page_number", F.col("expository").alias("text"))
        return written(self._broken.union(page_glyph_loss(claims).select("document_id", "page_number", F.lit("OCR_UNCERTAINTY"), F.concat_ws(": ", "sign", "excerpt"))), "issues")

    @cached_property
    def run(self) -> DataFrame:
        lost = self.issue.where(F.col("issue_type").isin(*DISCARDING)).groupBy("document_id").agg(F.count("*").alias("n_issues"))
        runs = self._pages.select("document_id").distinct().join(lost, "document_id", "left")
        return runs.select("document_id", F.when(F.coalesce("n_issues", F.lit(0)) > 0, "PARTIAL").otherwise("COMPLETED").alias("status"))


def _spot() -> tuple[str | Column, ...]:
    return "document_id", "page_number", "char_start", "char_end", F.col("method").alias("extraction_method"), "text"


def write(candidates: DataFrame, pages: DataFrame) -> Tables:
    """See Tables.

    A run is PARTIAL if one of its issues kept something from being stored as it stands, lost glyphs among its claims included.

    candidates: what detectors found; pages: (document_id, page_number, text), with text_origin and reader if known.
    Repeated candidates add occurrences; documents without candidates have a run and nothing else.
    """
    return Tables(candidates, pages)


def report(tables: Tables) -> DataFrame:
    """(document_id, category, n_stored, n_linked) of what was written."""
    return tables.source_occurrence.groupBy("document_id", "category").agg(F.count_if(~F.col("linked")).alias("n_stored"), F.count_if(F.col("linked")).alias("n_linked"))
