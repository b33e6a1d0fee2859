"""What pages state: definitions, equations, variables, units, properties, rules, examples, procedures, prerequisites
and relations, each with its exact span. Expository text is read for claims, instructional text for examples.

All rows have (document_id, page_number, char_start, char_end, category, text, name, statement, symbol, unit, subject,
object, owner, relation_type, numeric, weak); what a category lacks is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import clean_term, let
from quillspark.operators.structure import lines, masked, prose_regions, sentences
from quillspark.storage import written

_PAGE = ("document_id", "page_number")
FIELDS = ("name", "statement", "symbol", "unit", "subject", "object", "owner", "relation_type")
#: Cue phrases and shapes.
LABELLED_TERM = r"^\s*(?:\d{1,2}\s*[.)]\s*)?([A-Z][A-Za-z][A-Za-z \-/]{1,44}?)\s*:\s+(\S.{15,})$"
DASH_TERM = r"^\s*([A-Z][A-Za-z][A-Za-z \-/]{1,44}?)\s+[—–-]\s+(\S.{15,})$"
BY_WE_MEAN = r"(?i)^By\s+(?:the\s+term\s+)?(?:an?\s+|the\s+)?([A-Za-z][\w \-]{1,40}?),?\s+(?:we|one)\s+means?\b"
WE_DEFINE = r"(?i)^We\s+define\s+(?:an?\s+|the\s+)?([A-Za-z][\w \-]{1,40}?)\s+(?:as|to be)\b"
COMPLEMENT = r"(?i)\b(?:is called|are called|is known as|are known as|is termed|are termed|is said to be|are said to be)\b"
SUBJECT = r"(?i)\b(?:is defined as|are defined as|refers to|refer to|is the name given to|denotes|is defined to be|are defined to be|stands for|is the term for)\b"
IS_A = r"(?i)^(?:A|An|The)\s+([A-Za-z][A-Za-z \-]{2,44}?)\s+is\s+(?:a|an|the)\s+\S"
NOUNS = (
    "measure ability capacity quantity rate process device component opposition flow amount ratio unit region type kind form phenomenon method principle law state condition study branch science set collection "
    "element circuit material product sum difference number value tendency relationship force mechanism technique system instrument function variable constant parameter measurement electrode semiconductor "
    "transistor particle substance field energy"
).split()
BARE_IS = r"^([A-Z][A-Za-z\-]*(?:\s+[a-z][a-z\-]*){0,3})\s+(?:is|are)\s+(?:the|an?)\s+(?:[a-z\-]+\s+){0,2}?(?:" + "|".join(NOUNS) + r")\b"
TERM_END = r"\s*(?:,|;|\(|\band\b|\bwhich\b|\bthat\b|\bor\b|\bif\b|\bfor\b|\bwhen\b|\bwith\b)"
OPENING = r"(?i)^(?:It|This|They|These|(?:A|An|The)\s+[\w \-]{1,40}?)\s+(?:is|are|means|refers to)\b"
MEASURED_IN = r"(?i)\b(?:is |are )?(?:measured|expressed)\s+in\s+([A-Za-zΩΩ]+)\s*(?:\(([^)]{1,4})\))?"
UNIT_OF = r"(?i)\b(?:SI\s+)?units?\s+of\s+([a-z][a-z ]{2,30}?)\s+(?:is|are)\s+(?:the\s+)?([A-Za-zΩΩ]+)\s*(?:\(([^)]{1,4})\))?"
NOT_UNITS = ["terms", "the", "a", "an", "form", "this", "which", "its", "either", "both", "such", "units", "per", "general", "polar", "rectangular", "phasor", "time"]
PROPERTY_OF_SUBJECT = r"^([A-Za-z][A-Za-z \-']{2,40}?)\s+(?:is|are)\s+(?:the|a|an)\s+(?:property|properties|characteristic|characteristics)\b"
PROPERTY_NAMED = r"(?i)\b(?:the\s+)?(?:property|characteristic)s?\s+of\s+([a-zA-Z][\w \-]{2,40}?)\s+(?:is|are)\b"
MODAL = r"(?i)\b(?:must|shall|should never|never|always|cannot)\b"
NAMED_LAW = r"\b((?!(?:This|That|These|The|Above|Following|Same)\b)[A-Z][A-Za-z]+(?:\s?['’]\s?s)?(?:\s+[A-Z][A-Za-z]+)?\s+(?i:law|theorem|principle|rule))\b"
INVARIANT = r"(?i)\b(?:is|are)\s+(?:equal\s+to|zero|constant|the\s+same)\b|\bequals\b|\bsum\s+of\b.*\bis\b"
EXAMPLE = r"(?i)^\s*(Example\s*[\d.]*)\s*[:.–—-]?\s*(.*)$"
STEP = r"(?i)^\s*Step\s*(\d{1,2})\s*[:.–—-]?\s*(.*)$"
PREREQUISITE = r"(?i)\bis\s+(?:a\s+)?pre-?requisites?\s+(?:for|of|to)\s+([A-Za-z][\w \-]{2,40})"
REQUIRES_KNOWLEDGE = r"(?i)\brequires?\s+(?:a\s+)?(?:prior\s+)?(?:knowledge|understanding)\s+of\s+([A-Za-z][\w \-]{2,40})"
RELATIONS = {
    "COMPOSED_OF": "consists of|consist of|is composed of|is made up of",
    "PART_OF": "is a part of|is part of|forms part of",
    "INSTANCE_OF": "is a type of|is a kind of|is an example of|is a form of|is a special case of",
    "DEPENDS_ON": "depends on|depend on|is dependent on|is a function of",
    "EQUIVALENT_TO": "is equivalent to|are equivalent to|is the same as",
    "DERIVED_FROM": "is derived from|is obtained from",
    "ALTERNATIVE_TO": "can be replaced by|may be replaced by",
    "USES": "is used to|is used in|is used for|are used to|are used in",
    "APPLIES_TO": "applies to|is applicable to|is applicable only to",
    "REQUIRES": "requires|must satisfy|must obey",
    "PRODUCES": "produces|supplies|deliver|delivers|generates",
    "CONSTRAINS": "constrains|is limited by",
}
EQUALS = r"[=≅≈∝]"
#: What a sentence holds if a detector finds something in it: beginnings, a symbol that is something, or the first word of a cue.
OPENINGS = (LABELLED_TERM, DASH_TERM, BY_WE_MEAN, WE_DEFINE, IS_A, BARE_IS)
SYMBOL_IS = r"(?:where|and|,)\s+[A-Za-z](?:_?[A-Za-z0-9]{1,3})?\s+is\s"
CUES = r"(?i)\b(?:" + "|".join([*(p.removeprefix(r"(?i)\b(?:").removesuffix(r")\b") for p in (COMPLEMENT, SUBJECT, MODAL)), *RELATIONS.values(), "denote|represent|measured|expressed|unit|propert|characteristic|law|theorem|principle|rule|pre-?requisite|require"]) + ")"


def _some(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _after(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(text, r"(?s)^.*?" + pattern.replace("(?i)", "(?i:", 1) + ")" if pattern.startswith("(?i)") else r"(?s)^.*?" + pattern, ""))


def _before(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.get(F.split(text, pattern, 2), F.lit(0)))


def _leading(text: Column) -> Column:
    """The noun phrase at the start, cut where a term ends."""
    return clean_term(F.get(F.split(text, TERM_END, 2), F.lit(0)))


def _row(category: str, weak: Column | bool = False, numeric: Column | bool = False, **fields: Column) -> list[Column]:
    given = [fields.get(f, F.lit(None).cast("string")).cast("string").alias(f) for f in FIELDS]
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [*(F.col(c) for c in _PAGE), F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.lit(category).alias("category"), F.col("flat").alias("text"), *given, flag(numeric).alias("numeric"), flag(weak).alias("weak")]


def definitions(s: DataFrame) -> DataFrame:
    """Glossary entries, then `By X we mean`, `We define X`, `is called X`, `X is defined as`, `A X is a`, and weakly `X is the <noun>`; each with its concept, which a page lists once."""
    flat = F.col("flat")
    entry = F.coalesce(clean_term(F.coalesce(_some(flat, LABELLED_TERM), _some(flat, DASH_TERM))), F.lit(None))
    body = F.trim(F.coalesce(_some(flat, LABELLED_TERM, 2), _some(flat, DASH_TERM, 2)))
    d = s.withColumn("is_entry", flat.rlike(LABELLED_TERM) | flat.rlike(DASH_TERM)).withColumn("entry", entry).withColumn("body", body)
    head = F.regexp_replace(F.lower("entry"), "s+$", "")
    defines = F.startswith(F.lower("body"), head) | F.col("body").rlike(OPENING) | F.col("body").rlike(SUBJECT) | F.col("body").rlike(COMPLEMENT)
    apposition = F.col("body").rlike(r"(?i)^(?:the|an?)\s+\w") & ~F.get(F.split("body", ","), F.lit(0)).rlike(r"\b(?:is|are|was|were)\b")
    explicit = F.coalesce(clean_term(_some(flat, BY_WE_MEAN)), clean_term(_some(flat, WE_DEFINE)))
    strong = F.coalesce(explicit, _leading(_after(flat, COMPLEMENT)), clean_term(_before(flat, SUBJECT)), clean_term(_some(flat, IS_A)))
    bare = clean_term(_some(flat, BARE_IS))
    d = d.withColumn("term", F.when(F.col("is_entry"), F.col("entry")).otherwise(F.coalesce(strong, bare))).withColumn("weak", F.when(F.col("is_entry"), ~defines).otherwise(strong.isNull()))
    d = d.withColumn("stated", F.when(~F.col("is_entry"), flat).when(defines, F.col("body")).when(apposition, F.concat_ws(": ", "entry", "body"))).where("term is not null")
    first = F.row_number().over(W.partitionBy(*_PAGE, F.lower("term")).orderBy("start")) == 1
    concepts = d.withColumn("first", first).where("first").select(*_row("CONCEPT", name=F.col("term")))
    return concepts.union(d.where("stated is not null").select(*_row("DEFINITION", name=F.col("term"), statement=F.col("stated"), weak=F.col("weak"))))


def equations(l: DataFrame) -> DataFrame:
    """Lines with an equality, a symbol on the left and few words; numeric if nothing symbolic remains on the right."""
    flat = F.trim("stripped")
    left = F.trim(F.get(F.split(flat, EQUALS, 2), F.lit(0)))
    last = F.trim(F.element_at(F.split(flat, EQUALS), -1))
    bare = F.regexp_replace(F.regexp_replace(last, r"(?:\d+(?:\.\d+)?|\.\d+)\s*(?:[×x·]\s*10\^?-?\d+)?\s*(?:[a-zA-ZΩμ°%]{1,4}\b)?", ""), r"[\d\s+\-−*/×·().,^]", "")
    ok = flat.rlike(EQUALS) & left.rlike(r"(?U)^[\p{L}\\(][\p{L}\p{N}_{}\\()^' ]{0,24}$") & (F.length(last) > 0) & (F.size(F.regexp_extract_all(flat, F.lit(r"[A-Za-z]{4,}"), F.lit(0))) <= 3)
    rows = l.where(ok).withColumn("flat", flat).withColumn("end", F.col("offset") + F.length("raw")).withColumnRenamed("offset", "start")
    return rows.select(*_row("EQUATION", statement=flat, symbol=left, numeric=F.length(bare) == 0))


def variables(s: DataFrame) -> DataFrame:
    """`where V is the voltage`, `the voltage is denoted by V`; several in a sentence."""
    where = F.transform(F.regexp_extract_all("flat", F.lit(r"\b(?:where|and|,)\s+([A-Za-z](?:_?[A-Za-z0-9]{1,3})?)\s+(?:is|denotes|represents)\s+(?:the\s+)?([a-z][a-z \-]{2,40}?)(?=,|;|\.| and |$)"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"\s([A-Za-z](?:_?[A-Za-z0-9]{1,3})?)\s+(?:is|denotes|represents)", 1).alias("symbol"), F.regexp_extract(m, r"(?:is|denotes|represents)\s+(?:the\s+)?(.*)$", 1).alias("name")))
    by = F.transform(F.regexp_extract_all("flat", F.lit(r"(?:[Tt]he\s+)?[a-z][a-z \-]{2,40}?\s+is\s+(?:denoted|represented)\s+by\s+[A-Za-z](?:_?[A-Za-z0-9]{1,3})?\b"), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"([A-Za-z0-9_]+)$", 1).alias("symbol"), F.regexp_replace(F.regexp_replace(m, r"\s+is\s+(?:denoted|represented).*$", ""), r"^[Tt]he\s+", "").alias("name")))
    each = s.select("*", F.explode(F.array_distinct(F.concat(where, by))).alias("v")).where(~F.lower("v.symbol").isin("a", "an", "as", "at", "it", "in", "is", "so"))
    return each.select(*_row("VARIABLE", symbol=F.col("v.symbol"), name=F.trim("v.name")))


def units_of(s: DataFrame) -> DataFrame:
    """`measured in <unit>`, `the unit of <quantity> is <unit>`; words that are no unit are left out."""
    flat = F.col("flat")
    unit, quantity = F.coalesce(_some(flat, UNIT_OF, 2), _some(flat, MEASURED_IN, 1)), _some(flat, UNIT_OF, 1)
    return s.withColumn("u", unit).where(F.col("u").isNotNull() & ~F.lower("u").isin(NOT_UNITS)).select(*_row("UNIT", unit=F.col("u"), name=quantity, symbol=F.coalesce(_some(flat, UNIT_OF, 3), _some(flat, MEASURED_IN, 2))))


def properties(s: DataFrame) -> DataFrame:
    """`X is the property of …` has no owner; `the property of X is …` belongs to X."""
    flat = F.col("flat")
    named, owned = clean_term(_some(flat, PROPERTY_OF_SUBJECT)), clean_term(_some(flat, PROPERTY_NAMED))
    return s.withColumn("n", F.coalesce(named, owned)).where("n is not null").select(*_row("PROPERTY", name=F.col("n"), statement=flat, owner=F.when(named.isNull(), owned)))


def rules(s: DataFrame) -> DataFrame:
    """Modal sentences, and sentences that name a law and state an invariant."""
    flat = F.col("flat")
    law = _some(flat, NAMED_LAW)
    return s.where(flat.rlike(MODAL) | (law.isNotNull() & flat.rlike(INVARIANT))).select(*_row("RULE", name=law, statement=flat))


def examples(l: DataFrame) -> DataFrame:
    """`Example N` lines; the body is on the line, or the prose lines that follow it, five at most."""
    order = W.partitionBy(*_PAGE).orderBy("line")
    next_lines = F.array(*(F.lead("stripped", i).over(order) for i in range(1, 6)))
    rows = l.withColumn("next", next_lines).where(F.col("stripped").rlike(EXAMPLE)).withColumn("flat", F.col("stripped")).withColumn("end", F.col("offset") + F.length("raw")).withColumnRenamed("offset", "start")
    body = F.aggregate("next", F.struct(F.lit("").alias("t"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & F.coalesce(F.length(x) >= 4, F.lit(False)), F.trim(F.concat(a["t"], F.lit(" "), x))).otherwise(a["t"]).alias("t"), (a["on"] & F.coalesce(F.length(x) >= 4, F.lit(False))).alias("on")), lambda a: F.substring(a["t"], 1, 400))
    return rows.select(*_row("EXAMPLE", name=F.trim(F.regexp_extract("flat", EXAMPLE, 1)), statement=F.coalesce(_some(F.col("flat"), EXAMPLE, 2), F.nullif(body, F.lit("")))))


def procedures(l: DataFrame) -> DataFrame:
    """Two or more `Step N` lines of a page are one procedure, from the first to the last."""
    steps = l.where(F.col("stripped").rlike(STEP)).groupBy(*_PAGE).agg(F.count("*").alias("n"), F.min("offset").alias("start"), F.max(F.col("offset") + F.length("raw")).alias("end"), F.sort_array(F.collect_list(F.struct("line", F.regexp_extract("stripped", STEP, 2).alias("body")))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["body"]), " / ")
    return steps.where("n >= 2").withColumn("flat", joined).select(*_row("PROCEDURE", statement=joined))


def prerequisites(s: DataFrame) -> DataFrame:
    """`X is a prerequisite for Y` and `Y requires a knowledge of X`: subject before object."""
    flat = F.col("flat")
    first, second = flat.rlike(PREREQUISITE), flat.rlike(REQUIRES_KNOWLEDGE)
    subject = F.when(first, clean_term(_before(flat, PREREQUISITE))).when(second, clean_term(_some(flat, REQUIRES_KNOWLEDGE)))
    target = F.when(first, _leading(_some(flat, PREREQUISITE))).when(second, clean_term(_before(flat, REQUIRES_KNOWLEDGE)))
    return s.withColumn("a", subject).withColumn("b", target).where("a is not null and b is not null").select(*_row("PREREQUISITE", subject=F.col("a"), object=F.col("b"), relation_type=F.lit("PREREQUISITE_OF")))


def relations(s: DataFrame) -> DataFrame:
    """The first relation phrase of the table that a sentence holds, with the terms before and after it."""
    flat, found = F.col("flat"), F.lit(None).cast("string")
    before = after = F.lit(None).cast("string")
    for kind, cue in reversed(RELATIONS.items()):
        p = rf"(?i)\b(?:{cue})\b"
        found = F.when(flat.rlike(p), F.lit(kind)).otherwise(found)
        before = F.when(flat.rlike(p), _before(flat, p)).otherwise(before)
        after = F.when(flat.rlike(p), _after(flat, p)).otherwise(after)
    d = s.withColumn("r", found).where("r is not null").withColumn("a", clean_term(before)).withColumn("b", _leading(after))
    return d.where("a is not null and b is not null and lower(a) <> lower(b)").select(*_row("RELATIONSHIP", subject=F.col("a"), object=F.col("b"), relation_type=F.col("r")))


def telling(text: Column) -> Column:
    """Whether a sentence holds what any of its detectors looks for: each of them finds nothing elsewhere."""
    return let(text, lambda t: reduce(lambda a, b: a | b, (t.rlike(p) for p in (CUES, SYMBOL_IS, *OPENINGS))))


def detect(pages: DataFrame) -> DataFrame:
    """All candidates of pages (document_id, page_number, text). Detectors see only the sentences, lines and pages that hold a cue."""
    m = written(masked(pages), "masked")
    claims, lessons = m.select(*_PAGE, F.col("expository").alias("text")), m.select(*_PAGE, F.col("instructional").alias("text"))
    s = written(sentences(prose_regions(claims)).where(telling(F.col("flat"))), "sentences")
    l = written(lines(claims.where(F.col("text").rlike(rf"{EQUALS}|(?i:Step\s*\d)"))).where(F.col("stripped").rlike(rf"{EQUALS}|^\s*(?i:Step\s*\d)")), "lines")
    out = definitions(s)
    for part in (equations(l), variables(s), units_of(s), properties(s), rules(s), examples(lines(lessons.where(F.col("text").rlike("(?i)example")))), procedures(l), prerequisites(s), relations(s)):
        out = out.union(part)
    return out
