"""Lines, headings, prose and masks of pages, as windows over exploded lines. Pages: (document_id, page_number, text).

Offsets count code points of the page text from 0; spans are half-open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import alpha_ratio, collapse, let
from quillspark.storage import written

#: Where a line ends, least length and share of letters of prose, headings, masks.
LINE_END = r"(?<=\n|[\x0B\x0C\x1C-\x1E\x85  ])|(?<=\r)(?!\n)"
PROSE_LENGTH, PROSE_ALPHA, CONTINUATION, HEADING_LENGTH = 25, 0.55, 4, 140
NUMBERED = r"^\s*(\d+(?:\.\d+){1,4})\.?\s+(\S.{0,120})$"
LABELLED = r"(?i)^\s*(definition|theorem|lemma|proof|example|exercise|problem|solution|note|remark|procedure|algorithm)\s*([0-9][0-9.]*)?\s*[:.–—-]?\s*(.{0,120})$"
KEYWORD = r"(?i)^\s*(chapter|unit|module|part|appendix|section|topic|preface|introduction|references|bibliography)\s*([0-9]+|[IVXLC]+|[A-Z])?\s*[:.–—-]?\s*(.{0,120})$"
QUESTIONS = r"(?i)^\s*(?:Exercises|Practice\s+Problems(?:\s*\d+)?|Previous\s+Years?[’']?\s*Questions|Answer\s+Keys?|Direction\s+for\s+questions\b.*)\s*$"
OPENER = r"(?i)^\s*CHAPTER\s+HIGHLIGHTS\s*$"
OPTION = r"^\s*\((?:[A-Da-d]|i{1,3}|iv|v|vi{0,3}|ix|x)\)"
NOT_CLAIMED = (OPTION, r"\[(?:19|20)\d\d\]", r"_{3,}", r"\?$")
EXAMPLE_START, SOLUTION_START = r"(?i)^\s*Example\b", r"(?i)^\s*(?:Solution|Sol\.?)\b"
#: What a text holds if one of its lines opens questions or an example.
MAY_ASK, MAY_SHOW = r"(?i)Exercises|Practice\s+Problems|Previous\s+Year|Answer\s+Key|Direction\s+for\s+questions", r"(?i)Example"
_PAGE = ("document_id", "page_number")


def _stripped(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")


def lines(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line, offset, raw, stripped) of every line, with its line break."""
    each = pages.select(*_PAGE, F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("line", "raw")).where("raw <> ''")
    before = W.partitionBy(*_PAGE).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return each.select("*", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("int").alias("offset"), _stripped(F.col("raw")).alias("stripped"))


def headings(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line, kind, label, title, depth) of numbered, labelled and keyword headings, in this order of precedence."""
    s = F.col("stripped")
    word = lambda p: F.lower(F.regexp_extract(s, p, 1))
    numbered, labelled, keyword = s.rlike(NUMBERED), s.rlike(LABELLED), s.rlike(KEYWORD)
    dots = F.length(F.regexp_replace(F.regexp_extract(s, NUMBERED, 1), r"[^.]", ""))
    kinds = {"CHAPTER": ["chapter", "unit", "part"], "SECTION": ["module", "section"], "SUBSECTION": ["topic"], "APPENDIX": ["appendix"], "PREFACE": ["preface", "introduction"], "REFERENCES": ["references", "bibliography"]}
    named = reduce(lambda c, k: c.when(word(KEYWORD).isin(kinds[k]), k), kinds, F)
    kind = F.when(numbered, F.when(dots == 1, "SECTION").otherwise("SUBSECTION")).when(labelled, F.when(word(LABELLED) == "algorithm", "PROCEDURE").otherwise(F.upper(word(LABELLED)))).when(keyword, named)
    part = lambda i: F.nullif(F.when(numbered, F.regexp_extract(s, NUMBERED, max(1, i - 1))).when(labelled, F.regexp_extract(s, LABELLED, i)).otherwise(F.regexp_extract(s, KEYWORD, i)), F.lit(""))
    depth = F.when(numbered, dots).when(labelled, 4).when(F.col("kind").isin("SECTION"), 1).when(F.col("kind") == "SUBSECTION", 2).otherwise(0)
    found = lines(pages).where(F.length("stripped").between(1, HEADING_LENGTH)).withColumn("kind", kind).where("kind is not null")
    return found.select(*_PAGE, "line", "kind", part(2).alias("label"), part(3).alias("title"), depth.cast("int").alias("depth"))


def with_parents(found: DataFrame, most_depth: int = 5) -> DataFrame:
    """headings with their number `idx` in the document and that of the nearest earlier, shallower one (null: top level).

    For each depth the last heading of that depth is carried forward; the parent is the latest of those less deep.
    """
    order = W.partitionBy("document_id").orderBy("page_number", "line")
    h = found.withColumn("idx", F.row_number().over(order) - 1)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.col("idx")), ignorenulls=True).over(before) for d in range(most_depth)]
    h = h.select("*", *(c.alias(f"_last{d}") for d, c in enumerate(last)))
    parent = F.greatest(F.lit(None).cast("int"), F.lit(None).cast("int"), *(F.when(F.col("depth") > d, F.col(f"_last{d}")) for d in range(most_depth)))
    return h.withColumn("parent_idx", parent).drop(*(f"_last{d}" for d in range(most_depth)))


def prose_regions(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, start, end, region) of runs of prose lines.

    A long line of mostly letters starts a run; a short one continues it while the line before ends no sentence.
    """
    by_line = W.partitionBy(*_PAGE).orderBy("line")
    letters = alpha_ratio(F.col("stripped")) >= PROSE_ALPHA
    starts = (F.length("stripped") >= PROSE_LENGTH) & letters & F.contains("stripped", F.lit(" "))
    may = (F.length("stripped") >= CONTINUATION) & letters & ~F.coalesce(F.lag("stripped").over(by_line).rlike(r"[.!?:]\s*$"), F.lit(False))
    marked = lines(pages).withColumn("starts", starts).withColumn("ok", starts | may)
    marked = marked.withColumn("run", F.sum((~F.col("ok")).cast("int")).over(by_line))
    in_run = W.partitionBy(*_PAGE, "run").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    kept = marked.where("ok").withColumn("open", F.max(F.col("starts").cast("int")).over(in_run)).where("open = 1")
    spans = kept.groupBy(*_PAGE, "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.length("raw")).alias("end"), F.sort_array(F.collect_list(F.struct("line", "raw"))).alias("l"))
    return spans.select(*_PAGE, "start", "end", F.array_join(F.transform("l", lambda x: x["raw"]), "").alias("region"))


def sentences(regions: DataFrame) -> DataFrame:
    """(document_id, page_number, start, end, flat) of the sentences of prose regions, in page offsets."""
    each = regions.select(*_PAGE, F.col("start").alias("at"), F.posexplode(F.split("region", r"(?<=[.!?])(?=\s)")).alias("n", "raw"))
    before = W.partitionBy(*_PAGE, "at").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    begin = F.col("at") + F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)).cast("int")
    lead = F.when(F.col("n") > 0, F.length("raw") - F.length(F.regexp_replace("raw", r"(?U)^\s+", ""))).otherwise(0)
    placed = each.select(*_PAGE, (begin + lead).alias("start"), (begin + F.length("raw")).alias("end"), collapse(F.col("raw")).alias("flat"))
    return placed.where("flat <> ''")


def _blank(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^\r\n]", " ")


def masked(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, expository, instructional, question_chars): the page with blanks for what is no claim.

    Question sections go on across pages until a page that holds a chapter opener, which ends them for the whole page;
    a section heading on that page starts anew. Example stems last until a solution, within a page. Lengths never change.
    Where no page of a document may open questions and the page no example, a line's mask depends on the line alone.
    """
    asking = written(pages.where(F.col("text").rlike(MAY_ASK)).select("document_id").distinct(), "asking")
    p = pages.select(*_PAGE, F.coalesce("text", F.lit("")).alias("text")).join(asking.withColumn("asks", F.lit(True)), "document_id", "left")
    alone = F.col("document_id").isNotNull() & F.col("asks").isNull() & ~F.col("text").rlike(MAY_SHOW)
    line = lambda raw: F.when(let(_stripped(raw), _no_claim), _blank(raw)).otherwise(raw)
    plain = p.where(alone & (F.col("text") != "")).select(*_PAGE, F.array_join(F.transform(F.split("text", LINE_END), line), "").alias("expository"), F.col("text").alias("instructional"), F.lit(0).cast("long").alias("question_chars"))
    return plain.union(_masked(p.where(~alone)))


def _no_claim(stripped: Column) -> Column:
    return reduce(lambda a, b: a | b, (stripped.rlike(p) for p in NOT_CLAIMED))


def _masked(pages: DataFrame) -> DataFrame:
    """See masked: of documents with all their pages, or pages that are asked nothing."""
    s = F.col("stripped")
    by_doc = W.partitionBy("document_id").orderBy("page_number", "line")
    l = lines(pages).withColumn("opens", F.max(s.rlike(OPENER).cast("int")).over(W.partitionBy(*_PAGE)))
    first = F.row_number().over(W.partitionBy(*_PAGE).orderBy("line")) == 1
    event = F.when(s.rlike(QUESTIONS), 1).when(first & (F.col("opens") == 1), 0)
    l = l.withColumn("asked", F.coalesce(F.last(event, ignorenulls=True).over(by_doc.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) == 1)
    stem = F.when(~F.col("asked") & s.rlike(EXAMPLE_START), 1).when(~F.col("asked") & s.rlike(SOLUTION_START), 0)
    l = l.withColumn("stem", F.coalesce(F.last(stem, ignorenulls=True).over(W.partitionBy(*_PAGE).orderBy("line").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) == 1)
    no_claim = _no_claim(s) | F.col("stem") | F.col("asked")
    l = l.select(*_PAGE, "line", F.when(no_claim, _blank(F.col("raw"))).otherwise(F.col("raw")).alias("e"), F.when(F.col("asked"), _blank(F.col("raw"))).otherwise(F.col("raw")).alias("i"), F.when(F.col("asked"), F.length("stripped")).otherwise(0).alias("q"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", c))), lambda x: x[c]), "")
    return l.groupBy(*_PAGE).agg(text("e").alias("expository"), text("i").alias("instructional"), F.sum("q").alias("question_chars"))


def units(paragraphs: DataFrame, limit: int = 6000) -> DataFrame:
    """(document_id, unit, text): paragraphs (document_id, n, text) packed in order until a unit holds `limit` characters.

    A fold over each document's lengths gives the unit of every paragraph, so texts themselves are only joined once.
    """
    sizes = paragraphs.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("n", F.length("text").alias("size")))).alias("p"))

    def step(a: Column, x: Column) -> Column:
        full = a["size"] >= limit
        unit = F.when(full, a["unit"] + 1).otherwise(a["unit"])
        return F.struct(unit.alias("unit"), (F.when(full, 0).otherwise(a["size"]) + x["size"]).alias("size"), F.concat(a["out"], F.array(F.struct(x["n"].alias("n"), unit.alias("unit")))).alias("out"))

    zero = F.struct(F.lit(0).alias("unit"), F.lit(0).alias("size"), F.array().cast("array<struct<n:int,unit:int>>").alias("out"))
    placed = sizes.select("document_id", F.explode(F.aggregate("p", zero, step, lambda a: a["out"])).alias("x")).select("document_id", "x.n", "x.unit")
    joined = paragraphs.join(placed, ["document_id", "n"]).groupBy("document_id", "unit").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("p"))
    return joined.select("document_id", "unit", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
