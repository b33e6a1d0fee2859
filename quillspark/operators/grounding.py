"""Which sentences of a worded answer rest on the numbered statements that it was given, and which sentences of a text name a subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import normalised

#: A sentence with the citations that may follow its mark, a citation, a number; the most statements, their length, sentences that name a subject.
SENTENCE = r"[^.!?]+(?:[.!?]+|$)(?:\s*(?:\[\d+\])+)?"
CITATION, NUMBER = r"\[(\d+)\]", r"\d+(?:[.,]\d+)?"
MOST_STATEMENTS, STATEMENT_CHARS, MOST_NAMING = 12, 600, 5


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def numbered(statements: DataFrame) -> DataFrame:
    """(request_id, number, statement) of statements (request_id, place, statement): the first MOST_STATEMENTS that aren't blank, cut to STATEMENT_CHARS, counted from 1."""
    s = statements.select("request_id", "place", F.substring(_flat(F.col("statement")), 1, STATEMENT_CHARS).alias("statement")).where("statement <> ''")
    n = F.row_number().over(W.partitionBy("request_id").orderBy("place"))
    return s.select("request_id", n.alias("number"), "statement").where(F.col("number") <= MOST_STATEMENTS)


def grounded(replies: DataFrame, statements: DataFrame) -> DataFrame:
    """(request_id, place, text, citations, problem) of each sentence of replies (request_id, reply) against numbered statements; a sentence is kept if its problem is null.

    It must cite statements, all of which there are (NO_CITATION, NO_SUCH_STATEMENT), and each number in it must occur in
    one that it cites (UNSUPPORTED_NUMBER). Citations may follow the mark at the end. Chunks without a word are no
    sentences; a reply that says INSUFFICIENT, or to a request without statements, has none.
    """
    own = statements.select("request_id").distinct()
    r = replies.select("request_id", _flat(F.coalesce("reply", F.lit(""))).alias("reply")).join(own, "request_id", "left_semi").where(~F.upper("reply").startswith("INSUFFICIENT"))
    chunks = r.select("request_id", F.posexplode(F.regexp_extract_all("reply", F.lit(SENTENCE), F.lit(0))).alias("place", "chunk"))
    chunks = chunks.withColumn("text", F.trim(F.regexp_replace("chunk", CITATION, ""))).where(F.regexp_like("text", F.lit(r"(?U)\w")))
    chunks = chunks.withColumn("cites", F.transform(F.regexp_extract_all("chunk", F.lit(CITATION), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))))
    s = statements.select("request_id", F.col("number").alias("cited"), "statement")
    met = chunks.select("request_id", "place", F.explode(F.array_distinct("cites")).alias("cited")).join(s, ["request_id", "cited"], "left")
    per = met.groupBy("request_id", "place").agg(F.max(F.col("statement").isNull()).alias("unknown"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cited", "statement"))), lambda x: F.coalesce(x["statement"], F.lit(""))), " ").alias("said"))
    d = chunks.join(per, ["request_id", "place"], "left")
    numbers = F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0))
    problem = F.when(F.size("cites") == 0, "NO_CITATION").when(F.col("unknown"), "NO_SUCH_STATEMENT").when(F.exists(numbers, lambda n: ~F.contains("said", n)), "UNSUPPORTED_NUMBER")
    return d.select("request_id", "place", F.regexp_replace("text", r"\s+([.!?,;:])", "$1").alias("text"), F.array_distinct("cites").alias("citations"), problem.alias("problem"))


def explanations(replies: DataFrame, statements: DataFrame) -> DataFrame:
    """(request_id, text, n_kept, n_removed, insufficient) of each reply: what is left of it, in order."""
    g = grounded(replies, statements)
    kept = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("place", "text", F.col("problem").isNull().alias("ok")))), lambda x: x["ok"]), lambda x: x["text"])
    per = g.groupBy("request_id").agg(F.array_join(kept, " ").alias("text"), F.count_if(F.col("problem").isNull()).alias("n_kept"), F.count_if(F.col("problem").isNotNull()).alias("n_removed"))
    d = replies.select("request_id").distinct().join(per, "request_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return d.select("request_id", F.coalesce("text", F.lit("")).alias("text"), zero("n_kept"), zero("n_removed"), (F.coalesce("n_kept", F.lit(0)) == 0).alias("insufficient"))


def _stems(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)), lambda w: w != "")
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w))


def topic_problem(question: Column, topic: Column) -> Column:
    """Why a topic that someone else read from a question can't be used; null if all its words are the question's, a plural's s apart."""
    extra = F.array_except(_stems(topic), _stems(question))
    return F.when(F.size(_stems(topic)) == 0, "NO_TOPIC").when(F.size(extra) > 0, F.concat(F.lit("NOT_ASKED: "), F.array_join(extra, " ")))


def naming(texts: DataFrame) -> DataFrame:
    """(text_id, place, start, end, sentence) of texts (text_id, text, subject): the first MOST_NAMING sentences that hold the subject, as names are compared.

    A sentence ends at a line end, or at a mark before white space or the end; start and end are its place without blanks.
    """
    text = F.coalesce("text", F.lit(""))
    pieces = F.split(text, r"(?<=\n)|(?<=[.!?])(?=\s|$)", -1)
    t = texts.select("text_id", "subject", pieces.alias("pieces"))
    ends = F.aggregate("pieces", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    t = t.select("text_id", "subject", F.posexplode(F.arrays_zip("pieces", ends.alias("at"))).alias("i", "x")).select("text_id", "subject", "i", F.col("x.pieces").alias("piece"), F.col("x.at").alias("before")).where("piece is not null")
    lead = F.length(F.regexp_extract("piece", r"(?U)^\s*", 0))
    trimmed = F.regexp_replace("piece", r"(?U)^\s+|\s+$", "")
    t = t.select("text_id", "subject", "i", (F.col("before") + lead).alias("start"), trimmed.alias("raw")).where("raw <> ''")
    t = t.withColumn("norm", normalised(F.col("raw"))).withColumn("wanted", normalised(F.col("subject"))).where(F.contains("norm", F.col("wanted")) & (F.col("wanted") != ""))
    place = F.row_number().over(W.partitionBy("text_id").orderBy("i"))
    return t.select("text_id", place.alias("place"), "start", (F.col("start") + F.length("raw")).alias("end"), _flat(F.col("raw")).alias("sentence")).where(F.col("place") <= MOST_NAMING)
