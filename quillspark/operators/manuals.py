"""Steps, menu paths, shortcuts and formats that manuals state, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Marks, shapes and spellings.
SEPARATOR = " / "
MARKER = r"(?i)\bStep\s*(\d{1,2})\s*[:.–—-]?\s*"
PLACEHOLDER = r"<([A-Za-z][A-Za-z0-9 _-]{0,39})>"
ELEMENT = r"^[A-Z][A-Za-z0-9&'()/+.\- ]{0,39}$"
ARROW = r"\s*(?:→|->)\s*"
KEY = "(?:F1[0-2]|F[1-9]|Enter|Return|Tab|Escape|Esc|Delete|Del|Insert|Ins|Home|End|Space|Backspace|PageUp|PageDown|PgUp|PgDn|Up|Down|Left|Right|[A-Za-z0-9])"
SHORTCUT = rf"(?i)\b(?:(?:Ctrl|Control|Alt|Shift|Win|Cmd)\s*\+\s*)+{KEY}(?![A-Za-z0-9])"
SPELLINGS = {
    "ctrl": "Ctrl", "control": "Ctrl", "alt": "Alt", "shift": "Shift", "win": "Win", "cmd": "Cmd", "enter": "Enter", "return": "Enter", "tab": "Tab", "escape": "Esc", "esc": "Esc", "delete": "Delete",
    "del": "Delete", "insert": "Insert", "ins": "Insert", "home": "Home", "end": "End", "space": "Space", "backspace": "Backspace", "pageup": "PageUp", "pgup": "PageUp", "pagedown": "PageDown",
    "pgdn": "PageDown", "up": "Up", "down": "Down", "left": "Left", "right": "Right",
}
LOWER_WORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with")
CONSTRAINT = r"(?i)\b(?:must(?:\s+not)?|cannot|can\s+not|may\s+not|(?:is|are)\s+limited\s+to|at\s+most|no\s+more\s+than|maximum\s+of)\b"
EXTENSION = r"(?<![\w/\\.*])\*?\.([A-Za-z][A-Za-z0-9]{0,7})\b"
FORMAT_WORD = r"(?i)\b(?:files?|formats?|extensions?|saved?|saves|exports?|imports?)\b"
INPUT = r"(?i)^(?:enter|type|specify|select|choose|pick)\s+(?:the\s+|a\s+|an\s+|your\s+)?(.+?)\.?$"
SENTENCE_END = r"(?<=[.!?])(?=\s|$)|(?<=:)(?=\s*\n)|(?=\n\s*\n)"


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stored_steps(statement: Column) -> Column:
    """The steps of a stored procedure."""
    return F.transform(F.split(statement, SEPARATOR), flat)


def quoted_steps(quote: Column) -> Column:
    """The steps of a quote at its marks; null unless it begins with a mark and has two at least."""
    parts = F.split(quote, MARKER, -1)
    return F.when((F.size(parts) > 2) & (F.trim(F.get(parts, F.lit(0))) == ""), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), flat))


def menu_element(text: Column) -> Column:
    """A label of five words at most, each with a capital or a digit in front or a small function word; null for anything else. A full stop at the end doesn't belong to it, three do."""
    t = F.trim(text)
    e = F.when(t.endswith(".") & ~t.endswith("..."), F.rtrim(F.regexp_replace(t, r"\.$", ""))).otherwise(t)
    core = lambda w: F.regexp_replace(w, r"^[.&/+()'\-]+|[.&/+()'\-]+$", "")
    fits = lambda w: (core(w) == "") | core(w).rlike("^[A-Z0-9]") | F.lower(core(w)).isin(*LOWER_WORDS)
    words = F.filter(F.split(e, r"\s+"), lambda w: w != "")
    return F.when(e.rlike(ELEMENT) & (F.size(words) <= 5) & F.forall(words, fits), e)


def menu_elements(line: Column) -> Column:
    """The elements of a whole line of two or more joined by arrows; null for any other line."""
    elements = F.transform(F.split(F.trim(line), ARROW), menu_element)
    return F.when((F.size(elements) > 1) & F.forall(elements, lambda e: e.isNotNull()), elements)


def menu_paths(lines: DataFrame) -> DataFrame:
    """(document_id, page_number, line, last_line, elements) of menu paths: a whole line, or an element followed by lines that each begin with an arrow and hold one. lines: (document_id, page_number, line, text)."""
    page = ("document_id", "page_number")
    led = F.regexp_extract("text", r"^\s*(?:→|->)\s*(.*?)\s*$", 1)
    d = lines.withColumn("whole", menu_elements(F.col("text"))).withColumn("more", F.when(F.col("text").rlike(r"^\s*(?:→|->)"), menu_element(led)))
    # each line that doesn't continue another starts a run
    d = d.withColumn("run", F.sum(F.col("more").isNull().cast("int")).over(W.partitionBy(*page).orderBy("line")))
    head = F.when(F.col("whole").isNull() & ~F.col("text").rlike("→|->"), menu_element(F.col("text")))
    runs = d.groupBy(*page, "run").agg(F.min("line").alias("line"), F.max("line").alias("last_line"), F.max(F.when(F.col("more").isNull(), F.struct(head.alias("head")))).alias("h"), F.sort_array(F.collect_list(F.when(F.col("more").isNotNull(), F.struct("line", "more")))).alias("m"))
    below = runs.where((F.size("m") > 0) & F.col("h.head").isNotNull()).select(*page, "line", "last_line", F.concat(F.array("h.head"), F.col("m.more")).alias("elements"))
    return d.where("whole is not null").select(*page, "line", F.col("line").alias("last_line"), F.col("whole").alias("elements")).union(below)


def combo(text: Column) -> Column:
    """A key combination in its one spelling."""
    spelt = F.create_map(*(F.lit(x) for kv in SPELLINGS.items() for x in kv))
    one = lambda p: F.coalesce(F.element_at(spelt, F.lower(p)), F.when((F.length(p) == 1) | F.lower(p).rlike(r"^f\d{1,2}$"), F.upper(p)).otherwise(p))
    return F.array_join(F.transform(F.split(F.trim(text), r"\s*\+\s*"), one), "+")


def sentences(text: Column, excluded: Column) -> Column:
    """array<struct<start, end>> of the sentences of a text, blanks at either end left out. No sentence crosses an excluded stretch (array<struct<start, end>>) or lies in one."""
    pieces = F.split(text, SENTENCE_END, -1)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    bounds = F.flatten(F.transform(excluded, lambda x: F.array(x["start"], x["end"])))
    cuts = F.array_sort(F.array_distinct(F.concat(ends, bounds, F.array(F.length(text)))))
    each = F.transform(F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0))), lambda a, i: F.struct(a.alias("start"), F.get(cuts, i + 1).alias("end")))
    each = F.filter(each, lambda x: ~F.exists(excluded, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    piece = lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])
    trimmed = F.transform(each, lambda x: F.struct((x["start"] + F.length(F.regexp_extract(piece(x), r"(?U)^\s*", 0))).alias("start"), (x["end"] - F.length(F.regexp_extract(piece(x), r"(?U)\s*$", 0))).alias("end")))
    return F.filter(trimmed, lambda x: x["start"] < x["end"])


def sentence_items(texts: DataFrame) -> DataFrame:
    """(document_id, page_number, start, end, kind, statement, name, quote) of the shortcuts, constraints and file formats that sentences state.

    texts: (document_id, page_number, text), and if there is one a column `excluded` with the places of menu paths, which
    no sentence enters. start and end are the sentence's place in the text, quote the sentence. The statement is the
    sentence, but for a shortcut what to press; the name of a file format lists its endings.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    excluded = F.coalesce("excluded", none) if "excluded" in texts.columns else none
    s = texts.select("document_id", "page_number", "text", F.explode(sentences(F.coalesce("text", F.lit("")), excluded)).alias("at"))
    s = s.select("document_id", "page_number", F.col("at.start").alias("start"), F.col("at.end").alias("end"), flat(F.substring(F.col("text"), F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))).alias("s"))
    item = lambda kind, statement, name: F.struct(F.lit(kind).alias("kind"), statement.alias("statement"), name.alias("name"))
    keys = F.transform(F.regexp_extract_all("s", F.lit(SHORTCUT), F.lit(0)), lambda m: item("SHORTCUT", F.concat(F.lit("Press "), combo(m)), F.concat(F.lit("Keyboard shortcut "), combo(m))))
    formats = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(EXTENSION), F.lit(1)), lambda m: F.concat(F.lit("."), F.lower(m)))))
    one = lambda holds, x: F.when(holds, F.array(x)).otherwise(F.array().cast("array<struct<kind:string,statement:string,name:string>>"))
    found = F.concat(keys, one(F.col("s").rlike(CONSTRAINT), item("CONSTRAINT", F.col("s"), F.lit("Constraint"))), one((F.size(formats) > 0) & F.col("s").rlike(FORMAT_WORD), item("FILE_FORMAT", F.col("s"), F.concat(F.lit("File format "), F.array_join(formats, ", ")))))
    return s.select("document_id", "page_number", "start", "end", F.explode(found).alias("x"), F.col("s").alias("quote")).select("document_id", "page_number", "start", "end", "x.*", "quote")


def step_input(step: Column) -> Column:
    """The input that a step asks for, lower case; null if it asks for none."""
    return F.when(F.trim(step).rlike(INPUT), F.lower(flat(F.regexp_extract(F.trim(step), INPUT, 1))))


def step_problem(statement: Column, quote: Column) -> Column:
    """Why the steps can't be taken as documented, by a quote of their evidence; null if it agrees with them."""
    steps = stored_steps(statement)
    single = F.get(steps, F.lit(0))
    pressed = F.transform(F.regexp_extract_all(quote, F.lit(SHORTCUT), F.lit(0)), lambda m: F.concat(F.lit("Press "), combo(m)))
    again = F.coalesce(quoted_steps(quote), menu_elements(quote), F.when((F.size(steps) == 1) & F.array_contains(pressed, single), steps))
    return F.when(quote.isNull(), "no evidence").when(again.isNull(), "the quote does not split into steps").when(again != steps, "the steps and the quote disagree")


def parameters(steps: Column) -> Column:
    """The placeholders that steps name, in order, each as it is first written; names are compared without case and extra blanks."""
    named = F.flatten(F.transform(steps, lambda s: F.transform(F.regexp_extract_all(s, F.lit(PLACEHOLDER), F.lit(1)), flat)))
    keys = F.transform(named, F.lower)
    return F.filter(named, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def value_problem(value: Column) -> Column:
    """Why a value can't be put in a placeholder's place; null if it can."""
    return F.when(F.trim(value) == "", "is empty").when(value.rlike("[\\n\\r]"), "spans more than one line").when(value.rlike("[<>]"), "contains < or >")


def substituted(step: Column, values: Column) -> Column:
    """The step with each placeholder replaced by its value in a map by lower-case name; unknown ones stay."""
    parts, names = F.split(step, PLACEHOLDER, -1), F.regexp_extract_all(step, F.lit(PLACEHOLDER), F.lit(1))
    put = lambda p, i: F.concat(p, F.coalesce(F.element_at(values, F.lower(flat(F.get(names, i)))), F.concat(F.lit("<"), F.get(names, i), F.lit(">")), F.lit("")))
    return F.array_join(F.transform(parts, put), "")
