"""Windows and joins against sequential versions of the same rules."""

import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillspark.functions import formulas, ids, text, units
from quillspark.operators import catalogue, dedup, detectors, evidence, graph, mentions, retrieval, structure


def pages(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, text string")


def letters(s):
    return sum(c.isalpha() for c in s) / len(s) if s else 0.0


def plain_regions(t):
    out, at, start, before = [], 0, None, ""
    for line in t.splitlines(keepends=True):
        s = line.strip()
        starts = len(s) >= 25 and letters(s) >= 0.55 and " " in s
        goes_on = start is not None and len(s) >= 4 and letters(s) >= 0.55 and not re.search(r"[.!?:]\s*$", before)
        if starts or goes_on:
            start = at if start is None else start
            before = s
        elif start is not None:
            out.append((start, at))
            start, before = None, ""
        at += len(line)
    return out + ([(start, at)] if start is not None else [])


def test_prose_regions(spark):
    r = random.Random(1)
    parts = ["a long line of words that is prose for sure", "ends a sentence with words here today.", "short", "go on", "1 2 3 4 5", "", "é ü long enough line of words to be prose", "x = 3"]
    texts = ["".join(r.choice(parts) + r.choice(["\n", "\r\n", "\n", "\x0b"]) for _ in range(r.randint(0, 12))) for _ in range(150)]
    got = {}
    for x in structure.prose_regions(pages(spark, [(str(i), 1, t) for i, t in enumerate(texts)])).collect():
        got.setdefault(int(x["document_id"]), []).append((x["start"], x["end"]))
        assert texts[int(x["document_id"])][x["start"] : x["end"]] == x["region"]
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, t in enumerate(texts) if (v := plain_regions(t))}


def test_sentences_keep_their_places(spark):
    t = "First sentence of the page is here. Second one\nwraps over a line!  Third?\nrest of it goes on\n\n1 2\nAnother region of prose starts here now.\n"
    for x in structure.sentences(structure.prose_regions(pages(spark, [("d", 1, t)]))).collect():
        assert " ".join(t[x["start"] : x["end"]].split()) == x["flat"]


def plain_masks(doc):
    asked, out = False, []
    for t in doc:
        asked = asked and not any(re.match(r"(?i)^\s*CHAPTER\s+HIGHLIGHTS\s*$", line.strip()) for line in t.splitlines())
        stem, kept = False, []
        for line in t.splitlines(keepends=True):
            s = line.strip()
            asked = asked or s == "Exercises"
            if not asked:
                stem = True if s.startswith("Example") else False if s.startswith("Solution") else stem
            hide = asked or stem or s.startswith("(A)") or "[2015]" in s or "___" in s or s.endswith("?")
            kept.append(re.sub(r"[^\r\n]", " ", line) if hide else line)
        out.append("".join(kept))
    return out


def test_masks(spark):
    r = random.Random(2)
    parts = ["plain text line", "Exercises", "CHAPTER HIGHLIGHTS", "(A) an option", "asked in [2015] here", "fill ____ in", "why?", "Example 3 stem", "Solution text", ""]
    docs = [["".join(r.choice(parts[:1] * 4 + parts) + "\n" for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 4))] for _ in range(60)]
    rows = [(str(i), n, t) for i, d in enumerate(docs) for n, t in enumerate(d)]
    got = {(x["document_id"], x["page_number"]): x["expository"] for x in structure.masked(pages(spark, rows)).collect()}
    assert got == {(str(i), n): t for i, d in enumerate(docs) for n, t in enumerate(plain_masks(d))}


def test_parents(spark):
    r = random.Random(3)
    depths = [[r.randint(0, 4) for _ in range(r.randint(1, 15))] for _ in range(80)]
    rows = [(str(i), 1, n, d) for i, ds in enumerate(depths) for n, d in enumerate(ds)]
    got = {(int(x["document_id"]), x["idx"]): x["parent_idx"] for x in structure.with_parents(spark.createDataFrame(rows, "document_id string, page_number int, line int, depth int")).collect()}
    for i, ds in enumerate(depths):
        stack = []
        for n, d in enumerate(ds):
            while stack and stack[-1][0] >= d:
                stack.pop()
            assert got[i, n] == (stack[-1][1] if stack else None)
            stack.append((d, n))


def test_units_pack_in_order(spark):
    r = random.Random(4)
    rows = [(str(i), n, "x" * r.randint(0, 30)) for i in range(20) for n in range(r.randint(1, 12))]
    got = {(x["document_id"], x["unit"]): x["text"] for x in structure.units(spark.createDataFrame(rows, "document_id string, n int, text string"), 40).collect()}
    want, size, unit = {}, {}, {}
    for d, _, t in rows:
        if size.get(d, 0) >= 40:
            unit[d], size[d] = unit[d] + 1, 0
        size[d] = size.get(d, 0) + len(t)
        want.setdefault((d, unit.setdefault(d, 0)), []).append(t)
    assert got == {k: "\n\n".join(v) for k, v in want.items()}


PAGE = """Chapter 5 Circuits
A capacitor is a device that stores electric charge in a field.
The process is called rectification and it is widely used in many circuits.
Inductance is defined as the property of a coil that opposes change.
V = IR
V = 20 V
where V is the voltage, I is the current flowing in it.
The unit of resistance is ohm (Ω) in the international system.
A Full adder consists of Half adder and one gate as drawn here.
The Laplace transform is a prerequisite for Network synthesis in this course.
The voltage must never exceed the rated value of the part used.
Example 3: Find the current.
Solution is easy
Step 1: Remove the load
Step 2: Compute the source
"""


def test_detectors(spark):
    got = detectors.detect(pages(spark, [("d", 1, PAGE), ("d", 2, "Exercises\nA thing is a device that should be hidden here.\n"), ("e", 1, None)])).collect()
    by = {}
    for x in got:
        by.setdefault(x["category"], []).append(x)
        assert x["document_id"] == "d" and x["page_number"] == 1
    names = lambda c: {x["name"] for x in by[c]}
    assert names("DEFINITION") >= {"Capacitor", "Rectification", "Inductance"} and names("CONCEPT") >= {"Capacitor", "Rectification", "Inductance"}
    assert {(x["statement"], x["numeric"]) for x in by["EQUATION"]} == {("V = IR", False), ("V = 20 V", True)}
    assert {x["symbol"] for x in by["VARIABLE"]} == {"V", "I"} and by["UNIT"][0]["unit"] == "ohm"
    assert [(x["subject"], x["object"], x["relation_type"]) for x in by["RELATIONSHIP"]] == [("Full adder", "Half adder", "COMPOSED_OF")]
    assert by["PREREQUISITE"][0]["subject"] == "Laplace transform" and by["PROCEDURE"][0]["statement"] == "Remove the load / Compute the source"
    assert by["EXAMPLE"][0]["statement"] == "Find the current." and any("must never" in x["statement"] for x in by["RULE"])


PAIRS = [
    ("v is 0.7 v", "v is 0.3 v", True), ("v is 0.7.", "v is 0.3.", True), ("x -1 y 2", "x −1 y 3", False), ("x -1 y 2", "x −4 y 3", True), ("a 1 b 2", "a 2 b 1", True), ("v is 0.7 v", "v is 0.70 v", False), ("v is 7 v", "v is seven v", False),
    ("v is 1,000", "v is 2", False), ("v is 0.7 v", "v is not 0.3 v", False), ("v is 1.", "v is 2;", False), ("r1 is 5", "r2 is 5", False), ("same", "same", False), ("v is 0.7v", "v is 0.3v", False),
]


def test_contradictions(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string")
    got = {x["i"]: x["c"] for x in df.select("i", dedup.contradicts(F.col("a"), F.col("b")).alias("c")).collect()}
    assert [got[i] for i in range(len(PAIRS))] == [c for *_, c in PAIRS]


def test_exact_groups(spark):
    rows = [("K-00000002", "RULE", "n", None, None), ("K-00000010", "RULE", "n", None, None), ("K-00000003", "EQUATION", "e", "p1", None), ("K-00000004", "EQUATION", "e", "p2", None), ("K-00000005", "EQUATION", "e", "p1", None)]
    rows += [("K-00000006", "DEFINITION", "d", "p1", "x"), ("K-00000007", "DEFINITION", "d", "p2", "x"), ("K-00000008", "DEFINITION", "d", "p2", "y"), ("K-00000009", "DEFINITION", "d", "p3", "z")]
    got = {x["id"]: x["canonical_id"] for x in dedup.exact_groups(spark.createDataFrame(rows, "id string, knowledge_type string, norm string, location string, alias string")).collect()}
    assert {int(k[-2:]): int(v[-2:]) for k, v in got.items()} == {2: 2, 10: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 6, 8: 6, 9: 9}


def test_closure_and_states(spark):
    edges = spark.createDataFrame([("X", "A"), ("X", "B"), ("A", "C"), ("A", "D"), ("C", "E"), ("s", "s"), ("p", "q"), ("q", "p"), ("l", "p")], "src string, dst string")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    reach = {(x["seed"], x["node"]) for x in graph.reachable(edges, nodes("X", "s", "l", "p")).collect()}
    assert reach == {("X", n) for n in "ABCDE"} | {("s", "s"), ("l", "p"), ("l", "q"), ("p", "p"), ("p", "q")}
    state = lambda *given: {x["node"]: x["state"] for x in graph.states(edges, nodes(*given)).collect()}
    assert {k: v for k, v in state("E").items() if k in "XABCDE"} == {"X": "BLOCKED", "A": "BLOCKED", "B": "MISSING", "C": "DERIVED", "D": "MISSING", "E": "AVAILABLE"}
    full = state("E", "D", "B")
    assert [full[n] for n in "XACBDE"] == ["DERIVED"] * 3 + ["AVAILABLE"] * 3 and full["s"] == full["p"] == full["l"] == "BLOCKED"
    assert [x["path"] for x in graph.chains(edges, nodes("E", "D", "B"), "X").collect()] == [["B", "X"], ["D", "A", "X"], ["E", "C", "A", "X"]]
    comp = {x["node"]: x["component"] for x in graph.components(edges).collect()}
    assert comp["p"] == comp["q"] == "p" and comp["l"] == "l" and comp["s"] == "s"


def test_mentions_are_longest_first(spark):
    known = mentions.names(spark.createDataFrame([("C1", "field effect transistor"), ("C2", "transistor"), ("C3", "gate"), ("C4", "gate")], "concept_id string, normalized_alias string"))
    texts = spark.createDataFrame([("t", "C2", "A field-effect transistor has a gate; a transistor does too.")], "text_id string, own string, text string")
    found = {(x["name"], x["start_word"]): x["concepts"] for x in mentions.mentions(texts, known).collect()}
    assert found == {("field effect transistor", 2): ["C1"], ("gate", 7): ["C3", "C4"], ("transistor", 9): ["C2"]}
    none = spark.createDataFrame([], "concept_a string, concept_b string")
    assert [(x["concept_a"], x["concept_b"], x["n_bases"]) for x in mentions.inferred(mentions.mentions(texts, known), none).collect()] == [("C1", "C2", 1)]


def test_quotes(spark):
    occ = spark.createDataFrame([("1", "s", 0, 5, "Hello"), ("2", "s", 6, 12, "big world"), ("3", "s", 6, 16, "big world"), ("4", None, 0, 1, "x"), ("5", "s", None, None, "x")], "id string, segment_id string, char_start int, char_end int, text string")
    seg = spark.createDataFrame([("s", "Hello big\n world!")], "segment_id string, segment_text string")
    got = retrieval.quote_checks(occ, seg)
    assert {x["id"]: x["status"] for x in got.collect()} == {"1": "VERIFIED", "2": "FAILED", "3": "VERIFIED", "4": "INCONCLUSIVE", "5": "INCONCLUSIVE"}
    assert retrieval.combined(got.withColumn("k", F.lit(1)), "k").first()["status"] == "FAILED"


@pytest.mark.parametrize(("term", "prefix", "text_", "hit"), [("MOSFET", False, "A mosfet is", True), ("MOSFET", False, "MOSFETs are", False), ("MOSFET", True, "MOSFETs are", True), ("MOSFET*", False, "a mosfet here", True), ("flip-flop", False, "the Flip flop", True), ("V GS", False, "v_gs is", True), ("VGS", False, "v_gs", False), ("cafe", False, "café", False)])
def test_phrases(spark, term, prefix, text_, hit):
    found = spark.createDataFrame([(text_,)], "t string").select(F.contains(retrieval.tokens(F.col("t")), F.lit(retrieval.phrase(term, prefix))).alias("h")).first()["h"]
    assert found == hit


def test_text_columns(spark):
    df = spark.createDataFrame([("ﬁ  Straße X ",), ("batteries",), ("the  Glass",)], "t string")
    rows = df.select(text.normalised(F.col("t")).alias("n"), text.singular(F.col("t")).alias("s"), text.name_key(F.col("t")).alias("k"), text.clean_term(F.col("t")).alias("c")).collect()
    assert rows[0]["n"] == "fi strasse x" and rows[1]["s"] == "battery" and rows[2]["s"] is None and rows[2]["k"] == "glass" and rows[2]["c"] == "Glass"


def test_ids(spark):
    r = spark.range(1).select(ids.format_id("K", F.lit(42)).alias("a"), ids.format_id("K", F.lit(123456789)).alias("b"), ids.counter(F.lit("K-00000042")).alias("c"), ids.counter(F.lit("K-42")).alias("d")).first()
    assert tuple(r) == ("K-00000042", "K-123456789", 42, None)


def test_formulas(spark):
    df = spark.createDataFrame([(6.0, 2.0, 3.0), (1.0, 0.0, None)], "a double, b double, c double")
    assert [x[0] for x in df.select(formulas.column("v = (a + -c) / b ^ 2")).collect()] == [0.75, None]
    assert formulas.isolate("P = V * I / (R - 2)", "R") == "R = V * I / P + 2" and formulas.isolate("a = b - x", "x") == "x = b - a"
    for bad in ("v = __import__('os')", "a b", "v = a[0]", "v = a ** b", "v == 2", "1 = a"):
        with pytest.raises(formulas.FormulaError):
            formulas.parse(bad)
    with pytest.raises(formulas.FormulaError):
        formulas.isolate("v = x * x", "x")
    r = random.Random(7)
    for _ in range(60):
        a, b, c = (r.randint(1, 9) for _ in range(3))
        shape = r.choice(["y = x + {b} * {c}", "y = ({b} - x) / {c}", "y = {b} / (x + {c})", "y = -x * {b} - {c}"]).format(b=b, c=c)
        y = eval(shape.partition("=")[2], {}, {"x": a})  # noqa: S307
        solved = formulas.isolate(shape, "x").partition("=")[2]
        assert eval(solved, {}, {"y": y}) == pytest.approx(a)  # noqa: S307


def test_units(spark):
    df = spark.createDataFrame([(3.0, "kΩ"), (2.0, "mA"), (1.0, "MHz"), (5.0, "g"), (1.0, "xyz")], "v double, u string")
    got = {x["u"]: (None if x["coherent"] is None else float(x["coherent"])) for x in units.converted(df, "v", "u").collect()}
    assert got == {"kΩ": 3000.0, "mA": 0.002, "MHz": 1e6, "g": 0.005, "xyz": None}
    shown = [tuple(x["d"]) for x in spark.sql("select explode(array(cast(0.333333333333 as decimal(38,18)), 1000000, 0.0001, 12.5)) as v").select(units.display(F.col("v")).alias("d")).collect()]
    assert shown == [("0.333333", False), ("1000000", True), ("0.0001", True), ("12.5", True)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a")], "p int, q string")
    assert df.where(evidence.filters(p=[1, 2], q=["a"])).count() == 1 and df.where(evidence.filters(p=[])).count() == 3


def test_concept_conflicts(spark):
    knowledge = spark.createDataFrame([("K-1", "a", "ACTIVE"), ("K-2", "b", "ARCHIVED"), ("K-3", "c", "SUPERSEDED")], "id string, statement string, lifecycle_status string")
    edges = [("C-1", "K-1", "ACTIVE"), ("C-1", "K-1", "ACTIVE"), ("C-1", "K-3", "ACTIVE"), ("C-2", "K-2", "ACTIVE"), ("C-3", "K-1", "INVALID"), ("C-4", None, "ACTIVE"), (None, "K-3", None)]
    edge = spark.createDataFrame(edges, "from_concept_id string, to_knowledge_id string, lifecycle_status string")
    conflicts = [("X-1", "K-1", "K-2", "ACTIVE"), ("X-2", "K-3", "K-1", "ACTIVE"), ("X-3", "K-1", "K-3", "DELETED"), ("X-4", "K-3", "K-9", "ACTIVE"), ("X-5", None, "K-1", None)]
    conflict = spark.createDataFrame(conflicts, "id string, claim_a_id string, claim_b_id string, lifecycle_status string")
    kb = SimpleNamespace(knowledge=knowledge, edge=edge, conflict=conflict)
    want = [("C-1", "X-1", "K-1", "a", "K-2", None), ("C-1", "X-2", "K-3", "c", "K-1", "a"), ("C-1", "X-4", "K-3", "c", "K-9", None)]
    assert sorted(tuple(r) for r in catalogue.concept_conflicts(kb).collect()) == want
    assert catalogue.concept_conflicts(SimpleNamespace(knowledge=knowledge, edge=edge.where("false"), conflict=conflict)).count() == 0
