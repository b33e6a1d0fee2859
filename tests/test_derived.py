"""Graphs, writers, steps and values on small rows, against plain versions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillspark.operators import calculation as K
from quillspark.operators import dedup, graph, manuals, mentions, validation, writer
from quillspark.sources import sites


def edges(spark, pairs):
    return spark.createDataFrame(sorted(pairs), "src string, dst string")


def plain_reach(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {c for b in r for c in reach[b]} for n, r in reach.items()}
    return reach


def test_components_and_hierarchy(spark):
    r = random.Random(1)
    pairs = {(f"n{r.randint(10, 39)}", f"n{r.randint(10, 39)}") for _ in range(38)} | {("n50", "n51"), ("n51", "n50"), ("n51", "n52")}
    reach = plain_reach(pairs)
    want = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in reach}
    assert {x["node"]: x["component"] for x in graph.components(edges(spark, pairs)).collect()} == want
    assert {x["node"] for x in graph.cyclic(edges(spark, pairs)).collect()} == {n for n in reach if n in reach[n]}
    tree = {(f"d{i:02}", f"d{i + 1:02}") for i in range(40)} | {("x1", "x2"), ("x2", "x1"), ("x2", "x3")}
    rows = graph.hierarchy(edges(spark, tree)).collect()
    assert max(x["depth"] for x in rows) == 40 and {x["root"] for x in rows} == {"d00", "x1"}
    assert {(x["node"], x["depth"]) for x in rows if x["root"] == "x1"} == {("x1", 0), ("x2", 1), ("x3", 2)}


def test_states_steps_and_chains(spark):
    e = edges(spark, {("A", "B"), ("A", "C"), ("C", "D"), ("E", "A"), ("E", "F"), ("G", "H"), ("H", "G"), ("I", "C"), ("J", "B")})
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    found = graph.states(e, nodes("B", "D"), nodes("J"), nodes("I"))
    assert {x["node"]: x["state"] for x in found.collect()} == {"A": "DERIVED", "B": "AVAILABLE", "C": "DERIVED", "D": "AVAILABLE", "E": "BLOCKED", "F": "MISSING", "G": "BLOCKED", "H": "BLOCKED", "I": "BLOCKED", "J": "CONFLICTING"}
    order = [x["node"] for x in graph.derivation_steps(found).orderBy("step").collect()]
    assert sorted(order) == ["A", "C"] and order.index("C") < order.index("A")
    assert [tuple(x) for x in graph.missing_nodes(found, e).collect()] == [("F", "E")]
    assert {x["complete"] for x in graph.chains(e, nodes("B", "D"), "E").collect()} == {True} and {x["complete"] for x in graph.chains(e, nodes("B", "D"), "E", 1).collect()} == {False}


def test_connected_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root}


def test_names_of_any_length(spark):
    long_name = "a name of more words than six and even eight"
    known = mentions.names(spark.createDataFrame([("C1", long_name), ("C2", "more words"), ("C3", "more words")], "concept_id string, normalized_alias string"))
    texts = spark.createDataFrame([("t", "o", f"This is {long_name}, with more words.")], "text_id string, own string, text string")
    assert {(x["name"], len(x["concepts"])) for x in mentions.mentions(texts, known).collect()} == {(long_name, 1), ("more words", 2)}


def test_comparisons_keep_to_their_type(spark):
    rows = [("K-00000001", "RULE", "x", "x is 5 by a"), ("K-00000002", "RULE", "x", "x is 6 by a"), ("K-00000003", "RULE", "x", "x is 5.0 by a"), ("K-00000004", "EXAMPLE", "x", "x is 7 by a"), ("K-00000005", "RULE", "x", "x was 5 by a")]
    d = spark.createDataFrame(rows, "id string, knowledge_type string, name string, norm string")
    got = {(x["canonical_id"][-1], x["other_id"][-1]): x["outcome"] for x in dedup.compared(d, "name").collect()}
    assert {k for k, v in got.items() if v == "CONTRADICTORY"} == {("1", "2"), ("2", "3")} and not any("4" in k for k in got) and len(got) == 6
    assert {(x["claim_a_id"][-1], x["claim_b_id"][-1]) for x in dedup.contradictions(d, "name").collect()} == {("1", "2"), ("2", "3")}


def test_lost_glyphs(spark):
    pages = spark.createDataFrame([("d", 1, "ok\n(V a I law) here\nx □\n□ again"), ("d", 2, "\\frac fine"), ("d", 3, "a \\ b"), ("d", 4, None)], "document_id string, page_number int, text string")
    got = {(x["page_number"], x["sign"]): x["excerpt"] for x in validation.page_glyph_loss(pages).collect()}
    signs = list(validation.GLYPHS)
    assert got == {(1, signs[1]): "x □", (1, signs[3]): "(V a I law) here", (3, signs[2]): "a \\ b"}


def test_writer(spark):
    fields = "document_id string, page_number int, char_start int, char_end int, category string, text string, name string, statement string, symbol string, unit string, subject string, object string, owner string, relation_type string, numeric boolean, weak boolean"

    def row(doc, page, at, category, weak=False, numeric=False, **more):
        return (doc, page, at, at + 5, category, more.get("statement", "t"), *(more.get(k) for k in ("name", "statement", "symbol", "unit", "subject", "object", "owner", "relation_type")), numeric, weak)

    rows = [
        row("d1", 1, 0, "CONCEPT", name="Voltage"), row("d1", 1, 0, "DEFINITION", name="Voltage", statement="Voltage is  a thing"), row("d1", 2, 9, "DEFINITION", name="VOLTAGE", statement="voltage IS a thing"),
        row("d1", 2, 20, "CONCEPT", name="Current"), row("d1", 2, 30, "RELATIONSHIP", subject="current", object="voltage", relation_type="DEPENDS_ON"), row("d1", 3, 30, "RELATIONSHIP", subject="Current", object="Voltage", relation_type="DEPENDS_ON"),
        row("d1", 3, 50, "RELATIONSHIP", subject="Current", object="Unknown", relation_type="USES"), row("d1", 3, 60, "EQUATION", statement="V = (I"), row("d1", 3, 70, "EQUATION", statement="V = I R"), row("d1", 3, 80, "EQUATION", statement="V = 5", numeric=True),
        row("d1", 3, 90, "PROPERTY", statement="p", subject="x", owner="Voltage", weak=True), row("d2", 1, 0, "RULE", statement="Never do"), row("d1", 4, 0, "RULE", statement="never  do"),
    ]
    pages = spark.createDataFrame([("d1", n, "text") for n in range(1, 5)] + [("d2", 1, "x □"), ("d3", 1, "")], "document_id string, page_number int, text string")
    t = writer.write(spark.createDataFrame(rows, fields), pages)
    assert {(x["document_id"], x["canonical_name"]) for x in t.concept.collect()} == {("d1", "Voltage"), ("d1", "Current")}
    k = {(x["knowledge_type"], x["statement"]): x["certainty"] for x in t.knowledge.collect()}
    assert k[("EQUATION", "V = I R")] == "UNCERTAIN" and k[("PROPERTY", "p")] == "UNCERTAIN" and sum(a == "RULE" for a, _ in k) == 1 and sum(a == "DEFINITION" for a, _ in k) == 1
    assert sorted(x["relation_type"] for x in t.edge.collect()) == ["DEFINED_BY", "DEPENDS_ON", "HAS_PROPERTY"]
    per = t.edge_occurrence.join(t.edge.select(F.col("id").alias("relationship_id"), "relation_type"), "relationship_id").groupBy("relation_type").count().collect()
    assert {x["relation_type"]: x["count"] for x in per} == {"DEFINED_BY": 2, "DEPENDS_ON": 2, "HAS_PROPERTY": 1}
    assert sorted((x["document_id"], x["issue_type"]) for x in t.issue.collect()) == [("d1", "BROKEN_RELATIONSHIP"), ("d1", "INVALID_EQUATION_STRUCTURE"), ("d2", "OCR_UNCERTAINTY")]
    assert {x["document_id"]: x["status"] for x in t.run.collect()} == {"d1": "PARTIAL", "d2": "PARTIAL", "d3": "COMPLETED"}
    names = {(x["knowledge_type"], x["label"]) for x in t.knowledge.collect()}
    assert names == {("DEFINITION", "Definition: Voltage"), ("EQUATION", "Equation: V = I R"), ("PROPERTY", "Property of Voltage: p"), ("RULE", "Rule: Never do")} or names == {("DEFINITION", "Definition: Voltage"), ("EQUATION", "Equation: V = I R"), ("PROPERTY", "Property of Voltage: p"), ("RULE", "Rule: never do")}
    own = {x["kind"]: (x["expression"], x["name"], x["statement"] is not None) for x in t.companion.collect()}
    assert own == {"EQUATION": ("V = I R", None, False), "RULE": (None, "Rule", True)} and t.companion.join(t.knowledge.select(F.col("id").alias("knowledge_id")), "knowledge_id").count() == 2
    assert {x["extraction_method"] for x in t.source_occurrence.where("category = 'PROPERTY'").collect()} == {"deterministic/PropertyCandidate@v6+weak"}
    assert sum(x["n_linked"] for x in writer.report(t).collect()) == 2
    empty = writer.write(spark.createDataFrame([], fields), pages.limit(0))
    assert empty.concept.count() == empty.edge.count() == empty.knowledge.count() == 0


def test_manual_columns(spark):
    lines = ["Menu", "-> One", "→ Two", "text line here ends", "File -> Open -> it", "File -> Open", "-> Stray", "Head.", "-> Last..."]
    d = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(lines)], "document_id string, page_number int, line int, text string")
    assert {(x["line"], x["last_line"], tuple(x["elements"])) for x in manuals.menu_paths(d).collect()} == {(0, 2, ("Menu", "One", "Two")), (5, 5, ("File", "Open")), (7, 8, ("Head", "Last..."))}
    one = spark.range(1).select(manuals.step_problem(F.lit("Press Ctrl+S"), F.lit("use ctrl + s")).alias("a"), manuals.quoted_steps(F.lit("Step 1: a  b Step 2 c")).alias("b"), manuals.quoted_steps(F.lit("no Step 1: a")).alias("c"), manuals.value_problem(F.lit("a<b")).alias("d"), manuals.step_problem(F.lit("A"), F.lit(None).cast("string")).alias("e")).first()
    assert tuple(one) == (None, ["a b", "c"], None, "contains < or >", "no evidence")


def test_values(spark):
    assert K.composition("abc", {"a", "b", "c", "bc"}) == ("a", "bc") and K.composition("abd", {"a", "b"}) is None and K.composition("a", {"a"}) is None
    cases = [("x = 1/3 + a", {"a": ("1/6", None)}, "1/2", None), ("x = a / 0", {"a": ("1", None)}, None, "DIVISION_BY_ZERO"), ("x = a + b", {"a": ("1", (1, 0, 0, 0, 0, 0, 0)), "b": ("1", None)}, None, "DIMENSION_MISMATCH"), ("x = b", {}, None, "UNBOUND_SYMBOL"), ("x = a ^ -2", {"a": ("0", None)}, None, "ZERO_TO_NEGATIVE_POWER"), ("x = a * a * a", {"a": (str(Fraction(2) ** 2000), None)}, None, "TOO_LARGE")]
    rows = [(i, f, {k: (v, list(d) if d else None) for k, (v, d) in b.items()}) for i, (f, b, _, _) in enumerate(cases)]
    got = K.evaluated(spark.createDataFrame(rows, "key int, formula string, bound map<string,struct<value:string,dimension:array<int>>>")).orderBy("key").collect()
    assert [(x["value"], x["problem"]) for x in got] == [(v, p) for _, _, v, p in cases]
    eq = spark.createDataFrame([("1", "c", "c = a + b", ["a", "b"]), ("2", "c", "c = a * 2", ["a"]), ("3", "d", "d = c + 1", ["c"]), ("4", "e", "e = 4", []), ("5", "f", "f = g", ["g"]), ("6", "g", "g = f", ["f"])], "equation_id string, target string, formula string, needs array<string>")
    known = spark.createDataFrame([("p", "a", "1", None), ("p", "b", "1", None), ("q", "a", "1", None), ("q", "b", "2", None)], "problem_id string, symbol string, value string, dimension array<int>")
    state = {(x["problem_id"], x["symbol"]): (x["state"], x["value"]) for x in K.solved(eq, known).collect()}
    assert state["p", "c"] == ("DERIVED", "2") and state["p", "d"] == ("DERIVED", "3") and state["q", "c"] == ("CONFLICTING", None) and state["q", "d"][0] == "BLOCKED"
    assert state["p", "e"] == ("DERIVED", "4") and state["p", "f"][0] == state["p", "g"][0] == "BLOCKED"


@pytest.mark.parametrize(("url", "inside"), [("https://A.org/x/y?q#f", True), ("https://a.org:443/x/z", True), ("http://a.org/x/z", False), ("https://a.org:8443/x/", False), ("https://b.org/x/", False), ("https://a.org/y", False), ("https://u:p@a.org/x/y", False), ("ftp://a.org/x/", False), ("https:///x/", False), (None, False)])
def test_sites(spark, url, inside):
    assert spark.range(1).select(sites.within(F.lit("https://a.org/x/page"), F.lit(url).cast("string"))).first()[0] is inside


def test_requests(spark):
    from quillspark.operators import requests

    cases = {
        "Could you please tell me about the  Voltage?": [("QUERY_CONCEPT", "query.what_is", "INTERPRETED", "Voltage", None)],
        "What is it?": [("QUERY_CONCEPT", "query.what_is", "INCOMPLETE", "it", None)],
        "calculate power and then search for ohm": [("CALCULATE", "calculate.verb", "INTERPRETED", "power", None), ("KEYWORD_SEARCH", "query.keyword", "INTERPRETED", "ohm", None)],
        "what is salt and pepper": [("QUERY_CONCEPT", "query.what_is", "INTERPRETED", "salt and pepper", None)],
        "which equations are given for current using all authorized sources": [("QUERY_CONCEPT", "query.equations_given", "INTERPRETED", "current", "AUTHORIZED")],
        "hello": [(None, "", "UNRECOGNIZED", None, None)], "": [(None, "", "UNRECOGNIZED", None, None)],
    }
    d = spark.createDataFrame([*enumerate(cases), (99, None)], "request_id int, text string")
    got = {}
    for x in requests.interpreted(d).orderBy("request_id", "clause").collect():
        got.setdefault(x["request_id"], []).append((x["intent"], x["rule"], x["status"], x["target"], x["scope"]))
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == [(None, "", "UNRECOGNIZED", None, None)]
