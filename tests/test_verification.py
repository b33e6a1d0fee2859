"""The second evaluator against the first, planted faults, and checks of recorded answers and derivations."""

import random
from fractions import Fraction
from types import SimpleNamespace

from quillspark.functions import formulas
from quillspark.operators import calculation
from quillspark.operators import verification as V

NONE = [0] * 7


def made(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice(["a", "b", "c", str(r.randint(0, 9)), "2.5"])
    kind = r.choice("+-*/^~(")
    if kind == "~":
        return f"-{made(r, depth - 1)}"
    if kind == "(":
        return f"({made(r, depth - 1)})"
    if kind == "^":
        return f"({made(r, depth - 1)})^{r.choice(['2', '3', '-1', '-2'])}"
    return f"{made(r, depth - 1)} {kind} {made(r, depth - 1)}"


def test_second_evaluator_agrees_and_finds_faults():
    r = random.Random(3)
    given = {"a": Fraction(7, 3), "b": Fraction(-2), "c": Fraction(0)}
    agreed = refused = 0
    for _ in range(3000):
        text = f"x = {made(r, 4)}"
        bound = {k: (v, calculation.NONE) for k, v in given.items()}
        recorded = {k: (str(v), None) for k, v in given.items()}
        try:
            value, _ = calculation.value_of(formulas.parse(text)[1], bound)
        except (calculation.NoValue, formulas.FormulaError):
            refused += 1
            continue
        assert V.disagreement(text, recorded, str(value), NONE) is None, text
        assert V.disagreement(text, recorded, str(value * (1 + Fraction(1, 10**30)) + (value == 0)), NONE) == "another value"
        assert V.disagreement(text, recorded, str(value), [1, 0, 0, 0, 0, 0, 0]) == "another dimension"
        agreed += 1
    assert agreed > 1500 and refused > 50


def test_what_it_refuses():
    a = {"a": ("1", NONE), "m": ("2", [1, 0, 0, 0, 0, 0, 0])}
    for text, why in {"x = a b": "side by side", "x = a a": "side by side", "x = (a": "not closed", "x = a)": "not opened", "x = a +": "missing", "x = * a": "missing", "x = a / (a - a)": "division by zero", "x = a + m": "different dimensions", "x = a ^ m": "whole number", "x = (a - a)^-1": "negative power", "x = a # a": "can't be read", "x = y": "no value", "x = a = a": "one equals sign", "x = ()": "missing"}.items():
        assert why in V.disagreement(text, a, "1", NONE), text
    assert V.disagreement("x = m ^ 2", a, "4", [2, 0, 0, 0, 0, 0, 0]) is None
    assert "no fraction" in V.disagreement("x = a", a, "1/0", NONE)


def test_recorded_calculations(spark):
    inputs = lambda *xs: [dict(zip(("symbol", "value", "dimension", "from_step"), (s, v, None, n), strict=True)) for s, v, n in xs]
    steps = [(1, 1, "u", "u = a + 1", inputs(("a", "2", None)), "3", None), (1, 2, "w", "w = u * 2", inputs(("u", "3", 1)), "6", None)]
    steps += [(2, 1, "u", "u = a + 1", inputs(("a", "2", None)), "4", None)]
    steps += [(3, 1, "u", "u = a + 1", inputs(("a", "2", None)), "3", None), (3, 2, "w", "w = u * 2", inputs(("u", "5", 1)), "10", None)]
    steps += [(5, 1, "u", "u = a + 1", inputs(("a", "2", None)), "3", None), (6, 1, "u", "u = 1 / a", inputs(("a", "0", None)), "3", None), (7, 1, "u", "u = a", None, "3", None)]
    answers = [(1, "w", "CALCULATED", "6", None, False), (2, "u", "CALCULATED", "4", None, False), (3, "w", "CALCULATED", "10", None, False), (4, "a", "CALCULATED", "2", None, True), (5, "w", "CALCULATED", "3", None, False), (6, "u", "CALCULATED", "3", None, False), (7, "u", "CALCULATED", "3", None, False), (8, "z", "CANNOT_DETERMINE", None, None, False), (9, "z", "CANNOT_DETERMINE", None, None, False)]
    schema = "answer_id int, target string, status string, value string, dimension array<int>, given boolean"
    recorded = spark.createDataFrame(answers, schema)
    again = spark.createDataFrame([x for x in answers if x[0] != 9 and x[0] != 8] + [(8, "z", "CALCULATED", "1", None, False)], schema)
    s = spark.createDataFrame(steps, "answer_id int, number int, symbol string, formula string, inputs array<struct<symbol: string, value: string, dimension: array<int>, from_step: int>>, value string, dimension array<int>")
    got = {x["answer_id"]: (x["status"], x["kind"]) for x in V.verdicts(V.calculations(recorded, s, again)).collect()}
    assert got == {1: ("VERIFIED", "CHAIN"), 2: ("FAILED", "INDEPENDENT"), 3: ("FAILED", "CHAIN"), 4: ("INCONCLUSIVE", "DIRECT_ANSWER"), 5: ("FAILED", "CHAIN"), 6: ("FAILED", "INDEPENDENT"), 7: ("FAILED", "INDEPENDENT"), 8: ("FAILED", "REPRODUCTION"), 9: ("INCONCLUSIVE", "REPRODUCTION")}


def test_recorded_derivations(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    place = ", document_id string, source_id string, extraction_run_id string, page_number int, char_start int, char_end int, segment_id string, text string"
    at = ("D1", "S1", "RUN1", 1, 0, 1, None, "x")
    edge = [("R1", "REQUIRES", "EXPLICIT", "ACTIVE", "A", "B", None), ("R2", "DEPENDS_ON", "EXPLICIT", "ACTIVE", "A", "C", None), ("R3", "REQUIRES", "EXPLICIT", "DELETED", "D", "B", None), ("R4", "REQUIRES", "EXPLICIT", "ACTIVE", "E", "B", None), ("R5", "RELATED_TO", "EXPLICIT", "ACTIVE", "F", "B", None)]
    kb = SimpleNamespace(
        edge=df(edge, "id string, relation_type string, origin string, lifecycle_status string, from_concept_id string, to_concept_id string, to_knowledge_id string"),
        edge_occurrence=df([("O1", "R1", *at), ("O2", "R2", *at), ("O5", "R5", *at)], "id string, relationship_id string" + place),
        source_occurrence=df([], "id string, knowledge_id string" + place), concept_occurrence=df([], "id string, concept_id string" + place), basis=df([], "relationship_id string, rule string, basis_occurrence_id string"),
        source=df([("S1", "AUTHORIZED", "LOCAL_SOURCE")], "id string, authorization string, source_category string"), run=df([("RUN1", "COMPLETED", 6)], "id string, status string, extractor_version int"),
    )
    steps = df([(1, 1, "A", ["B", "C"], ["R1", "R2"]), (2, 1, "A", ["B"], ["R1"]), (3, 1, "D", ["B"], ["R3"]), (4, 1, "E", ["B"], ["R4"]), (5, 1, "F", ["B"], ["R5"]), (6, 1, "A", ["B"], ["R1", "R2"]), (7, 1, "G", ["B"], ["R9"])], "answer_id int, number int, concept_id string, requirements array<string>, relationships array<string>")
    got = {x["answer_id"]: (x["status"], x["detail"]) for x in V.derivations(kb, steps).collect()}
    assert got == {1: ("VERIFIED", None), 2: ("FAILED", "R2: left out"), 3: ("FAILED", "R3: not active"), 4: ("FAILED", "R4: not in scope"), 5: ("FAILED", "R5: no requirement"), 6: ("FAILED", "R2: joins something else"), 7: ("FAILED", "R9: not stored")}
