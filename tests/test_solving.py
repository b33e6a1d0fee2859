"""Equations read, turned and chained, against expected readings and a plain search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import formulas, notation
from quillspark.operators import solving as S

ATOMS = ["V", "I", "R", "P", "Vc", "C", "t", "Req", "R1", "R2", "IR", "E", "m", "c", "a", "ab", "b"]
READ = {
    "V = IR": ["V = IR"],  # IR is itself a quantity
    "V = I R": ["V = I * R"],
    "P = VI = I^{2} R = \\frac{V^{2}}{R} W": ["P = V * I", "P = I^2 * R", "P = V^2 / R"],
    "V_{c} = I\\cdot R_{1}": ["Vc = I * R1"],
    "Req = \\frac{R_1 R_2}{R_1 + R_2}": ["Req = R1 * R2 / (R1 + R2)"],
    "E = mc^2": ["E = m * c^2"],
    "V^2 = P R": "NO_SINGLE_QUANTITY",
    "R = \\frac{\\frac{V}{I}}{2}": ["R = V / I / 2"],
    "R = 5 \\Omega": ["R = 5"],
    "R = 5 Ω": ["R = 5"],
    "I_c = C \\frac{dV}{dt}": "DIFFERENTIAL",
    "V = \\int I dt": "NOT_ARITHMETIC",
    "V = \\sqrt{P R}": "NOT_ARITHMETIC",
    "i(t) = 5": "FUNCTION_OF",
    "V = sin(t)": "FUNCTION",
    "V == I": "ONE_SIDED",
    "V + I": "NO_EQUALS",
    "V = I ? R": "ODD_CHARACTER",
    "V = I^{R}": "STRUCTURE",
    "": "EMPTY",
    "V + I = P + R": "NO_SINGLE_QUANTITY",
    "V = I + ": "GRAMMAR",
    "P = aab": "AMBIGUOUS",
    "α = \\beta × 2": ["α = β * 2"],
    "V − I = P": ["P = V - I"],
    "V = is": ["V = is"],
    "V = I^{-1}": ["V = I^(-1)"],
}


def test_readings(spark):
    rows = [(f"K-{i}", x) for i, x in enumerate(READ)]
    atoms = spark.createDataFrame([(a,) for a in [*ATOMS, "aa", None]], "atom string")
    got = {}
    for r in S.readings(spark.createDataFrame(rows, "equation_id string, expression string"), atoms).collect():
        got.setdefault(r["equation_id"], []).append((r["place"], r["formula"], r["problem"]))
    for i, x in rows:
        found = sorted(got[i], key=str)
        want = READ[x]
        if isinstance(want, str):
            assert [p for _, _, p in found] == [want], (x, found)
        else:
            assert [(f or "").replace("^(-1)", "^-1") for _, f, _ in found] == [w.replace("^(-1)", "^-1") for w in want], (x, found)


def test_products_against_every_split(spark):
    r = random.Random(1)
    atoms = sorted({"".join(r.choice("ab1") for _ in range(r.randint(1, 3))) for _ in range(12)})
    runs = sorted({"".join(r.choice("ab1") for _ in range(r.randint(1, 8))) for _ in range(60)})

    def splits(x):
        if not x:
            return [()]
        return [(a, *rest) for a in sorted(atoms, key=lambda a: (-len(a), a)) if x.startswith(a) for rest in splits(x[len(a) :])]

    want = {x: ["*".join(w) for w in splits(x) if len(w) > 1][:3] for x in runs}
    one = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} string")
    got = {x["run"]: x["ways"] for x in S.products(one(runs, "run"), one(atoms, "atom")).collect()}
    assert got == {x: w for x, w in want.items() if w}


def test_readable(spark):
    cases = {"\\frac{V^{2}}{R}": "V²/R", "\\frac{a + b}{2}": "(a + b)/2", "\\alpha \\cdot x_{12}^{-1}": "α · x_12⁻¹", "\\sqrt{x}": "√(x)", "\\frac{\\frac{a}{b}}{c}": "(a/b)/c", "\\foo{x}": "\\foo{x}", "x^{n}": "x^{n}", "a  =\tb": "a = b"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", notation.readable(F.col("t")).alias("x")).collect()} == cases


@pytest.mark.parametrize("seed", range(3))
def test_costs_and_plans(spark, seed):
    r = random.Random(seed)
    symbols = [f"q{i}" for i in range(9)]
    equations = []
    for i in range(9):
        target, *needs = r.sample(symbols, r.choice([2, 3]))
        equations.append((f"K-{i:08}", f"{target} = {f' {r.choice("+*")} '.join(needs)}{r.choice([' + 1', ''])}", r.random() < 0.7))
    stored = spark.createDataFrame(equations, "equation_id string, formula string, stated boolean")
    have_of = {p: r.sample(symbols, 2) for p in range(2)}
    targets = [(10 * p + i, s) for p in range(2) for i, s in enumerate(symbols)]  # a problem for each target
    given = [(k, s) for k, _ in targets for s in have_of[k // 10]]
    known = spark.createDataFrame(given, "problem_id int, symbol string")
    found = S.forms(stored)
    forms = [f.asDict() for f in found.collect()]
    want_forms = set()
    for k, text, _ in equations:
        for s in formulas.symbols(text):
            try:
                want_forms.add((k, s, formulas.isolate(text, s)))
            except formulas.FormulaError:
                pass
    assert {(f["equation_id"], f["output"], f["formula"]) for f in forms} == want_forms
    cost = {(x["problem_id"], x["symbol"]): x["cost"] for x in S.costs(found, known).collect()}
    for p in (0, 10):
        want = {s: 0 for q, s in given if q == p}
        while True:
            new = dict(want)
            for f in forms:
                if all(s in want for s in f["inputs"]):
                    new[f["output"]] = min(new.get(f["output"], 10**9), 1 + sum(want[s] for s in f["inputs"]))
            if new == want:
                break
            want = new
        assert {s: c for (q, s), c in cost.items() if q == p} == want

    def every(symbol, have, path):
        """All plans as ordered tuples of forms, without any bound but the depth."""
        if symbol in have:
            return {()}
        if symbol in path or len(path) >= S.MAX_DEPTH:
            return set()
        out = set()
        for i, f in enumerate(forms):
            if f["output"] != symbol:
                continue
            for parts in itertools.product(*(every(s, have, path | {symbol}) for s in f["inputs"])):
                steps = []
                ok = True
                for j in [*itertools.chain(*parts), i]:
                    if j in steps:
                        ok = ok and j != i
                        continue
                    ok = ok and all(forms[j]["output"] != forms[x]["output"] and (forms[j]["equation_id"], forms[j]["statement"]) != (forms[x]["equation_id"], forms[x]["statement"]) for x in steps)
                    steps.append(j)
                if ok:
                    out.add(tuple(steps))
        return out

    rank = lambda steps: (len(steps), sum(not forms[i]["stated"] for i in steps), sum(forms[i]["rearranged"] for i in steps), [int(forms[i]["equation_id"][2:]) for i in steps], [forms[i]["formula"] for i in steps])
    got = {}
    for x in S.plans(found, known, spark.createDataFrame(targets, "problem_id int, symbol string")).collect():
        got.setdefault(x["problem_id"], {})[x["place"]] = [(y["equation_id"], y["formula"]) for y in x["steps"]]
    for k, s in targets:
        if s in have_of[k // 10]:
            continue
        best = sorted(every(s, set(have_of[k // 10]), frozenset()), key=rank)
        shown = [got.get(k, {})[i] for i in sorted(got.get(k, {}))]
        want = [[(forms[i]["equation_id"], forms[i]["formula"]) for i in steps] for steps in best]
        assert shown[:3] == want[:3] and len(shown) == min(len(want), S.KEEP), (k, s)


def test_answers(spark):
    stored = [("K-1", "V = I * R", True), ("K-2", "P = V * I", True), ("K-3", "P = I^2 * R", True), ("K-4", "Q = P + 1", True), ("K-5", "Q = P - 1", False), ("K-6", "W = 1 / (R - R2)", True), ("K-7", "Z = y * 2", False), ("K-8", "U = I + 1", True), ("K-9", "U = I + 2", True)]
    found = S.forms(spark.createDataFrame(stored, "equation_id string, formula string, stated boolean"))
    values = {1: {"I": "2", "R": "5"}, 2: {"R": "3", "R2": "3"}, 3: {"y": "1/3"}, 4: {"I": "1"}, 5: {"i": "2", "R": "1"}, 6: {"Q": "9"}}
    known = spark.createDataFrame([(p, s, v, None) for p, x in values.items() for s, v in x.items()], "problem_id int, symbol string, value string, dimension array<int>")
    asked = {1: "P", 2: "W", 3: "Z", 4: "U", 5: "V", 6: "Q"}
    targets = spark.createDataFrame(list(asked.items()), "problem_id int, symbol string")
    got = {x["problem_id"]: x for x in S.answers(found, known, targets).collect()}
    want = {1: ("CALCULATED", "20", "stated"), 2: ("CANNOT_DETERMINE", None, "stated"), 3: ("CALCULATED", "2/3", "mixed"), 4: ("CONFLICTING", None, "stated"), 5: ("CANNOT_DETERMINE", None, None), 6: ("CALCULATED", "9", "given")}
    assert {k: (x["status"], x["value"], x["tier"]) for k, x in got.items()} == want
    assert got[1]["n_agreeing"] == 1 and got[1]["steps"][-1].startswith("P = ")
    assert (got[2]["problem"], got[5]["problem"]) == ("DIVISION_BY_ZERO", "NO_ROUTE")
    lacking = [(x["place"], x["formula"], x["needs"]) for x in S.missing(found, known, targets.where("problem_id = 5")).orderBy("place").collect()]
    assert lacking[0] == (1, "V = I * R", ["I"]) and all(len(a[2]) <= len(b[2]) for a, b in itertools.pairwise(lacking))
    assert [tuple(x) for x in S.spellings(found, known.where("problem_id = 5")).collect()] == [(5, "i", "I")]
