"""Recorded answers held against a second evaluation, against their own steps, and against a new run.

The second evaluator shares no code with the first: it reads a formula with two stacks, in decimals of 50 digits, and
keeps dimensions by itself. What it can't read or work out is a disagreement, never a pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal, DecimalException, localcontext
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.answers import visible_edges
from quillspark.operators.reasoning import REQUIREMENTS
from quillspark.session import ship

Base = SimpleNamespace
Amount = tuple[Decimal, tuple[int, ...]]

#: Digits of the second evaluation, and the relative difference that still agrees.
DIGITS, TOLERANCE = 50, Decimal("1e-40")
VERIFIED, FAILED, INCONCLUSIVE = "VERIFIED", "FAILED", "INCONCLUSIVE"
_PIECE = re.compile(r"\s*(?:(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|([^\W\d_]\w*)|([-+*/^()−×·÷])|(\S))")
_SAME = {"−": "-", "×": "*", "·": "*", "÷": "/"}
#: How tightly operators bind; `~` is a sign, looser than a power and tighter than a product.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3, "^": 4}


class Disagrees(ValueError):
    """Why the second evaluation gives nothing."""


def amount(exact: str, dimension: list[int] | None) -> Amount:
    """An exact fraction n/d as a decimal of DIGITS digits."""
    over, _, under = exact.partition("/")
    with localcontext() as c:
        c.prec = DIGITS
        try:
            return Decimal(over) / Decimal(under or 1), tuple(dimension or (0,) * 7)
        except DecimalException as e:
            raise Disagrees(f"{exact} is no fraction") from e


def _combine(op: str, values: list[Amount]) -> None:
    """The operator applied to the last values, which it replaces."""
    if len(values) < 1 + (op != "~"):
        raise Disagrees("an operand is missing")
    b, db = values.pop()
    if op == "~":
        values.append((-b, db))
        return
    a, da = values.pop()
    if op in "+-":
        if da != db:
            raise Disagrees("different dimensions are added")
        values.append((a + b if op == "+" else a - b, da))
    elif op == "*":
        values.append((a * b, tuple(x + y for x, y in zip(da, db, strict=True))))
    elif op == "/":
        if not b:
            raise Disagrees("division by zero")
        values.append((a / b, tuple(x - y for x, y in zip(da, db, strict=True))))
    else:
        if any(db) or b != b.to_integral_value():
            raise Disagrees("a power is no whole number")
        if not a and b < 0:
            raise Disagrees("zero to a negative power")
        values.append((a ** int(b), tuple(x * int(b) for x in da)))


def second_value(formula: str, given: dict[str, Amount]) -> Amount:
    """The value of a formula's right side."""
    parts = formula.split("=")
    if len(parts) != 2:
        raise Disagrees("a formula has one equals sign")
    values: list[Amount] = []
    waiting: list[str] = []
    operand = True  # whether an operand must come next
    with localcontext() as c:
        c.prec = DIGITS
        try:
            for number, symbol, sign, other in _PIECE.findall(parts[1].rstrip()):
                if other:
                    raise Disagrees(f"{other} can't be read")
                if number or symbol:
                    if not operand:
                        raise Disagrees("two operands side by side")
                    if symbol and symbol not in given:
                        raise Disagrees(f"{symbol} has no value")
                    values.append((Decimal(number), (0,) * 7) if number else given[symbol])
                    operand = False
                    continue
                op = _SAME.get(sign, sign)
                if op == "(":
                    if not operand:
                        raise Disagrees("an operand before a bracket")
                    waiting.append(op)
                elif op == ")":
                    if operand:
                        raise Disagrees("an operand is missing")
                    while waiting and waiting[-1] != "(":
                        _combine(waiting.pop(), values)
                    if not waiting:
                        raise Disagrees("a bracket is not opened")
                    waiting.pop()
                elif operand:
                    if op != "-":
                        raise Disagrees("an operand is missing")
                    waiting.append("~")
                else:
                    while waiting and waiting[-1] != "(" and (_BINDS[waiting[-1]] > _BINDS[op] or _BINDS[waiting[-1]] == _BINDS[op] and op != "^"):
                        _combine(waiting.pop(), values)
                    waiting.append(op)
                    operand = True
            if operand:
                raise Disagrees("an operand is missing")
            while waiting:
                if waiting[-1] == "(":
                    raise Disagrees("a bracket is not closed")
                _combine(waiting.pop(), values)
        except DecimalException as e:
            raise Disagrees("no decimal") from e
        return +values[0][0], values[0][1]


def disagreement(formula: str, given: dict[str, tuple[str, list[int] | None]], value: str, dimension: list[int] | None) -> str | None:
    """Why a recorded value is not what the second evaluation gives; null if it is."""
    try:
        found, d = second_value(formula, {k: amount(*v) for k, v in given.items()})
        want, dw = amount(value, dimension)
    except Disagrees as e:
        return str(e)
    if d != dw:
        return "another dimension"
    with localcontext() as c:
        c.prec = DIGITS
        near = abs(found) <= TOLERANCE if not want else abs(found - want) / abs(want) <= TOLERANCE
    return None if near else "another value"


STEPS = "answer_id, number, symbol, formula, inputs, value, dimension"


def independent(steps: DataFrame) -> DataFrame:
    """(answer_id, kind, subject, status, detail): each recorded step evaluated a second time. steps: STEPS, inputs an array of struct(symbol, value, dimension, from_step)."""
    ship(steps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, formula, inputs, value, dimension = (c.to_pylist() for c in b.columns)
            why = []
            for f, given, v, d in zip(formula, inputs, value, dimension, strict=True):
                try:
                    why.append(disagreement(f, {x["symbol"]: (x["value"], x["dimension"]) for x in given or []}, v, d))
                except (TypeError, AttributeError):
                    why.append("the record is incomplete")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(why, pa.string())], ["answer_id", "number", "detail"])

    kind = steps.schema["answer_id"].dataType.simpleString()
    found = steps.select("answer_id", "number", "formula", "inputs", "value", "dimension").mapInArrow(run, f"answer_id {kind}, number int, detail string")
    return found.select("answer_id", F.lit("INDEPENDENT").alias("kind"), F.concat(F.lit("step "), F.col("number").cast("string")).alias("subject"), F.when(F.col("detail").isNull(), VERIFIED).otherwise(FAILED).alias("status"), "detail")


def _one(rows: DataFrame, kind: str, why: Column) -> DataFrame:
    """A check for each answer, failed where `why` is not empty."""
    return rows.select("answer_id", F.lit(kind).alias("kind"), F.lit("answer").alias("subject"), F.when(why == "", VERIFIED).otherwise(FAILED).alias("status"), F.when(why != "", why).alias("detail"))


def chained(answers: DataFrame, steps: DataFrame) -> DataFrame:
    """The CHAIN check: inputs that come from an earlier step have its value, and the answer is the value of a step for its target, or was given. answers: (answer_id, target, status, value, dimension, given)."""
    of = steps.select("answer_id", F.col("number").alias("from_step"), F.col("value").alias("earlier"), F.col("symbol").alias("made"))
    taken = steps.select("answer_id", "number", F.explode("inputs").alias("x")).select("answer_id", "number", F.col("x.symbol").alias("symbol"), F.col("x.value").alias("value"), F.col("x.from_step").alias("from_step")).where("from_step is not null")
    bad = taken.join(of, ["answer_id", "from_step"], "left").where("earlier is null or earlier <> value or made <> symbol or from_step >= number").groupBy("answer_id").agg(F.min("number").alias("bad_step"))
    last = steps.select("answer_id", F.col("symbol").alias("target"), "value").distinct().withColumn("made", F.lit(True))
    a = answers.where("status = 'CALCULATED'").join(bad, "answer_id", "left").join(last, ["answer_id", "target", "value"], "left")
    why = F.concat_ws("; ", F.when(F.col("bad_step").isNotNull(), F.concat(F.lit("an input of step "), F.col("bad_step").cast("string"), F.lit(" is not what an earlier step gave"))), F.when(F.col("made").isNull() & ~F.col("given"), "no step gives the answer"))
    return _one(a, "CHAIN", why)


def reproduced(answers: DataFrame, again: DataFrame) -> DataFrame:
    """The REPRODUCTION check: the same request run again, both (answer_id, status, value, dimension, ...), gives the same; INCONCLUSIVE where it could not be run again."""
    b = again.select("answer_id", F.struct("status", "value", "dimension").alias("new"))
    a = answers.select("answer_id", F.struct("status", "value", "dimension").alias("old")).join(b, "answer_id", "left")
    differs = lambda c: F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), c)
    why = F.concat_ws(", ", *map(differs, ("status", "value", "dimension")))
    found = _one(a, "REPRODUCTION", why)
    lost = a.where("new is null").select("answer_id").withColumn("lost", F.lit(True))
    found = found.join(lost, "answer_id", "left")
    return found.select("answer_id", "kind", "subject", F.when(F.col("lost"), INCONCLUSIVE).otherwise(F.col("status")).alias("status"), F.when(F.col("lost"), "not run again").otherwise(F.col("detail")).alias("detail"))


def calculations(answers: DataFrame, steps: DataFrame, again: DataFrame) -> DataFrame:
    """All checks of recorded calculations; an answer that was given itself is INCONCLUSIVE, since nothing confirms it."""
    own = answers.where("given and status = 'CALCULATED'").select("answer_id", F.lit("DIRECT_ANSWER").alias("kind"), F.lit("answer").alias("subject"), F.lit(INCONCLUSIVE).alias("status"), F.lit("the value was given").alias("detail"))
    return reproduced(answers, again).union(independent(steps)).union(chained(answers, steps)).union(own)


def verdicts(checks: DataFrame) -> DataFrame:
    """(answer_id, status, kind, subject, detail): FAILED before INCONCLUSIVE before VERIFIED, with the first check that decides it."""
    order = F.when(F.col("status") == FAILED, 0).when(F.col("status") == INCONCLUSIVE, 1).otherwise(2)
    first = checks.groupBy("answer_id").agg(F.min(F.struct(order.alias("o"), "kind", "subject", "status", "detail")).alias("x"))
    return first.select("answer_id", "x.status", "x.kind", "x.subject", "x.detail")


def derivations(kb: Base, steps: DataFrame, own_books: bool = False) -> DataFrame:
    """(answer_id, kind, subject, status, detail) of recorded derivation steps (answer_id, number, concept_id, requirements, relationships).

    Every edge that a step cites must be stored, active, a requirement from its concept to one of the recorded ones, and
    seen in scope; and together they must be all requirements that the concept now has. Both sides are joined as rows.
    """
    key = ["answer_id", "number", "concept_id"]
    cited = steps.select(*key, "requirements", F.explode("relationships").alias("id"))
    e = kb.edge.select("id", "relation_type", "lifecycle_status", "from_concept_id", "to_concept_id", F.lit(True).alias("stored"))
    seen = visible_edges(kb, own_books).select("id", F.lit(True).alias("seen"))
    c = cited.join(e, "id", "left").join(seen, "id", "left")
    joins = (F.col("from_concept_id") == F.col("concept_id")) & F.array_contains("requirements", F.col("to_concept_id"))
    why = (
        F.when(F.col("stored").isNull(), "not stored").when(F.col("lifecycle_status") != "ACTIVE", "not active").when(~F.col("relation_type").isin(*REQUIREMENTS), "no requirement")
        .when(~F.coalesce(joins, F.lit(False)), "joins something else").when(F.col("seen").isNull(), "not in scope")
    )
    # several edges may bear one number: the one that fits best is the cited one
    stage = F.array_position(F.array(*map(F.lit, ("not stored", "not active", "no requirement", "joins something else", "not in scope"))), F.col("why"))
    per = c.withColumn("why", why).groupBy(*key, "id").agg(F.count_if(F.col("why").isNull()).alias("n_right"), F.max_by("why", stage).alias("why"))
    bad = per.where("n_right = 0").groupBy(*key).agg(F.min(F.struct("id", "why")).alias("bad"))
    now = kb.edge.where(F.col("relation_type").isin(*REQUIREMENTS) & (F.col("lifecycle_status") == "ACTIVE") & F.col("to_concept_id").isNotNull()).select(F.col("from_concept_id").alias("concept_id"), "id")
    missing = steps.select(*key).join(now, "concept_id").join(cited.select("answer_id", "number", "id"), ["answer_id", "number", "id"], "left_anti").groupBy(*key).agg(F.min("id").alias("left_out"))
    d = steps.select(*key).join(bad, key, "left").join(missing, key, "left")
    detail = F.coalesce(F.when(F.col("bad").isNotNull(), F.concat(F.col("bad.id"), F.lit(": "), F.col("bad.why"))), F.when(F.col("left_out").isNotNull(), F.concat(F.col("left_out"), F.lit(": left out"))))
    return d.select("answer_id", F.lit("STEP").alias("kind"), F.concat(F.lit("step "), F.col("number").cast("string")).alias("subject"), F.when(detail.isNull(), VERIFIED).otherwise(FAILED).alias("status"), detail.alias("detail"))
