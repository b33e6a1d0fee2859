"""Values of symbols from equations: which can be had, by which equations, exactly, with dimensions.

Equations are rows (equation_id, target, formula, needs): what each needs is joined with what is known, round by round,
so that any number of problems and equations is solved at once. Values are exact fractions written n/d; a small helper
evaluates one formula with its values.
"""

from __future__ import annotations

import ast
from collections.abc import Collection, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import formulas
from quillspark.functions.units import BASE, DERIVED
from quillspark.operators.graph import components
from quillspark.session import ship, small_broadcasts
from quillspark.storage import written

#: What keeps an expression from having a value; the most bits of a result.
PROBLEMS = ("DIMENSION_MISMATCH", "DIVISION_BY_ZERO", "ZERO_TO_NEGATIVE_POWER", "UNBOUND_SYMBOL", "TOO_LARGE")
MAX_BITS = 4096
NONE = (0,) * len(BASE)


class NoValue(ArithmeticError):
    """Why there is no value: one of PROBLEMS."""


def composition(symbol: str, known: Collection[str]) -> tuple[str, ...] | None:
    """symbol as two or more known symbols side by side, with the fewest parts, shorter ones first; None if it can't be read so. Then `ab` may mean a times b."""
    best: dict[int, tuple[str, ...]] = {0: ()}
    parts = sorted({k for k in known if k}, key=lambda k: (len(k), k))
    layer = [0]
    while layer:
        after = []
        for at in layer:
            for part in parts:
                end = at + len(part)
                if symbol.startswith(part, at) and end not in best and (at or end < len(symbol)):
                    best[end] = (*best[at], part)
                    after.append(end)
        if len(symbol) in best:
            return best[len(symbol)]
        layer = after
    return None


def coherent_unit(dimension: Column) -> Column:
    """The unit of a dimension vector: a named one, else a product of base units, else nothing."""
    named = F.create_map(*(x for unit, d in DERIVED.items() for x in (F.lit(",".join(map(str, d))), F.lit(unit))))
    part = lambda e, i: F.when(e == 1, F.get(F.array(*map(F.lit, BASE)), i)).when(e != 0, F.concat(F.get(F.array(*map(F.lit, BASE)), i), F.lit("^"), e.cast("string")))
    product = F.array_join(F.filter(F.transform(dimension, part), lambda x: x.isNotNull()), "·")
    return F.coalesce(F.element_at(named, F.array_join(F.transform(dimension, lambda e: e.cast("string")), ",")), product)


def value_of(tree: ast.expr, bound: dict[str, tuple[Fraction, tuple[int, ...]]]) -> tuple[Fraction, tuple[int, ...]]:
    """The exact value and the dimension of an expression."""
    if isinstance(tree, ast.Constant):
        return Fraction(str(tree.value)), NONE
    if isinstance(tree, ast.Name):
        if tree.id not in bound:
            raise NoValue("UNBOUND_SYMBOL")
        return bound[tree.id]
    if isinstance(tree, ast.UnaryOp):
        v, d = value_of(tree.operand, bound)
        return (-v if isinstance(tree.op, ast.USub) else v), d
    a, da = value_of(tree.left, bound)
    if isinstance(tree.op, ast.Pow):
        n = formulas.power(tree)
        if n < 0 and a == 0:
            raise NoValue("ZERO_TO_NEGATIVE_POWER")
        out, d = a**n, tuple(x * n for x in da)
    else:
        b, db = value_of(tree.right, bound)
        if isinstance(tree.op, (ast.Add, ast.Sub)):
            if da != db:
                raise NoValue("DIMENSION_MISMATCH")
            out, d = (a + b if isinstance(tree.op, ast.Add) else a - b), da
        elif isinstance(tree.op, ast.Mult):
            out, d = a * b, tuple(x + y for x, y in zip(da, db, strict=True))
        elif b == 0:
            raise NoValue("DIVISION_BY_ZERO")
        else:
            out, d = a / b, tuple(x - y for x, y in zip(da, db, strict=True))
    if max(out.numerator.bit_length(), out.denominator.bit_length()) > MAX_BITS:
        raise NoValue("TOO_LARGE")
    return out, d


def _tuples(bound: pa.MapArray) -> list[tuple]:
    """For each row its (symbol, value, dimension), column by column; nothing for a null."""
    offsets, at = bound.offsets.to_pylist(), bound.offsets[0].as_py()
    n = offsets[-1] - at
    items = bound.items.slice(at, n)
    dimensions = [None if d is None else tuple(d) for d in items.field("dimension").to_pylist()] if items.field("dimension").null_count < n else [None] * n
    flat = list(zip(bound.keys.slice(at, n).to_pylist(), items.field("value").to_pylist(), dimensions, strict=True))
    return [tuple(flat[x - at : y - at]) for x, y in zip(offsets, offsets[1:], strict=False)]


def evaluated(rows: DataFrame) -> DataFrame:
    """rows (key, formula, bound: map of symbol to struct(value, dimension)) with `value`, `dimension` and `problem`, one of PROBLEMS or why the formula can't be read."""
    ship(rows.sparkSession)
    columns = [c for c in rows.columns if c not in ("formula", "bound")]

    def one(formula: str | None, bound: tuple) -> tuple[str | None, list[int] | None, str | None]:
        try:
            given = {k: (Fraction(v), d or NONE) for k, v, d in bound}
            v, d = value_of(formulas.parse(formula or "")[1], given)
            return str(v), list(d), None
        except NoValue as e:
            return None, None, str(e)
        except (formulas.FormulaError, ValueError, ZeroDivisionError) as e:
            return None, None, f"not read: {e}"[:80]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # rows with the same formula and values are worked out once a batch
            known: dict[tuple, tuple] = {}
            found = []
            for formula, bound in zip(b.column("formula").to_pylist(), _tuples(b.column("bound")), strict=True):
                if (formula, bound) not in known:
                    known[formula, bound] = one(formula, bound)
                found.append(known[formula, bound])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.list_(pa.int32()), pa.string())))], [*columns, "value", "dimension", "problem"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{kinds}, value string, dimension array<int>, problem string")


def solved(equations: DataFrame, known: DataFrame) -> DataFrame:
    """(problem_id, symbol, state, value, dimension, n_methods, round, problem) of every symbol of each problem; problem says why an equation that had all it needs gave no value.

    equations: (equation_id, target, formula, needs array); known: (problem_id, symbol, value, dimension). AVAILABLE as
    given; DERIVED if some equation has all it needs: all such equations of a round are evaluated and none is
    preferred, so equations with different values make the symbol CONFLICTING; MISSING if nothing defines it; BLOCKED
    otherwise, cycles included. Rounds are as many as the longest chain; a symbol's methods are those of its round.
    """
    small_broadcasts(known.sparkSession)
    given = known.select("problem_id", "symbol", "value", "dimension", F.lit("AVAILABLE").alias("state"), F.lit(0).cast("long").alias("n_methods"), F.lit(0).alias("round"))
    now, done = written(given, "known"), 0
    # written, so that its size is known and Spark never broadcasts the problems to meet it
    each = written(equations.select("equation_id", "target", "formula", F.size(F.array_distinct("needs")).alias("n"), F.explode_outer(F.array_distinct("needs")).alias("symbol")), "equations")
    problems = written(known.select("problem_id").distinct(), "problems")
    failed = None
    while True:
        done += 1
        usable = now.where("state in ('AVAILABLE', 'DERIVED')").select("problem_id", "symbol", F.struct("value", "dimension").alias("v"), "round")
        # what had all its inputs in an earlier round was tried then
        ready = each.join(usable, "symbol").groupBy("problem_id", "equation_id", "target", "formula", "n").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "v"))).alias("bound"), F.max("round").alias("last")).where((F.size("bound") == F.col("n")) & (F.col("last") == done - 1)).drop("last")
        if done == 1:
            free = each.where("n = 0 or symbol is null").crossJoin(problems).select("problem_id", "equation_id", "target", "formula", "n", F.map_from_entries(F.array().cast("array<struct<symbol:string,v:struct<value:string,dimension:array<int>>>>")).alias("bound"))
            ready = ready.union(free)
        ready = ready.join(now.select("problem_id", F.col("symbol").alias("target")), ["problem_id", "target"], "left_anti")
        tried = written(evaluated(ready.select("problem_id", "equation_id", "target", "formula", "bound")).select("problem_id", "target", "value", "dimension", "problem"), "tried")
        got, lost = tried.where("problem is null"), tried.where("problem is not null").select("problem_id", F.col("target").alias("symbol"), "problem")
        failed = lost if failed is None else failed.union(lost)
        made = got.groupBy("problem_id", F.col("target").alias("symbol")).agg(F.min("value").alias("value"), F.min("dimension").alias("dimension"), (F.countDistinct("value", "dimension") > 1).alias("clash"), F.count("*").alias("n_methods"))
        new = written(made.select("problem_id", "symbol", F.when(~F.col("clash"), F.col("value")).alias("value"), F.when(~F.col("clash"), F.col("dimension")).alias("dimension"), F.when(F.col("clash"), "CONFLICTING").otherwise("DERIVED").alias("state"), "n_methods", F.lit(done).alias("round")), "derived")
        if new.isEmpty():
            break
        now = written(now.union(new), "known") if done % 10 == 0 else now.union(new)
    named = written(equations.select(F.col("target").alias("symbol"), F.lit(True).alias("defined")).union(equations.select(F.explode("needs"), F.lit(False))).groupBy("symbol").agg(F.max("defined").alias("defined")), "symbols")
    # every problem has a state for every symbol of the equations: a stated set of problems against all symbols
    rest = problems.crossJoin(named).join(now.select("problem_id", "symbol"), ["problem_id", "symbol"], "left_anti")
    rest = rest.select("problem_id", "symbol", F.lit(None).cast("string"), F.lit(None).cast("array<int>"), F.when(F.col("defined"), "BLOCKED").otherwise("MISSING"), F.lit(0).cast("long"), F.lit(None).cast("int"))
    why = failed.groupBy("problem_id", "symbol").agg(F.min("problem").alias("problem"))
    found = now.union(rest).join(why, ["problem_id", "symbol"], "left")
    return found.select("problem_id", "symbol", "state", "value", "dimension", "n_methods", "round", F.when(F.col("state") == "BLOCKED", F.col("problem")).alias("problem"))


def symbol_cycles(equations: DataFrame) -> DataFrame:
    """(node, component) of the symbols that define one another in a circle."""
    edges = equations.select(F.col("target").alias("src"), F.explode("needs").alias("dst")).distinct()
    found = components(edges)
    return found.join(found.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component")
