"""From stored equations to values: reading them, writing them for any of their quantities, and finding the chains that lead from what is known to what is asked.

Equations are read into formulas by joins with the quantities that documents name: a run of letters is a product only
if these quantities make it in exactly one way. Chains are found in rounds for any number of problems at once: costs
relax over equations until none falls, plans grow from what is known, the ten best of each quantity are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import formulas, notation
from quillspark.functions.ids import counter
from quillspark.operators import calculation
from quillspark.operators import evidence as E
from quillspark.session import ship
from quillspark.storage import forget, written

Base = SimpleNamespace

#: How deep plans go, how many are kept, how many options for missing quantities, states of certainty that the source itself gave.
MAX_DEPTH, KEEP, OPTIONS = 6, 10, 5
STATED = ("REPORTED_BY_SOURCE", "KNOWN", "VERIFIED")
#: How many equations longer than the shortest plan another may be, plans that are calculated, and the most equations of one that isn't all stated.
EXTRA_STEPS, MAX_PLANS, MIXED_STEPS = 2, 8, 3
#: Ways to read a run of letters that are told apart.
_WAYS = 3
#: How many times as many equations the search for plans would rather try ahead than back: what is found ahead need not be looked at from behind.
_LEAN = 4


def heads(equations: DataFrame) -> DataFrame:
    """(atom): the quantities that stand alone on the left of an equation (expression)."""
    left = F.trim(F.split_part("plain_text", F.lit("="), F.lit(1)))
    # written, or the filters would work out the plain text again wherever they use it
    texts = written(notation.plain(equations.select("expression").repartition("expression"), "expression"), "plain")
    return texts.where("plain_text is not null").select(left.alias("atom")).where(notation.is_symbol(F.col("atom"))).distinct()


def products(runs: DataFrame, atoms: DataFrame) -> DataFrame:
    """(run, ways array<string>) of runs that are two or more atoms side by side: at most _WAYS ways, longest atoms first; runs: (run), atoms: (atom), each once.

    The stretches of a run are joined with the atoms, then ways are counted from the end of the run to its start.
    """
    longest = atoms.agg(F.coalesce(F.max(F.length("atom")), F.lit(0))).first()[0]
    n = F.length("run")
    at = runs.select("run", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    cut = at.select("run", "start", F.explode(F.sequence(F.lit(1), F.least(n - F.col("start") + 1, F.lit(max(1, longest))))).alias("n"))
    # merged, since Spark takes the stretches for as few as the runs and would broadcast them
    cut = cut.withColumn("atom", F.expr("substring(run, start, n)")).where("atom <> run").join(atoms.hint("merge"), "atom")
    steps = cut.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("start", F.col("n").alias("n"), "atom")), asc=False).alias("steps"))

    def back(ways: Column, step: Column) -> Column:
        """ways: for each place after one that has been handled, the ways from there to the end."""
        rest = F.when(step["start"] + step["n"] > F.size(ways) - 1, F.array(F.lit(""))).otherwise(F.get(ways, step["start"] + step["n"] - 1))
        new = F.transform(rest, lambda r: F.when(r == "", step["atom"]).otherwise(F.concat(step["atom"], F.lit("*"), r)))
        return F.transform(ways, lambda w, i: F.when(i == step["start"] - 1, F.slice(F.concat(w, new), 1, _WAYS)).otherwise(w))

    empty = F.array_repeat(F.array().cast("array<string>"), F.length("run") + 1)
    found = steps.select("run", F.get(F.aggregate("steps", empty, back), F.lit(0)).alias("ways"))
    return found.where("size(ways) > 0")


def _why(problem: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(problem).alias("problem"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))


def readings(equations: DataFrame, atoms: DataFrame) -> DataFrame:
    """(equation_id, place, target, formula, needs, notes, problem, detail) of equations (equation_id, expression), one row for each formula that an equation states, or one with the problem.

    A chain `a = b = c` states several formulas. Quantities side by side are a product; a run of letters that no atom
    is becomes a product only if atoms (atom) make it in one way. A unit after a result goes. `notes` says what was done.
    """
    atoms = written(atoms.where("atom is not null").distinct(), "atoms")
    texts = written(notation.plain(equations.select("equation_id", "expression").repartition("equation_id"), "expression"), "plain")
    parts = F.transform(F.split("plain_text", "="), lambda p: F.trim(p))
    sides = texts.where("plain_text is not null").select("equation_id", parts.alias("parts"))
    empty = sides.where(F.exists("parts", lambda p: p == "")).select("equation_id")
    s = sides.join(empty, "equation_id", "left_anti").select("equation_id", F.posexplode("parts").alias("i", "side"))
    unit = F.regexp_extract("side", r"^.*[\d)]\s+(\p{L}+)$", 1)
    s = s.withColumn("unit", F.when(unit.isin(*notation.UNITS), unit)).withColumn("side", F.when(F.col("unit").isNotNull(), F.regexp_extract("side", r"^(.*[\d)])\s+\p{L}+$", 1)).otherwise(F.col("side")))
    s = s.withColumn("tokens", notation.tokens(F.col("side"))).withColumn("head", (F.col("i") == 0) & notation.is_symbol(F.col("side")))
    function = F.get(F.filter("tokens", lambda t: t.isin(*notation.FUNCTIONS, *notation.DIFFERENTIALS)), F.lit(0))
    call = F.regexp_like("side", F.lit(rf"{notation.SYMBOL}\(|{notation.SYMBOL}\s*\(\s*{notation.SYMBOL}\s*\)"))
    s = s.withColumn("bad", F.when(function.isin(*notation.FUNCTIONS), _why("FUNCTION", function)).when(function.isNotNull(), _why("DIFFERENTIAL", function)).when(~F.col("head") & call, _why("FUNCTION_OF")))
    s = written(s, "sides")
    used = s.where("bad is null and not head").select("equation_id", "i", F.explode(F.array_distinct("tokens")).alias("run")).where(notation.is_symbol(F.col("run")))
    runs = written(used.select("run").distinct().join(atoms.withColumnRenamed("atom", "run"), "run", "left_anti"), "runs")
    ways = written(products(runs, atoms), "ways")
    per = used.join(ways.hint("merge"), "run").groupBy("equation_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("run", "ways"))).alias("ways"))
    s = s.join(per, ["equation_id", "i"], "left")
    unclear = F.get(F.filter("tokens", lambda t: F.size(F.element_at("ways", t)) > 1), F.lit(0))
    s = s.withColumn("unclear", F.when(~F.col("head") & F.col("ways").isNotNull(), unclear))
    both = F.element_at("ways", F.col("unclear"))
    bad = F.coalesce("bad", F.when(F.col("unclear").isNotNull(), _why("AMBIGUOUS", F.concat_ws(" or ", F.col("unclear"), F.get(both, F.lit(0)), F.get(both, F.lit(1))))))
    operand = lambda t: F.regexp_like(t, F.lit(r"^[\p{L}\p{N}_]"))
    joined = lambda t, i: (i > 0) & (operand(F.get("tokens", i - 1)) | (F.get("tokens", i - 1) == ")")) & (operand(t) | (t == "("))
    one = lambda t: F.coalesce(F.get(F.element_at("ways", t), F.lit(0)), t)
    text = F.array_join(F.transform("tokens", lambda t, i: F.concat(F.when(joined(t, i), F.lit("* ")).otherwise(F.lit("")), one(t))), " ")
    side_by_side = F.exists(F.transform("tokens", joined), lambda x: x)
    read = F.transform(F.filter(F.array_distinct("tokens"), lambda t: F.element_at("ways", t).isNotNull()), lambda t: F.concat(t, F.lit(" as "), F.get(F.element_at("ways", t), F.lit(0))))
    notes = F.concat(F.when(side_by_side, F.array(F.lit("side by side"))).otherwise(F.array().cast("array<string>")), F.coalesce(read, F.array().cast("array<string>")), F.when(F.col("unit").isNotNull(), F.array(F.concat(F.lit("unit "), F.col("unit")))).otherwise(F.array().cast("array<string>")))
    s = s.select("equation_id", "i", bad.alias("bad"), F.when(F.col("head"), F.col("side")).otherwise(text).alias("side"), F.when(F.col("head"), F.array().cast("array<string>")).otherwise(notes).alias("notes"))
    s = written(s.withColumn("single", notation.is_symbol(F.col("side"))), "clear")
    whole = s.groupBy("equation_id").agg(F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("i"))).alias("bad"), F.max("single").alias("any"), F.sort_array(F.collect_list(F.struct("i", "side", "notes", "single"))).alias("sides"))
    whole = whole.withColumn("bad", F.coalesce("bad", F.when(~F.col("any"), _why("NO_SINGLE_QUANTITY"))))
    pair = lambda x, y: F.struct(x["i"].alias("i"), y["i"].alias("j"), F.concat(x["side"], F.lit(" = "), y["side"]).alias("text"), F.array_distinct(F.concat(x["notes"], y["notes"])).alias("notes"))
    fits = lambda x, y: (x["i"] != y["i"]) & ~(y["single"] & (y["i"] < x["i"]))
    pairs = F.flatten(F.transform(F.filter("sides", lambda x: x["single"]), lambda x: F.transform(F.filter("sides", lambda y: fits(x, y)), lambda y: pair(x, y))))
    stated = spelled(whole.where("bad is null").select("equation_id", F.explode(pairs).alias("p")).select("equation_id", "p.i", "p.j", "p.text", "p.notes"))
    good = stated.where("formula is not null").groupBy("equation_id", "formula").agg(F.min(F.struct("i", "j")).alias("at"), F.min_by("target", F.struct("i", "j")).alias("target"), F.min_by("needs", F.struct("i", "j")).alias("needs"), F.min_by("notes", F.struct("i", "j")).alias("notes"))
    good = written(good.withColumn("place", F.row_number().over(W.partitionBy("equation_id").orderBy("at"))), "readings")
    failed = stated.join(good.select("equation_id").distinct(), "equation_id", "left_anti").groupBy("equation_id").agg(F.max_by("why", F.struct("i", "j")).alias("detail"))
    columns = ["equation_id", "place", "target", "formula", "needs", "notes", "problem", "detail"]
    none = lambda df, problem, detail: df.select("equation_id", F.lit(0).alias("place"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("formula"), F.lit(None).cast("array<string>").alias("needs"), F.lit(None).cast("array<string>").alias("notes"), problem.alias("problem"), detail.alias("detail"))
    rows = good.select("equation_id", "place", "target", "formula", "needs", "notes", F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("detail"))
    for df, problem, detail in ((texts.where("plain_text is null"), F.col("problem"), F.col("detail")), (empty, F.lit("ONE_SIDED"), F.lit("")), (whole.where("bad is not null"), F.col("bad.problem"), F.col("bad.detail")), (failed, F.lit("GRAMMAR"), F.col("detail"))):
        rows = rows.union(none(df, problem, detail))
    return rows.select(*columns)


def spelled(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with formula in its one spelling, target and needs, or why it is none."""
    ship(rows.sparkSession)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(columns.index("text")).to_pylist():
                try:
                    name, tree = formulas.parse(text)
                    formula = formulas.written(name, tree)
                    needs = formulas.symbols_of(name, tree)[1:]
                    if name in needs:
                        raise formulas.FormulaError("the quantity stands on both sides")
                    out.append((formula, name, needs, None))
                except formulas.FormulaError as e:
                    out.append((None, None, None, str(e)))
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], [*columns, "formula", "target", "needs", "why"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, formula string, target string, needs array<string>, why string")


def library(kb: Base, own_books: bool = True) -> DataFrame:
    """(equation_id, expression, stated, state) of the equations in force: USABLE ones may be read, NO_EVIDENCE and CONFLICT are withheld.

    Evidence must be in scope; an equation in a conflict that is neither archived nor deleted, or at either end of a
    CONTRADICTS edge, is withheld. `stated` says whether the source itself gave the text.
    """
    seen = E.judged(kb, kb.source_occurrence.select("id", F.lit("KNOWLEDGE").alias("subject_kind"), F.col("knowledge_id").alias("subject_id"), *E.PLACE), own_books).where("verdict = 'IN_SCOPE'").select(F.col("subject_id").alias("equation_id")).distinct()
    clash = kb.conflict.where(~F.col("lifecycle_status").isin(*E.LEFT_OUT)).select(F.explode(F.array("claim_a_id", "claim_b_id")).alias("equation_id"))
    against = kb.edge.where("relation_type = 'CONTRADICTS' and to_knowledge_id is not null").select(F.col("to_knowledge_id").alias("equation_id"))
    k = kb.knowledge.where("knowledge_type = 'EQUATION' and lifecycle_status = 'ACTIVE'").select(F.col("id").alias("equation_id"), F.col("certainty").isin(*STATED).alias("stated"))
    e = kb.equation.where("lifecycle_status = 'ACTIVE'").select(F.col("knowledge_id").alias("equation_id"), "expression").join(k, "equation_id")
    e = e.join(seen.withColumn("seen", F.lit(True)), "equation_id", "left").join(clash.union(against).distinct().withColumn("clash", F.lit(True)), "equation_id", "left")
    return e.select("equation_id", "expression", "stated", F.when(F.col("seen").isNull(), "NO_EVIDENCE").when(F.col("clash"), "CONFLICT").otherwise("USABLE").alias("state"))


def forms(stated: DataFrame) -> DataFrame:
    """(equation_id, statement, output, inputs, formula, rearranged, stated) of formulas (equation_id, formula, stated): each written for every quantity that it can be undone for; formulas without a quantity have none."""
    ship(stated.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for equation_id, formula, by_source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name, tree = formulas.parse(formula)
                needs = formulas.symbols_of(name, tree)[1:]
                if needs:
                    out.append((equation_id, formula, name, needs, formula, False, by_source))
                for wanted in needs:
                    try:
                        other = formulas.isolated(name, tree, wanted)
                    except formulas.FormulaError:
                        continue
                    out.append((equation_id, formula, wanted, formulas.symbols_of(wanted, other)[1:], formulas.written(wanted, other), True, by_source))
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_()]
            names = ["equation_id", "statement", "output", "inputs", "formula", "rearranged", "stated"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return stated.select("equation_id", "formula", "stated").mapInArrow(run, "equation_id string, statement string, output string, inputs array<string>, formula string, rearranged boolean, stated boolean")


def costs(found: DataFrame, known: DataFrame) -> DataFrame:
    """(problem_id, symbol, cost): the fewest equations by which each quantity can be had, those of its inputs each counted, from known (problem_id, symbol); found: see forms.

    Costs relax until a round lowers none, so circles end by themselves; a round tries only the equations of a quantity
    whose cost fell in the one before. Rounds are as many as the longest cheapest chain.
    """
    each = written(found.select("formula", "equation_id", "output", F.size("inputs").alias("n"), F.explode("inputs").alias("symbol")), "inputs")
    now = written(known.select("problem_id", "symbol").distinct().withColumn("cost", F.lit(0).cast("long")), "costs")
    fell = now
    while True:
        total = _touched(each, fell).join(each, ["equation_id", "formula", "output", "n"]).join(now, ["problem_id", "symbol"]).groupBy("problem_id", "equation_id", "formula", "output", "n").agg(F.count("*").alias("have"), F.sum("cost").alias("cost")).where("have = n")
        came = total.groupBy("problem_id", F.col("output").alias("symbol")).agg((F.min("cost") + 1).alias("cost"), F.lit(1).alias("new"))
        new = now.withColumn("new", F.lit(0)).unionByName(came).groupBy("problem_id", "symbol").agg(F.min("cost").alias("cost"), F.min_by("new", F.struct("cost", "new")).alias("new"))
        new = written(new, "costs")
        forget(now)
        now, fell = new.drop("new"), new.where("new = 1")
        now._written = new._written
        if fell.isEmpty():
            return now


def _touched(each: DataFrame, fell: DataFrame) -> DataFrame:
    """(problem_id, equation_id, formula, output, n): the equations, each once, that use a quantity whose cost fell."""
    return each.join(fell.select("problem_id", "symbol"), "symbol").select("problem_id", "equation_id", "formula", "output", "n").distinct()


_STEP = "struct<equation_id: string, statement: string, output: string, inputs: array<string>, formula: string, rearranged: boolean, stated: boolean>"


def _merged(rows: DataFrame) -> DataFrame:
    """(problem_id, far, symbol, steps) of rows (problem_id, far, step, plans): one plan for each input, joined in order where they don't clash, and the step itself at the end.

    Plans clash if they find a quantity in two ways or use a statement twice.
    """
    ship(rows.sparkSession)

    def joined(a: list[dict], b: list[dict]) -> list[dict] | None:
        out = list(a)
        have = {(x["equation_id"], x["formula"]) for x in a}
        outputs, statements = {x["output"] for x in a}, {(x["equation_id"], x["statement"]) for x in a}
        for x in b:
            if (x["equation_id"], x["formula"]) in have:
                continue
            if x["output"] in outputs or (x["equation_id"], x["statement"]) in statements:
                return None
            out.append(x)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for b in batches:
            kind = kind or b.schema.field("step").type
            problems, fars, symbols, found = [], [], [], []
            for problem, far, step, plans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of = {p["symbol"]: p["plans"] for p in plans}
                partial: list[list[dict]] = [[]]
                for needed in step["inputs"]:
                    partial = [m for have in partial for option in of[needed] if (m := joined(have, option)) is not None][: 2 * KEEP]
                for have in partial:
                    if (m := joined(have, [step])) is not None and len(m) > len(have):
                        problems.append(problem)
                        fars.append(far)
                        symbols.append(step["output"])
                        found.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(problems, b.schema.field("problem_id").type), pa.array(fars, pa.int32()), pa.array(symbols, pa.string()), pa.array(found, pa.list_(kind))], ["problem_id", "far", "symbol", "steps"])

    kind = rows.schema["problem_id"].dataType.simpleString()
    return rows.select("problem_id", "far", "step", "plans").mapInArrow(run, f"problem_id {kind}, far int, symbol string, steps array<{_STEP}>")


def _rank() -> Column:
    """The order of plans: fewest steps, fewest that the source didn't state, fewest rearranged ones, then by number and text."""
    uncertain, turned = (F.size(F.filter("steps", f)) for f in (lambda s: ~s["stated"], lambda s: s["rearranged"]))
    number = F.transform("steps", lambda s: F.split_part(s["equation_id"], F.lit("-"), F.lit(2)).try_cast("long"))
    return F.struct(F.size("steps"), uncertain, turned, number, F.transform("steps", lambda s: s["formula"]))


def plans(found: DataFrame, known: DataFrame, targets: DataFrame) -> DataFrame:
    """(problem_id, place, steps): the KEEP best plans that give each problem's target (problem_id, symbol) from what it knows (problem_id, symbol); found: see forms.

    A plan's steps are in the order in which they can be applied, at most MAX_DEPTH deep; no quantity is found twice in
    it, and no statement is used twice. Only equations that lead from what is known to the target within that depth are
    looked at (see _between). The KEEP best plans of each quantity grow by one level a round; a round leaves out what
    lies too far behind the target for its plans to get there in the rounds that remain.
    """
    kind = "array<" + _STEP + ">"
    step = F.struct("equation_id", "statement", "output", "inputs", "formula", "rearranged", "stated").alias("step")
    # written with their numbers, so that these stay the same
    each = written(found.select(F.monotonically_increasing_id().alias("form"), step), "forms")
    wanted = written(targets.select("problem_id", "symbol").distinct(), "wanted")
    given = written(known.select("problem_id", "symbol").distinct(), "given")
    inputs = _between(each, wanted, given)
    leaves = given.select("problem_id", "symbol", F.array(F.array().cast(kind)).alias("plans"))
    now, before = None, None
    for left in range(MAX_DEPTH - 1, -1, -1):
        options = leaves if now is None else leaves.union(now.select("problem_id", "symbol", "plans"))
        ready = inputs.where(F.col("far") <= left).join(options, ["problem_id", "symbol"]).groupBy("problem_id", "far", "form").agg(F.collect_list(F.struct("symbol", "plans")).alias("plans"))
        ready = ready.join(each, "form").where("size(plans) = size(step.inputs)")
        made = _merged(ready).withColumn("rank", _rank()).distinct()
        best = made.withColumn("place", F.row_number().over(W.partitionBy("problem_id", "symbol").orderBy("rank"))).where(F.col("place") <= KEEP)
        new = written(best.groupBy("problem_id", "symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "steps"))), lambda x: x["steps"]).alias("plans"), F.first("far").alias("far")), "plans")
        # the same plans as a round before, of all that this round looks at: they stay so
        marks = {x[0]: x[1:] for x in new.groupBy("far").agg(F.count("*"), F.sum(F.xxhash64("problem_id", "symbol", "plans") % F.lit(1 << 40))).collect()}
        same = before is not None and marks == {f: m for f, m in before.items() if f <= left}
        forget(now)
        now, before = new, marks
        if same:
            break
    return now.join(wanted, ["problem_id", "symbol"], "left_semi").select("problem_id", F.posexplode("plans").alias("place", "steps"))


def _between(each: DataFrame, wanted: DataFrame, given: DataFrame) -> DataFrame:
    """(problem_id, far, form, symbol): the inputs of the equations (form, step) by which wanted quantities (problem_id, symbol) can be had from given ones in MAX_DEPTH levels, far the levels between an equation and the target.

    The search goes from both ends until it meets: back from the target through all that it may need, ahead from what is
    given through what it gives; the next level is made ahead unless more than _LEAN times as many equations wait there.
    Behind the place where they meet only equations count whose inputs can be had in the levels that remain, so none of
    the others is looked at.
    """
    key = ["problem_id", "symbol"]
    uses = written(each.select("form", F.col("step.output").alias("output"), F.size("step.inputs").alias("n"), F.explode("step.inputs").alias("symbol")), "uses")
    # all inputs must be given at first, so an equation waits for the one that the fewest problems know
    n_known = given.groupBy("symbol").agg(F.count("*").alias("k"))
    waits = uses.join(n_known, "symbol").groupBy("form", "output", "n").agg(F.count("*").alias("m"), F.min_by("symbol", F.struct("k", "symbol")).alias("symbol")).where("m = n").drop("m")
    waits = written(waits, "waits")
    unknown = lambda df, *tables: reduce(lambda x, t: x.join(t, key, "left_anti"), tables, df)
    front = written(unknown(wanted, given), "front")
    needed, back = front, []
    had, fresh, ahead = given, given, []
    outputs = each.select(F.col("step.output").alias("symbol"))
    n_back, n_ahead = _meetings(front, outputs), _meetings(fresh, waits)
    while len(back) + len(ahead) < MAX_DEPTH:
        if n_ahead > _LEAN * n_back:
            far = len(back)
            back.append(written(front.withColumnRenamed("symbol", "output").join(uses, "output").select("problem_id", F.lit(far).alias("far"), "form", "symbol"), "back"))
            front = written(unknown(back[-1].select(*key).distinct(), given, needed), "front")
            needed = needed.union(front)
            n_back = _meetings(front, outputs)
        else:
            met = fresh.join(waits, "symbol").select("problem_id", "form", "output").distinct()
            met = met.join(given.withColumnRenamed("symbol", "output"), ["problem_id", "output"], "left_anti")
            full = met.join(uses.drop("output"), "form").join(had, key).groupBy("problem_id", "form", "output", "n").agg(F.count("*").alias("m")).where("m = n")
            ahead.append(written(full.select("problem_id", "form", F.col("output").alias("symbol")), "ahead"))
            fresh = written(unknown(ahead[-1].select(*key).distinct(), had), "fresh")
            had, waits = had.union(fresh), uses
            n_ahead = _meetings(fresh, waits)
    if back:
        # of the last equations, those that need what can't be had in the levels that remain
        lost = back[-1].join(unknown(front, had), key, "left_semi").select("problem_id", "form").distinct()
        back[-1] = back[-1].join(lost, ["problem_id", "form"], "left_anti").select("problem_id", "far", "form", "symbol")
    for far in range(len(back), MAX_DEPTH):
        ways = reduce(DataFrame.union, ahead[: MAX_DEPTH - far]).join(front, key).select("problem_id", "form")
        back.append(written(ways.join(uses, "form").select("problem_id", F.lit(far).alias("far"), "form", "symbol"), "back"))
        front = written(unknown(back[-1].select(*key).distinct(), given, needed), "front")
        needed = needed.union(front)
    return written(reduce(DataFrame.unionByName, back), "inputs")


def _meetings(rows: DataFrame, others: DataFrame) -> int:
    """How many pairs of rows and others have the same symbol, without making them."""
    n = lambda df, name: df.groupBy("symbol").agg(F.count("*").alias(name))
    return int(n(rows, "a").join(n(others, "b"), "symbol").agg(F.coalesce(F.sum(F.col("a").cast("decimal(38,0)") * F.col("b")), F.lit(0))).first()[0])


def _values(rows: DataFrame) -> DataFrame:
    """rows (problem_id, place, steps, bound) with value, dimension and problem of each plan's last step; bound: map of symbol to struct(value, dimension)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for formulas_of, given in zip(b.column("formulas").to_pylist(), b.column("bound").to_pylist(), strict=True):
                try:
                    bound = {k: (Fraction(v["value"]), tuple(v["dimension"] or calculation.NONE)) for k, v in given or ()}
                    for text in formulas_of:
                        name, tree = formulas.parse(text)
                        bound[name] = last = calculation.value_of(tree, bound)
                    out.append((str(last[0]), list(last[1]), None))
                except (calculation.NoValue, formulas.FormulaError, ValueError, ZeroDivisionError) as e:
                    out.append((None, None, str(e)[:80]))
            yield pa.RecordBatch.from_arrays([b.column("problem_id"), b.column("place"), *(pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.list_(pa.int32()), pa.string())))], ["problem_id", "place", "value", "dimension", "problem"])

    kind = rows.schema["problem_id"].dataType.simpleString()
    return rows.select("problem_id", "place", "formulas", "bound").mapInArrow(run, f"problem_id {kind}, place int, value string, dimension array<int>, problem string")


def worked(routes: DataFrame) -> DataFrame:
    """(problem_id, number, symbol, formula, inputs, value, dimension) of each step of routes (problem_id, formulas, bound), inputs as struct(symbol, value, dimension, from_step); what has no value ends a route."""
    ship(routes.sparkSession)
    given = pa.list_(pa.struct([("symbol", pa.string()), ("value", pa.string()), ("dimension", pa.list_(pa.int32())), ("from_step", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for problem, texts, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bound = {k: (Fraction(v["value"]), tuple(v["dimension"] or calculation.NONE)) for k, v in known or ()}
                made: dict[str, int] = {}
                for number, text in enumerate(texts, 1):
                    name, tree = formulas.parse(text)
                    try:
                        value, dimension = calculation.value_of(tree, bound)
                    except calculation.NoValue:
                        break
                    inputs = [{"symbol": s, "value": str(bound[s][0]), "dimension": list(bound[s][1]), "from_step": made.get(s)} for s in formulas.symbols(text)[1:]]
                    bound[name], made[name] = (value, dimension), number
                    out.append((problem, number, name, text, inputs, str(value), list(dimension)))
            kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), given, pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["problem_id", "number", "symbol", "formula", "inputs", "value", "dimension"])

    kind = routes.schema["problem_id"].dataType.simpleString()
    return routes.select("problem_id", "formulas", "bound").mapInArrow(run, f"problem_id {kind}, number int, symbol string, formula string, inputs array<struct<symbol: string, value: string, dimension: array<int>, from_step: int>>, value string, dimension array<int>")


def answers(found: DataFrame, known: DataFrame, targets: DataFrame) -> DataFrame:
    """(problem_id, symbol, status, value, dimension, tier, steps, n_agreeing, problem) for each problem's target.

    known: (problem_id, symbol, value, dimension). A value that is given is the answer. Plans of stated equations come
    before others (`tier`); every plan up to EXTRA_STEPS longer than the shortest is calculated, and if they differ the
    answer is CONFLICTING and none is chosen. Without a plan or a value it is CANNOT_DETERMINE, with the problem.
    """
    targets = written(targets.select("problem_id", "symbol").distinct(), "targets")
    given = targets.join(known, ["problem_id", "symbol"])
    asked = targets.join(known.select("problem_id", "symbol"), ["problem_id", "symbol"], "left_anti")
    stated = plans(found.where("stated"), known, asked).withColumn("tier", F.lit("stated"))
    rest = asked.join(stated.select("problem_id").distinct(), "problem_id", "left_anti")
    # where the source stated every equation, a second search would find no more
    both = stated if found.where("not stated").isEmpty() else stated.union(plans(found, known, rest).withColumn("tier", F.lit("mixed")))
    both = written(both, "routes")
    n, shortest = F.size("steps"), F.min(F.size("steps")).over(W.partitionBy("problem_id"))
    both = both.withColumn("shortest", shortest).withColumn("longest", F.when(F.col("tier") == "stated", F.col("shortest") + EXTRA_STEPS).otherwise(F.greatest("shortest", F.least(F.col("shortest") + EXTRA_STEPS, F.lit(MIXED_STEPS)))))
    tried = both.where(n <= F.col("longest")).withColumn("k", F.row_number().over(W.partitionBy("problem_id").orderBy("place"))).where(F.col("k") <= MAX_PLANS)
    bound = known.groupBy("problem_id").agg(F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("value", "dimension")))).alias("bound"))
    routes = tried.select("problem_id", "place", "tier", F.transform("steps", lambda s: s["formula"]).alias("formulas")).join(bound, "problem_id")
    done = written(_values(routes).join(routes.drop("bound"), ["problem_id", "place"]), "values")
    right = F.col("problem").isNull()
    result = F.struct("value", "dimension")
    per = done.groupBy("problem_id").agg(F.countDistinct(F.when(right, result)).alias("n_values"), F.sum(right.cast("long")).alias("n_right"), F.min_by("value", F.when(right, F.col("place"))).alias("value"), F.min_by("dimension", F.when(right, F.col("place"))).alias("dimension"), F.min_by("formulas", F.when(right, F.col("place"))).alias("steps"), F.first("tier").alias("tier"), F.min_by("problem", F.when(~right, F.col("place"))).alias("problem"))
    state = F.when(F.col("n_values") == 1, "CALCULATED").when(F.col("n_values") > 1, "CONFLICTING").otherwise("CANNOT_DETERMINE")
    one = lambda c: F.when(F.col("n_values") == 1, F.col(c)).alias(c)
    found_rows = asked.join(per, "problem_id", "left").select("problem_id", "symbol", state.alias("status"), one("value"), one("dimension"), "tier", one("steps"), F.when(F.col("n_values") == 1, F.col("n_right") - 1).otherwise(F.lit(0)).cast("long").alias("n_agreeing"), F.when(F.coalesce("n_values", F.lit(0)) == 0, F.coalesce("problem", F.lit("NO_ROUTE"))).alias("problem"))
    none = F.lit(None).cast("string")
    return found_rows.union(given.select("problem_id", "symbol", F.lit("CALCULATED"), "value", "dimension", F.lit("given"), F.array().cast("array<string>"), F.lit(0).cast("long"), none))


def missing(found: DataFrame, known: DataFrame, targets: DataFrame) -> DataFrame:
    """(problem_id, symbol, place, formula, equation_id, needs): the first OPTIONS ways to write each target, with what is not known, fewest first."""
    # merged, since Spark takes both for much smaller than they are and would broadcast them
    ways = targets.select("problem_id", "symbol").distinct().hint("merge").join(found.select("equation_id", "formula", "output", "inputs").distinct(), F.col("symbol") == F.col("output"))
    have = known.groupBy("problem_id").agg(F.collect_set("symbol").alias("have")).hint("merge")
    needs = F.filter("inputs", lambda x: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), x))
    ways = ways.join(have, "problem_id", "left").withColumn("needs", needs)
    order = W.partitionBy("problem_id", "symbol").orderBy(F.size("needs"), counter("equation_id"), "equation_id", "formula")
    return ways.withColumn("place", F.row_number().over(order)).where(F.col("place") <= OPTIONS).select("problem_id", "symbol", "place", "formula", "equation_id", "needs")


def spellings(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(problem_id, symbol, spelled) of quantities (problem_id, symbol) that no equation has as they are written, while exactly one has them in other capitals. Nothing is changed."""
    names = found.select(F.explode(F.concat(F.array("output"), "inputs")).alias("spelled")).distinct()
    others = asked.select("problem_id", "symbol").distinct().join(names, F.lower("symbol") == F.lower("spelled")).where("symbol <> spelled")
    return others.groupBy("problem_id", "symbol").agg(F.count("*").alias("n"), F.min("spelled").alias("spelled")).where("n = 1").select("problem_id", "symbol", "spelled")


__all__ = ["answers", "costs", "forms", "heads", "library", "missing", "plans", "products", "readings", "spelled", "spellings", "worked"]
