"""Queries over stored equations: reading them, what can be had from them, and by which plans. Part n's law gives S_n by S_(n/2) and one of seven K's; a problem is a supplier who knows S of its number and all K's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.adapter import knowledge_base, with_tables
from quillspark.functions import notation
from quillspark.operators import solving as S
from quillspark.plans.catalog import query, simple
from quillspark.storage import written

_S, _K = "'S' || cast({} as varchar)", "'K' || cast({} as varchar)"
_STATED = f"case n % 5 when 0 then {_S.format('n')} || ' = ' || {_S.format('m')} || ' / ' || {_K.format('q')} when 1 then {_S.format('n')} || ' = ' || {_S.format('m')} || ' + 2' when 2 then {_S.format('n')} || ' = ' || {_S.format('m')} || ' * ' || {_K.format('q')} when 3 then {_S.format('m')} || ' = ' || {_S.format('n')} || '^2' end"
_TURNED = f"case n % 5 when 0 then {_S.format('m')} || ' = ' || {_S.format('n')} || ' * ' || {_K.format('q')} when 1 then {_S.format('m')} || ' = ' || {_S.format('n')} || ' - 2' when 2 then {_S.format('m')} || ' = ' || {_S.format('n')} || ' / ' || {_K.format('q')} end"


def _atoms(kb) -> DataFrame:
    """The quantities that stand alone on the left of a law, and those that stored variables name."""
    s = kb.law.select(F.explode(F.array("n", "m")).alias("k")).select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("atom"))
    return S.heads(kb.law).union(s).union(kb.law.select(F.concat(F.lit("K"), F.col("q").cast("string")))).distinct()


def _readings(kb) -> DataFrame:
    return S.readings(kb.law.select(F.col("id").alias("equation_id"), "expression"), _atoms(kb))


def _forms(kb) -> DataFrame:
    return written(S.forms(_readings(kb).where("formula is not null").select("equation_id", "formula", F.lit(True).alias("stated"))), "forms")


def _problems(kb, spark, d) -> tuple[DataFrame, DataFrame]:
    """A problem for each part whose number, by eight, is a supplier's: what the supplier knows, with values, and S of the part."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("s"))
    asked = kb.law.select("n", F.floor(F.col("n") / 8).alias("s")).join(s.where("s > 0"), "s").select(F.col("n").alias("problem_id"), "s")
    own = asked.select("problem_id", F.concat(F.lit("S"), F.col("s").cast("string")).alias("symbol"), F.col("s").cast("string").alias("value"))
    constants = asked.select("problem_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("q")).select("problem_id", F.concat(F.lit("K"), F.col("q").cast("string")), (F.col("q") + 1).cast("string"))
    known = own.union(constants).withColumn("dimension", F.lit(None).cast("array<int>"))
    return written(known, "known"), asked.select("problem_id", F.concat(F.lit("S"), F.col("problem_id").cast("string")).alias("symbol"))


simple("sv1_plain_equations", lambda kb: notation.plain(kb.law.select("id", "expression"), "expression").select("id", "plain_text", "problem", "detail"), ("law",), (
    f"select id, case n % 5 when 0 then {_S.format('n')} || ' = ((' || {_S.format('m')} || ')/(' || {_K.format('q')} || '))' when 1 then {_S.format('n')} || ' = ' || {_S.format('m')} || ' + 2 W' when 2 then {_S.format('n')} || ' = ' || {_S.format('m')} || {_K.format('q')} when 3 then {_S.format('n')} || '^2 = ' || {_S.format('m')} end as plain_text, case when n % 5 = 4 then 'NOT_ARITHMETIC' end as problem, case when n % 5 = 4 then 'an integral' end as detail from kb_law"))
simple("sv2_read_equations", lambda kb: _readings(kb).select("equation_id", "formula", F.array_join("notes", "; ").alias("notes"), "problem"), ("law",), (
    f"select id as equation_id, {_STATED} as formula, case n % 5 when 1 then 'unit W' when 2 then {_S.format('m')} || {_K.format('q')} || ' as ' || {_S.format('m')} || '*' || {_K.format('q')} when 4 then null else '' end as notes, case when n % 5 = 4 then 'NOT_ARITHMETIC' end as problem from kb_law"))
simple("t17_readable_equations", lambda kb: kb.law.select("id", notation.readable(F.col("expression")).alias("line")), ("law",), (
    "select id, 'S_' || cast(n as varchar) || case n % 5 when 0 then ' = S_' || cast(m as varchar) || '/K_' || cast(q as varchar) when 1 then ' = S_' || cast(m as varchar) || ' + 2 W' when 2 then ' = S_' || cast(m as varchar) || 'K_' || cast(q as varchar) when 3 then '² = S_' || cast(m as varchar) else ' = ∫ S_' || cast(m as varchar) || ' dt' end as line from kb_law"))


_WALK = "steps as (select m as a, n as b from kb_law where n % 5 in (0, 1, 2) union all select n, m from kb_law where n % 5 in (0, 1, 2, 3)), walk as (select r_regionkey as problem_id, cast(r_regionkey + 1 as bigint) as here, cast(-1 as bigint) as came, cast(0 as bigint) as cost from region union all select w.problem_id, s.b, w.here, w.cost + 1 from walk w join steps s on s.a = w.here where s.b <> w.came)"


@query("sv5_costs", flat=True, sql=f"{with_tables('law')}, {_WALK} select problem_id, {_S.format('here')} as symbol, cost from walk union all select r_regionkey, {_K.format('k')}, 0 from region, (select distinct q as k from kb_law) x")
def _costs(spark, d):
    kb = knowledge_base(spark, d)
    regions = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("problem_id"))
    constants = F.array(*(F.concat(F.lit("K"), F.lit(q)) for q in range(7)))
    known = regions.select("problem_id", F.explode(F.concat(F.array(F.concat(F.lit("S"), (F.col("problem_id") + 1).cast("string"))), constants)).alias("symbol"))
    return S.costs(_forms(kb), known)


#: From part n/8 to part n by three laws, as numbers over and under a line.
_THREE = (
    "asked as (select a.n as problem_id, s_suppkey as s, c.n as n1, c.q as q1, b.n as n2, b.q as q2, a.n as n3, a.q as q3 from kb_law a join kb_law b on b.n = a.m join kb_law c on c.n = b.m join supplier on s_suppkey = c.m where c.m > 0),"
    " found as (select * from asked where n1 % 5 < 3 and n2 % 5 < 3 and n3 % 5 < 3)"
)
_LAW = "'S{n}' || cast({k} as varchar) || ' = S' || cast({m} as varchar) || case {k} % 5 when 0 then ' / K' || cast({q} as varchar) when 1 then ' + 2' else ' * K' || cast({q} as varchar) end"
_CHAIN = " || '; ' || ".join(_LAW.format(n="", k=f"n{i}", m=m, q=f"q{i}") for i, m in ((1, "s"), (2, "n1"), (3, "n2")))


@query("sv6_plans", flat=True, sql=f"{with_tables('law')}, {_THREE} select problem_id, 0 as place, {_CHAIN} as steps from found")
def _plans(spark, d):
    kb = knowledge_base(spark, d)
    known, targets = _problems(kb, spark, d)
    found = S.plans(_forms(kb), known, targets)
    return found.select("problem_id", "place", F.array_join(F.transform("steps", lambda s: s["formula"]), "; ").alias("steps"))


def _after(over: str, under: str, i: int) -> tuple[str, str]:
    """Numbers over and under the line after law i of a chain."""
    return (f"(case n{i} % 5 when 0 then {over} when 1 then {over} + 2 * {under} else {over} * (q{i} + 1) end)", f"(case n{i} % 5 when 0 then {under} * (q{i} + 1) else {under} end)")


_OVER, _UNDER = "cast(s as bigint)", "cast(1 as bigint)"
for _i in (1, 2, 3):
    _OVER, _UNDER = _after(_OVER, _UNDER, _i)


@query("sv7_answers", flat=True, sql=f"{with_tables('law')}, {_THREE}, lines as (select problem_id, {_OVER} as over, {_UNDER} as under from found) select a.problem_id, case when l.over is null then 'CANNOT_DETERMINE' else 'CALCULATED' end as status, case when l.over % l.under = 0 then cast(l.over // l.under as varchar) else cast(l.over // gcd(l.over, l.under) as varchar) || '/' || cast(l.under // gcd(l.over, l.under) as varchar) end as value, case when l.over is null then 'NO_ROUTE' end as problem from asked a left join lines l on l.problem_id = a.problem_id")
def _answers(spark, d):
    kb = knowledge_base(spark, d)
    known, targets = _problems(kb, spark, d)
    return S.answers(_forms(kb), known, targets).select("problem_id", "status", "value", "problem")


_WAYS = f"select n as s, n, formula, other from (select n, m, n % 5 as t, {_STATED} as formula, {_S.format('m')} as other from kb_law) x where t in (0, 1, 2) union all select m, n, case when t = 3 then stated else turned end, {_S.format('n')} from (select n, m, n % 5 as t, {_STATED} as stated, {_TURNED} as turned from kb_law) y where t < 4"


@query("sv8_missing", flat=True, sql=f"{with_tables('law')}, ways as ({_WAYS}) select s_suppkey as problem_id, row_number() over (partition by s_suppkey order by n, formula) as place, formula, other as needs from supplier join ways on s = s_suppkey qualify place <= {S.OPTIONS}")
def _missing(spark, d):
    kb = knowledge_base(spark, d)
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("problem_id"))
    known = s.select("problem_id", F.explode(F.array(*(F.concat(F.lit("K"), F.lit(q)) for q in range(7)))).alias("symbol"))
    found = S.missing(_forms(kb), known, s.select("problem_id", F.concat(F.lit("S"), F.col("problem_id").cast("string")).alias("symbol")))
    return found.select("problem_id", "place", "formula", F.array_join("needs", ",").alias("needs"))
