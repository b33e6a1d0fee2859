"""Printed equations as plain arithmetic, or the reason why they are none, as column expressions.

Typeset fractions, powers, subscripts and Greek letters are rewritten; what needs more than + - * / and whole powers is
named as a reason. A second function shows typeset text as a readable line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters by command, commands that no arithmetic has, units that may follow a result, names of functions, differentials.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "varrho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
NOT_ARITHMETIC = {
    "int": "an integral", "oint": "an integral", "sum": "a sum", "prod": "a product over a range", "partial": "a derivative", "nabla": "a derivative", "lim": "a limit", "sqrt": "a root", "begin": "a matrix or aligned block", "end": "a matrix or aligned block", "sin": "a trigonometric function", "cos": "a trigonometric function", "tan": "a trigonometric function", "log": "a logarithm", "ln": "a logarithm", "exp": "an exponential",
    "infty": "infinity", "mathcal": "a script letter", "hat": "an accent", "bar": "an accent", "vec": "a vector", "dot": "a time derivative", "ddot": "a time derivative", "text": "words inside the equation", "overline": "an accent", "underline": "an accent",
}
UNITS = ("V", "A", "W", "F", "H", "J", "C", "S", "s", "Hz", "Wb", "T", "\u03a9", "\u2126", "volt", "volts", "Volt", "Volts", "amp", "amps", "Amp", "Amps", "ampere", "amperes", "ohm", "ohms", "Ohm", "Ohms", "watt", "watts", "Watt", "Watts", "farad", "farads", "henry", "henries", "joule", "joules", "hertz", "Hertz", "second", "seconds", "coulomb", "coulombs")
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "sinh", "cosh", "tanh", "log", "ln", "exp", "sqrt", "arg", "Re", "Im", "mod", "min", "max", "abs")
DIFFERENTIALS = ("dt", "dx", "dy", "dz", "dr", "dθ", "dω", "dφ", "dq", "di", "dv", "dV", "dI", "dW", "dE", "dP", "dQ", "dT", "dw", "dp", "ds", "du")
SUPERSCRIPTS = {"²": "^2", "³": "^3", "¹": "^1"}
#: A symbol, a token, characters of plain arithmetic.
SYMBOL = r"\p{L}[\p{L}\p{N}_]*"
TOKEN = rf"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|{SYMBOL}|[+\-*/^()=]|\S"
ARITHMETIC = r"[\p{L}\p{N}_\s+\-*/^()=.]"
_FRACTION = r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}"


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def _commands(text: Column, names: dict[str, str]) -> Column:
    """Commands that are in `names` by what they stand for, others as they are."""
    table = F.create_map(*(F.lit(x) for k, v in names.items() for x in ("\\" + k, v)))
    parts = F.regexp_extract_all(text, F.lit(r"\\[A-Za-z]+|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(table, p), p)), "")


def _fractions(text: Column, by: str) -> Column:
    """Fractions rewritten from the innermost outwards: as often as there are fractions, so any nesting ends."""
    rounds = F.sequence(F.lit(0), F.size(F.split(text, "frac", -1)))
    return F.aggregate(rounds, text, lambda t, _: F.regexp_replace(t, _FRACTION, by))


def plain(rows: DataFrame, column: str) -> DataFrame:
    """rows with plain_text, the equation in `column` in plain signs, or else problem and detail. Null and blank texts are EMPTY."""
    s = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)\s+", " "))
    for mark, by in SUPERSCRIPTS.items():
        s = F.replace(s, F.lit(mark), F.lit(by))
    s = _replaced(
        s, ("[−–—‒]", "-"), ("[×·⋅∙•]", "*"), ("÷", "/"),
        (r"\\(?:left|right|big|Big|bigg|Bigg)\s*([()\[\]|.]?)", "$1"), (r"\\(?:,|;|:|!|quad|qquad|ldots|cdots)", " "), (r"\\\s", " "), (r"\\tag\s*\{[^{}]*\}", " "),
        (r"\\(?:mathrm|mathit|mathbf|operatorname|boldsymbol)\s*\{([^{}]*)\}", "$1"), (r"\\(?:cdot|times|ast)\b", "*"), (r"\\div\b", "/"),
        (r"_\s*\{\s*([A-Za-z0-9α-ωΑ-Ω]+)\s*\}", "$1"), (r"_\s*([A-Za-z0-9α-ωΑ-Ω])", "$1"), (r"\^\s*\{\s*(-?)\s*([0-9]+)\s*\}", "^$1$2"), (r"\^\s*(-?[0-9]+)", "^$1"),
    )
    # each step is a column of its own, so that none is computed where the next one uses it twice
    rows = rows.withColumn("_s", _fractions(s, "(($1)/($2))"))
    rows = rows.withColumn("_other", F.get(F.filter(F.regexp_extract_all("_s", F.lit(r"\\([A-Za-z]+)"), F.lit(1)), lambda c: ~c.isin(*GREEK)), F.lit(0)))
    rows = rows.withColumn("_done", F.translate(_commands(F.col("_s"), GREEK), "[]", "()"))
    rows = rows.withColumn("_odd", F.regexp_extract(F.regexp_replace("_done", ARITHMETIC, ""), r"^(?s)(.)", 1))
    named = F.create_map(*(F.lit(x) for pair in NOT_ARITHMETIC.items() for x in pair))
    why = lambda problem, detail="": F.struct(F.lit(problem).alias("problem"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    found = (
        F.when(F.col("_s") == "", why("EMPTY")).when(F.col("_other").isNotNull(), why("NOT_ARITHMETIC", F.coalesce(F.element_at(named, F.col("_other")), F.concat(F.lit("\\"), F.col("_other")))))
        .when(F.regexp_like("_done", F.lit(r"[{}\\]")), why("STRUCTURE")).when(F.col("_odd") != "", why("ODD_CHARACTER", F.col("_odd"))).when(~F.contains("_done", F.lit("=")), why("NO_EQUALS"))
    )
    rows = rows.withColumn("_found", found)
    done = [F.when(F.col("_found").isNull(), F.col("_done")).alias("plain_text"), F.col("_found.problem").alias("problem"), F.col("_found.detail").alias("detail")]
    return rows.select(*[c for c in rows.columns if c not in ("_s", "_other", "_done", "_odd", "_found")], *done)


def tokens(segment: Column) -> Column:
    return F.regexp_extract_all(segment, F.lit(TOKEN), F.lit(0))


def is_symbol(text: Column) -> Column:
    return F.regexp_like(text, F.lit(f"^{SYMBOL}$"))


#: Fixed values of a readable line: signs and letters by command, and raised digits.
SIGNS = {"cdot": "·", "times": "×", "int": "∫", "partial": "∂", "infty": "∞", "pm": "±", "approx": "≈", "propto": "∝", "Rightarrow": "⇒", "sqrt": "√"}
LETTERS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "psi": "ψ", "omega": "ω", "Delta": "Δ", "Omega": "Ω", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Theta": "Θ", "Lambda": "Λ"}
DIGITS, RAISED = "0123456789-+", "⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺"


def readable(text: Column) -> Column:
    """A typeset line as one reads it: raised powers, fractions with / and brackets only around more than one word, signs and Greek letters. A text that still holds typeset structure afterwards stays as it is."""
    power = r"\^\s*\{?\s*-?[0-9]+\s*\}?"
    s = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    parts = F.regexp_extract_all(s, F.lit(rf"{power}|[^^]+|\^"), F.lit(0))
    s = F.array_join(F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(f"^{power}$")), F.translate(F.regexp_replace(p, r"[\^{}\s]", ""), DIGITS, RAISED)).otherwise(p)), "")
    s = F.regexp_replace(s, r"_\s*\{([^{}]*)\}", "_$1")
    # each part of a fraction is bracketed, then brackets around a single word go; innermost fractions first
    once = lambda t, _: _replaced(t, (_FRACTION, "\u0001$1\u0002/\u0001$2\u0002"), ("\u0001\\s*([\\p{L}\\p{N}_.]+)\\s*\u0002", "$1"), ("\u0001\\s*([^\u0001\u0002]*?)\\s*\u0002", "($1)"))
    s = F.aggregate(F.sequence(F.lit(0), F.size(F.split(s, "frac", -1))), s, once)
    s = _replaced(s, (r"\\(?:left|right|big|Big)\s*", ""), (r"\\[,;:! ]", " "))
    s = F.regexp_replace(_commands(s, SIGNS | LETTERS), r"√\s*\{([^{}]*)\}", "√($1)")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(F.regexp_like(s, F.lit(r"[\\{}]")), text).otherwise(s)
