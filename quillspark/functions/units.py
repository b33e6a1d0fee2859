"""SI units as a table made by rule: symbols with prefixes, a factor to coherent units and a dimension."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base units in order of the dimension vector, derived units with their exponents, prefixes.
BASE = ("m", "kg", "s", "A", "K", "mol", "cd")
DERIVED = {
    "Hz": (0, 0, -1, 0, 0, 0, 0), "N": (1, 1, -2, 0, 0, 0, 0), "Pa": (-1, 1, -2, 0, 0, 0, 0), "J": (2, 1, -2, 0, 0, 0, 0), "W": (2, 1, -3, 0, 0, 0, 0), "C": (0, 0, 1, 1, 0, 0, 0),
    "V": (2, 1, -3, -1, 0, 0, 0), "F": (-2, -1, 4, 2, 0, 0, 0), "Ω": (2, 1, -3, -2, 0, 0, 0), "S": (-2, -1, 3, 2, 0, 0, 0), "Wb": (2, 1, -2, -1, 0, 0, 0), "T": (0, 1, -2, -1, 0, 0, 0), "H": (2, 1, -2, -2, 0, 0, 0),
}
PREFIXES = {"p": -12, "n": -9, "μ": -6, "µ": -6, "m": -3, "c": -2, "k": 3, "M": 6, "G": 9}


def table(spark: SparkSession) -> DataFrame:
    """(symbol, factor decimal, dimension array<int>) of every unit with and without a prefix; grams stand for kilograms with prefixes."""
    dims = {b: tuple(int(i == j) for j in range(7)) for i, b in enumerate(BASE)} | DERIVED
    dims["\u2126"] = dims["Ω"]  # the sign for ohm has a character of its own besides the letter
    rows = [(s, Decimal(1), list(d)) for s, d in dims.items()] + [("g", Decimal("0.001"), list(dims["kg"]))]
    rows += [(p + s, Decimal(10) ** e, list(d)) for s, d in dims.items() if s not in ("kg", "K") for p, e in PREFIXES.items()]
    rows += [(p + "g", Decimal(10) ** (e - 3), list(dims["kg"])) for p, e in PREFIXES.items() if p != "k"]
    return spark.createDataFrame(rows, "symbol string, factor decimal(38,18), dimension array<int>").dropDuplicates(["symbol"])


def converted(values: DataFrame, value: str, unit: str) -> DataFrame:
    """values with `coherent`, the value in coherent units, and `dimension`; null for unknown units. Symbols are case-sensitive."""
    t = table(values.sparkSession)
    out = values.join(F.broadcast(t), F.col(unit) == F.col("symbol"), "left")
    return out.select(*values.columns, (F.col(value).cast("decimal(38,18)") * F.col("factor")).cast("decimal(38,18)").alias("coherent"), "dimension")


def display(value: Column) -> Column:
    """At most six significant digits, half to even, marked = where exact and ≈ where not; positional from 1e-4 below 1e6."""
    v = value.cast("decimal(38,18)")
    size = F.abs(v.cast("double"))
    digits = F.when(size == 0, 0).otherwise(F.floor(F.log10(size)).cast("int"))
    shown = F.coalesce(*(F.when(digits == d, F.bround(v, 5 - d).cast("decimal(38,18)")) for d in range(-18, 20)), v)
    plain = F.regexp_replace(F.regexp_replace(shown.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.struct(plain.alias("text"), (shown == v).alias("exact"))
