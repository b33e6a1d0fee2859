"""Exact duplicates, possible duplicates and contradictions of statements; nothing is compared but normalised texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.ids import counter, pair
from quillspark.operators.graph import connected_components
from quillspark.storage import written

NUMBER = r"^([+\-−]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))([.,;:]?)$"

#: Statements of a block, parts that the texts of a name are dealt into, tasks that pair them.
_BLOCK, _DEALT, _TASKS = 500, 8, 120


def contradicts(first: Column, second: Column) -> Column:
    """Whether two normalised statements differ in numbers alone: as many tokens, at least one difference, and each of them between two numbers of different value with the same mark behind."""
    value = lambda t: F.regexp_replace(F.regexp_extract(t, NUMBER, 1), "−", "-").try_cast("decimal(38,18)")
    pairs = F.filter(F.zip_with(F.split(first, " "), F.split(second, " "), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~p["a"].eqNullSafe(p["b"]))

    def numeric(p: Column) -> Column:
        both = p["a"].rlike(NUMBER) & p["b"].rlike(NUMBER)
        return F.coalesce(both & (F.regexp_extract(p["a"], NUMBER, 2) == F.regexp_extract(p["b"], NUMBER, 2)) & (value(p["a"]) != value(p["b"])), F.lit(False))

    return (F.size(F.split(first, " ")) == F.size(F.split(second, " "))) & (F.size(pairs) > 0) & F.forall(pairs, numeric)


def exact_groups(items: DataFrame) -> DataFrame:
    """items (id, knowledge_type, norm, location, alias) with canonical_id.

    Equal types and normalised statements are the same; an equation also needs a shared location, a definition a shared
    location or alias. There, rows that share a key are linked, and groups are what links connect within the bucket.
    """
    rest = items.where("knowledge_type not in ('EQUATION', 'DEFINITION')").select("id", "knowledge_type", "norm")
    first = rest.groupBy("knowledge_type", "norm").agg(F.min(F.struct(counter("id").alias("n"), "id")).alias("m"))
    plain = rest.join(first, ["knowledge_type", "norm"]).select("id", F.col("m.id").alias("canonical_id"))
    keyed = items.where("knowledge_type in ('EQUATION', 'DEFINITION')")
    by_place = keyed.where("location is not null").select("id", "knowledge_type", "norm", F.concat(F.lit("at "), "location").alias("key"))
    by_name = keyed.where("knowledge_type = 'DEFINITION' and alias is not null").select("id", "knowledge_type", "norm", F.concat(F.lit("as "), "alias").alias("key"))
    links = by_place.union(by_name)
    hub = links.groupBy("knowledge_type", "norm", "key").agg(F.min("id").alias("hub"))
    star = links.join(hub, ["knowledge_type", "norm", "key"]).where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    root = connected_components(star)
    canonical = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("first.id"))
    own = keyed.select("id").distinct().join(root, F.col("id") == F.col("node"), "left").select("id", "root")
    first = own.where("root is not null").groupBy("root").agg(F.min(F.struct(counter("id").alias("n"), "id")).alias("first"))
    return plain.union(own.join(first, "root", "left").select("id", canonical.alias("canonical_id"))).distinct()


def masked_numbers(norm: Column) -> Column:
    """A normalised statement with every number as #, the mark behind it kept: statements that contradict one another have this in common."""
    return F.array_join(F.transform(F.split(norm, " "), lambda t: F.when(t.rlike(NUMBER), F.concat(F.lit("#"), F.regexp_extract(t, NUMBER, 2))).otherwise(t)), " ")


def _rows(statements: DataFrame, name: str) -> DataFrame:
    """statements with their mask, and the tokens that it hides with their values; a token that is the mask itself has none. Equal masks have as many of these, in the same order."""
    value = lambda t: F.when(t.rlike(NUMBER), F.regexp_replace(F.regexp_extract(t, NUMBER, 1), "−", "-").try_cast("decimal(38,18)"))
    hidden = F.filter(F.split("norm", " "), lambda t: t.rlike(NUMBER) | t.rlike(r"^#[.,;:]?$"))
    numbers = F.transform(hidden, lambda t: F.struct(t.alias("token"), value(t).alias("value")))
    return written(statements.select("id", "knowledge_type", F.col(name).alias("name"), "norm", counter("id").alias("n"), masked_numbers(F.col("norm")).alias("mask"), numbers.alias("numbers")), "statements")


def _other_values(a: str, b: str) -> Column:
    """Whether statements with equal masks and different texts contradict one another: each token that differs is a number of another value. The same as contradicts, without parting the texts for each pair."""
    return F.forall(F.zip_with(f"{a}.numbers", f"{b}.numbers", lambda x, y: (x["token"] == y["token"]) | F.coalesce(x["value"] != y["value"], F.lit(False))), lambda x: x)


def compared(statements: DataFrame, name: str) -> DataFrame:
    """Pairs of statements (id, knowledge_type, norm, name) of the same type under the same name with different texts: CONTRADICTORY or POSSIBLE_DUPLICATE, each pair once, by number.

    Two texts are compared once, however many statements have them: the numbers of a text stand in blocks of bounded
    size, and pairs of blocks of different texts are written out at the end. The texts of a name are dealt out, since a
    few names may make nearly all pairs.
    """
    key = ["knowledge_type", "name"]
    rows = _rows(statements, name).where("n is not null and norm is not null")
    place = F.row_number().over(W.partitionBy(*key, "norm").orderBy("n", "id"))
    items = F.collect_list(F.struct("n", "id")).alias("items")
    blocks = rows.withColumn("block", F.floor((place - 1) / _BLOCK)).groupBy(*key, "norm", "block").agg(F.first("mask").alias("mask"), F.first("numbers").alias("numbers"), items)
    blocks = written(blocks, "blocks")
    a = blocks.withColumn("dealt", F.pmod(F.xxhash64("norm", "block"), F.lit(_DEALT)).cast("int")).repartition(_TASKS, *key, "dealt").alias("a")
    b = blocks.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1)))).repartition(_TASKS, *key, "dealt").alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "dealt")))
    outcome = F.when((F.col("a.mask") == F.col("b.mask")) & _other_values("a", "b"), "CONTRADICTORY").otherwise("POSSIBLE_DUPLICATE")
    met = a.hint("merge").join(b, same & (F.col("a.norm") < F.col("b.norm"))).select(outcome.alias("outcome"), F.col("a.items").alias("x"), F.col("b.items").alias("y"))
    pairs = met.select("outcome", F.explode("x").alias("x"), "y").select("outcome", "x", F.explode("y").alias("y")).where("x.n <> y.n")
    first = F.col("x.n") < F.col("y.n")
    return pairs.select(F.when(first, F.col("x.id")).otherwise(F.col("y.id")).alias("canonical_id"), F.when(first, F.col("y.id")).otherwise(F.col("x.id")).alias("other_id"), "outcome")


def contradictions(statements: DataFrame, name: str) -> DataFrame:
    """(claim_a_id, claim_b_id) of the contradictory pairs alone, by a join on type, name and masked text: no other pair is ever made."""
    rows = _rows(statements, name)
    a, b = rows.alias("a"), rows.alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("knowledge_type", "name", "mask")))
    return a.join(b, same & (F.col("a.n") < F.col("b.n")) & (F.col("a.norm") != F.col("b.norm"))).where(_other_values("a", "b")).select(F.col("a.id").alias("claim_a_id"), F.col("b.id").alias("claim_b_id"))


def decisions(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, decision, target) of items against exact_groups: LINKED to the canonical object of the group, or CREATED, which then is compared with its peers."""
    return items.select("id").distinct().join(groups, "id").select("id", F.when(F.col("id") == F.col("canonical_id"), "CREATED").otherwise("LINKED").alias("decision"), F.when(F.col("id") != F.col("canonical_id"), F.col("canonical_id")).alias("target"))


def statement_peers(items: DataFrame, groups: DataFrame) -> DataFrame:
    """(canonical_id, other_id): canonical objects with the same type and normalised statement in different groups, such as one equation stated at two places; each pair once, by number."""
    canonical = items.join(groups, "id").where("id = canonical_id").select("id", "knowledge_type", "norm").distinct()
    a, b = canonical.alias("a"), canonical.alias("b")
    same = (F.col("a.knowledge_type") == F.col("b.knowledge_type")) & (F.col("a.norm") == F.col("b.norm"))
    return a.join(b, same & (counter("a.id") < counter("b.id"))).select(F.col("a.id").alias("canonical_id"), F.col("b.id").alias("other_id"))


def unrecorded(pairs: DataFrame, recorded: DataFrame) -> DataFrame:
    """pairs (concept_a, concept_b) less those that are recorded (a, b) in either order."""
    lo, hi = pair(F.col("a"), F.col("b"))
    return pairs.join(recorded.select(lo.alias("concept_a"), hi.alias("concept_b")), ["concept_a", "concept_b"], "left_anti")
