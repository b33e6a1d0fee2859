"""Concept names in definitions: longest first, whole words, no overlap; pairs of concepts become inferred relations.

Names are met by joining word n-grams with the name table, and each text's spans are then chosen in one fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ids import pair
from quillspark.operators.retrieval import tokens


def names(aliases: DataFrame) -> DataFrame:
    """(name, concepts, n_words) from (concept_id, normalized_alias); a name of several concepts is ambiguous."""
    n = aliases.select(F.trim(tokens(F.col("normalized_alias"))).alias("name"), "concept_id").where("name <> ''")
    return n.groupBy("name").agg(F.sort_array(F.collect_set("concept_id")).alias("concepts")).withColumn("n_words", F.size(F.split("name", " ")))


def name_sizes(aliases: DataFrame) -> DataFrame:
    """(name, n_words, n_concepts) from (concept_id, normalized_alias): as names, with the number of concepts instead of all of them."""
    n = aliases.select(F.trim(tokens(F.col("normalized_alias"))).alias("name"), "concept_id").where("name <> ''").distinct()
    return n.groupBy("name").agg(F.count("concept_id").cast("int").alias("n_concepts")).withColumn("n_words", F.size(F.split("name", " ")))


def spans(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text_id, own, name, start_word, n_words) of the names in texts (text_id, own, text) that survive: longer before shorter, then earlier; what overlaps a chosen span is dropped. Only names (name, n_words) are carried along, not their concepts, which may be very many."""
    sizes = sorted(r[0] for r in known.select("n_words").distinct().collect())  # the lengths that names have, few whatever their number
    if not sizes:
        sizes = [1]
    words = texts.select("text_id", "own", F.split(F.trim(tokens(F.col("text"))), " ").alias("w"))
    every = words.select("text_id", "own", F.explode(F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("name"), i.alias("i"), n.alias("n")))))).alias("s")).select("text_id", "own", "s.*").distinct()
    met = every.join(known.select("name", F.col("n_words").alias("k")), "name").where("n = k")
    per = met.groupBy("text_id", "own").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("longest"), "i", "n", "name"))).alias("m"))

    def choose(a: Column, x: Column) -> Column:
        clash = F.exists(a, lambda y: (y["i"] < x["i"] + x["n"]) & (x["i"] < y["i"] + y["n"]))
        return F.when(clash, a).otherwise(F.concat(a, F.array(x)))

    chosen = F.aggregate("m", F.slice("m", 1, 0), choose)
    return per.select("text_id", "own", F.explode(chosen).alias("x")).select("text_id", "own", "x.name", F.col("x.i").alias("start_word"), F.col("x.n").alias("n_words"))


def mentions(texts: DataFrame, known: DataFrame) -> DataFrame:
    """spans with the concepts that bear the name: (text_id, own, name, concepts, start_word, n_words)."""
    return spans(texts, known).join(known.select("name", "concepts"), "name").select("text_id", "own", "name", "concepts", "start_word", "n_words")


def inferred(found: DataFrame, explicit: DataFrame) -> DataFrame:
    """(concept_a, concept_b, n_bases): unordered pairs of a definition's concept (own) and one that it names, without ambiguous and own names, and without pairs that have an explicit relation (concept_a, concept_b)."""
    one = found.where(F.size("concepts") == 1).select("text_id", "own", F.get("concepts", F.lit(0)).alias("other")).where("own <> other")
    lo, hi = pair(F.col("own"), F.col("other"))
    return one.groupBy(lo.alias("concept_a"), hi.alias("concept_b")).agg(F.countDistinct("text_id").alias("n_bases")).join(explicit, ["concept_a", "concept_b"], "left_anti")
