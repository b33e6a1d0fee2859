"""Stored procedures and the history of their runs: what was known of each at any time, and of which version; files against their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Outcomes of a run.
OUTCOMES = ("VERIFIED", "FAILED", "INCONCLUSIVE")


def with_version(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """runs (subject_id, id, status, at, ...) with `version`: the latest version (subject_id, version, at) that there was at the time of the run; null if there was none.

    Both tables stand in one order of time for each subject, and the last version is carried on to the runs: one sort,
    no pairs of a run and a version.
    """
    names = runs.columns
    v = versions.select("subject_id", "at", "version", F.lit(0).alias("_kind"), *(F.lit(None).cast(runs.schema[c].dataType).alias(c) for c in names if c not in ("subject_id", "at")))
    r = runs.select("subject_id", "at", F.lit(None).cast(versions.schema["version"].dataType).alias("version"), F.lit(1).alias("_kind"), *(c for c in names if c not in ("subject_id", "at")))
    upto = W.partitionBy("subject_id").orderBy("at", "_kind", "version").rowsBetween(W.unboundedPreceding, 0)
    return v.unionByName(r).withColumn("version", F.last("version", ignorenulls=True).over(upto)).where("_kind = 1").select(*names, "version")


def states(runs: DataFrame, versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(subject_id, at, version, executions, successes, failures, last_verified, last_status, verified, note) of each procedure at each asked time (subject_id, at).

    runs: (subject_id, id, status, at). A run counts from its time on. An inconclusive run is neither a success nor a
    failure. `verified` is true if a run of the version in force then was a success: a new version starts without one.
    Runs of the same time are ordered by id. A time before any run has zero counts.
    """
    r = with_version(runs.select("subject_id", "id", "status", "at"), versions).withColumn("_kind", F.lit(0))
    q = with_version(asked.select("subject_id", "at").distinct().select("subject_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("status"), "at"), versions).withColumn("_kind", F.lit(1))
    order = W.partitionBy("subject_id").orderBy("at", "_kind", "id").rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy("subject_id", "version").orderBy("at", "_kind", "id").rowsBetween(W.unboundedPreceding, 0)
    count = lambda name: F.sum((F.col("status") == name).cast("long")).over(order)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    all_rows = r.unionByName(q)
    d = all_rows.select(
        "subject_id", "at", "version", "_kind", zero(F.sum((F.col("_kind") == 0).cast("long")).over(order)).alias("executions"), zero(count("VERIFIED")).alias("successes"), zero(count("FAILED")).alias("failures"),
        F.max(F.when(F.col("status") == "VERIFIED", F.col("at"))).over(order).alias("last_verified"), F.last("status", ignorenulls=True).over(order).alias("last_status"), (zero(F.sum((F.col("status") == "VERIFIED").cast("long")).over(own)) > 0).alias("verified"),
    ).where("_kind = 1")
    note = (
        F.when(F.col("executions") == 0, "never executed").when(F.col("successes") == 0, F.concat(F.lit("executed "), F.col("executions").cast("string"), F.lit(" time(s), never verified; the last run was "), F.col("last_status")))
        .otherwise(F.concat(F.lit("verified on "), F.col("successes").cast("string"), F.lit(" of "), F.col("executions").cast("string"), F.lit(" run(s); the last run was "), F.col("last_status")))
    )
    return d.select("subject_id", "at", "version", "executions", "successes", "failures", "last_verified", "last_status", "verified", note.alias("note"))


def file_checks(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, status) of documents (document_id, file_hash) against preserved files (document_id, content): VERIFIED if the content has the hash, FAILED if not, INCONCLUSIVE without a file."""
    kept = files.select("document_id", F.sha2("content", 256).alias("now"))
    d = documents.select("document_id", "file_hash").join(kept, "document_id", "left")
    return d.select("document_id", F.when(F.col("now").isNull(), "INCONCLUSIVE").when(F.col("now") == F.col("file_hash"), "VERIFIED").otherwise("FAILED").alias("status"))
