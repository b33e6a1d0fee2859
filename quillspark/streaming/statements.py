"""Statements as they arrive, compared with all that came before: duplicates, conflicts and issues are the same however the input was cut into batches.

Statements that could be the same or contradict one another have their type and their text with masked numbers in
common; that is the key of the state. A batch takes from the state only the keys that it touches, works these out anew
with the batch operators, and writes the outcome of each such key in one table, so decisions, pointers, conflicts and
issues of a key always belong together. The latest outcome of a key counts. A batch that is run again reads what was
there before it and overwrites its own folder.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspark.operators.dedup import contradictions, decisions, exact_groups, masked_numbers
from quillspark.storage import written

ITEM = "id string, knowledge_type string, norm string, location string, alias string, mask string"
OUTCOME = "kind string, knowledge_type string, mask string, id string, other_id string, outcome string"
KEY = ["knowledge_type", "mask"]


def _before(spark: SparkSession, folder: str, schema: str, number: int | None = None) -> DataFrame:
    """The rows of all batches before one (None: of all), with the number of their batch."""
    try:
        rows = spark.read.schema(f"{schema}, batch long").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    return rows if number is None else rows.where(F.col("batch") < number)


def absorb(batch: DataFrame, number: int, folder: str) -> None:
    """Add a batch of statements (id, knowledge_type, norm, location, alias) to the state in a folder. Statements whose id is known are left out."""
    spark = batch.sparkSession
    known = _before(spark, f"{folder}/items", ITEM, number).drop("batch")
    new = batch.select("id", "knowledge_type", "norm", "location", "alias", masked_numbers(F.col("norm")).alias("mask")).dropDuplicates(["id"])
    new = written(new.join(known.select("id"), "id", "left_anti"), "new")
    new.write.mode("overwrite").parquet(f"{folder}/items/batch={number}")
    touched = new.select(*KEY).distinct()
    items = written(known.join(touched, KEY, "left_semi").unionByName(new), "touched")
    groups = written(exact_groups(items.drop("mask")), "groups")
    made = decisions(items, groups).join(items.select("id", *KEY), "id")
    canonical = items.join(groups.where("id = canonical_id").select("id"), "id", "left_semi").where("alias is not null")
    clash = contradictions(canonical.select("id", "knowledge_type", "norm", "alias"), "alias").join(items.select(F.col("id").alias("claim_a_id"), *KEY), "claim_a_id")
    row = lambda df, kind, i, other, outcome: df.select(F.lit(kind).alias("kind"), *KEY, F.col(i).alias("id"), F.col(other).alias("other_id"), outcome.alias("outcome"))
    parts = [
        row(made, "DECISION", "id", "target", F.col("decision")), row(made.where("decision = 'LINKED'"), "POINTER", "target", "id", F.lit("EXACT_DUPLICATE")),
        row(clash, "CONFLICT", "claim_a_id", "claim_b_id", F.lit("UNDETERMINED")), row(clash, "ISSUE", "claim_a_id", "claim_b_id", F.lit("POTENTIAL_CONTRADICTION")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    out.write.mode("overwrite").parquet(f"{folder}/outcomes/batch={number}")


def current(spark: SparkSession, folder: str) -> SimpleNamespace:
    """decision (id, decision, target), pointer (canonical_id, other_id, outcome), conflict (claim_a_id, claim_b_id, cause) and issue (id, other_id, issue_type) as they stand."""
    rows = _before(spark, f"{folder}/outcomes", OUTCOME)
    last = rows.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    now = rows.join(last, [*KEY, "batch"], "left_semi")
    kind = lambda name, *columns: now.where(F.col("kind") == name).select("id", "other_id", "outcome").toDF(*columns)
    decision = kind("DECISION", "id", "target", "decision").select("id", "decision", "target")
    return SimpleNamespace(decision=decision, pointer=kind("POINTER", "canonical_id", "other_id", "outcome"), conflict=kind("CONFLICT", "claim_a_id", "claim_b_id", "cause"), issue=kind("ISSUE", "id", "other_id", "issue_type"))


def stream(spark: SparkSession, source: str, schema: StructType, folder: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Statements in a folder of files, absorbed batch by batch."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return arriving.writeStream.foreachBatch(lambda batch, number: absorb(batch, number, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
