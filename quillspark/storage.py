"""Written tables in the shared folder, to cut lineage in operators that iterate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local one, but only for a local master, as in tests: on a cluster other machines would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "/tmp/quillspark-shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the application ends; until then later results may read it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read back: what comes before is never computed again, also not after a lost executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all tasks by its keys, before costly columns: a packed file gives one task for each million rows, however many cores wait."""
    return df.repartition(*keys)


def forget(df: DataFrame | None) -> None:
    """Delete what `written` made of df, once nothing reads it any more: a round, when the next one is written."""
    path = getattr(df, "_written", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
