"""Documents as they arrive: a folder of segments, or of events, read as a stream; each batch runs the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillspark.operators.detectors import detect


def candidates_stream(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Detect what new pages (document_id, page_number, text) state and append it, a folder for each batch, so a batch that is run again overwrites its own rows."""

    def run(batch: DataFrame, number: int) -> None:
        detect(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def issue_counts_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, window: str = "1 hour", late: str = "1 day") -> StreamingQuery:
    """Events (ts, event_type) counted by window and type; windows are final once they are later than the watermark."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    return counts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
