"""Files as rows: formats by their first bytes, hashes, refusals with reasons. Input: spark.read.format("binaryFile")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes (hexadecimal) and endings of the formats that are read, and those that are refused.
MAGIC = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "tiff": "49492A00", "rtf": "7B5C727466", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1"}
ENDINGS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "xhtml": "html", "csv": "csv", "txt": "txt", "text": "txt", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "epub": "epub"}
#: The member, or the folder of members, that tells what a ZIP file is.
MEMBERS = {"docx": ("word/document.xml",), "pptx": ("ppt/",), "xlsx": ("xl/",), "epub": ("META-INF/container.xml", "application/epub+zip", ".opf")}
REFUSED = {"doc": "an old binary format", "xls": "an old binary format", "ppt": "an old binary format", "json": "data, not a document", "xml": "data, not a document"}
MOST_BYTES = 512 << 20


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files in a folder and below; Spark lists no empty ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def detected(rows: DataFrame) -> DataFrame:
    """rows with format, file_hash and reason: null for what can be read, else why it is refused. A ZIP file is what its members say, and what its name says only if they say nothing."""
    head, end = F.hex(F.substring("content", 1, 8)), ending(F.col("path"))
    by_magic = F.coalesce(*(F.when(head.startswith(m), k) for k, m in MAGIC.items()))
    by_end = F.coalesce(*(F.when(end == e, k) for e, k in ENDINGS.items()))
    by_member = F.coalesce(*(F.when(F.contains(F.decode("content", "ISO-8859-1"), F.lit(m)), k) for k, names in MEMBERS.items() for m in names))
    kind = F.when(by_magic == "zip", F.coalesce(by_member, F.when(by_end.isin(*MEMBERS), by_end))).when(by_magic == "ole", F.lit(None)).otherwise(F.coalesce(by_magic, by_end))
    refused = F.coalesce(*(F.when(end == e, r) for e, r in REFUSED.items()))
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MOST_BYTES, "too large").when(refused.isNotNull(), refused).when(kind.isNull(), "unknown format")
    return rows.withColumn("format", kind).withColumn("file_hash", F.sha2("content", 256)).withColumn("reason", reason)


def ingested(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files to read: each content once, by the first path, without those whose hash is known."""
    new = rows.where("reason is null")
    if known is not None:
        new = new.join(known.select("file_hash"), "file_hash", "left_anti")
    first = new.groupBy("file_hash").agg(F.min("path").alias("first_path"))
    return new.join(first, "file_hash").where("path = first_path").drop("first_path")
