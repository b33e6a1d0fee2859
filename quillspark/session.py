"""A session with the settings that the operators count on; on a cluster, submit-time settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("quillspark")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**settings, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Fixed value: the size up to which a table may be broadcast without a hint. Spark takes it from packed files and column widths; rows with worked-out texts take some sixty times that in the driver, which collects them.
MAX_BROADCAST = 1 << 16


def small_broadcasts(spark: SparkSession) -> None:
    """Joins shuffle what is over MAX_BROADCAST, so that the driver's memory doesn't grow with the tables; a lower limit of the session stays."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    if int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) > MAX_BROADCAST:
        spark.conf.set(name, str(MAX_BROADCAST))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where they find it by path, else it is sent along as a zip file once."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]:
        return
    path = Path(tempfile.mkdtemp()) / "quillspark_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in (root / "quillspark").rglob("*.py"):
            z.write(f, str(f.relative_to(root)))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
