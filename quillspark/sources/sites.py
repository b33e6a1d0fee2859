"""Which addresses lie within an authorised site: same scheme, host and port, and a path below the page's folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site(url: Column) -> Column:
    """struct(scheme, host, port, path, prefix) of an http or https address; null for anything else, and for one without a host or with credentials."""
    u = F.trim(url)
    place = F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
    port = F.regexp_extract(place, r":([0-9]+)$", 1)
    default = F.when(scheme == "http", 80).otherwise(443)
    fits = scheme.isin("http", "https") & place.rlike(r"^[^@:]+(?::[0-9]{0,5})?$")
    return F.when(fits, F.struct(scheme.alias("scheme"), F.lower(F.regexp_extract(place, r"^([^:]+)", 1)).alias("host"), F.when(port == "", default).otherwise(port.try_cast("int")).alias("port"), path.alias("path"), F.regexp_extract(path, r"^(.*/)", 1).alias("prefix")))


def within(authorised: Column, url: Column) -> Column:
    """Whether a url is inside the site of an authorised page; false for what is no page's address."""
    a, b = site(authorised), site(url)
    same = (a["scheme"] == b["scheme"]) & (a["host"] == b["host"]) & (a["port"] == b["port"]) & F.startswith(b["path"], a["prefix"])
    return F.coalesce(same, F.lit(False))


def within_first(pages: DataFrame) -> DataFrame:
    """(page_id, within) of pages (page_id, url): whether each lies within the site of the first address in order."""
    first = pages.agg(F.min("url")).first()[0]
    return pages.select("page_id", within(F.lit(first).cast("string"), F.col("url")).alias("within"))
