"""Streaming counterparts, an extension: the batch operators have no stream form of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_content(files: DataFrame, time: str, content: str = "content", late: str = "1 hour") -> DataFrame:
    """A stream's files less later copies of the same content that arrive within ``late``; state is bounded by the watermark."""
    keyed = files.withColumns({"size": F.octet_length(content), "digest": F.sha2(content, 256)})
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["size", "digest"])


def arrivals(files: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by kind in tumbling windows."""
    return files.withWatermark(time, late).groupBy(F.window(time, window), "kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
