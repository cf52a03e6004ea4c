"""Counters of a plan or a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_sources(plan: DataFrame) -> DataFrame:
    """One row: planned files by date source, and the orthogonal count of unsorted ones."""
    kinds = ("exif", "sidecar", "filesystem", "unreadable", "unsupported", "none")
    return plan.agg(*[F.count_if(F.col("date_source") == k).alias(f"n_{k}") for k in kinds], F.count_if("unsorted").alias("n_unsorted"))


def warning(tally: DataFrame, percent: int = 20) -> DataFrame:
    """Adds from_filesystem, dated, percent and warns: strictly more than ``percent`` of the dated files."""
    fs = F.col("n_filesystem") + F.col("n_unreadable") + F.col("n_unsupported")
    dated = F.col("n_exif") + F.col("n_sidecar") + fs
    return tally.select("*", fs.alias("from_filesystem"), dated.alias("dated"), F.when(dated > 0, F.floor(fs * 100 / dated)).otherwise(0).cast("long").alias("percent"), ((dated > 0) & (fs * 100 > percent * dated)).alias("warns"))


def time_zones(plan: DataFrame) -> DataFrame:
    """One row: offsets that were recorded, configured, the machine's, or assumed to be UTC."""
    buckets = {"recorded": ("exif", "sidecar", "recorded"), "configured": ("config", "configured"), "system": ("system",), "assumed_utc": ("utc",)}
    return plan.agg(*[F.count_if(F.col("tz_source").isin(*v)).alias(f"tz_{k}") for k, v in buckets.items()])


def duplicates(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"), F.coalesce(F.sum((F.col("copies") - 1) * F.col("size")), F.lit(0)).alias("bytes_reclaimable"))


# The parts of a restore's shortfall, in order.
SHORTFALLS = {"failed": "could not be restored", "skipped_missing": "skipped (missing)", "skipped_modified": "skipped (modified)", "conflicted": "restored under a different name", "unprocessed": "never attempted"}


def shortfall(counts: dict[str, Column]) -> Column:
    """The non-zero counters as one text; null if there is none."""
    text = F.concat_ws(", ", *[F.when(counts[k] > 0, F.concat(counts[k].cast("string"), F.lit(f" {label}"))) for k, label in SHORTFALLS.items()])
    return F.when(text != "", text)
