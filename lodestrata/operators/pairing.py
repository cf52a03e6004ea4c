"""Pairing companions with the media they belong to, by directory and name without case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, paths


def pair(media: DataFrame, companions: DataFrame) -> DataFrame:
    """(path, parent, convention, reason) for each companion path; ``media(path)``, ``companions(path)``.

    A companion's stem is held against full names first (photo.cr2.xmp), then against stems
    (photo.xmp). More than one parent is ambiguous, and an ambiguous full name doesn't fall back.
    """
    m = media.select(F.col("path").alias("m"), paths.directory(F.col("path")).alias("d"), F.lower(paths.file_name(F.col("path"))).alias("full"), F.lower(paths.stem(paths.file_name(F.col("path")))).alias("stem"))
    by_full = m.groupBy("d", F.col("full").alias("key")).agg(F.count("*").alias("nf"), F.min("m").alias("pf"))
    by_stem = m.groupBy("d", F.col("stem").alias("key")).agg(F.count("*").alias("ns"), F.min("m").alias("ps"))
    c = companions.select("path", paths.directory(F.col("path")).alias("d"), F.lower(paths.stem(paths.file_name(F.col("path")))).alias("key"))
    both = c.join(by_full, ["d", "key"], "left").join(by_stem, ["d", "key"], "left")
    n = F.coalesce("nf", "ns")
    return both.select(
        "path",
        F.when(n == 1, F.coalesce("pf", "ps")).alias("parent"),
        F.when(n == 1, F.when(F.col("nf").isNotNull(), "full_name").otherwise("stem")).alias("convention"),
        F.when(n.isNull(), "no_parent").when(n > 1, "ambiguous").alias("reason"),
    )


def for_parents(media: DataFrame, paired: DataFrame) -> DataFrame:
    """Each media path with its companions in order of path, as an array of (path, convention)."""
    own = paired.where("parent is not null").groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("path", "convention"))).alias("companions"))
    return media.select("path").join(own.withColumnRenamed("parent", "path"), "path", "left").withColumn("companions", F.coalesce("companions", F.array().cast("array<struct<path:string,convention:string>>")))


def beside(parent_destination, companion_path, convention):
    """Where a companion goes: beside its parent, by its parent's full name or stem."""
    name = names.companion_name(paths.file_name(parent_destination), paths.extension(paths.file_name(companion_path)), convention == "full_name")
    return F.concat(paths.directory(parent_destination), F.lit("/"), name)
