"""Verdicts: duplicate groups against their manifests, restore steps against what is on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = b"lodestrata verification"


def keyed_digest(content: Column) -> Column:
    """A digest other than the cascade's, so one function's flaw can't confirm itself."""
    return F.sha2(F.concat(F.lit(KEY), content), 512)


def group_verdicts(originals: DataFrame, copies: DataFrame) -> DataFrame:
    """(group_id, n_copies, n_matching, verdict) of ``originals(group_id, digest)`` (null: missing) and ``copies(group_id, digest)``.

    original_missing, mismatch, or confirmed; a group without copies is confirmed.
    """
    met = originals.select("group_id", F.col("digest").alias("o")).join(copies.select("group_id", F.col("digest").alias("c"), F.lit(True).alias("is")), "group_id", "left")
    out = met.groupBy("group_id").agg(F.count("is").alias("n_copies"), F.count_if(F.col("is") & F.coalesce(F.col("o") == F.col("c"), F.lit(False))).alias("n_matching"), F.max("o").alias("o"))
    verdict = F.when(F.col("o").isNull(), "original_missing").when(F.col("n_matching") < F.col("n_copies"), "mismatch").otherwise("confirmed")
    return out.select("group_id", "n_copies", "n_matching", verdict.alias("verdict"))


def exit_code(verdicts: DataFrame) -> int:
    """1 on a mismatch, 2 on a missing original, 3 if there are groups and none is confirmed, else 0."""
    r = verdicts.agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("mismatch", "original_missing", "confirmed")]).first()
    return 1 if r.mismatch else 2 if r.original_missing else 3 if r.n and not r.confirmed else 0


def verify_steps(steps: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``status`` to ``steps(destination, size, hash)`` from ``listing(path, is_file, size, hash)``.

    missing, unverifiable (not a regular file), modified (size, then hash, where recorded) or intact.
    """
    there = listing.select(F.col("path").alias("destination"), "is_file", F.col("size").alias("l_size"), F.col("hash").alias("l_hash"))
    status = (
        F.when(F.col("is_file").isNull(), "missing")
        .when(~F.col("is_file"), "unverifiable")
        .when(F.col("size") != F.col("l_size"), "modified")
        .when(F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("l_hash")), "modified")
        .otherwise("intact")
    )
    return steps.join(there, "destination", "left").withColumn("status", status).drop("is_file", "l_size", "l_hash")
