"""Replaying a journal backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def restore_plan(journal: DataFrame) -> DataFrame:
    """Steps of one or more runs, last first within a run: run_id, line_no, seq, type, source, destination, size, hash.

    Only commit records make steps. A moved file needs its intent's source; a duplicate carries its own.
    """
    outcomes = journal.where(F.col("type").isin("move_committed", "duplicate_moved"))
    intents = journal.where("type = 'move_intent'").groupBy("run_id", "seq").agg(F.min(F.struct("line_no", F.col("source").alias("i_source"), F.col("source_size").alias("size"), F.col("source_hash").alias("hash"))).alias("i"))
    met = outcomes.select("run_id", "line_no", "seq", "type", F.col("source").alias("own"), F.coalesce("final_destination", "destination").alias("destination")).join(intents, ["run_id", "seq"], "left")
    source = F.when(F.col("type") == "duplicate_moved", F.coalesce("i.i_source", "own")).otherwise(F.col("i.i_source"))
    return met.select("run_id", "line_no", "seq", "type", source.alias("source"), "destination", "i.size", "i.hash").where("source is not null").orderBy("run_id", F.desc("line_no"))


def unresolved(journal: DataFrame) -> DataFrame:
    """Intents without any outcome; they are reported and never restored."""
    settled = journal.where(F.col("type").isin("move_committed", "duplicate_moved", "move_failed")).select("run_id", "seq")
    return journal.where("type = 'move_intent'").join(settled, ["run_id", "seq"], "left_anti").select("run_id", "line_no", "seq", "source", "destination")


def runs(journal: DataFrame) -> DataFrame:
    """Per run: how many steps can be restored, whether it was interrupted, and its first completion's counters."""
    done = F.min_by(F.struct("moved", "failed", "skipped"), F.when(F.col("type") == "run_completed", F.col("line_no")))
    g = journal.groupBy("run_id").agg(F.count_if(F.col("type").isin("move_committed", "duplicate_moved")).alias("n_restorable"), (~F.bool_or(F.coalesce(F.col("type") == "run_completed", F.lit(False)))).alias("interrupted"), done.alias("d"))
    return g.select("run_id", "n_restorable", "interrupted", "d.moved", "d.failed", "d.skipped").orderBy(F.desc("run_id"))


def latest(journal: DataFrame) -> DataFrame:
    """``runs`` of the newest run only; run ids sort by when they began."""
    return runs(journal.join(journal.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi"))
