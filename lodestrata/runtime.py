"""Making the package importable to Spark's Python workers, and cutting plans."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Bytes of rows that a Python worker gets at a time, unless the session names another number than Spark's own.
BATCH_BYTES, SPARK_BATCH_BYTES = "8m", ("64m", "64MB", "67108864", "67108864b")


def ready(spark: SparkSession) -> SparkSession:
    """Adds this checkout to the workers' path; where it isn't there on a worker, that does nothing.

    Rows that hold whole files or chunks of documents go to Python 8 MB at a time, not 64: the copies on both sides
    of the pipe are what fills an executor.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in SPARK_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where it is unset, a temporary one on this machine, but only for a local master: elsewhere each executor would write
    to its own disk, so that is refused.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _made:
        _made.append(tempfile.mkdtemp(prefix="lodestrata-"))
        atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
    return f"file://{_made[0]}"


_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the shared folder, so that what follows neither repeats it nor carries its plan."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def measured(df: DataFrame, **what: Column) -> tuple[DataFrame, dict]:
    """``cut`` of ``df``, and aggregates over its rows that were taken in the pass that computed them."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(name) for name, c in what.items()]))
    return out, seen.get
