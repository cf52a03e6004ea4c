"""The write-ahead journal: one JSON object a line, the first the header."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA_VERSION = 1
ENTRY = "type string, seq long, source string, destination string, source_size long, source_hash string, kind string, final_destination string, move_kind string, reason string, `group` int, moved long, failed long, skipped long, ended_at timestamp"
HEADER = "schema_version int, run_id string, started_at timestamp, version string, output_dir string, argv array<string>"


#: The end of the name of a folder of segments that a run has left, if it was stopped.
PARTS = ".parts"


class JournalError(ValueError):
    """A journal that can't be trusted, with the line."""


def lines(text: DataFrame, key: str = "run_id", body: str = "text") -> DataFrame:
    """(key, line_no, line) of whole journals, one row each; empty lines are skipped but numbered."""
    return text.select(key, F.posexplode(F.split(body, "\n")).alias("n", "line")).where("line <> ''").select(key, (F.col("n") + 1).alias("line_no"), "line")


def file_lines(spark: SparkSession, path: str, named: str = r"([^/]+?)(?:\.jsonl)?$") -> DataFrame:
    """(run_id, line_no, line) of the journal files at ``path``, read line by line: a journal of any length is split as other text is.

    ``named`` finds a file's run in its path.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.regexp_extract(F.col("_metadata.file_path"), named, 1).alias("run_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    placed = raw.withColumn("n", F.row_number().over(Window.partitionBy("run_id", "block").orderBy("at")))
    before = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("run_id", "block").agg(F.count("*").alias("c")).select("run_id", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, ["run_id", "block"]).where("line <> ''").select("run_id", (F.col("start") + F.col("n")).cast("int").alias("line_no"), "line")


def run_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_lines`` of journals, with the segments that stopped runs left beside them after their own lines; a segment's torn last line goes."""
    own = file_lines(spark, path)
    held = str(Path(path).with_suffix("")) + PARTS + "/*.jsonl"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(held)
    if not [f for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or [] if f.getLen()]:
        return own
    found = file_lines(spark, held, rf"([^/]+{re.escape(PARTS)}/[^/]+)$").select(F.regexp_replace("run_id", rf"{re.escape(PARTS)}/.*$", "").alias("run_id"), F.col("run_id").alias("segment"), "line_no", "line")
    last = found.groupBy("segment").agg(F.max("line_no").alias("last"))
    whole = found.join(last, "segment").where((F.col("line_no") < F.col("last")) | F.try_parse_json("line").isNotNull())
    after = own.groupBy("run_id").agg(F.max("line_no").alias("own"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("segment", "line_no"))
    more = whole.join(after, "run_id").select("run_id", (F.col("own") + place).cast("int").alias("line_no"), "line")
    return own.union(more)


def parse(numbered: DataFrame, key: str = "run_id") -> DataFrame:
    """Entries of ``lines``, with ``corrupt`` (the raw text) where a line isn't one."""
    e = F.from_json("line", f"{ENTRY}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = numbered.where("line_no > 1").select(key, "line_no", e.alias("e"), "line").select(key, "line_no", "e.*", "line")
    bad = F.col("_corrupt").isNotNull() | F.col("type").isNull()
    return out.withColumn("corrupt", F.when(bad, F.col("line"))).drop("_corrupt", "line")


def state(numbered: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, header_ok, newer, torn, bad_line) of each journal: only the last line may be torn."""
    h = F.from_json("line", HEADER)
    head = numbered.where("line_no = 1").select(key, h["schema_version"].alias("v"))
    last = numbered.groupBy(key).agg(F.max("line_no").alias("last"))
    bad = parse(numbered, key).where("corrupt is not null").groupBy(key).agg(F.min("line_no").alias("first_bad"))
    met = last.join(head, key, "left").join(bad, key, "left")
    return met.select(key, F.col("v").isNotNull().alias("header_ok"), F.coalesce(F.col("v") > SCHEMA_VERSION, F.lit(False)).alias("newer"), F.coalesce(F.col("first_bad") == F.col("last"), F.lit(False)).alias("torn"), F.when(F.col("first_bad") < F.col("last"), F.col("first_bad")).alias("bad_line"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The journal files at ``path`` as entries with run_id; raises on a bad header, a newer version or a bad inner line."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:  # readers leave empty files out
        if f.isFile() and f.getLen() == 0:
            raise JournalError(f"{f.getPath().getName()}: no header")
    numbered = run_lines(spark, path)
    for r in state(numbered).where("not header_ok or newer or bad_line is not null").limit(1).collect():
        raise JournalError(f"{r.run_id}: {fault(r)}")
    return parse(numbered).where("corrupt is null").drop("corrupt")


def fault(r) -> str | None:
    """What is wrong with a row of ``state``; None if the journal can be read."""
    return "no header" if not r.header_ok else "written by a newer version" if r.newer else f"line {r.bad_line} can't be read" if r.bad_line is not None else None


def newest_first(directory: str) -> list[Path]:
    """Journal files by name, newest first; none if there is no such directory."""
    d = Path(directory)
    return sorted(d.glob("*.jsonl"), key=lambda p: p.name, reverse=True) if d.is_dir() else []


class Writer:
    """Appends entries; each is one write and on disk before the call returns."""

    def __init__(self, path: str | Path, run_id: str, started_at: str, output_dir: str, argv: list[str]):
        self.path = str(path)
        self.fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_APPEND, 0o644)
        self._put({"schema_version": SCHEMA_VERSION, "run_id": run_id, "started_at": started_at, "version": "1", "output_dir": output_dir, "argv": argv})

    def _put(self, entry: dict) -> None:
        os.write(self.fd, (json.dumps(entry, ensure_ascii=False) + "\n").encode())
        os.fsync(self.fd)

    def append(self, what: str, /, **fields) -> None:
        self._put({"type": what, **fields})

    def parts(self) -> str:
        """The folder of this run's segments, made if it isn't there."""
        os.makedirs(at := self.path.removesuffix(".jsonl") + PARTS, exist_ok=True)
        return at

    def close(self) -> None:
        os.close(self.fd)


class Segment(Writer):
    """Entries that one task appends to a file of its own, without a header."""

    def __init__(self, path: str):
        self.path = path
        self.fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o644)


class Nowhere:
    """A journal for runs that were told, and acknowledged, to keep none."""

    def append(self, what: str, /, **fields) -> None:
        pass

    def close(self) -> None:
        pass
