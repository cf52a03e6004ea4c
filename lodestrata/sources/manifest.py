"""Manifests of duplicate groups: comments after #, then one original path a line."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterable
from typing import TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import manifest_escape
from ..operators.cascade import group_directory
from ..operators.numbering import ranked
from ..runtime import cut
from .journal import file_lines

# The comment lines that carry paths.
KEPT, MOVED = "# Original kept at: ", "# Original moved to: "
NAME = "manifest.txt"


_BLANK = r"[\p{IsWhite_Space}]+"


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"(?s)^{_BLANK}|{_BLANK}\\z", "")


def originals(lines: DataFrame) -> DataFrame:
    """(group_id, original) of ``lines(group_id, line_no, line)``: the last "moved to", or else the last "kept at"; white space around a line doesn't count."""
    rows = lines.select("group_id", "line_no", _trimmed(F.col("line")).alias("line"))

    def last(prefix: str):
        is_it = F.col("line").startswith(prefix)
        return F.max_by(F.when(is_it, F.expr(f"substring(line, {len(prefix) + 1})")), F.when(is_it, F.col("line_no")))

    return rows.groupBy("group_id").agg(F.coalesce(last(MOVED), last(KEPT)).alias("original"))


def members(lines: DataFrame) -> DataFrame:
    """(group_id, line_no, path) of the lines that are neither empty nor comments, a row each however many a group has."""
    rows = lines.select("group_id", "line_no", _trimmed(F.col("line")).alias("path"))
    return rows.where((F.col("path") != "") & ~F.col("path").startswith("#"))


def lines(groups: DataFrame, paths: DataFrame) -> DataFrame:
    """(group_id, line_no, line) of the manifests of ``groups(group_id, number, hash, size, original)`` with ``paths(group_id, path)``.

    Paths are escaped and in order. A group of any size is a row a line: its members are placed by ranges.
    """
    head = F.array(F.format_string("# Duplicate group %03d", "number"), F.concat(F.lit("# SHA-256: "), "hash"), F.format_string("# File size: %d bytes", "size"), F.concat(F.lit(KEPT), manifest_escape(F.col("original"))), F.lit("#"))
    first = groups.select("group_id", F.posexplode(head).alias("n", "line")).select("group_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")
    body = ranked(paths.select("group_id", "path"), ["group_id"], ["path"], "n")
    return first.union(body.select("group_id", F.col("n") + 6, manifest_escape(F.col("path"))))


def intended(copies: DataFrame) -> DataFrame:
    """(group_id, line_no, line) of the manifests of planned ``copies(group, depth, key, source, hash, size, copies, original)``: what is meant, before any move."""
    of = F.format_string("%03d", "group").alias("group_id")
    one = copies.groupBy("group").agg(F.first("hash").alias("hash"), F.first("size").alias("size"), F.first("copies").alias("copies"), F.first("original").alias("original"))
    head = F.array(
        F.format_string("# Duplicate group %03d", "group"), F.concat(F.lit("# SHA-256: "), "hash"), F.format_string("# File size: %d bytes", "size"), F.concat(F.lit(KEPT), manifest_escape(F.col("original"))),
        F.format_string("# Meant for this directory: %d", "copies"), F.lit("#"),
    )
    first = one.select(of, F.posexplode(head).alias("n", "line")).select("group_id", (F.col("n") + 1).cast("long").alias("line_no"), "line")
    body = ranked(copies.select("group", "depth", "key", "source"), ["group"], ["depth", "key"], "n").select(of, F.col("n") + 7, manifest_escape(F.col("source")))
    last = one.select(of, F.posexplode(F.array(F.lit(""), F.lit("# Outcomes"))).alias("n", "line")).select("group_id", F.col("n") + F.lit(1 << 40), "line")
    return first.union(body).union(last)


def write(lines: DataFrame, root: str) -> DataFrame:
    """Writes root/<group_id>/manifest.txt of ``lines(group_id, line_no, line)``; returns (group_id, offset, bytes), a row for each segment.

    The lines are cut into pieces by ranges, and each piece is written where it belongs in its file by the task that holds
    it, so that a group of any size is written by many tasks. ``root`` is a folder that all executors share. A task that
    runs again writes the same bytes to the same place.
    """
    size = F.octet_length("line").cast("long") + 1
    marked = cut(lines.withColumn("_bytes", size).repartitionByRange("group_id", "line_no").withColumn("_piece", F.spark_partition_id()))
    per = marked.groupBy("group_id", "_piece").agg(F.sum("_bytes").alias("_n"))
    own = Window.partitionBy("group_id")
    starts = per.select("group_id", "_piece", F.coalesce(F.sum("_n").over(own.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_n").over(own).alias("_total"))
    dealt = marked.join(starts, ["group_id", "_piece"]).repartition("group_id", "_piece").sortWithinPartitions("group_id", "_piece", "line_no")

    def put(batches):
        at = None
        for pdf in batches:
            for (group, piece), some in pdf.groupby(["group_id", "_piece"], sort=False):
                if at is None or at[:2] != (group, piece):
                    at = (group, piece, int(some["_offset"].iloc[0]))
                data = ("\n".join(some["line"]) + "\n").encode()
                os.makedirs(directory := os.path.join(root, str(group)), exist_ok=True)
                fd = os.open(os.path.join(directory, NAME), os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    os.ftruncate(fd, int(some["_total"].iloc[0]))
                    os.pwrite(fd, data, at[2])
                    os.fsync(fd)
                finally:
                    os.close(fd)
                yield pd.DataFrame({"group_id": [group], "offset": [at[2]], "bytes": [len(data)]})
                at = (group, piece, at[2] + len(data))

    return dealt.select("group_id", "_piece", "line_no", "line", "_offset", "_total").mapInPandas(put, f"group_id {lines.schema['group_id'].dataType.simpleString()}, offset long, bytes long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, line_no, line) of the manifests at ``path``, each in a directory of its group's name, read line by line."""
    return file_lines(spark, path, r"([^/]+)/[^/]+$").select(F.col("run_id").alias("group_id"), "line_no", "line")


def of_originals(files: DataFrame, groups: DataFrame, duplicates_dir: str = "duplicates") -> DataFrame:
    """(path, manifest) of ``files(path)``: the manifest of the group that a file heads, of ``groups(original, number)``, or null."""
    at = F.concat(group_directory(F.col("number"), duplicates_dir), F.lit(f"/{NAME}"))
    return files.join(groups.select(F.col("original").alias("path"), at.alias("manifest")), "path", "left").select("path", "manifest")


def escaped(path: str) -> str:
    """``manifest_escape`` for one path."""
    short = {"\n": "\\n", "\r": "\\r"}
    return "".join(short.get(c) or (f"\\u{{{ord(c):x}}}" if ord(c) < 32 or 127 <= ord(c) < 160 else c) for c in path)


def original_of(lines: Iterable[str]) -> str | None:
    """The original's path: the last "moved to", else the last "kept at"."""
    kept = moved = None
    for line in lines:
        line = line.strip()
        if line.startswith(MOVED):
            moved = line.removeprefix(MOVED)
        elif line.startswith(KEPT):
            kept = line.removeprefix(KEPT)
    return moved or kept


class Manifests:
    """The manifests of one run's groups: intentions before the first move, outcomes as they happen, each on disk at once."""

    def __init__(self, root: str):
        self.root, self.group, self.file, self.of = root, None, None, {}

    def path(self, group: int) -> str:
        return os.path.join(self.root, f"{group:03d}", NAME)

    def begin(self, rows: Iterable[dict]) -> None:
        """Writes what is meant for rows (group, source, hash, size, copies, original) that come group by group."""
        for group, members in itertools.groupby(rows, key=lambda r: r["group"]):
            first = next(members)
            self.of[first["original"]] = group
            os.makedirs(os.path.dirname(self.path(group)), exist_ok=True)
            with open(self.path(group), "x", encoding="utf-8") as f:
                f.write(f"# Duplicate group {group:03d}\n# SHA-256: {first['hash']}\n# File size: {first['size']} bytes\n{KEPT}{escaped(first['original'])}\n# Meant for this directory: {first['copies']}\n#\n")
                for r in itertools.chain([first], members):
                    f.write(escaped(r["source"]) + "\n")
                f.write("\n# Outcomes\n")
                f.flush()
                os.fsync(f.fileno())

    def _append(self, f: TextIO, line: str) -> None:
        f.write(line + "\n")
        f.flush()
        os.fsync(f.fileno())

    def record(self, group: int, line: str) -> None:
        """Adds an outcome; raises where it can't be written."""
        if group != self.group:
            self.close()
            self.group, self.file = group, open(self.path(group), "a", encoding="utf-8")
        self._append(self.file, line)

    def moved(self, group: int, source: str, at: str) -> None:
        self.record(group, f"# moved: {escaped(source)} -> {escaped(at)}")

    def original_moved(self, source: str, at: str) -> None:
        """Notes where a group's original went, if ``source`` is one."""
        if source in self.of:
            self.record(self.of[source], MOVED + escaped(at))

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.group = self.file = None
