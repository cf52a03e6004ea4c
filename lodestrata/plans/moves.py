"""Carrying plans out and taking runs back as Spark jobs: each task moves its rows, with a journal segment of its own.

A task writes an intent before each move and an outcome after it, into ``<run>.parts/<first row>.jsonl`` beside the
run's journal. Numbers of entries follow from the rows, and a task that runs again finds its segment and goes on where the one
before stopped. When all moves are done the segments are copied into the journal, each to its place by a task, and go. All
paths have to be on folders that the executors share.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import ranked
from ..runtime import cut
from ..sources import journal, manifest
from . import undo
from .sink import Outcome, place, verify_step

COUNTS = ("moved", "failed", "skipped", "sidecars", "unprocessed", "restored", "conflicted", "skipped_missing", "skipped_modified")
DONE = "segment string, bytes long, " + ", ".join(f"{c} long" for c in COUNTS)


class _Task:
    """The moves of one task: its segment, what an earlier attempt recorded there, and its counters."""

    def __init__(self, parts: str | None, first: int, appended: Callable[[int], str]):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.name = f"{first:012d}.jsonl"
        self.at = parts and os.path.join(parts, self.name)
        self.recorded: dict[int, dict] = {}
        self.meant: set[int] = set()
        if self.at and os.path.exists(self.at):
            self._take_up()
        self.log = journal.Segment(self.at) if self.at else journal.Nowhere()
        self.appended, self.stopped = appended, set()

    def _take_up(self) -> None:
        """Reads what was recorded; a line that was torn goes."""
        with open(self.at, "rb+") as f:
            whole = 0
            for line in f:
                try:
                    entry = json.loads(line)
                except ValueError:
                    break
                whole += len(line)
                if entry["type"] == "move_intent":
                    self.meant.add(entry["seq"])
                else:
                    self.recorded[entry["seq"]] = entry
            f.truncate(whole)

    def move(self, seq: int, source: str, destination: str, size, digest, kind: str, group: int | None = None) -> str | None:
        """Where the file is now, or None if it couldn't be moved; what an earlier attempt did isn't done again."""
        if (entry := self.recorded.get(seq)) is None:
            again = seq in self.meant
            if not again:
                size = os.path.getsize(source) if size is None else int(size)
                self.log.append("move_intent", seq=seq, source=source, destination=destination, source_size=size, source_hash=digest, kind=kind)
            try:
                at = destination if again and not os.path.lexists(source) else place(source, destination)
            except OSError as e:
                self.log.append("move_failed", seq=seq, reason=str(e))
                return None
            if group is None:
                self.log.append("move_committed", seq=seq, final_destination=at, move_kind="renamed")
            else:
                self.log.append("duplicate_moved", seq=seq, group=group, source=source, destination=at)
            return at
        return None if entry["type"] == "move_failed" else entry.get("final_destination") or entry["destination"]

    def known(self, seq: int) -> bool:
        return seq in self.recorded or seq in self.meant

    def row(self) -> pd.DataFrame:
        self.log.close()
        size = os.path.getsize(self.at) if self.at and os.path.exists(self.at) else 0
        return pd.DataFrame([{"segment": self.name, "bytes": size, **self.counts}])

    def note(self, group: int, line: str) -> None:
        """Adds an outcome to a group's manifest, in one write."""
        with open(self.appended(group), "ab", buffering=0) as f:
            f.write((line + "\n").encode())
            os.fsync(f.fileno())

    def organise(self, r: dict, step: int) -> None:
        """One row of a plan with its companions, which follow to where it landed."""
        seq, c = r["n"] * step + 1, self.counts
        group = None if r["group"] < 0 else int(r["group"])
        if group in self.stopped:
            c["unprocessed"] += 1
            return
        if not os.path.lexists(r["source"]) and not self.known(seq):
            c["skipped"] += 1
            return
        at = self.move(seq, r["source"], r["destination"], r["size"], r["hash"], "organise" if group is None else "duplicate", group)
        c["moved" if at else "failed"] += 1
        if not at:
            return
        try:
            if group is not None:
                self.note(group, f"# moved: {manifest.escaped(r['source'])} -> {manifest.escaped(at)}")
            elif r["heads"] >= 0:
                self.note(int(r["heads"]), manifest.MOVED + manifest.escaped(at))
        except OSError:
            c["failed"] += 1
            self.stopped.add(group)
        for k, x in enumerate(r["companions"], 1):
            base = os.path.basename(at) if x["convention"] == "full_name" else os.path.splitext(os.path.basename(at))[0]
            if os.path.lexists(x["path"]) or self.known(seq + k):
                to = self.move(seq + k, x["path"], os.path.join(os.path.dirname(at), base + os.path.splitext(x["path"])[1].lower()), None, None, "sidecar")
                c["moved" if to else "failed"] += 1
                c["sidecars"] += bool(to)

    def restore(self, r: dict) -> None:
        """One step back, verified just before."""
        seq, c = r["n"] + 1, self.counts
        size, digest = None if pd.isna(r["size"]) else int(r["size"]), r["hash"]
        status = "intact" if self.known(seq) else verify_step(r["destination"], size, digest)
        if status != "intact":
            c["skipped_missing" if status == "missing" else "skipped_modified" if status == "modified" else "failed"] += 1
            return
        at = self.move(seq, r["destination"], r["source"], size, digest, "restore")
        c["failed" if at is None else "restored" if at == r["source"] else "conflicted"] += 1


def _work(parts: str | None, appended: Callable[[int], str], each: Callable[[_Task, dict], None]):
    """A partition's rows, in order, by one task; returns what came of them as one row."""

    def run(batches: Iterator[pd.DataFrame]):
        task = None
        for pdf in batches:
            for r in pdf.to_dict("records"):
                task = task or _Task(parts, int(r["n"]), appended)
                each(task, r)
        if task:
            yield task.row()

    return run


def _job(rows: DataFrame, tasks: int, work) -> list:
    """Runs ``work`` over ranges of the rows; what comes back is a row a task."""
    return rows.repartitionByRange(tasks, "n").sortWithinPartitions("n").mapInPandas(work, DONE).collect()


def _gathered(spark, journal_at: str, parts: str, done: list) -> None:
    """Copies the segments into the journal, each to its place by a task, and removes them."""
    at, rows = os.path.getsize(journal_at), []
    for r in sorted(done, key=lambda r: r.segment):
        if r.bytes:
            rows.append((os.path.join(parts, r.segment), at, r.bytes))
            at += r.bytes

    def copy(batches):
        for pdf in batches:
            for path, offset in zip(pdf["path"], pdf["offset"], strict=True):
                fd = os.open(journal_at, os.O_WRONLY)
                try:
                    with open(path, "rb") as f:
                        while block := f.read(1 << 20):
                            os.pwrite(fd, block, int(offset))
                            offset += len(block)
                    os.fsync(fd)
                finally:
                    os.close(fd)
            yield pdf[["bytes"]]

    if rows:
        spark.createDataFrame(rows, "path string, offset long, bytes long").repartition(min(len(rows), spark.sparkContext.defaultParallelism)).mapInPandas(copy, "bytes long").count()
    shutil.rmtree(parts, ignore_errors=True)


def carry_out(rows: DataFrame, order: list[str], log: journal.Writer | None, duplicates: str, chunk_size: int = 0, go_on: Callable[[int], bool] | None = None, total: int | None = None) -> Outcome:
    """Moves a plan's rows; ``duplicates`` is the folder of the groups' manifests, which are there already.

    Copies go before the files that stay, and chunks of ``chunk_size`` rows one after the other, each asked for by ``go_on``; with nobody to
    ask, all rows are one chunk. What is left when it says no is counted as unprocessed. A failure costs one file.
    """
    spark = rows.sparkSession
    heads = rows.where("phase = 0").groupBy(F.col("original").alias("_source")).agg(F.min("group").alias("_heads"))
    led = rows.join(heads, rows.source == heads._source, "left").withColumn("heads", F.coalesce("_heads", F.lit(-1)))
    steps = cut(ranked(led.select(*order, "source", "destination", "size", "hash", "companions", "heads"), [], order, "n"))
    step = 1 + (steps.agg(F.max(F.size("companions"))).first()[0] or 0)
    parts = log.parts() if log else None
    out, done, tasks = dict.fromkeys(COUNTS, 0), [], spark.sparkContext.defaultParallelism
    path_of = lambda group: os.path.join(duplicates, f"{group:03d}", manifest.NAME)
    work = _work(parts, path_of, lambda task, r: task.organise(r, step))
    all_ = total if total is not None else steps.count()
    size = chunk_size if chunk_size and go_on else max(all_, 1)
    for k in range(-(-all_ // size)):
        if go_on and not go_on(k):
            out["unprocessed"] += all_ - k * size
            break
        chunk = steps.where((F.col("n") >= k * size) & (F.col("n") < (k + 1) * size))
        for phase in (0, 1):
            done += _job(chunk.where(F.col("phase") == phase), min(tasks, size), work)
    for r in done:
        for c in COUNTS:
            out[c] += r[c]
    if log:
        _gathered(spark, log.path, parts, done)
        log.append("run_completed", moved=out["moved"], failed=out["failed"], skipped=out["skipped"], ended_at=None)
    return Outcome(*(out[c] for c in ("moved", "failed", "skipped", "sidecars", "unprocessed")))


def take_back(steps: DataFrame, log: journal.Writer, root: str) -> dict[str, int]:
    """Takes steps (line_no, source, destination, size, hash) back, last first, each verified just before; then removes emptied directories.

    A step to where another of the steps still has a file waits for that one: they go in waves.
    """
    spark = steps.sparkSession
    left = cut(ranked(steps.select((-F.col("line_no")).alias("turn"), "source", "destination", "size", "hash"), [], ["turn"], "n"))
    out, done, tasks = dict.fromkeys(COUNTS, 0), [], spark.sparkContext.defaultParallelism
    parts = log.parts()
    work = _work(parts, str, lambda task, r: task.restore(r))
    while number := left.count():
        ahead = left.select(F.col("destination").alias("source"), F.col("n").alias("_n"))
        waits = left.join(ahead, "source").where("_n < n").select("n").distinct()
        now = cut(left.join(waits, "n", "left_anti"))
        done += _job(now, min(tasks, number), work)
        left = cut(left.join(waits, "n", "left_semi"))
    for r in done:
        for c in COUNTS:
            out[c] += r[c]
    _gathered(spark, log.path, parts, done)

    def prune(batches):
        for pdf in batches:
            for d in pdf["directory"]:
                p = Path(d)
                while p != Path(root) and Path(root) in p.parents:
                    try:
                        os.rmdir(p)
                    except OSError:  # not empty, or gone already
                        if p.exists():
                            break
                    p = p.parent
            yield pdf

    left_behind = undo.restore_plan(journal.read(spark, log.path)).select(F.regexp_extract("source", "^(.*)/[^/]*$", 1).alias("directory")).distinct()
    left_behind.mapInPandas(prune, "directory string").count()
    log.append("run_completed", moved=out["restored"] + out["conflicted"], failed=out["failed"], skipped=out["skipped_missing"] + out["skipped_modified"], ended_at=None)
    return {c: out[c] for c in ("restored", "conflicted", "failed", "skipped_missing", "skipped_modified")}
