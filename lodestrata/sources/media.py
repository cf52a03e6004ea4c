"""A Spark data source that walks directories of media.

``spark.read.format("lodestrata_media").option("roots", json list).load()`` lists regular files without
following links, whatever their names. Each top-level subtree of a root is a partition; directories that
a pattern hides are pruned before they are opened. Content is never read here. ``scan`` gives the same rows and
splits the work further: executors list level by level until there are subtrees enough for all of them.
"""

from __future__ import annotations

import json
import logging
import os
import re
import stat
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import paths
from ..runtime import cut, ready

_log = logging.getLogger(__name__)

SCHEMA = "path string, root string, rel_path string, size long, extension string, kind string, mtime timestamp, birthtime timestamp, status string"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_ARROW = [{"string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}[f.split()[1]] for f in SCHEMA.split(", ")]


class _Subtree(InputPartition):
    def __init__(self, root: str, rel: str):
        super().__init__((root, rel))
        self.root, self.rel = root, rel


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.skip = [(re.compile(paths.glob_regex(p)), "/" in p) for p in json.loads(options.get("skip", "[]"))]
        lists = json.loads(options.get("extensions", "{}"))
        self.image, self.video, self.companion = (set(lists.get(k, v)) for k, v in (("image", paths.IMAGE), ("video", paths.VIDEO), ("sidecar", paths.COMPANION)))
        self.companions = json.loads(options.get("sidecars", "true"))

    def partitions(self) -> list[InputPartition]:
        """One for each top-level entry of each root that is a directory; other roots are left out, as ``scan`` has warned."""
        out = []
        for root in self.roots:
            if os.path.isdir(root):
                try:
                    out += [_Subtree(root, name) for name in sorted(os.listdir(root))]
                except OSError:
                    out.append(_Subtree(root, ""))
        return out or [_Subtree("", "")]

    def _hidden(self, rel: str) -> bool:
        name = rel.rsplit("/", 1)[-1]
        return any(r.match(rel if whole else name) for r, whole in self.skip)

    def _kind(self, ext: str) -> str | None:
        return "image" if ext in self.image else "video" if ext in self.video else "sidecar" if ext in self.companion and self.companions else None

    def read(self, part: _Subtree) -> Iterator[tuple]:
        if part.root:
            yield from self._walk(part.root, part.rel)

    def _entry(self, root: str, rel: str) -> tuple | None:
        """The row of one entry; a directory that isn't hidden has the status ``directory``; None for what isn't listed."""
        path = os.path.join(root, rel)
        name = rel.rsplit("/", 1)[-1]
        try:
            st = os.lstat(path)
        except OSError:
            return (path, root, rel, None, None, None, None, None, "unreadable")
        is_dir = stat.S_ISDIR(st.st_mode)
        if is_dir and name == paths.METADATA_DIR:
            return None
        if self._hidden(rel):
            return (path, root, rel, None, None, None, None, None, "excluded")
        if is_dir:
            return (path, root, rel, None, None, None, None, None, "directory")
        ext = name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
        if not stat.S_ISREG(st.st_mode) or not (kind := self._kind(ext)):
            return None
        birth = getattr(st, "st_birthtime", None)
        at = [datetime.fromtimestamp(t, timezone.utc) if t is not None else None for t in (st.st_mtime, birth)]
        return (path, root, rel, st.st_size, ext, kind, *at, "ok")

    def level(self, root: str, rel: str) -> Iterator[tuple]:
        """The rows of a directory's entries; one row for the directory itself if it can't be listed."""
        path = os.path.join(root, rel)
        try:
            names = sorted(os.listdir(path))
        except OSError:
            yield (path, root, rel, None, None, None, None, None, "unreadable")
            return
        for name in names:
            if row := self._entry(root, f"{rel}/{name}" if rel else name):
                yield row

    def below(self, root: str, rel: str) -> Iterator[tuple]:
        """The rows of all that lies below a directory, however deep."""
        open_ = [self.level(root, rel)]
        while open_:
            row = next(open_[-1], None)
            if row is None:
                open_.pop()
            elif row[-1] == "directory":
                open_.append(self.level(root, row[2]))
            else:
                yield row

    def _walk(self, root: str, rel: str) -> Iterator[tuple]:
        row = self._entry(root, rel) if rel else (None, root, "", None, None, None, None, None, "directory")
        if row and row[-1] == "directory":
            yield from self.below(root, rel)
        elif row:
            yield row


class MediaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestrata_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


#: Levels that are listed one by one, at most, before what is left is dealt out as subtrees.
LEVELS = 8


def scan(spark: SparkSession, roots: list[str], skip: list[str] = (), sidecars: bool = True, subtrees: int | None = None, **extensions: list[str]) -> DataFrame:
    """The files under ``roots`` (an overlap lists a file twice), with rows for what was excluded or unreadable.

    A root that is no directory is left out with a warning and counted nowhere. Directories are listed level by level,
    each level dealt to all tasks, until there are ``subtrees`` of them (four a task unless given); those are then walked as
    tasks of their own. Only numbers of directories come to the driver, and no single directory at the top holds the rest up.
    """
    for root in roots:
        if not os.path.isdir(root):
            _log.warning("%s is not a directory and is left out", root)
    for p in skip:
        paths.glob_regex(p)
    ready(spark).dataSource.register(MediaSource)
    tasks = spark.sparkContext.defaultParallelism
    reader = _Reader({"roots": "[]", "skip": json.dumps(list(skip)), "sidecars": json.dumps(sidecars), "extensions": json.dumps(extensions)})

    def listed(how):
        def run(batches):
            for b in batches:
                for root, rel in zip(b.column("root").to_pylist(), b.column("rel_path").to_pylist(), strict=True):
                    rows = how(root, rel)
                    while some := list(islice(rows, 4096)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), _ARROW, strict=True)], names=_NAMES)

        return run

    open_ = spark.createDataFrame([(r, "") for r in roots if os.path.isdir(r)], "root string, rel_path string")
    found, left = [spark.createDataFrame([], SCHEMA)], len(roots)
    for _ in range(LEVELS):
        if not left or left >= (subtrees or 4 * tasks):
            break
        level = cut(open_.repartition(max(1, min(left, tasks))).mapInArrow(listed(reader.level), SCHEMA))
        found.append(level.where("status <> 'directory'"))
        open_ = level.where("status = 'directory'").select("root", "rel_path")
        left = open_.count()
    if left:
        found.append(open_.repartition(min(left, 4 * tasks)).mapInArrow(listed(reader.below), SCHEMA))
    return reduce(DataFrame.union, found)
