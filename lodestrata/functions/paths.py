"""Paths as component arrays: ordering, extensions, globs and kinds of file."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of the media and companion files that are organised.
IMAGE = ("jpg", "jpeg", "png", "heic", "heif", "tiff", "tif", "raw", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "srw", "pef", "webp", "avif", "bmp")
VIDEO = ("mov", "mp4", "m4v", "avi", "mkv", "wmv", "flv", "webm", "3gp", "mts", "m2ts")
COMPANION = ("xmp", "aae", "thm")
METADATA_DIR = ".lodestrata"


def components(path: Column) -> Column:
    return F.split(path, "/")


def path_key(path: Column) -> list[Column]:
    """Sort key of a path: fewer components first, then component by component."""
    return [F.size(components(path)), components(path)]


def file_name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; empty if there is none or the dot leads the name."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def stem(name: Column) -> Column:
    """The name without its last extension; a name with only a leading dot is all stem."""
    return F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")


def kind(ext: Column, image=IMAGE, video=VIDEO, companion=COMPANION) -> Column:
    """image, video or sidecar, in that precedence; null for anything else."""
    return F.when(ext.isin(*image), "image").when(ext.isin(*video), "video").when(ext.isin(*companion), "sidecar")


class PatternError(ValueError):
    """A glob that can't be used."""


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * and ? stay within a component, ** crosses them, [..] and {a,b} as usual."""
    if not pattern:
        raise PatternError("an empty pattern matches nothing")
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise PatternError(f"{pattern}: a [ has no ]")
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise PatternError(f"{pattern}: a {{ has no }}")
    return f"^{out}$"


@F.arrow_udf(T.BooleanType())
def usable(pattern: pa.Array) -> pa.Array:
    """Whether ``glob_regex`` takes a pattern; null for null."""

    def fine(p: str) -> bool:
        try:
            return bool(re.compile(glob_regex(p)))
        except (PatternError, re.error):
            return False

    return pa.array([None if p is None else fine(p) for p in pattern.to_pylist()], pa.bool_())


def _like(regex: str):
    return lambda x: x.rlike(regex)


def skipped(rel_path: Column, patterns: list[str]) -> Column:
    """Whether a path below its root, or a directory above it, matches a pattern.

    A pattern without / is held against each component, one with / against the path and each of its
    ancestors. The root itself is no part of ``rel_path`` and so is exempt.
    """
    parts = components(rel_path)
    found = F.lit(False)
    for p in patterns:
        regex = glob_regex(p)
        if "/" in p:
            prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
            found = found | F.exists(prefixes, _like(regex))
        else:
            found = found | F.exists(parts, _like(regex))
    return found


def topmost_skipped(rel_path: Column, patterns: list[str]) -> Column:
    """The shortest prefix that a pattern hides: what one pruned entry is counted by. Null if none."""
    parts = components(rel_path)
    hit = F.lit(False)

    def prefix_hit(n: Column) -> Column:
        prefix, name = F.concat_ws("/", F.slice(parts, 1, n)), F.element_at(parts, n)
        out = hit
        for p in patterns:
            out = out | (prefix if "/" in p else name).rlike(glob_regex(p))
        return out

    return F.try_element_at(F.transform(F.filter(F.sequence(F.lit(1), F.size(parts)), prefix_hit), lambda n: F.concat_ws("/", F.slice(parts, 1, n))), F.lit(1)) if patterns else F.lit(None).cast("string")


def in_metadata_dir(rel_path: Column, name: str = METADATA_DIR) -> Column:
    """Whether a directory above the file is the engine's own; such files are left out and not counted."""
    parts = components(rel_path)
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x == name)
