"""Dates in XMP sidecars, read mark by mark.

The text is walked once, from one tag to the next, with the prefixes that are bound where the walk is.
A property counts as soon as its tag or its text has been passed, so damage further on takes nothing
back, and a name that can't be resolved concerns that name alone.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clocks import parse_offset, parse_wall_clock

LIMIT = 10 << 20

# The properties of XMP that hold dates, best first: rank, prefix, namespace, name.
DATES = (
    (0, "exif", "http://ns.adobe.com/exif/1.0/", "DateTimeOriginal"),
    (1, "photoshop", "http://ns.adobe.com/photoshop/1.0/", "DateCreated"),
    (2, "xmp", "http://ns.adobe.com/xap/1.0/", "CreateDate"),
)
_BY_NAME = {name.encode(): (rank, prefix.encode(), space.encode(), f"{prefix}:{name}") for rank, prefix, space, name in DATES}
_WANTED = re.compile(b"|".join([b"xmlns", *_BY_NAME]))
_ANY_DATE = re.compile(b"|".join(_BY_NAME))

#: What can stand at a "<": a comment, characters as they are, an instruction, a document type, an end, or a start or empty tag.
_MARK = re.compile(
    rb"""<(?:!--.*?--> | !\[CDATA\[(?P<chars>.*?)\]\]> | \?.*?\?> | !(?!--|\[)(?:[^<>\[]|\[.*?\])*>
    | /(?P<end>[^>]*)> | (?P<start>[^!?/>\s][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>)""",
    re.S | re.X,
)
_NAME = re.compile(rb"[^\s/]+")
_ATTRIBUTE = re.compile(rb"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&([^;&]*);?")
# The entities of XML.
_ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}

_ZONED = re.compile(r"(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2})(\.\d+)?([Zz]|[+-]\d{2}:\d{2})", re.A)
_PLAIN = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}):(\d{2}))?", re.A)


def parse_value(text: str) -> tuple[datetime, int | None, bool] | None:
    """A date in XMP: (naive, offset, whether it has a time of day)."""
    if m := _PLAIN.fullmatch(text):
        try:
            return datetime(*map(int, m.groups(0))), None, m[4] is not None
        except ValueError:
            pass  # a second of 60, or no such day: what follows decides
    if m := _ZONED.fullmatch(text):
        offset = 0 if m[3] in "Zz" else parse_offset(m[3])
        try:
            naive = datetime.fromisoformat(m[1].upper())
        except ValueError:
            naive = None
        if naive is not None and offset is not None:
            return naive + timedelta(microseconds=int((m[2] or ".0")[1:7].ljust(6, "0"))), offset, True
    if not text[:1].isdigit():
        return None
    if found := parse_wall_clock(text):
        return *found, True
    for fmt, timed in (("%Y-%m-%dT%H:%M", True), ("%Y-%m-%d %H:%M", True), ("%Y-%m-%d", False)):
        try:
            return datetime.strptime(text, fmt), None, timed
        except ValueError:
            continue
    return None


def _character(m: re.Match) -> str:
    """The character of an entity; raises ValueError for one that XML doesn't know."""
    name = m[1]
    if m[0][-1] != ";" or not name:
        raise ValueError(m[0])
    if name[0] == "#":
        return chr(int(name[2:], 16) if name[1:2] == "x" else int(name[1:]))
    try:
        return _ENTITIES[name]
    except KeyError as e:
        raise ValueError(m[0]) from e


class _Scan:
    """A walk over one sidecar: open elements, the prefixes bound around them, and the best date so far."""

    def __init__(self):
        self.open: list[bytes] = []
        self.bound: list[tuple[int, bytes, bytes]] = []
        self.inside: tuple | None = None
        self.best: tuple | None = None

    def resolve(self, name: bytes, attribute: bool) -> tuple | None:
        """The property that a name means here: by its namespace, or by its customary prefix where that prefix is bound to nothing."""
        prefix, colon, local = name.partition(b":")
        if not colon:
            prefix, local = b"", name
        if (known := _BY_NAME.get(local)) is None or attribute and not colon:
            return None
        space = next((s for _, p, s in reversed(self.bound) if p == prefix), b"")
        return known if space == known[2] or not space and prefix == known[1] else None

    def consider(self, known: tuple, value: str) -> None:
        if got := parse_value(value.strip()):
            key = (not got[2], known[0])
            if self.best is None or key < self.best[0]:
                self.best = key, (got[0], got[1], known[3], got[2])

    def start(self, tag: bytes) -> None:
        name, empty = _NAME.match(tag)[0], tag.endswith(b"/")
        depth = len(self.open)
        if _WANTED.search(tag):
            found: dict[bytes, bytes] = {}
            for m in _ATTRIBUTE.finditer(tag, len(name)):
                found.setdefault(m[1], m[2] if m[2] is not None else m[3])
            self.bound += [(depth, k[6:], v) for k, v in found.items() if k == b"xmlns" or k.startswith(b"xmlns:")]
            for k, v in found.items():
                if known := self.resolve(k, True):
                    try:
                        self.consider(known, _ENTITY.sub(_character, v.decode()))
                    except (ValueError, OverflowError):
                        continue  # not a value: other text encodings, unknown entities
            own = self.resolve(name, False)
        else:
            own = self.resolve(name, False) if name.rpartition(b":")[2] in _BY_NAME else None
        self.inside = None if empty else own
        if empty:
            self.leave(depth)
        else:
            self.open.append(name)

    def leave(self, depth: int) -> None:
        while self.bound and self.bound[-1][0] >= depth:
            self.bound.pop()

    def end(self, name: bytes) -> bool:
        """Closes the innermost element; False if that isn't the one named."""
        if not self.open or self.open.pop() != name.rstrip():
            return False
        self.leave(len(self.open))
        self.inside = None
        return True

    def text(self, data: bytes, entities: bool) -> None:
        try:
            whole = data.decode()
        except UnicodeDecodeError:
            return
        for part in _ENTITY.split(whole)[::2] if entities else [whole]:
            self.consider(self.inside, part)


def parse(data: bytes) -> tuple[datetime, int | None, str, bool] | None:
    """The best date of a sidecar: with a time of day before without, then by property, then the first seen.

    Attributes are seen where their tag starts, text where it ends. Text of an element is taken up to its next tag,
    each piece between entities by itself. At malformed XML the walk ends; what it saw counts.
    """
    if not _ANY_DATE.search(data):
        return None
    scan, at = _Scan(), 0
    while (begin := data.find(b"<", at)) >= 0:
        if scan.inside and begin > at:
            scan.text(data[at:begin], True)
        if (m := _MARK.match(data, begin)) is None:
            break
        at = m.end()
        if (tag := m["start"]) is not None:
            scan.start(tag)
        elif (name := m["end"]) is not None:
            if not scan.end(name):
                break
        elif m["chars"] is not None and scan.inside:
            scan.text(m["chars"], False)
    else:
        if scan.inside:
            scan.text(data[at:], True)
    return scan.best[1] if scan.best else None


STRUCT = T.StructType().add("naive", T.TimestampNTZType()).add("offset_s", "integer").add("property", "string").add("has_time_of_day", "boolean").add("status", "string")
_ARROW = (pa.timestamp("us"), pa.int32(), pa.string(), pa.bool_(), pa.string())


def read(contents) -> pa.StructArray:
    """The dates of sidecars, null ones missing, as STRUCT's columns."""
    rows = []
    for c in contents:
        got = parse(c) if c is not None and len(c) <= LIMIT else None
        rows.append((*(got or (None, None, None, None)), "missing" if c is None else "too_large" if len(c) > LIMIT else "ok" if got else "undated"))
    columns = zip(*rows, strict=True) if rows else [()] * len(_ARROW)
    return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(columns, _ARROW, strict=True)], names=STRUCT.names)


@F.arrow_udf(STRUCT)
def dates_of(content: pa.Array) -> pa.Array:
    return read(x.as_py() for x in content)
