"""Readers of media files: digests by byte range, EXIF in JPEG, TIFF and HEIF, ISO base media.

Each is a pandas UDF over paths that opens the file where it runs; malformed input is a status, never
an exception.
"""

from __future__ import annotations

import hashlib
import mmap
import re
import struct
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clocks import parse_offset, parse_wall_clock

DIGEST = T.StructType().add("digest", "string").add("reason", "string")
BUFFER = 128 * 1024


def partial_digest(path: str, scanned: int, k: int) -> str:
    """SHA-256 of the whole, the head, or head and tail, by size; an error if the file isn't as long as it was."""
    with open(path, "rb") as f:
        if f.seek(0, 2) != scanned:
            raise OSError("the file changed since it was listed")
        f.seek(0)
        data = f.read(min(scanned, k))
        want = min(scanned, k)
        if scanned > 2 * k:
            f.seek(scanned - k)
            data, want = data + f.read(k), 2 * k
        if len(data) != want:
            raise OSError("the file is shorter than it was")
    return hashlib.sha256(data).hexdigest()


def full_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(BUFFER):
            h.update(block)
    return h.hexdigest()


def _each(fn, *columns: pd.Series) -> pd.DataFrame:
    rows = []
    for args in zip(*columns, strict=True):
        try:
            rows.append((fn(*args), None))
        except OSError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["digest", "reason"])


def partial_digest_udf(k: int):
    @F.pandas_udf(DIGEST)
    def read(path: pd.Series, size: pd.Series) -> pd.DataFrame:
        return _each(lambda p, s: partial_digest(p, int(s), k), path, size)

    return read


@F.pandas_udf(DIGEST)
def full_digest_udf(path: pd.Series) -> pd.DataFrame:
    return _each(full_digest, path)


# ---- EXIF -----------------------------------------------------------------------------------------

# TIFF field types' sizes and the tags that are read.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_EXIF_IFD, _GPS_IFD = 0x8769, 0x8825
_ORIGINAL, _CREATE, _OFFSET, _OFFSET_ORIGINAL = 0x9003, 0x9004, 0x9010, 0x9011


def _ifd(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    (n,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for i in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
        size = _SIZES.get(kind, 1) * count
        start = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        out[tag] = kind, count, data[start : start + size]
    return out


def parse_tiff(data: bytes) -> dict:
    """Dates, offsets and coordinates of a TIFF structure, raw; keys original, create, offset, lat, lon."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    magic, first = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise ValueError("not TIFF")
    main = _ifd(data, first, order)

    def pointer(tag: int) -> dict:
        return _ifd(data, struct.unpack(order + "I", main[tag][2])[0], order) if tag in main else {}

    def text(ifd: dict, tag: int) -> str | None:
        if tag not in ifd or ifd[tag][0] != 2:
            return None
        try:
            return ifd[tag][2].split(b"\0")[0].decode("ascii").strip() or None
        except UnicodeDecodeError:
            return None

    def degrees(gps: dict, tag: int) -> float | None:
        if tag not in gps or gps[tag][0] != 5 or gps[tag][1] < 3:
            return None
        n = struct.unpack(order + "6I", gps[tag][2][:24])
        if not (n[1] and n[3] and n[5]):
            return None
        value = n[0] / n[1] + n[2] / n[3] / 60 + n[4] / n[5] / 3600
        return -value if (text(gps, tag - 1) or "").upper() in ("S", "W") else value

    exif, gps = pointer(_EXIF_IFD), pointer(_GPS_IFD)
    lat, lon = degrees(gps, 2), degrees(gps, 4)
    if lat is None or lon is None or abs(lat) > 90 or abs(lon) > 180:
        lat = lon = None
    return {"original": text(exif, _ORIGINAL), "create": text(exif, _CREATE), "offset": text(exif, _OFFSET_ORIGINAL) or text(exif, _OFFSET), "lat": lat, "lon": lon}


def find_exif(data: bytes) -> bytes | None:
    """The TIFF structure of a JPEG's APP1 segment, an HEIF item, or a TIFF file; None if there is none."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            if data[at + 1] == 0xFF:  # a fill byte
                at += 1
                continue
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if marker == 0xDA:
                return None
            at += 2 + size
        return None
    if data[4:8] == b"ftyp":
        return heif_exif(data)
    raise ValueError("no known container")


def heif_exif(data: bytes) -> bytes | None:
    """The TIFF structure of the Exif item that meta's iinf names and iloc places; None if there is none."""
    for kind, a, b in boxes(data):
        if kind != b"meta":
            continue
        parts = {k: (c, d) for k, c, d in boxes(data, a + 4, b)}
        if b"iinf" not in parts or b"iloc" not in parts:
            return None
        wanted = _exif_items(data, *parts[b"iinf"])
        item = _item(data, wanted, *parts[b"iloc"], parts.get(b"idat")) if wanted else None
        if item is None:
            return None
        (skip,) = struct.unpack_from(">I", item)
        return item[4 + skip :]
    return None


def _exif_items(data: bytes, at: int, end: int) -> set[int]:
    """Ids of the items of type Exif; of that name in entries from before there were types."""
    found = set()
    for kind, a, b in boxes(data, at + (6 if data[at] == 0 else 8), end):
        if kind != b"infe":
            continue
        version = data[a]
        (item,) = struct.unpack_from(">I" if version == 3 else ">H", data, a + 4)
        rest = data[a + (10 if version == 3 else 8) : b]
        if rest[:4] == b"Exif" if version >= 2 else rest.split(b"\0")[0] == b"Exif":
            found.add(item)
    return found


def _item(data: bytes, wanted: set[int], at: int, end: int, idat: tuple[int, int] | None) -> bytes | None:
    """The extents of the first wanted item of iloc, joined; an error if they don't lie in the file."""

    def number(size: int) -> int:
        nonlocal at
        if at + size > end:
            raise ValueError("iloc ends within an entry")
        at += size
        return int.from_bytes(data[at - size : at], "big")

    version, _ = number(1), number(3)
    sizes = number(2)
    offset_size, length_size, base_size, index_size = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    for _ in range(number(4 if version == 2 else 2)):
        item = number(4 if version == 2 else 2)
        method = number(2) & 15 if version else 0
        elsewhere, base = number(2), number(base_size)
        extents = []
        for _ in range(number(2)):
            number(index_size)
            extents.append((base + number(offset_size), number(length_size)))
        if item not in wanted:
            continue
        if elsewhere or method > 1 or method == 1 and idat is None:
            raise ValueError("the item isn't in this file")
        low, high = idat if method == 1 else (0, len(data))
        spans = [(low + a, low + a + n if n else high) for a, n in extents]
        if any(a > b or b > high for a, b in spans) or sum(b - a for a, b in spans) > len(data):
            raise ValueError("an item ends outside its file")
        return b"".join(data[a:b] for a, b in spans)
    return None


def image_metadata(data: bytes) -> dict:
    """naive, offset_s, lat, lon and status: ok, absent, unreadable or unsupported."""
    none = {"naive": None, "offset_s": None, "lat": None, "lon": None}
    if len(data) < 2:
        return none | {"status": "unsupported"}
    recognised = data[:2] in (b"\xff\xd8", b"II", b"MM") or data[4:8] == b"ftyp"
    try:
        tiff = find_exif(data)
        if tiff is None:
            return none | {"status": "absent"}
        found = parse_tiff(tiff)
    except (ValueError, KeyError, struct.error, IndexError):
        return none | {"status": "unreadable" if recognised else "unsupported"}
    out = none | {"lat": found["lat"], "lon": found["lon"]}
    raw = found["original"] or found["create"]
    if raw is None:
        return out | {"status": "absent"}
    got = parse_wall_clock(raw)
    if got is None:
        return out | {"status": "unreadable"}
    offset = got[1] if got[1] is not None else parse_offset(found["offset"]) if found["offset"] else None
    return out | {"naive": got[0], "offset_s": offset, "status": "ok"}


# ---- ISO base media -------------------------------------------------------------------------------


def boxes(data: bytes, at: int = 0, end: int | None = None):
    """(type, body start, body end) of the boxes in a range."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError("a box ends outside its parent")
        yield kind, at + head, at + size
        at += size


def parse_iso6709(text: str) -> tuple[float, float] | None:
    m = re.match(r"([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)(?:[+-]|/|$)", text)
    if not m or abs(float(m[1])) > 90 or abs(float(m[2])) > 180:
        return None
    return float(m[1]), float(m[2])


_EPOCH = datetime(1904, 1, 1)


def video_metadata(data: bytes) -> dict:
    """As ``image_metadata``: the creation date key, else the movie header's instant; the last valid location.

    An undated video has no coordinates. ``kind`` is zoned, instant or wall_clock.
    """
    none = {"naive": None, "offset_s": None, "lat": None, "lon": None, "kind": None}
    if len(data) < 2:
        return none | {"status": "unsupported"}
    dates, instant, place = [], None, None
    try:
        if data[4:8] not in (b"ftyp", b"moov", b"wide", b"mdat", b"free"):
            return none | {"status": "unsupported"}
        for kind, a, b in boxes(data):
            if kind != b"moov":
                continue
            for inner, c, d in boxes(data, a, b):
                if inner == b"mvhd":
                    (t,) = struct.unpack_from(">Q" if data[c] == 1 else ">I", data, c + 4)
                    instant = _EPOCH + timedelta(seconds=t) if t else None
                elif inner == b"udta":
                    for leaf, e, f in boxes(data, c, d):
                        if leaf == b"\xa9xyz":
                            n = struct.unpack_from(">H", data, e)[0]
                            place = parse_iso6709(data[e + 4 : min(e + 4 + n, f)].decode("utf-8", "replace")) or place
                elif inner == b"meta":
                    names, start = [], c if data[c + 4 : c + 8] in (b"hdlr", b"keys") else c + 4
                    for leaf, e, f in boxes(data, start, d):
                        if leaf == b"keys":
                            names = [data[x:y] for _, x, y in boxes(data, e + 8, f)]
                        elif leaf == b"ilst":
                            for number, x, y in boxes(data, e, f):
                                i = struct.unpack(">I", number)[0] - 1
                                for _, p, q in boxes(data, x, y):
                                    value = data[p + 8 : q].decode("utf-8", "replace")
                                    if 0 <= i < len(names) and names[i] == b"com.apple.quicktime.creationdate":
                                        dates.append(value)
                                    elif 0 <= i < len(names) and names[i] == b"com.apple.quicktime.location.ISO6709":
                                        place = parse_iso6709(value) or place
    except (ValueError, struct.error, IndexError, OverflowError):
        return none | {"status": "unreadable"}
    got = next((g for g in map(parse_wall_clock, dates) if g), None)
    where = {"lat": place[0], "lon": place[1]} if place else {}
    if got:
        return none | {"naive": got[0], "offset_s": got[1], "kind": "wall_clock" if got[1] is None else "zoned" if got[1] else "instant", "status": "ok"} | where
    if instant:
        return none | {"naive": instant, "offset_s": 0, "kind": "instant", "status": "ok"} | where
    return none | {"status": "unreadable" if dates else "absent"}


METADATA_STRUCT = T.StructType().add("naive", T.TimestampNTZType()).add("offset_s", "integer").add("lat", "double").add("lon", "double").add("kind", "string").add("status", "string")


def _metadata_at(path: str, media_kind: str) -> dict:
    """A file's metadata; the file is mapped, so only the boxes and directories that are looked at are read."""
    read = video_metadata if media_kind == "video" else image_metadata
    with open(path, "rb") as f:
        if not f.seek(0, 2):
            return {"kind": None} | read(b"")
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return {"kind": None} | read(data)


@F.pandas_udf(METADATA_STRUCT)
def content_metadata_udf(content: pd.Series, media_kind: pd.Series) -> pd.DataFrame:
    """``metadata_udf`` over contents in a column; a null one is unreadable."""
    rows = [_UNREAD if c is None else {"kind": None} | (video_metadata if k == "video" else image_metadata)(bytes(c)) for c, k in zip(content, media_kind, strict=True)]
    return _metadata_frame(rows)


_UNREAD = {"naive": None, "offset_s": None, "lat": None, "lon": None, "kind": None, "status": "unreadable"}


def _metadata_frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["naive", "offset_s", "lat", "lon", "kind", "status"])
    return out.astype({"naive": "datetime64[us]", "offset_s": "Int32", "lat": "float64", "lon": "float64"})


@F.pandas_udf(METADATA_STRUCT)
def metadata_udf(path: pd.Series, media_kind: pd.Series) -> pd.DataFrame:
    rows = []
    for p, k in zip(path, media_kind, strict=True):
        try:
            rows.append(_metadata_at(p, k))
        except OSError:
            rows.append(_UNREAD)
    return _metadata_frame(rows)
