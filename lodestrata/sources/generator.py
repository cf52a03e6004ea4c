"""A seeded library of file rows for tests and trials, of any size."""

from __future__ import annotations

import random
import struct
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places that generated files are taken at: on each side of the equator and of both meridians, one beside the antimeridian.
PLACES = [("Oslo", "NO", 59.9139, 10.7522), ("Quito", "EC", -0.1807, -78.4678), ("Nairobi", "KE", -1.2921, 36.8219), ("Perth", "AU", -31.9523, 115.8613), ("Apia", "WS", -13.8333, -171.7667), ("Suva", "FJ", -18.1416, 178.4419), ("Accra", "GH", 5.6037, -0.187), ("Anchorage", "US", 61.2181, -149.9003), ("Hanoi", "VN", 21.0278, 105.8342), ("Ushuaia", "AR", -54.8019, -68.303)]
#: Photos, videos, raw files with an XMP each, and duplicates of each profile; whether it has malformed files.
PROFILES = {"minimal": (8, 1, 2, 2, False), "realistic": (64, 8, 8, 16, False), "awkward": (15, 3, 2, 9, True), "stress": (500, 50, 50, 100, False)}
#: Names that are awkward on one system or another.
AWKWARD = ["a  b.jpg", "żółw.jpg", "--long-option.jpg", "tab\tin it.jpg", "LOUD.JPG"]


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLACES, "name string, country string, lat double, lon double")


def library(spark: SparkSession, n: int, seed: int = 42, copies: float = 0.1) -> DataFrame:
    """``n`` files with path, extension, content, time and coordinates; about a share ``copies`` repeats another's content."""
    h = F.xxhash64(F.lit(seed), "id")
    base = spark.range(n).withColumns({"h": h, "of": F.when(F.pmod(h, F.lit(1000)) < int(copies * 1000), F.pmod(h, F.lit(max(1, n // 2)))).otherwise(F.col("id"))})
    place = F.element_at(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for _, _, a, o in PLACES]), (F.pmod(h, F.lit(len(PLACES))) + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "heic", "cr2", "mov"))), (F.pmod(h, F.lit(4)) + 1).cast("int"))
    return base.select(
        F.concat(F.lit("in/"), F.pmod("h", F.lit(7)).cast("string"), F.lit("/IMG_"), F.lpad(F.col("id").cast("string"), 8, "0"), F.lit("."), ext).alias("path"),
        ext.alias("extension"), F.encode(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("of").cast("string")), 256), "UTF-8").alias("content"),
        F.timestamp_seconds(1_500_000_000 + F.pmod("h", F.lit(200_000_000))).cast("timestamp_ntz").alias("ts"), place["lat"].alias("lat"), place["lon"].alias("lon"),
    )


def _ifd(entries: list[tuple[int, int, int, bytes]], at: int, nxt: int = 0) -> bytes:
    """A TIFF directory at offset ``at`` of (tag, type, count, value bytes), values of over four bytes after it."""
    body, head = b"", struct.pack("<H", len(entries))
    tail = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in sorted(entries):
        if len(value) > 4:
            head += struct.pack("<HHII", tag, kind, count, tail + len(body))
            body += value + b"\0" * (len(value) % 2)
        else:
            head += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
    return head + struct.pack("<I", nxt) + body


def photo(text: str | None, offset: str | None = None, place: tuple[float, float] | None = None, note: str = "") -> bytes:
    """A JPEG with an EXIF date, and an offset and coordinates where given; without any segment if there is no date text."""
    marker = b"\xff\xfe" + struct.pack(">H", len(note.encode()) + 2) + note.encode()
    if text is None and place is None:
        return b"\xff\xd8" + marker + b"\xff\xd9"
    words = [(tag, 2, len(t) + 1, t.encode() + b"\0") for tag, t in ((0x9003, text), (0x9011, offset)) if t]
    dates = _ifd(words, 8 + 30)
    gps = b""
    if place:
        at = 8 + 30 + len(dates)
        parts = [(2 * k + 2, 5, 3, struct.pack("<6I", *(n for part in (int(d), int(d * 60) % 60) for n in (part, 1)), round(d * 3600 % 60 * 1000), 1000)) for k, d in enumerate(map(abs, place))]
        refs = [(1, 2, 2, b"N\0" if place[0] >= 0 else b"S\0"), (3, 2, 2, b"E\0" if place[1] >= 0 else b"W\0")]
        gps = _ifd(refs + parts, at)
    pointers = [(0x8769, 4, 1, struct.pack("<I", 38)), (0x8825, 4, 1, struct.pack("<I", 38 + len(dates)))][: 2 if place else 1]
    tiff = b"II" + struct.pack("<HI", 42, 8) + _ifd(pointers, 8).ljust(30, b"\0") + dates + gps
    segment = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + marker + b"\xff\xd9"


def video(at: datetime, place: tuple[float, float] | None, note: str = "") -> bytes:
    """A QuickTime file with a creation time and, where given, an ISO 6709 location."""

    def box(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I4s", 8 + len(body), kind) + body

    seconds = int((at - datetime(1904, 1, 1)).total_seconds())
    where = f"{place[0]:+08.4f}{place[1]:+09.4f}/".encode() if place else b""
    udta = box(b"udta", box(b"\xa9xyz", struct.pack(">HH", len(where), 0) + where)) if place else b""
    return box(b"ftyp", b"qt  ") + box(b"moov", box(b"mvhd", struct.pack(">III", 0, seconds, seconds)) + udta) + box(b"free", note.encode())


def xmp(at: datetime) -> bytes:
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:exif="http://ns.adobe.com/exif/1.0/" exif:DateTimeOriginal="{at.isoformat()}"/></rdf:RDF></x:xmpmeta>'.encode()


def write(directory: str | Path, profile: str = "realistic", seed: int = 42) -> int:
    """Writes a library of small media into an empty or new directory with EXPECTED.md, what should become of each; returns how many.

    The same profile and seed give the same bytes.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}: one of {', '.join(PROFILES)}")
    root = Path(directory)
    if root.is_dir() and any(root.iterdir()):
        raise FileExistsError(f"{root} is not empty")
    n_photos, n_videos, n_raw, n_copies, malformed = PROFILES[profile]
    rng, made = random.Random(f"{profile}:{seed}"), []

    def put(rel: str, data: bytes, what: str, expect: str, bad: bool = False) -> None:
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_bytes(data)
        made.append((rel, what, expect, bad))

    def when() -> datetime:
        return datetime(2015, 1, 1) + timedelta(seconds=rng.randrange(9 * 365 * 86400))

    photos = []
    for i in range(n_photos):
        at, place = when(), rng.choice(PLACES)[2:] if rng.random() < 0.7 else None
        data, rel = photo(at.strftime("%Y:%m:%d %H:%M:%S"), rng.choice(["+00:00", "+09:00", "-05:00", "+01:00"]), place, f"photo {i} {seed}"), f"camera/{i % 5}/IMG_{i:04d}.jpg"
        photos.append((rel, data))
        put(rel, data, "photo", f"filed {at:%Y-%m-%d}")
    for i in range(n_videos):
        at = when()
        put(f"video/MOV_{i:04d}.mov", video(at, rng.choice(PLACES)[2:], f"video {i} {seed}"), "video", f"filed near {at:%Y-%m-%d}")
    for i in range(n_raw):
        at = when()
        put(f"raw/DSC_{i:04d}.cr2", b"II" + struct.pack("<HIHI", 42, 8, 0, 0) + f"raw {i} {seed}".encode(), "raw", f"filed {at:%Y-%m-%d}")
        put(f"raw/DSC_{i:04d}.xmp", xmp(at), "sidecar", f"travels with raw/DSC_{i:04d}.cr2")
    for i in range(3):
        put(f"undated/scan_{i}.jpg", photo(None, note=f"undated {i} {seed}"), "undated photo", "filed by the file system's date")
    put("undated/local.jpg", photo(when().strftime("%Y:%m:%d %H:%M:%S"), note=f"no offset {seed}"), "photo without an offset", "filed, zone from the settings")
    for i in range(n_copies):
        rel, data = photos[i % len(photos)]
        put(f"backup/{i // len(photos)}/deep/{i:04d}_{Path(rel).name}", data, "copy", f"duplicate of {rel}")
    for name in ("notes.txt", "index.html", "sub/list.csv"):
        put(f"other/{name}", b"not media", "bystander", "untouched")
    if malformed:
        for name, data in {"zero.jpg": b"", "one.jpg": b"x", "corrupt.jpg": b"\xff\xd8\xff\xe1\0\x10Exif\0\0II*\0\xff\xff\xff\xff", "zeros.jpg": photo("0000:00:00 00:00:00"), "nowhere.jpg": photo(None, place=(1.5, 2.5)), "beyond.jpg": photo("2020:01:01 10:00:00", None, (91.5, 181.5))}.items():
            put(f"malformed/{name}", data, "malformed", "never fatal", True)
        for name in AWKWARD:
            put(f"awkward/{name}", photo("2021:05:06 07:08:09", "+00:00", None, name), "awkward name", "filed 2021-05-06", True)
        put("awkward/orphan.xmp", xmp(when()), "orphan sidecar", "untouched", True)
        (root / "empty").mkdir()
    rows = "".join(f"| {repr(rel)[1:-1]} | {what} | {expect} | {'yes' if bad else 'no'} |\n" for rel, what, expect, bad in made)
    (root / "EXPECTED.md").write_text("| Path | What | Expectation | Malformed |\n|-|-|-|-|\n" + rows, encoding="utf-8")
    return len(made)
