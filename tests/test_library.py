import json
import math
import os
import random
import struct
import unicodedata
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import dates, geo, names, paths
from lodestrata.operators import cascade, ledger, numbering, pairing, verify
from lodestrata.plans import settings as conf
from lodestrata.plans import sink, undo
from lodestrata.sources import generator, journal, manifest, media, readers, xmp


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_ledger_takes_the_first_free_name():
    assert ledger.claim(["a.jpg", "a.jpg", "a.jpg", "a-1.jpg"], set()) == ["a.jpg", "a-1.jpg", "a-2.jpg", "a-1-1.jpg"]
    assert ledger.claim(["x"], {"x", "x-1"}) == ["x-2"]


def test_ledger_over_frames(spark):
    rows = [("d", "a.jpg", 1), ("d", "a.jpg", 2), ("d", "a-1.jpg", 3), ("e", "a.jpg", 4)]
    there = spark.createDataFrame([("e", "a.jpg"), ("f", "z")], "directory string, name string")
    got = ledger.assign(spark.createDataFrame(rows, "directory string, name string, k int"), ["k"], there).orderBy("k").collect()
    assert [r.final_name for r in got] == ["a.jpg", "a-1.jpg", "a-1-1.jpg", "a-1.jpg"]


NAMES = ["a.jpg", "a-1.jpg", "a-2.jpg", "a-1-1.jpg", "a-01.jpg", "a", "a-1", ".a", ".a-1", "a-1.b-2", "a.b-2", "2021-10-12-123456.jpg", "2021-10-12.jpg", "2021-10.jpg", "b-9999.x", "b-10000.x", "b.x", "c-\n", "x.", "x-1."]


def test_ledger_is_the_sequential_one(spark):
    """Many directories of random names, planned and existing, at once; the n-th row by order claims what it would claim one by one."""
    r = random.Random(11)
    planned, there, want, k = [], [], {}, 0
    for d in range(150):
        some = r.sample(NAMES, r.randint(1, 6))
        held = {r.choice([n, ledger.candidate(n, r.randint(0, 4))]) for n in r.choices(NAMES, k=r.randint(0, 8))}
        own = r.choices(some, k=r.randint(1, 14))
        for n, got in zip(own, ledger.claim(own, set(held)), strict=True):
            planned.append((f"d{d}", n, k, "x"))
            want[k] = got
            k += 1
        there += [(f"d{d}", n) for n in held] + [(f"e{d}", n) for n in held]
    df = spark.createDataFrame(planned, "directory string, name string, k int, more string").repartition(5)
    got = ledger.assign(df, ["k"], spark.createDataFrame(there, "directory string, name string"))
    assert got.columns == ["directory", "name", "k", "more", "final_name"] and {x.k: x.final_name for x in got.collect()} == want
    alone = ledger.assign(df, ["k"])
    per = {}
    for d, n, i, _ in planned:
        per.setdefault(d, []).append((i, n))
    assert {x.k: x.final_name for x in alone.collect()} == {i: g for rows in per.values() for (i, _), g in zip(rows, ledger.claim([n for _, n in rows], set()), strict=True)}


def test_ledger_runs_out(spark, monkeypatch):
    monkeypatch.setattr(ledger, "ATTEMPTS", 4)
    for names_ in (["a.jpg"] * 6, ["a.jpg"] * 6 + ["a-1.jpg"] * 6):
        df = spark.createDataFrame([("d", n, i) for i, n in enumerate(names_)], "directory string, name string, k int")
        there = spark.createDataFrame([("d", "a-2.jpg")], "directory string, name string")
        got = {r.k: r.final_name for r in ledger.assign(df, ["k"], there).collect()}
        assert [got[i] for i in range(len(names_))] == ledger.claim(names_, {"a-2.jpg"}, 4)


def test_names_of_the_template_are_no_family(spark, monkeypatch):
    """Names as the engine makes them never come to the sequential ledger, whatever their numbers."""
    monkeypatch.setattr(ledger, "claim", lambda *a: 1 / 0)
    rows = [(f"2021-{m:02d}-{d:02d}", f"2021-{m:02d}-{d:02d}-{h:02d}3456{p}.jpg") for m in (1, 10, 12) for d in (1, 10, 11) for h in (0, 9, 12) for p in ("", "-Rio-BR") for _ in range(3)]
    rows += [("d", n) for n in ("IMG-1234.jpg", "IMG-1235.jpg", "IMG-1235.jpg", "IMG_0001.jpg")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "directory string, name string, k int")
    got = ledger.assign(df, ["k"], spark.createDataFrame([("d", "IMG.jpg"), ("d", "IMG-1234.jpg")], "directory string, name string")).collect()
    assert len({(r.directory, r.final_name) for r in got}) == len(rows)
    assert {r.final_name for r in got if r.directory == "d"} == {"IMG-1234-1.jpg", "IMG-1235.jpg", "IMG-1235-1.jpg", "IMG_0001.jpg"}


@given(st.lists(st.sampled_from(["a.jpg", "a-1.jpg", "a", ".a", "a-1-1.jpg", "b.x.y"]), max_size=30))
def test_ledger_never_repeats(some):
    out = ledger.claim(some, set())
    assert len(set(out)) == len(out)


def test_cascade_bands_and_conservation(spark):
    k = 4
    contents = [b"", b"", b"a", b"abcd", b"abcde", b"abcdefgh", b"abcdefghi", b"abcdXfghi", b"abcdXfghi", None]
    df = spark.createDataFrame([(f"p/{i}", bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "path string, content binary")
    out = {r.path: r for r in cascade.classify(df, k=k).collect()}
    assert len(out) == len(contents)
    assert [out[f"p/{i}"].role for i in range(10)] == ["original", "duplicate", "unique", "unique", "unique", "unique", "unique", "original", "duplicate", "skipped"][:6] + ["unique", "original", "duplicate", "skipped"]
    assert out["p/2"].known_hash is None and out["p/6"].known_hash is not None


def brute_roles(rows, k):
    """(path -> (role, copies)) of (path, content) by whole contents alone."""
    of = {}
    for p, c in rows:
        if c is not None:
            of.setdefault(c, []).append(p)
    first = {c: min(ps, key=lambda p: (p.count("/"), p.split("/"))) for c, ps in of.items()}
    return sorted((p, "skipped" if c is None else "unique" if len(of[c]) == 1 else "original" if p == first[c] else "duplicate", 1 if c is None else len(of[c])) for p, c in rows)


@pytest.mark.parametrize("exact", [1 << 20, 0])
def test_whole_contents_only_where_ends_agree(spark, monkeypatch, exact):
    """Shared ends as they are, and as bits; digests are taken of nothing else, and the result scans no content."""
    monkeypatch.setattr(cascade, "EXACT", exact)
    r = random.Random(2)
    rows = [(f"d{i % 7}/{i}", r.choice([b"head", b"HEAD"]) + bytes([r.randrange(3)]) * r.choice([0, 1, 9, 9, 40]) + b"tail") for i in range(300)] + [(f"u{i}", b"head%03d" % i + b"-" * 30 + b"tail") for i in range(200)] + [("n", None), ("e1", b""), ("e2", b"")]
    df = spark.createDataFrame([(p, c if c is None else bytearray(c), i) for i, (p, c) in enumerate(rows)], "path string, content binary, i int").repartition(6)
    got = cascade.classify(df, k=4)
    assert "Scan ExistingRDD" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "content" not in plan and "sha2" not in plan
    found = got.collect()
    assert "content" not in got.columns and {x.i for x in found} == set(range(len(rows)))
    assert sorted((x.path, x.role, x.copies) for x in found) == brute_roles(rows, 4)
    ends = Counter((len(c), c[:4] + c[-4:]) for _, c in rows if c is not None and len(c) > 8) + Counter((len(c), c[:4]) for _, c in rows if c is not None and 4 < len(c) <= 8)
    left = {i for i, (_, c) in enumerate(rows) if c is not None and len(c) > 4 and ends[len(c), c[:4] + c[-4:] if len(c) > 8 else c[:4]] > 1}
    digested = {x.i for x in found if x.digested}
    assert digested == left if exact else left <= digested and len(digested) < len(left) + 20
    w = cascade.work(got, 4).first()
    assert w.full_files == len(digested) and w.full_bytes == sum(len(rows[i][1]) for i in digested) and w.n_files == 502


def test_nothing_to_classify(spark):
    df = spark.createDataFrame([], "path string, content binary")
    assert cascade.classify(df).count() == 0 and cascade.work(cascade.classify(df)).first().n_files == 0


def test_original_is_shallowest_then_by_component(spark):
    df = spark.createDataFrame([("a/b/x", bytearray(b"1")), ("a-b", bytearray(b"1")), ("z", bytearray(b"1"))], "path string, content binary")
    assert {r.path: r.role for r in cascade.classify(df).collect()} == {"a/b/x": "duplicate", "a-b": "original", "z": "duplicate"}


def test_pairing_cases(spark):
    m = spark.createDataFrame([("d/IMG.jpg",), ("d/IMG.heic",), ("d/b.cr2",), ("e/b.cr2",)], "path string")
    c = spark.createDataFrame([("d/IMG.xmp",), ("d/b.CR2.xmp",), ("d/B.XMP",), ("e/q.xmp",)], "path string")
    got = {r.path: (r.parent, r.convention, r.reason) for r in pairing.pair(m, c).collect()}
    assert got == {"d/IMG.xmp": (None, None, "ambiguous"), "d/b.CR2.xmp": ("d/b.cr2", "full_name", None), "d/B.XMP": ("d/b.cr2", "stem", None), "e/q.xmp": (None, None, "no_parent")}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_sanitise_leaves_one_safe_component(spark, texts):
    texts = [t for t in texts if "\0" not in t and not any(unicodedata.category(c) == "Cs" for c in t)] or ["x"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.one_component(names.sanitise(F.col("t"))).alias("s")).collect():
        assert r.s and "/" not in r.s and not r.s.startswith(".") and "\0" not in r.s


def test_templates_are_refused():
    for bad in ("", "/a", "a/../b", "a\0", "%Q"):
        with pytest.raises(names.TemplateError):
            names.strftime_pattern(bad)
    for bad in ("{nope}", "{date", "a/b", "}"):
        with pytest.raises(names.TemplateError):
            names.parse_template(bad)
    with pytest.raises(paths.PatternError):
        paths.glob_regex("[a")


def test_dates(spark):
    w = lambda t: tuple(one(spark, w=dates.wall_clock(F.lit(t))).w)
    assert w("2024:01:02 03:04:05") == (datetime(2024, 1, 2, 3, 4, 5), None)
    assert w("2024-01-02T03:04:05") == (datetime(2024, 1, 2, 3, 4, 5), None)
    assert w("2024-01-02T03:04:05+08") == (datetime(2024, 1, 2, 3, 4, 5), 28800)
    assert w("2024-01-02 03:04:05-0330") == (datetime(2024, 1, 2, 3, 4, 5), -12600)
    assert w("2024-01-02 03:04:05") == (None, None)
    assert w("0000:00:00 00:00:00") == (None, None)
    for text in ("2024:01:02 03:04:05", "2024-01-02T03:04:05+08", "2024-01-02 03:04:05-0330", "nonsense"):
        assert (readers.parse_wall_clock(text) or (None, None)) == w(text)
    off = lambda t, z: one(spark, o=dates.offset_in(F.lit(t).cast("timestamp_ntz"), z)).o
    assert off("2024-10-27 01:30:00", "Europe/London") == 3600  # overlap: the earlier one
    assert off("2024-03-31 01:30:00", "Europe/Lisbon") == 3600  # gap: the digits as UTC
    assert off("2024-01-15 12:00:00", "Asia/Tokyo") == 32400


def test_geo(spark):
    p = lambda t: tuple(one(spark, p=geo.iso6709(F.lit(t))).p)
    for text, want in (("+48.8577+002.295/", (48.8577, 2.295)), ("+48.8577-002.295+35.6/", (48.8577, -2.295)), ("-33.8688+302.2093/", (None, None)), ("+nan+1/", (None, None))):
        assert p(text) == want
        assert (readers.parse_iso6709(text) or (None, None)) == want
    places = generator.places(spark)
    pts = spark.createDataFrame([(1, 48.0, 2.0), (2, -34.0, 150.0), (3, 64.0, -179.9), (4, 95.0, 0.0), (5, -80.0, 10.0)], "k int, lat double, lon double")
    small = {r.k: r.place for r in geo.nearest(pts, places, "k").collect()}
    assert small[1] == "Oslo" and small[2] == "Perth" and small[3] == "Anchorage" and small[4] is None


def test_nearest_by_cells_is_the_nearest(spark):
    r = random.Random(5)
    where = lambda lon: (r.uniform(-90, 90), lon)
    sparse = [(0.0, -179.5), (0.0, -172.0)]  # the advice's example
    pacific = [*sparse, *(where(r.uniform(-180, -128)) for _ in range(25)), *(where(r.uniform(150, 180)) for _ in range(25)), (10.0, 180.0), (20.0, -180.0), (90.0, 7.0), (-90.0, 7.0)]
    world = [where(r.uniform(-180, 180)) for _ in range(60)]
    points = [(0.0, -177.0), (0.0, 179.9), (10.0, -180.0), (20.0, 180.0), (89.0, -170.0), (-89.5, 100.0), *(where(r.choice([r.uniform(-180, -120), r.uniform(120, 180), r.uniform(-180, 180)])) for _ in range(150))]

    def xyz(lat, lon):
        a, b = math.radians(lat), math.radians(lon)
        return math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)

    for spots in (sparse, pacific, pacific + world):
        places = spark.createDataFrame([(str(i), "x", *s) for i, s in enumerate(spots)], "name string, country string, lat double, lon double")
        got = {row.k: row.place for row in geo.nearest(spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lat double, lon double"), places, "k").collect()}
        for k, p in enumerate(points):
            far = [math.dist(xyz(*p), xyz(*s)) for s in spots]
            assert far[int(got[k])] <= min(far) + 1e-12, (p, spots[int(got[k])])


def test_settings_layers(tmp_path):
    s = conf.merge({"user": {"chunk_size": 5, "extensions": {"video": ["mp4"]}}, "environment": conf.env_layer({"LODESTRATA_CHUNK_SIZE": "7", "OTHER": "x"})})
    assert s.values["chunk_size"] == 7 and s.source["chunk_size"] == "environment"
    assert s.values["extensions"]["video"] == ["mp4"] and len(s.values["extensions"]["image"]) == 21
    for bad in ({"LODESTRATA_NOPE": "1"}, {"LODESTRATA_HASH_THREADS": "0"}, {"LODESTRATA_COMMIT": "true"}):
        with pytest.raises(conf.SettingsError):
            conf.env_layer(bad)
    (tmp_path / ".lodestrata.toml").write_text("chunk_size = 3\n")
    (tmp_path / "a/b").mkdir(parents=True)
    assert conf.find_project_file(tmp_path / "a/b") == tmp_path / ".lodestrata.toml"
    (tmp_path / "bad.toml").write_text("chunk_size = \n")
    with pytest.raises(conf.SettingsError, match="line 1"):
        conf.file_layer(tmp_path / "bad.toml")
    conf.write_starter(tmp_path / "s.toml")
    with pytest.raises(FileExistsError):
        conf.write_starter(tmp_path / "s.toml")
    with pytest.raises(conf.SettingsError):
        conf.check_safety({"commit": True, "no_journal": True})


def jpeg(original: bytes, offset: bytes | None = None) -> bytes:
    entries = [(0x9003, original + b"\0")] + ([(0x9011, offset + b"\0")] if offset else [])
    body, at = b"", 26 + 2 + 12 * len(entries) + 4
    ifd = struct.pack("<H", len(entries))
    for tag, text in entries:
        ifd += struct.pack("<HHII", tag, 2, len(text), at + len(body))
        body += text
    tiff = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<HHHII", 1, 0x8769, 4, 1, 26) + struct.pack("<I", 0) + ifd + struct.pack("<I", 0) + body
    seg = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(seg) + 2) + seg + b"\xff\xd9"


def test_image_and_video_metadata():
    m = readers.image_metadata(jpeg(b"2024:01:02 03:04:05", b"+08:00"))
    assert (m["naive"], m["offset_s"], m["status"]) == (datetime(2024, 1, 2, 3, 4, 5), 28800, "ok")
    assert readers.image_metadata(jpeg(b"nonsense"))["status"] == "unreadable"
    assert readers.image_metadata(b"\xff\xd8\xff\xd9")["status"] == "absent"
    assert readers.image_metadata(b"hello there")["status"] == "unsupported" == readers.image_metadata(b"x")["status"]
    box = lambda k, b: struct.pack(">I4s", 8 + len(b), k) + b
    mvhd = box(b"mvhd", struct.pack(">II", 0, 3_786_912_000))
    v = readers.video_metadata(box(b"ftyp", b"qt  ") + box(b"moov", mvhd + box(b"udta", box(b"\xa9xyz", struct.pack(">HH", 17, 0) + b"+48.8577+002.295/"))))
    assert (v["naive"], v["kind"], v["lat"]) == (datetime(2024, 1, 1), "instant", 48.8577)


def heif(tiff: bytes, infe: int = 2, name: bytes = b"Exif\0", iloc: int = 0, method: int = 0, head: bytes = b"Exif\0\0", cut: int | None = None) -> bytes:
    """As the reference's synth_heif; also other versions of infe and iloc, an item in idat, and one in two extents."""
    box = lambda k, b: struct.pack(">I4s", 8 + len(b), k) + b
    full = lambda k, v, b: box(k, struct.pack(">I", v << 24) + b)
    item = struct.pack(">I", len(head)) + head + tiff
    entry = full(b"infe", infe, struct.pack(">IH" if infe == 3 else ">HH", 7, 0) + (b"Exif" if infe > 1 else b"") + name)
    iinf = full(b"iinf", 0, struct.pack(">H", 2) + full(b"infe", 2, struct.pack(">HH", 1, 0) + b"hvc1\0") + entry)
    wide = ">I" if iloc == 2 else ">H"

    def located(number: int, extents: list[tuple[int, int]], how: int) -> bytes:
        return struct.pack(wide, number) + (struct.pack(">H", how) if iloc else b"") + struct.pack(">HH", 0, len(extents)) + b"".join(struct.pack(">II", *e) for e in extents)

    def whole(at: int) -> bytes:
        extents = [(at, len(item))] if cut is None else [(at, cut), (at + cut, len(item) - cut)]
        body = b"\x44\0" + struct.pack(wide, 2) + located(1, [(0, 4)], 0) + located(7, extents, method)
        meta = full(b"meta", 0, full(b"hdlr", 0, b"\0" * 4 + b"pict" + b"\0" * 13) + iinf + full(b"iloc", iloc, body) + (box(b"idat", item) if method else b""))
        return box(b"ftyp", b"heic\0\0\0\0heicmif1") + meta + box(b"free", b"x")

    start = 0 if method else len(whole(0)) + 8
    return whole(start) + (b"" if method else box(b"mdat", item))


@pytest.mark.parametrize("how", [{}, {"name": b"\0"}, {"name": b"", "head": b""}, {"infe": 0}, {"infe": 3, "iloc": 2}, {"iloc": 1, "method": 1}, {"iloc": 1, "cut": 9}], ids=str)
def test_exif_in_heif(how):
    data = generator.photo("2020:01:02 03:04:05", "+09:00", (-33.8688, 151.2093))
    tiff = readers.find_exif(data)
    assert readers.image_metadata(heif(tiff, **how)) == readers.image_metadata(data) and readers.image_metadata(data)["status"] == "ok"


def test_heif_without_exif():
    tiff = readers.find_exif(jpeg(b"2024:01:02 03:04:05"))
    status = lambda data: readers.image_metadata(data)["status"]
    assert status(heif(tiff, infe=0, name=b"other\0")) == "absent" == status(b"\0\0\0\x0cftypheic")
    assert status(heif(tiff)[:-1]) == "unreadable" == status(heif(tiff, iloc=1, method=2))


@given(st.binary(max_size=60), st.integers(0, 400))
def test_malformed_heif_never_raises(data, at):
    whole = heif(readers.find_exif(jpeg(b"2024:01:02 03:04:05")))
    assert readers.image_metadata(whole[:at] + data + whole[at + len(data) :])["status"] in ("ok", "absent", "unreadable", "unsupported")


def test_fill_bytes_before_a_marker():
    data = jpeg(b"2024:01:02 03:04:05")
    assert readers.find_exif(data[:2] + b"\xff\xff" + data[2:]) == readers.find_exif(data) is not None


@given(st.binary(max_size=200))
def test_malformed_media_never_raises(data):
    for prefix in (b"", b"\xff\xd8", b"II*\0\x08\0\0\0", b"\0\0\0\x08ftyp"):
        assert readers.image_metadata(prefix + data)["status"] in ("ok", "absent", "unreadable", "unsupported")
        assert readers.video_metadata(prefix + data)["status"] in ("ok", "absent", "unreadable", "unsupported")
    xmp.parse(data)


def test_scan_lists_what_is_there(spark, tmp_path):
    for rel, text in {"a/x.JPG": "1", "a/.hidden.png": "", "_u/y.mov": "22", "skip/z.jpg": "3", ".lodestrata/j.jpg": "4", "n.txt": "5", "a/s.XMP": "6"}.items():
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text(text)
    os.symlink(tmp_path / "a/x.JPG", tmp_path / "link.jpg")
    got = media.scan(spark, [str(tmp_path), str(tmp_path / "n.txt")], ["skip"]).collect()
    assert sorted((r.rel_path, r.kind, r.size) for r in got if r.status == "ok") == [("_u/y.mov", "video", 2), ("a/.hidden.png", "image", 0), ("a/s.XMP", "sidecar", 1), ("a/x.JPG", "image", 1)]
    assert [r.rel_path for r in got if r.status == "excluded"] == ["skip"]
    digests = media.scan(spark, [str(tmp_path)]).where("kind <> 'sidecar'").select("rel_path", readers.partial_digest_udf(4)("path", "size").alias("d"), readers.full_digest_udf("path").alias("f")).collect()
    assert all(r.d.digest == r.f.digest for r in digests)
    assert readers.full_digest_udf.func(__import__("pandas").Series(["/nope"]))["digest"][0] is None


def test_one_wide_directory_is_many_tasks(spark, tmp_path):
    """A root with a single directory of many: split below it, with the rows that the source itself gives."""
    for i in range(120):
        d = tmp_path / "all" / f"{i:03d}"
        (d / "deep/er").mkdir(parents=True)
        (d / "a.jpg").write_text("x")
        (d / "deep/er/b.mov").write_text("yy")
        (d / "deep/skip").mkdir()
        (d / "deep/skip/c.jpg").write_text("z")
    (tmp_path / "all" / "top.png").write_text("1")
    (tmp_path / "all" / "007" / "locked").symlink_to("/nowhere")
    got = media.scan(spark, [str(tmp_path)], ["skip"], subtrees=40)
    rows = sorted(map(tuple, got.collect()), key=repr)
    source = spark.read.format("lodestrata_media").option("roots", json.dumps([str(tmp_path)])).option("skip", '["skip"]').load()
    assert rows == sorted(map(tuple, source.collect()), key=repr) and len(rows) == 361
    assert source.rdd.getNumPartitions() == 1 and len({r.p for r in got.where("kind = 'video'").select(F.spark_partition_id().alias("p")).collect()}) > 4
    assert media.scan(spark, [str(tmp_path / "nope")]).count() == 0
    flat = sorted(map(tuple, media.scan(spark, [str(tmp_path)], ["skip"], subtrees=1).collect()), key=repr)
    assert flat == rows == sorted(map(tuple, media.scan(spark, [str(tmp_path)], ["skip"], subtrees=10**6).collect()), key=repr)


def test_commit_then_undo_restores_the_tree(spark, tmp_path):
    tree = {"in/a.jpg": "1", "in/b.jpg": "2", "in/b.xmp": "s", "in/c.jpg": "1"}
    for rel, text in tree.items():
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text(text)
    p = lambda r: str(tmp_path / r)
    rows = [
        {"source": p("in/c.jpg"), "destination": p("out/duplicates/000/c.jpg"), "size": 1, "hash": None, "group": 0, "companions": []},
        {"source": p("in/a.jpg"), "destination": p("out/2024/x.jpg"), "size": 1, "hash": readers.full_digest(p("in/a.jpg")), "group": None, "companions": []},
        {"source": p("in/b.jpg"), "destination": p("out/2024/x.jpg"), "size": 1, "hash": None, "group": None, "companions": [{"path": p("in/b.xmp"), "convention": "stem"}]},
    ]
    j = journal.Writer(tmp_path / "20240101-000000-abcdef.jsonl", "r", "2024-01-01T00:00:00Z", "out", [])
    out = sink.execute(rows, j)
    j.close()
    assert out.moved == 4 and sorted(os.listdir(tmp_path / "out/2024")) == ["x-1.jpg", "x-1.xmp", "x.jpg"]
    (tmp_path / "in/a.jpg").write_text("squatter")
    entries = journal.read(spark, str(tmp_path / "*.jsonl"))
    steps = [r.asDict() for r in undo.restore_plan(entries).collect()]
    assert undo.unresolved(entries).count() == 0 and not undo.runs(entries).first().interrupted
    j2 = journal.Writer(tmp_path / "undo.jsonl", "u", "2024-01-02T00:00:00Z", "out", [])
    counts = sink.restore(steps, j2, str(tmp_path / "out"))
    j2.close()
    assert counts["restored"] == 3 and counts["conflicted"] == 1
    assert (tmp_path / "in/a-1.jpg").read_text() == "1" and not (tmp_path / "out/2024").exists()


def test_journal_faults(spark, tmp_path):
    head = json.dumps({"schema_version": 1, "run_id": "r", "started_at": "2024-01-01T00:00:00Z", "version": "1", "output_dir": "o", "argv": []})
    ok = json.dumps({"type": "move_failed", "seq": 1, "reason": "x"})
    cases = {"whole": f"{head}\n{ok}\n", "torn": f'{head}\n{ok}\n{{"type":"mo', "middle": f"{head}\nnot json\n{ok}\n", "newer": head.replace('"schema_version": 1', '"schema_version": 2') + "\n", "empty": ""}
    for name, text in cases.items():
        (tmp_path / f"{name}.jsonl").write_text(text)
    for name in ("whole", "torn"):
        assert journal.read(spark, str(tmp_path / f"{name}.jsonl")).count() == 1
    for name in ("middle", "newer", "empty"):
        with pytest.raises(journal.JournalError):
            journal.read(spark, str(tmp_path / f"{name}.jsonl"))
    assert [p.name for p in journal.newest_first(str(tmp_path))][0] == "whole.jsonl" and journal.newest_first("/nope") == []


def test_verdicts_and_manifest(spark):
    o = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "group_id int, digest string")
    c = spark.createDataFrame([(1, "a"), (1, "a"), (3, "x"), (2, "q")], "group_id int, digest string")
    v = verify.group_verdicts(o, c)
    assert {r.group_id: r.verdict for r in v.collect()} == {1: "confirmed", 2: "original_missing", 3: "mismatch", 4: "confirmed"}
    assert verify.exit_code(v) == 1 and verify.exit_code(v.where("group_id in (1, 4)")) == 0 and verify.exit_code(v.where("false")) == 0


def test_manifests_are_written_in_segments(spark, tmp_path):
    """A group with most of the rows lies in several pieces, and its file is the same as if it had been written at once."""
    g = spark.createDataFrame([(1, 7, "ab", 3, "in/k\n"), (2, 1000, "cd", 4, "in/\té")], "group_id int, number int, hash string, size int, original string")
    m = spark.createDataFrame([(1, f"in/é{i:05d}") for i in range(3000)] + [(2, "in/b"), (2, "in/a\r")], "group_id int, path string").repartition(7)
    lines = manifest.lines(g, m)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = manifest.write(lines, str(tmp_path / "m")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([r for r in parts if r.group_id == 1]) > 1
    want = "".join(f"{x}\n" for x in ("# Duplicate group 007", "# SHA-256: ab", "# File size: 3 bytes", "# Original kept at: in/k\\n", "#", *(f"in/é{i:05d}" for i in range(3000))))
    assert (tmp_path / "m/1/manifest.txt").read_text() == want
    assert (tmp_path / "m/2/manifest.txt").read_text().splitlines()[3:] == ["# Original kept at: in/\\u{9}é", "#", "in/a\\r", "in/b"]
    back = manifest.read(spark, str(tmp_path / "m/*/manifest.txt"))
    assert {r.group_id: r.original for r in manifest.originals(back).collect()} == {"1": "in/k\\n", "2": "in/\\u{9}é"}
    assert [r.path for r in manifest.members(back).where("group_id = '1'").orderBy("line_no").collect()] == [f"in/é{i:05d}" for i in range(3000)]


def test_white_space_around_manifest_lines(spark, tmp_path):
    text = " # Original kept at: in/a \r\n\t# Original moved to: out/b\t\r\n# Original kept at: in/c\r\n#\r\n\u2003in/x y \r\n\r\n"
    (tmp_path / "9").mkdir()
    (tmp_path / "9/manifest.txt").write_bytes(text.encode())
    lines = manifest.read(spark, str(tmp_path / "*/manifest.txt"))
    assert [tuple(r) for r in manifest.originals(lines).collect()] == [("9", "out/b")]
    assert [r.path for r in manifest.members(lines).collect()] == ["in/x y"]
    assert manifest.original_of(text.splitlines()) == "out/b" and manifest.original_of([" # Original kept at: a\t\r\n"]) == "a"


def test_ranks_of_a_hot_group(spark):
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 5}", r.randrange(500), i) for i in range(900)] + [(None, 1, 900), (None, 0, 901)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbering.ranked(df, ["g"], ["x", "i"], "n")
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {x.i: x.n for x in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.columns == ["g", "x", "i", "n"] and "_piece" in plan
    for g in {x[0] for x in rows}:
        assert [found[i] for _, _, i in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])] == list(range(sum(x[0] == g for x in rows)))


def test_elide_keeps_whole_characters(spark):
    text = "é" * 200
    assert one(spark, e=names.elide(F.lit("x" + text))).e == "x" + "é" * 79 + f"… ({len(('x' + text).encode())} bytes)"
    assert one(spark, e=names.elide(F.lit("short"))).e == "short"


def test_generated_library(spark):
    lib = generator.library(spark, 200)
    roles = {r.role: r["count"] for r in cascade.classify(lib).groupBy("role").count().collect()}
    assert sum(roles.values()) == 200 and roles["duplicate"] > 0


def test_streaming_dedup(spark, tmp_path):
    from lodestrata.streaming import dedup

    generator.library(spark, 50).select("path", "content", F.current_timestamp().alias("at")).union(generator.library(spark, 50).select("path", "content", F.current_timestamp().alias("at"))).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("path string, content binary, at timestamp").parquet(str(tmp_path / "s"))
    q = dedup.first_of_content(stream, "at").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == generator.library(spark, 50).select("content").distinct().count()


def test_ledger_is_the_sequential_claim(spark):
    """Every directory against one sequential pass over it, with families of names, existing entries and a hot name."""
    r = random.Random(11)
    names_ = ["a.jpg", "a-1.jpg", "a-1-1.jpg", "a-2.jpg", "b.jpg", "b", "b-1", ".hid", ".hid-1", "c.tar.gz", "c.tar-1.gz", "d-07.jpg", "d.jpg", "e-1", "line\nbreak.jpg", "x.", "x-1."]
    rows = [(k, f"d{r.randrange(4)}", r.choice(names_)) for k in range(300)] + [(1000 + k, "hot", "unknown.jpg") for k in range(400)] + [(2000 + k, "calm", f"n{k}.jpg") for k in range(20)]
    there = [("d0", "a.jpg"), ("d0", "b-1"), ("d1", "a-2.jpg"), ("hot", "unknown.jpg"), ("calm", "n3.jpg"), ("calm", "other"), ("d2", ".hid")]
    planned = spark.createDataFrame(rows, "k long, directory string, name string").repartition(5)
    for existing in (None, there):
        want = {}
        for d in {x[1] for x in rows}:
            own = sorted(x for x in rows if x[1] == d)
            taken = {n for e, n in existing or [] if e == d}
            want |= {x[0]: n for x, n in zip(own, ledger.claim([x[2] for x in own], taken), strict=True)}
        df = None if existing is None else spark.createDataFrame(existing, "directory string, name string")
        got = {x.k: x.final_name for x in ledger.assign(planned, ["k"], df).collect()}
        assert got == want


def test_ledger_without_bound(spark):
    """Every row gets a name, also where candidates' numbers have five digits, and the same as one by one."""
    r = random.Random(23)
    names_ = [*NAMES, "b-10001.x", "b-10000-1.x", "a-1-1-1.jpg", "a-1-1-2.jpg", "a-3.jpg"]
    rows, there, want = [("hot", "b.x", k) for k in range(10_010)] + [("hot", "b-10000.x", 10_010)], [("hot", "b-3.x")], {}
    for d in range(120):
        some = r.sample(names_, r.randint(1, 8))
        rows += [(f"d{d}", r.choice(some), 20_000 + 100 * d + i) for i in range(r.randint(1, 30))]
        there += [(f"d{d}", n) for n in {ledger.candidate(r.choice(names_), r.randint(0, 3)) for _ in range(r.randint(0, 5))}]
    for d in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == d]
        want |= {x[2]: n for x, n in zip(own, ledger.claim([x[1] for x in own], {n for e, n in there if e == d}, 1 << 40), strict=True)}
    df = spark.createDataFrame(rows, "directory string, name string, k int").repartition(5)
    got = ledger.assign(df, ["k"], spark.createDataFrame(there, "directory string, name string"), bounded=False).collect()
    assert {x.k: x.final_name for x in got} == want and len({(x.directory, x.final_name) for x in got}) == len(rows)
