from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.sources import xmp

RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
EXIF, PHOTOSHOP, XMP = (f'xmlns:{p}="{ns}"' for _, p, ns, _ in xmp.DATES)
ALL = f"{EXIF} {PHOTOSHOP} {XMP}"
T, U = "2024-03-15T23:30:00", "2019-01-02T03:04:05"
AT, OTHER = datetime(2024, 3, 15, 23, 30), datetime(2019, 1, 2, 3, 4, 5)


def packet(body, names=ALL):
    return f'<?xpacket begin="﻿"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {RDF} {names}>{body}</rdf:RDF></x:xmpmeta><?xpacket end="w"?>'


def about(attributes="", inside="", names=""):
    return packet(f"<rdf:Description {names} {attributes}>{inside}</rdf:Description>", "")


CASES = {
    "attribute": (packet(f'<rdf:Description xmp:CreateDate="{T}+08:00"/>'), (AT, 28800, "xmp:CreateDate", True)),
    "element": (packet(f"<rdf:Description><xmp:CreateDate>\n {T}Z </xmp:CreateDate></rdf:Description>"), (AT, 0, "xmp:CreateDate", True)),
    "single quotes and >": (packet(f"<rdf:Description a='>' xmp:CreateDate='{T}'/>"), (AT, None, "xmp:CreateDate", True)),
    "nearest the shutter": (packet(f'<rdf:Description xmp:CreateDate="{U}" photoshop:DateCreated="{U}" exif:DateTimeOriginal="{T}"/>'), (AT, None, "exif:DateTimeOriginal", True)),
    "time before rank": (packet(f'<rdf:Description photoshop:DateCreated="2024-03-15" xmp:CreateDate="{U}"/>'), (OTHER, None, "xmp:CreateDate", True)),
    "day alone": (packet('<rdf:Description photoshop:DateCreated="2024-03-15" xmp:CreateDate="2019-01-02"/>'), (datetime(2024, 3, 15), None, "photoshop:DateCreated", False)),
    "minutes": (packet('<rdf:Description xmp:CreateDate="2024-03-15T23:30"/>'), (AT, None, "xmp:CreateDate", True)),
    "coarser than a day": (packet('<rdf:Description xmp:CreateDate="2024-03"/>'), None),
    "camera's spelling": (packet('<rdf:Description xmp:CreateDate="2024:03:15 23:30:00"/>'), (AT, None, "xmp:CreateDate", True)),
    "unreadable value": (packet(f'<rdf:Description exif:DateTimeOriginal="soon" xmp:CreateDate="{T}"/>'), (AT, None, "xmp:CreateDate", True)),
    "any prefix": (about(f'q:CreateDate="{T}"', names='xmlns:q="http://ns.adobe.com/xap/1.0/"'), (AT, None, "xmp:CreateDate", True)),
    "prefix bound elsewhere": (about(f'xmp:CreateDate="{T}"', names='xmlns:xmp="http://example.org/"'), None),
    "undeclared prefix": (about(f'xmp:CreateDate="{T}"'), (AT, None, "xmp:CreateDate", True)),
    "prefix unbound again": (packet(f'<rdf:Description xmlns:xmp="" xmp:CreateDate="{T}"/>'), (AT, None, "xmp:CreateDate", True)),
    "no prefix": (packet(f'<rdf:Description CreateDate="{T}"><CreateDate>{T}</CreateDate></rdf:Description>'), None),
    "default namespace": (packet(f'<CreateDate xmlns="http://ns.adobe.com/xap/1.0/">{T}</CreateDate>'), (AT, None, "xmp:CreateDate", True)),
    "default namespace isn't an attribute's": (packet(f'<a xmlns="http://ns.adobe.com/xap/1.0/" CreateDate="{T}"/>'), None),
    "undeclared foreign prefix": (about(f'lost:bar="1" exif:DateTimeOriginal="{T}"', names=EXIF), (AT, None, "exif:DateTimeOriginal", True)),
    "undeclared foreign element": (packet(f'<lost:a/><rdf:Description exif:DateTimeOriginal="{T}"/>'), (AT, None, "exif:DateTimeOriginal", True)),
    "torn inside the element": (f'<x xmlns:x="x"><rdf:Description {RDF} {EXIF} exif:DateTimeOriginal="{T}"><lost:History><rdf:li when="', (AT, None, "exif:DateTimeOriginal", True)),
    "torn within a text": (f"<x {EXIF}><exif:DateTimeOriginal>{T}", (AT, None, "exif:DateTimeOriginal", True)),
    "ends that don't match": (packet(f"<rdf:a exif:DateTimeOriginal=\"{T}\"></rdf:b><exif:DateTimeOriginal>{U}</exif:DateTimeOriginal>"), (AT, None, "exif:DateTimeOriginal", True)),
    "bound only further down": (about(f'xmp:CreateDate="{T}"', f'<a xmlns:xmp="http://example.org/" xmp:CreateDate="{U}"/>'), (AT, None, "xmp:CreateDate", True)),
    "binding ends with its element": (about("", f'<a xmlns:xmp="http://example.org/"><b/></a><xmp:CreateDate>{T}</xmp:CreateDate>'), (AT, None, "xmp:CreateDate", True)),
    "binding of an empty element ends": (about("", f'<a xmlns:xmp="http://example.org/"/><xmp:CreateDate>{T}</xmp:CreateDate>'), (AT, None, "xmp:CreateDate", True)),
    "rebound inside": (packet(f'<a xmlns:xmp="http://example.org/"><xmp:CreateDate>{U}</xmp:CreateDate></a><xmp:CreateDate>{T}</xmp:CreateDate>'), (AT, None, "xmp:CreateDate", True)),
    "attribute before child": (packet(f'<rdf:Description exif:DateTimeOriginal="{T}"><exif:DateTimeOriginal>{U}</exif:DateTimeOriginal></rdf:Description>'), (AT, None, "exif:DateTimeOriginal", True)),
    "first of two elements": (packet(f"<exif:DateTimeOriginal>{T}</exif:DateTimeOriginal><exif:DateTimeOriginal>{U}</exif:DateTimeOriginal>"), (AT, None, "exif:DateTimeOriginal", True)),
    "text of a nested element": (packet(f"<xmp:CreateDate><rdf:li>{T}</rdf:li></xmp:CreateDate>"), None),
    "text after a nested element": (packet(f"<xmp:CreateDate><rdf:li/>{T}</xmp:CreateDate>"), None),
    "text after a comment": (packet(f"<xmp:CreateDate><!-- <xmp:CreateDate> -->{T}</xmp:CreateDate>"), (AT, None, "xmp:CreateDate", True)),
    "characters as they are": (packet(f"<xmp:CreateDate><![CDATA[{T}]]></xmp:CreateDate>"), (AT, None, "xmp:CreateDate", True)),
    "entities in an attribute": (packet(f'<rdf:Description xmp:CreateDate="{T}&#43;08&#x3a;00"/>'), (AT, 28800, "xmp:CreateDate", True)),
    "unknown entity": (packet(f'<rdf:Description exif:DateTimeOriginal="{U}&nope;" xmp:CreateDate="{T}"/>'), (AT, None, "xmp:CreateDate", True)),
    "first of two equal attributes": (packet(f'<rdf:Description xmp:CreateDate="{T}" xmp:CreateDate="{U}"/>'), (AT, None, "xmp:CreateDate", True)),
    "document type": (f'<!DOCTYPE x [<!ENTITY a "<b>">]><x {XMP} xmp:CreateDate="{T}"/>', (AT, None, "xmp:CreateDate", True)),
    "comment that doesn't end": (packet(f'<!-- <rdf:Description xmp:CreateDate="{T}"/>'), None),
    "nothing": ("", None),
    "no date at all": (packet("<rdf:Description/>"), None),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = CASES[name]
    assert xmp.parse(text.encode()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "<a ", "</a>", 'xmp:CreateDate="', T, '"', "'", "<!--", "-->", "<![CDATA[", "]]>", "<xmp:CreateDate>", "</xmp:CreateDate>", "&#43;", "&", "<?", "?>", "<!D", "[", "]", "xmlns=''", "\udce9"]), max_size=25).map("".join))
def test_whatever_comes_is_a_date_or_none(text):
    got = xmp.parse(text.encode("utf-8", "surrogateescape"))
    assert got is None or got[2] == "xmp:CreateDate"


@given(st.integers(0, 400))
def test_a_torn_sidecar_keeps_what_came_before(at):
    text = packet(f'<rdf:Description exif:DateTimeOriginal="{T}"/>' + "<lost:a>x</lost:a>" * 10).encode()
    seen = text.index(b"/>", text.index(b"DateTimeOriginal=")) + 2
    cut = min(seen + at, len(text))
    assert xmp.parse(text[:cut])[0] == AT and xmp.parse(text[: seen - 3]) is None


def test_columns(spark):
    rows = [(0, None), (1, bytearray(CASES["attribute"][0].encode())), (2, bytearray(b" " * (xmp.LIMIT + 1))), (3, bytearray(b"<a/>"))]
    got = {r.i: tuple(r.x) for r in spark.createDataFrame(rows, "i int, c binary").select("i", xmp.dates_of("c").alias("x")).collect()}
    assert got == {0: (None,) * 4 + ("missing",), 1: (*CASES["attribute"][1], "ok"), 2: (None,) * 4 + ("too_large",), 3: (None,) * 4 + ("undated",)}
