import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata import queries as q
from lodestrata.functions import blake3
from lodestrata.operators import tree_digest
from lodestrata.plans import sink

# Published test vectors; the input repeats the bytes 0 to 250.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
}


def pattern(n):
    return bytes(i % 251 for i in range(n))


@pytest.mark.parametrize("n", VECTORS)
def test_published_vectors(n, tmp_path):
    (tmp_path / "f").write_bytes(pattern(n))
    assert blake3.of_bytes(pattern(n)) == VECTORS[n] == blake3.of_many([pattern(n)])[0] == blake3.of_file(str(tmp_path / "f"), size=1024)
    assert blake3.of_bytes(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20_000), max_size=8), st.booleans(), st.integers(0, 5), st.sampled_from([3, 64, 4096]))
def test_parts_lanes_and_many_agree(sizes, keyed, k, lanes):
    key = b"k" * 32 if keyed else None
    datas = [random.Random(n).randbytes(n) for n in sizes]
    want = [blake3.of_bytes(d, key) for d in datas]
    before, blake3.LANES = blake3.LANES, lanes
    try:
        assert blake3.of_many(datas, key) == want == [blake3.of_bytes(d, key, 1024 << k) for d in datas]
    finally:
        blake3.LANES = before
    assert len(set(zip(want, datas, strict=True))) == len(set(want))
    with pytest.raises(ValueError):
        blake3.of_bytes(b"", b"short")


def test_parts_of_files_are_tasks(spark, tmp_path):
    rows = []
    for i, n in enumerate((0, 1, 1024, 5000, 70_000, 300_001)):
        (tmp_path / f"{i}").write_bytes(pattern(n))
        rows.append((str(tmp_path / f"{i}"), n))
    rows += [(str(tmp_path / "5"), 7), (str(tmp_path / "gone"), 3), rows[3]]
    files = spark.createDataFrame(rows, "path string, size long")
    for key in (None, tree_digest.KEY):
        got = tree_digest.tree_digests(files, key, 4096).collect()
        assert len(got) == len(rows)
        for r in got:
            fine = (r.path, r.size) in rows[:6]
            assert r.digest == (blake3.of_bytes(pattern(r.size), key) if fine else None) and (r.reason is None) == fine
    assert tree_digest.tree_digests(files.where("false")).count() == 0


def test_texts_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in q.table(spark, sf, "documents").collect()}
    got = q.queries()["m2_tree_digests"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        data = None if texts[r.doc_id] is None else texts[r.doc_id].encode()
        assert (r.digest, r.keyed) == ((None, None) if data is None else (blake3.of_bytes(data), blake3.of_bytes(data, tree_digest.KEY)))


def test_a_step_may_carry_either_digest(tmp_path):
    p = tmp_path / "a"
    p.write_bytes(pattern(3000))
    for digest, status in ((blake3.of_bytes(pattern(3000)), "intact"), (__import__("hashlib").sha256(pattern(3000)).hexdigest(), "intact"), ("0" * 64, "modified"), (None, "intact")):
        assert sink.verify_step(str(p), 3000, digest) == status
