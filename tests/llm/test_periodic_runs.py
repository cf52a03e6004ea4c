import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import periodic_runs, queries
from lodestrata.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(s, least):
    """Every maximal stretch by the definition: for each q, stretches whose words q apart agree, without those a divisor of q also fits."""
    s, out = np.asarray(s), []
    for q in range(1, len(s) // 2 + 1):
        same = np.concatenate([[False], s[:-q] == s[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= max(least, 2 * q) and not any(q % d == 0 and (s[a : b + q - d] == s[a + d : b + q]).all() for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbered(words):
    number = {}
    return [number.setdefault(w, len(number)) for w in words]


def listed(found):
    return sorted(zip(*[x.tolist() for x in found], strict=True), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4).flatmap(lambda a: st.lists(st.integers(0, a), max_size=60)), st.integers(1, 6), st.integers(0, 30))
def test_all_runs_of_short_strings(s, p, more):
    s = s + [s[i % min(p, len(s))] for i in range(more if s else 0)] + s[: len(s) // 2]
    assert listed(periodic_runs.runs(np.array(s, "i8"))) == brute(s, 2)


@pytest.mark.parametrize("s", [[0] * 3000, [0, 1] * 900, [i % 37 for i in range(1500)] + [i % 5 for i in range(400)], list(range(500))])
def test_long_periodic_strings(s):
    assert listed(periodic_runs.runs(np.array(s, "i8"))) == brute(s, 2)


def test_fibonacci_string_has_all_its_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert listed(periodic_runs.runs(np.array(b, "i8"))) == brute(b, 2)


def test_blocks_are_longest_earlier_stretches():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        h, want = 0, []
        while h < len(s):
            want.append(h)
            h += max([1] + [n for j in range(h) for n in range(1, len(s) - h + 1) if s[j : j + n] == s[h : h + n]])
        assert periodic_runs.SuffixTree(np.array(s, "i8")).blocks().tolist() == [*want, len(s)]


def test_documents_of_a_batch_do_not_meet():
    rng = random.Random(5)
    docs = []
    for _ in range(200):
        s = [b"w%d" % rng.randrange(rng.choice([2, 3, 10])) for _ in range(rng.randint(1, 60))]
        docs.append(s + [s[i % min(7, len(s))] for i in range(rng.randint(0, 40))])
    docs += [docs[3], docs[3], [], [b"one"]]
    for d, found in zip(docs, periodic_runs.runs_of(docs), strict=True):
        assert listed(found) == brute(numbered(d), 12)


def by_definition(doc_id, text):
    """The row of the query for one document."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(numbered(words), 12)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_is_the_definition(spark):
    want = [by_definition(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert all(f.dataType.simpleString() == ("string" if f.name.endswith("sha256") else "bigint") for f in got.schema.fields)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want) and sum(r[1] > 0 for r in rows) > 10


def test_detect(spark, corpus, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_BYTES", 500)
    got = periodic_runs.detect(corpus)
    assert got.columns == [*(c for c in corpus.columns if c != "text"), "runs", "collapsed"]
    rows = sorted((str((r.doc_id, r.source, r.n_chars)), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    want = []
    for r in corpus.collect():
        words = (r.text or "").encode().split()
        found = brute(numbered(words), 12)
        gone = {i for a, length, q in found for i in range(a + q, a + length)}
        want.append((str((r.doc_id, r.source, r.n_chars)), found, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    assert rows == sorted(want) and any(r[1] for r in rows)
    assert periodic_runs.detect(corpus.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.detect(corpus.withColumnRenamed("fp", "runs"))


def test_nothing_is_shuffled(spark):
    plan = queries.op11_periodic_runs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_query_takes_texts_without_words(spark, tmp_path):
    """Texts of no words among the ids whose texts go on over and over: the first word that would repeat is one modulo none."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = ["", " \t\n", None, "one", "a b c " * 20, "\x0b\x0c \r"]
    docs = [*zip(ids, texts * (len(ids) // len(texts)), strict=False), (None, ""), (1, " ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((by_definition(*d) for d in docs), key=repr) and len(got) > 100
