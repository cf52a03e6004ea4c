import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import divergence
from lodestrata.llm.divergence import merged, shares, terms, Trie


def brute(rows, documents, ranks):
    """The audit of (text, lang, source) by its definition, in Python's integers."""
    rows = [(t or "", l or "", s or "") for t, l, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        held, count, sources = Counter(), defaultdict(Counter), {s for _, l, s in rows if l == lang}
        for t, l, s in rows:
            if l == lang:
                own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t)]
                held.update(set(own))
                count[s].update(own)
        kept = [w for w, n in held.items() if n >= documents]
        total = {s: sum(count[s][w] for w in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        p = {s: {w: share(count[s][w], total[s]) for w in kept} for s in sources}
        q = {w: share(sum(count[s][w] for s in sources), sum(total.values())) for w in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            words = [(w, p[s][w] - q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", words)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, *r, i + 1) for i, r in enumerate(found) if part == "pair" or i < ranks]
    return sorted(out)


def read(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


LEAVES = st.dictionaries(st.text("abé漢", max_size=30).map(str.encode), st.tuples(st.integers(1, 9), st.dictionaries(st.sampled_from(["", "a", "é"]), st.integers(1, 2**40), min_size=1)), max_size=30)


def trie_of(table):
    cells = [(i, s, n) for i, (_, c) in enumerate(table.values()) for s, n in c.items()]
    sources = sorted({s for _, s, _ in cells})
    row, source, n = (np.array([x[0] for x in cells], "i8"), np.array([sources.index(x[1]) for x in cells], "i8"), np.array([x[2] for x in cells], "i8"))
    return Trie.of(list(table), np.array([d for d, _ in table.values()], "i8"), sources, row, source, n)


def leaves(trie):
    out = {}
    for i, t in enumerate(trie.terms):
        own = slice(trie.ends[i], trie.ends[i + 1])
        out[t] = int(trie.documents[i]), {trie.sources[s]: int(n) for s, n in zip(trie.source[own], trie.count[own], strict=True)}
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(LEAVES, max_size=4), st.integers(0, 30), st.integers(0, 30))
def test_tries_keep_and_merge_their_leaves(tables, a, b):
    tries = [trie_of(x) for x in tables]
    for x, t in zip(tables, tries, strict=True):
        assert t.terms == sorted(x) and leaves(t) == x and leaves(Trie.load(*t.pack())) == x
        a, b = sorted((min(a, len(x)), min(b, len(x))))
        part = Trie.load(*t.pack(a, b))
        assert leaves(part) == {w: x[w] for w in sorted(x)[a:b]}
        assert t.totals(a, b) == sum((Counter(x[w][1]) for w in sorted(x)[a:b]), Counter())
        assert leaves(t.kept(t.documents > 4)) == {w: v for w, v in x.items() if v[0] > 4}
    found = leaves(merged(Trie.load(*t.pack()) for t in tries))
    assert list(found) == sorted({w for x in tables for w in x})
    for w, (documents, counts) in found.items():
        assert documents == sum(x[w][0] for x in tables if w in x) and counts == sum((Counter(x[w][1]) for x in tables if w in x), Counter())


@given(st.lists(st.tuples(st.integers(0, 10**13), st.integers(0, 10**14)), min_size=1), st.integers(1, 10**7))
def test_shares_are_exact(pairs, kept):
    n, total = (np.array(x, "i8") for x in zip(*[(min(p), max(p)) for p in pairs], strict=True))
    assert shares(n, total, kept).tolist() == [1 + 10**9 * (c + 5) // (t + 5 * kept) for c, t in zip(n.tolist(), total.tolist(), strict=True)]


def test_terms_are_letters_and_all_beyond_ascii():
    text = "Don't STOP é漢Ä x1y_z\x00\x7f¿Ａ"
    assert [t.decode() for t in terms(text)] == ["don", "t", "stop", "é漢Ä", "x", "y", "z", "¿Ａ"]
    assert terms(None) == terms("") == terms("12 ,.") == []


@pytest.mark.parametrize(("held", "piece", "least", "spread"), [(1 << 22, 4096, 3, 1 << 18), (40, 3, 2, 4), (7, 1, 1, 2), (1 << 22, 4096, 10**6, 1 << 18)])
def test_audit(spark, corpus, scratch, monkeypatch, held, piece, least, spread):
    """Small limits make many tries, rows and prefix ranges; a bound that nothing reaches leaves all pairs at 0."""
    rows = corpus.where("n_chars is null or n_chars < 100000")
    for name, value in (("HELD", held), ("PIECE", piece), ("LEAD", 2), ("RANGE", spread)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(rows, scratch, documents=least, ranks=5)
    assert [tuple(f) for f in got.dtypes] == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, got.collect())) == brute(read(rows), least, 5)


def test_ranges_are_cut_at_equal_terms(spark, scratch, monkeypatch):
    """A language with a third of all terms, and a term that all documents hold, are split over ranges of like size."""
    monkeypatch.setattr(divergence, "PIECE", 16)
    monkeypatch.setattr(divergence, "RANGE", 1 << 8)
    rows = [(" ".join(["the", *(f"prefix{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + i // 26 % 26)}" for k in range(20))]), "en" if i % 3 else f"l{i % 7}", f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(9)
    parts = scratch.write(divergence.count(df))
    assert len(divergence._cuts(parts, 12)) >= 10
    kept = divergence.merge(parts, 1).collect()
    names = [(r.lang, t) for r in kept for t in Trie.load(*[r[c] for c in divergence._COLUMNS]).terms]
    assert len(names) == len(set(names))
    got = sorted(map(tuple, divergence.audit(df, scratch, documents=2, ranks=7).collect()))
    assert got == brute(rows, 2, 7)


def test_empty_and_long(spark, scratch):
    none = spark.createDataFrame([], "text string, lang string, source string, value int, rank int")
    assert divergence.audit(none, scratch).count() == 0
    rows = [("a" * 70_000 + " " + "a" * 69_999 + "b", "x", None), (None, None, None), ("", "x", "t"), ("12", "x", "")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df, scratch, documents=1).collect())) == brute(rows, 1, 50)
