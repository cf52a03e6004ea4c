import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import decontamination as d
from tests.llm.test_operators import brute_hits


def words(n, r, size=10**9):
    return [b"w%d" % r.randrange(size) for _ in range(n)]


@pytest.mark.parametrize("shared", range(10, 41))
def test_every_shared_window_has_a_selected_gram(shared):
    """The guarantee of winnowing: whatever surrounds it, a passage of ten words or more holds a gram that both sides select, at the same place."""
    r = random.Random(shared)
    for _ in range(30):
        passage = words(shared, r, r.choice([2, 3, 10**9]))
        sides = []
        for _ in range(2):
            a, b = words(r.randrange(30), r, 5), words(r.randrange(30), r, 5)
            chosen = d.winnow(d.grams(d.hashes([*a, *passage, *b]), d.GRAM)) - len(a)
            sides.append({int(i) for i in chosen if 0 <= i <= shared - d.GRAM})
        both = sides[0] & sides[1]
        assert all(any(s <= i <= s + d.WINDOW - d.GRAM for i in both) for s in range(shared - d.WINDOW + 1))


def test_selected_grams_are_sparse():
    """About two of seven grams are selected, and a seed is a few numbers without words."""
    r = random.Random(1)
    text = words(20_000, r)
    found = d.seeds(d.hashes(text), [])
    assert abs(len(found) / 20_000 - 2 / 7) < 0.01 and set(found[0]) == {"pos", "n", "h", "l", "r"}
    parts = d.slices(text, found)
    assert len(parts) == 1 and parts[0]["text"].encode().split() == text and len(parts[0]["seeds"]) == len(found)


def test_slices_reach_every_window_and_no_further():
    r = random.Random(2)
    text = words(100, r)
    some = [s for s in d.seeds(d.hashes(text), []) if s["pos"] < 20 or s["pos"] > 70]
    parts = d.slices(text, some)
    assert len(parts) == 2 and sum(len(p["seeds"]) for p in parts) == len(some)
    for p in parts:
        own = p["text"].encode().split()
        assert own == text[p["at"] : p["at"] + len(own)]
        assert all(min(p["at"] + s["pos"] + 10, 100) <= p["at"] + len(own) and (p["at"] == 0 or s["pos"] >= 5) for s in p["seeds"])


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=30))
def test_extend_finds_all_stretches_through_a_pair(a, b):
    mine, theirs = [str(x) for x in a], [str(x) for x in b]
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
    want = set()
    for i, j in pairs:
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if n >= min(10, len(b)):
            want.add((i, j, n))
    assert sorted(d.extend(mine, theirs, pairs)) == sorted(want)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_seeds_never_lose_a_window(seed):
    """In plain Python, without Spark: seeds, slices and extension against every pair of windows."""
    r = random.Random(seed)
    size = r.choice([2, 3, 40])
    items = [words(r.randint(1, 30), r, size) for _ in range(3)]
    text = words(r.randint(0, 20), r, size)
    for _ in range(3):
        own = r.choice(items)
        a = r.randrange(len(own))
        text += own[a : a + r.randint(1, 20)] + words(r.randint(0, 6), r, size)
    windows = {int(x) for own in items for x in d.grams(d.hashes(own), min(10, len(own)))}
    known = lambda g: np.array([int(x) in windows for x in g], bool)
    lengths = sorted({len(x) for x in items if len(x) < 10})
    hit = set()
    for part in d.slices(text, d.seeds(d.hashes(text), lengths, known)):
        for own in items:
            h = d.hashes(own)
            theirs = d.seeds(h, [len(own)] if len(own) < 10 else [])
            near = lambda s, t: s["n"] < 0 or s["l"] and s["l"] == t["l"] or s["r"] and s["r"] == t["r"]
            pairs = {(s["pos"], t["pos"]) for s in part["seeds"] for t in theirs if (s["h"], s["n"]) == (t["h"], t["n"]) and near(s, t)}
            for start, _, n in d.extend(part["text"].split(" "), [w.decode() for w in own], pairs):
                hit.update(range(part["at"] + start, part["at"] + start + n))
    want = {i + k for own in items for a in range(len(own) - min(10, len(own)) + 1) for i in range(len(text)) for k in range(min(10, len(own))) if text[i : i + min(10, len(own))] == own[a : a + min(10, len(own))]}
    assert hit == want


def test_items_that_share_passages(spark, scratch):
    """Boilerplate in every item and in a third of the documents, items within items, tails of their own, and documents of both."""
    r = random.Random(3)
    say = lambda n: " ".join(w.decode() for w in words(n, r))
    common, other = say(14), say(12)
    items = [(i, f"{common} {say(r.randint(0, 12))}".strip()) for i in range(40)] + [(100, other), (101, other.upper()), (102, f"{say(3)} {other} {say(3)}"), (103, "two words"), (None, say(20))]
    docs = [(i, f"{say(5)} {common} {say(4)}" if i % 3 == 0 else f"{say(8)} {items[i % 40][1]} {other}" if i % 3 == 1 else say(40)) for i in range(90)]
    docs += [(90, items[-1][1]), (91, "Two words, two WORDS"), (92, " ".join(common.split()[:9])), (93, " ".join(common.split()[2:12])), (94, f"{common} {common}")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(docs, "doc_id int, text string")
    got = {x.doc_id: x for x in d.scan(df, bench, scratch, "doc_id").collect()}
    for i, t in docs:
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == brute_hits(t, items), i
    with pytest.raises(ValueError):
        d.scan(df.withColumnRenamed("doc_id", "n_hit"), bench, scratch, "n_hit")
