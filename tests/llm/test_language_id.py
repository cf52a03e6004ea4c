from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import language_id, queries
from lodestrata.llm.language_id import counted, grams, Profiles, top


def low(c):
    x = c.lower()
    return (x if len(x) == 1 else c) if c.isalpha() else " "


def by_definition(text):
    """Counts of the n-grams of a text."""
    out = Counter()
    for word in "".join(map(low, text)).split(" "):
        padded = f" {word} "
        out.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if word and padded[i : i + n] != " ")
    return out


def spelt(code):
    return "".join(chr(code >> k & 0x1FFFFF) for k in (42, 21, 0) if code >> k & 0x1FFFFF)


def first(c, ranks):
    return [g for g, _ in sorted(c.items(), key=lambda r: (-r[1], r[0]))[:ranks]]


TEXT = st.text(alphabet="abAZéÉßİΣ漢0 .,'\n\t\x00\U00010400😀", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_grams_are_those_of_the_definition(texts):
    codes, cuts = grams(texts)
    assert len(cuts) == len(texts) + 1
    for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True):
        u, n = counted(codes[a:b])
        assert {spelt(c): k for c, k in zip(u.tolist(), n.tolist(), strict=True)} == by_definition(t)
        assert [spelt(c) for c in top(codes[a:b], 9).tolist()] == first(by_definition(t), 9)


def brute(learnt, texts, ranks):
    sums = {}
    for lang, text in learnt:
        if lang is not None and text is not None:
            sums.setdefault(lang, Counter()).update(by_definition(text))
    profiles = {l: {g: i for i, g in enumerate(first(c, ranks))} for l, c in sums.items() if c}
    for text in texts:
        own = first(by_definition(text or ""), ranks)
        if not own or not profiles:
            yield "und", 0.0
            continue
        far, lang = min((sum(abs(p[g] - i) if g in p else ranks for i, g in enumerate(own)), l.encode()) for l, p in profiles.items())
        yield lang.decode(), 1 - far / (ranks * len(own))


@pytest.mark.parametrize("ranks", [5, 300])
def test_predictions(spark, corpus, ranks, monkeypatch):
    monkeypatch.setattr(language_id, "BATCH_CHARS", 300)
    docs = corpus.where("n_chars is null or n_chars < 100000").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") < 20, "é")).drop("score")
    rows = docs.collect()
    profiles = language_id.learn(docs, ranks)
    got = language_id.predict(docs, profiles)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "fp", "rid", "lang_pred", "score"]
    want = [(str((r.doc_id, r.n_chars)), *x) for r, x in zip(rows, brute([(r.lang, r.text) for r in rows], [r.text for r in rows], ranks), strict=True)]
    found = [(str((r.doc_id, r.n_chars)), r.lang_pred, r.score) for r in got.collect()]
    assert [r[:2] for r in sorted(found)] == [r[:2] for r in sorted(want)]
    assert all(abs(a[2] - b[2]) < 1e-12 and 0 <= a[2] <= 1 for a, b in zip(sorted(found), sorted(want), strict=True))
    assert {r.lang_pred for r in got.where("doc_id in (0, 1, 2)").collect()} == {"und"}


def test_nothing_learnt(spark, corpus):
    docs = corpus.drop("score")
    assert language_id.learn(docs.where("false")).languages == []
    assert language_id.learn(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, Profiles.of([], 300)).collect()} == {("und", 0.0)}
    assert language_id.predict(docs.where("false"), Profiles.of([], 300)).count() == 0
    with pytest.raises(ValueError):
        language_id.predict(corpus, Profiles.of([], 300))


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    docs = spark.createDataFrame([(f"l{i}", "abc") for i in range(5)], "lang string, text string")
    with pytest.raises(ValueError, match="more than 3"):
        language_id.learn(docs, 2)


def test_held_out_accuracy(spark):
    """Languages of documents that were not learnt from."""
    sf = "/root/testdata/sf0.01"
    truth = queries.table(spark, sf, "documents").select("doc_id", "lang")
    got = queries.op13_language_id(spark, sf).where("held_out").join(truth, "doc_id")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right >= 0.98 * n


def test_lang_is_no_input_of_a_prediction(spark, corpus):
    docs = corpus.drop("score")
    profiles = language_id.learn(docs)
    read = lambda df: sorted((str(r.doc_id), str(r.n_chars), r.lang_pred, r.score) for r in language_id.predict(df, profiles).collect())
    assert read(docs) == read(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string")))
