import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import chat, decontamination, embedding_dedup, exchange, language_model, mixing, simhash, substring_dedup, token_counts, token_store, toxicity
from lodestrata.llm.common import components, split_hot
from lodestrata.llm.queries import oracle_sql, queries, tokenizer
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def docs_of(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name], SF)


# ---- token store ----------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 2**17 - 1), max_size=400), st.integers(17, 32))
def test_pack_round_trip(ids, bits):
    a = np.array(ids, "u4")
    assert token_store.unpack(token_store.pack(a, bits), bits, len(a)).tolist() == ids


def test_segment_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49408, n).astype("u4") for n in (0, 1, 4095, 4097, 9000, 0)]
    assert token_store.min_bits(49408) == 16 and token_store.min_bits(2) == 1 and token_store.min_bits(65537) == 17
    s = token_store.Segment(token_store.write_segment(docs, 17))
    for k, d in enumerate(docs):
        assert s.doc(k).tolist() == d.tolist()
    assert s.slice(4000, 4200).tolist() == np.concatenate(docs)[4000:4200].tolist()
    with pytest.raises(ValueError):
        token_store.write_segment([np.array([1 << 17], "u4")], 17)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abzAZ'.,-s 19\n\t\x1c\x85éÉßİŞ̱̇漢Σς", max_size=30))
def test_encoder_is_the_tokenizer(text):
    from lodestrata.llm.token_store import WordEncoder

    e = WordEncoder.of(tokenizer())
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert e.encode([text])[0].tolist() == want and e.count([text]) == [len(want)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|endofte\u212at|>", "<|", "Word", "É", "e\u0301", "'S", " ", "\n", "."]), max_size=8).map("".join))
@example("a <|ENDOFTEXT|> b")
@example("A<|endoftext|>B <|ENDOFTEXT|>")
def test_encoder_keeps_the_case_of_added_tokens(text):
    from lodestrata.llm.token_store import WordEncoder

    e = WordEncoder.of(tokenizer())
    texts = ["plain Words before", text, text.lower(), text]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in e.encode(texts)] == want and e.count(texts) == list(map(len, want))


def test_token_store(spark, corpus, scratch, plain, tmp_path):
    container = token_store.store(corpus, tokenizer(), 2, scratch)
    got = sorted(token_store.read_back(container).collect(), key=lambda r: r.start)
    want, at = [], 0
    for doc_id, text in sorted(docs_of(corpus), key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = [*plain(text), 2]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    listed = {r.file: r for r in token_store.export(container, str(tmp_path / "files")).collect()}
    opened = {p.name: token_store.Segment.open(str(p)) for p in sorted((tmp_path / "files").iterdir())}
    assert set(opened) == set(listed) and all(s.docs == listed[n].docs and s.ids == listed[n].ids for n, s in opened.items())
    read = [s.doc(k) for s in opened.values() for k in range(s.docs)]
    assert [(len(d), zlib.crc32(d.astype("<u4").tobytes())) for d in read] == [w[2:] for w in want]
    assert token_store.read_back(token_store.store(corpus.where("false"), tokenizer(), 2, scratch)).count() == 0


# ---- mixing ---------------------------------------------------------------------------------------


def test_mix_puts_null_ids_last_across_cuts(spark, scratch):
    df = spark.createDataFrame([(None if i % 3 == 0 else i, "four words in each", "s") for i in range(600)], "doc_id long, text string, source string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = mixing.mix(df, scratch, share=0.3713).select("doc_id", "copies").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rate, u = 0.3713, mixing.offset(F.lit("s"), 17)
    u = spark.range(1).select(u.alias("u")).first().u
    ids = sorted((i for i in range(600) if i % 3)) + [None] * 200
    want = [(d, math.floor(rate * (k + 1) + u) - math.floor(rate * k + u)) for k, d in enumerate(ids)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_mix(spark, corpus, scratch):
    got = mixing.mix(corpus, scratch).collect()
    assert len(got) == corpus.count()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(corpus.repartition(7), scratch).collect()))
    assert all(0 <= r.copies <= 2 for r in got)
    per = {}
    for r in got:
        per.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rows in per.items():
        assert target <= 2 * size + 1e-9 and abs(sum(r.size * r.copies for r in rows) - target) <= max(r.size for r in rows)
    assert math.isclose(sum(t for _, t in per), 1.5 * sum(s for s, _ in per))
    kept = mixing.expand(corpus, scratch)
    assert kept.columns == corpus.columns and kept.count() == sum(r.copies for r in got)
    odd = corpus.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "size": F.lit("x"), "copies": F.lit(None), "piece": F.array(F.create_map(F.lit(1), F.lit(2)))})
    assert mixing.expand(odd, scratch).columns == odd.columns and mixing.expand(odd, scratch).count() == sum(r.copies for r in got)
    assert mixing.mix(corpus.where("false"), scratch).count() == 0


# ---- toxicity -------------------------------------------------------------------------------------


def brute_toxicity(train, texts):
    """Scores by the definition, in plain Python: train (doc_id, text, label), all of it examples."""
    bags = [(Counter(toxicity.tokens(t)), y, toxicity.family(toxicity.tokens(t))) for _, t, y in train]
    kin = {(f, y) for _, y, f in bags}
    n1, n0 = sum(y for _, y in kin), sum(1 - y for _, y in kin)
    a, b = Counter(), Counter()
    for w, _, y in {(w, f, y) for c, y, f in bags for w in c}:
        (a if y else b)[w] += 1

    def weight(w, a_less=0, b_less=0):
        p, q, m1, m0 = max(a[w] - a_less, 0), max(b[w] - b_less, 0), n1 - a_less, n0 - b_less
        if p + q == 0:
            return 0.0
        phi = abs(p * (m0 - q) - q * (m1 - p)) / math.sqrt(max((p + q) * (m1 + m0 - p - q) * m1 * m0, 1e-9)) if m1 > 0 and m0 > 0 else 1.0
        return math.log(1 + (m1 + m0) / (p + q)) * phi

    def unit(c, less=(0, 0)):
        v = {w: (1 + math.log(n)) * weight(w, *less) for w, n in c.items() if a[w] + b[w]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items() if x > 0}

    rows = [unit(c) for c, _, _ in bags]
    y = [l for _, l, _ in bags]

    def vote(q, but=None):
        near = sorted(((-sum(x * rows[i].get(w, 0) for w, x in q.items()), i) for i in range(len(rows)) if i != but))
        near = [(-s, i) for s, i in near if s < -1e-12][: toxicity.NEIGHBOURS]
        return sum(y[i] / (1.1 - min(s, 1)) for s, i in near) / sum(1 / (1.1 - min(s, 1)) for s, i in near) if near else None

    votes = []
    for i, (c, l, _) in enumerate(bags):
        less = (l, 1 - l)
        q = {w: x * weight(w, *less) / weight(w) for w, x in unit(c, less).items() if weight(w) > 0}
        if (v := vote(q, i)) is not None:
            votes.append((v, l))
    pools = []
    for x in sorted({v for v, _ in votes}):
        own = [l for v, l in votes if v == x]
        pools.append([x, x, sum(own), len(own)])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, hi, s, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s, pools[-1][3] + n]
    prior = sum(y) / len(y)
    knots = [(x, (s + prior) / (n + 1)) for lo, hi, s, n in pools for x in sorted({lo, hi})]
    knots = np.array([knots[0], *knots[1:]])
    knots[:, 1] = np.maximum.accumulate(knots[:, 1])
    bare = [l for r, l in zip(rows, y, strict=True) if not r]
    none = (sum(bare) + prior) / (len(bare) + 1)
    return [none if (v := vote(unit(Counter(toxicity.tokens(t))))) is None else float(np.interp(v, *knots.T)) for t in texts]


def made_up(n, seed, toxic=lambda i: i % 4 == 0, bad=("vile", "nasty", "scoundrel")):
    """Documents of invented words; those that ``toxic`` picks hold bad words besides."""
    rng = np.random.default_rng(seed)
    words = ["word" + a + b for a in "abcdefghij" for b in "klmnopqrst"]
    return [(i, " ".join([*rng.choice(words, int(rng.integers(3, 60))), *(rng.choice(bad, 2) if toxic(i) else [])]), int(toxic(i))) for i in range(n)]


def tables(spark, rows, more=()):
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t, _ in rows] + [(i, t, None, None) for i, t in more], "doc_id long, text string, y string, score int")
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, quality int")


def learnt(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]


def test_toxicity_is_the_brute_force(spark):
    rows = made_up(160, 3)
    rows += [(1000 + i, rows[4 * i][1], 1) for i in range(6)] + [(1010, None, 0), (1011, "", 1), (1012, "wordak " * 30_000 + "vile", 1)]
    odd = [(None, "vile nasty"), (None, None), (7, "second text of an id that is taken"), (2000, "12 34 !!"), (2001, "wordak wordbl " * 20_000), (2002, "unheard of")]
    docs, labels = tables(spark, rows, odd)
    index = toxicity.fit(docs, labels)
    train = [(i, min(t or "", "second text of an id that is taken") if i == 7 else t, y) for i, t, y in learnt(rows)]
    texts = [t for _, t, _ in rows] + [t for _, t in odd]
    want = brute_toxicity(sorted(train, key=lambda r: index.ids.tolist().index(r[0])), texts)
    got = {}
    for r in toxicity.score(docs, index, "doc_id", "y", "text").collect():
        got.setdefault(r.text, set()).add(round(r.score, 6))
        assert r.predicted == (r.score >= 0.5)
    assert {t: {round(s, 6)} for t, s in zip(texts, want, strict=True)} == got


def test_toxicity_keeps_clean_texts_clean_beside_strays(spark):
    """One toxic example among clean neighbours and one clean among toxic ones don't turn the others."""
    rows = made_up(400, 5)
    rows += [(1001, "worddm wordeo wordfn wordhq", 1), (1002, "vile wordal nasty", 0)]
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels), "doc_id", evidence=True).collect()}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    assert sum(got[i].predicted for i, _, y in held if not y) <= 0.01 * len(held)
    assert all(len(got[i].evidence) and got[i].evidence[0].cosine <= 1 + 1e-9 for i, _, _ in held)


def test_toxicity_meets_rare_words(spark):
    """A word of ten toxic examples among many is evidence enough: no word is too rare for the index."""
    rows = made_up(800, 6)
    rows = [(i, t + " blackguard" if y and i % 80 == 0 else t, y) for i, t, y in rows]
    rows = [(i, t.replace(" vile", "").replace(" nasty", "").replace(" scoundrel", "") if i % 80 == 0 else t, y) for i, t, y in rows]
    docs, labels = tables(spark, rows, [(5000, "worddm wordeo blackguard wordfn"), (5001, "worddm wordeo wordfn")])
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels), "doc_id").collect()}
    assert got[5000] == 1 and got[5001] == 0


def test_toxicity_bounds_and_empty_tables(spark):
    docs, labels = tables(spark, made_up(200, 7))
    assert len(toxicity.fit(docs, labels, examples=20).ids) == 40
    small = toxicity.fit(docs, labels, example_bytes=4000)
    assert 0 < len(small.ids) < 160 and len(toxicity.fit(docs, labels, example_bytes=0).ids) == 0
    twice = labels.union(labels.select("doc_id", F.lit(None).cast("int"), "quality")).union(spark.createDataFrame([(None, 1, 1)], "doc_id long, toxic int, quality int"))
    assert toxicity.fit(docs, twice).ids.tolist() == toxicity.fit(docs, labels).ids.tolist()
    for index in (toxicity.fit(docs, labels.where("false")), toxicity.fit(docs.where("false"), labels), toxicity.fit(docs, labels.where("toxic = 1")), toxicity.fit(docs, labels.where("toxic = 0"))):
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, index, "doc_id").collect())
        assert toxicity.score(docs.where("false"), index, "doc_id").count() == 0
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert spark.range(400).where(toxicity.held_out(F.col("id"))).count() == len(ids)


def test_op3_query_holds_out_and_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op3_toxicity"](spark, sf).collect()}
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    assert sum(p for p, t in held if not t) <= 0.03 * len(held) and sum(p for p, t in held if t) >= 0.6 * sum(t for _, t in held)


def test_op3_query_is_the_brute_force(spark, tmp_path):
    """The registered query on a small table: every score by the definition, and as evidence the nearest examples, none of them held out."""
    rows = made_up(150, 21)
    docs, labels = tables(spark, rows, [(5000, "vile nasty wordal"), (5001, None), (5002, "unheard of")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in queries()["op3_toxicity"](spark, str(tmp_path)).collect()}
    index = toxicity.fit(docs, labels)
    train = sorted(learnt(rows), key=lambda r: index.ids.tolist().index(r[0]))
    texts = [(i, t) for i, t, _ in rows] + [(5000, "vile nasty wordal"), (5001, None), (5002, "unheard of")]
    for (i, _), want in zip(texts, brute_toxicity(train, [t for _, t in texts]), strict=True):
        r = got[i]
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert all(zlib.crc32(str(e.doc_id).encode()) % 5 and 0 < e.cosine <= 1 + 1e-9 for e in r.evidence)
        assert [e.cosine for e in r.evidence] == sorted((e.cosine for e in r.evidence), reverse=True)
    assert len(got) == len(texts) and got[5001].evidence == [] == got[5002].evidence and {e.toxic for e in got[5000].evidence[:3]} == {1}


# ---- language model -------------------------------------------------------------------------------


def test_language_model(spark, corpus, scratch):
    docs = docs_of(corpus)
    c = Counter()
    for i, t in docs:
        if not language_model.is_held_out(i):
            c.update([*(t or "").encode().lower().split(), 0])
    n, v = sum(c.values()), len(c)
    got = language_model.score(corpus, scratch).collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, round(r.base_score, 6), r.train_tokens, r.held_out))
        assert r.score <= 0
    for i, t in docs:
        w = [*(t or "").encode().lower().split(), 0]
        want = (len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), n, language_model.is_held_out(i))
        assert want in by[i]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert language_model.score(corpus.where("false"), scratch).count() == 0


def brute_model(docs):
    """Scores by the definition: counts, EM on the histogram of training tokens (each without itself), interpolation, in plain Python."""
    toks = [(i, [*(t or "").encode().lower().split(), 0]) for i, t in docs]
    train = [w for i, w in toks if not language_model.is_held_out(i)]
    one, two, ctx = Counter(), Counter(), Counter()
    for w in train:
        for x, y in zip([None, *w], w, strict=False):
            one[y] += 1
            two[x, y] += 1
            ctx[x] += 1
    n, v = sum(one.values()), len(one)
    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    level = lambda p: None if p == 0 else max(-62, round(2 * math.log2(p)))
    hist = Counter()
    for w in train:
        for x, y in zip([None, *w], w, strict=False):
            hist[bucket(ctx[x] - 1), level((one[y] - 1) / max(n - 1, 1)), level((two[x, y] - 1) / max(ctx[x] - 1, 1))] += 1
    value = lambda k: 0.0 if k is None else 2 ** (k / 2)
    w = {b: [1 / 3] * 3 for b in range(language_model.BUCKETS)} | {0: [0.5, 0.5, 0.0]}
    for _ in range(200):
        new = {b: [1e-3, 1e-3, 0.0] for b in w}
        for (b, p1, p2), k in hist.items():
            parts = [w[b][0] / (v + 1), w[b][1] * value(p1), w[b][2] * value(p2)]
            for j in range(3):
                new[b][j] += k * parts[j] / sum(parts)
        new = {b: [x / sum(r) for x in r] for b, r in new.items()}
        if max(abs(x - y) for b in w for x, y in zip(w[b], new[b], strict=True)) < 1e-7:
            break
        w = new
    seen = sorted({b for b, _, _ in hist} | {0})
    at = lambda c: w[max(b for b in seen if b <= bucket(c))]
    return [(i, sum(math.log10(at(ctx[x])[0] / (v + 1) + at(ctx[x])[1] * one[y] / n + (at(ctx[x])[2] * two[x, y] / ctx[x] if ctx[x] else 0)) for x, y in zip([None, *t], t, strict=False))) for i, t in toks]


def test_language_model_scores_are_the_brute_force(spark, corpus, scratch):
    docs = [(i, t) for i, t in docs_of(corpus) if t is None or len(t) < 10_000]
    got = language_model.score(spark.createDataFrame(docs, "doc_id long, text string"), scratch).collect()
    want = brute_model(docs)
    for a, b in zip(sorted((r.score for r in got)), sorted(s for _, s in want), strict=True):
        assert math.isclose(a, b, rel_tol=2e-4), (a, b)


def test_weights_are_distributions():
    w = language_model.learn(np.array([0, 70, 5000]), np.array([1.0, 5.0, 2.0]), 10)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 2] == 0


def test_levels_and_buckets_follow_the_tokens():
    """Made-up counts of a corpus of 10^12 tokens: rare words keep their own estimates, and contexts their own buckets."""
    n = 10**12
    grid = language_model.Grid.of(n)
    token, context = np.array([2, 3, 9, 1, 10**6, 10**11]), np.array([2**31, 2**33, 2**38, 5, 1, n])
    p = (token - 1) / (n - 1)
    own = grid.value()[grid.level(p)]
    assert own[3] == 0 and all(abs(math.log2(a / b)) <= 0.26 for a, b in zip(own[[0, 1, 2, 4, 5]], p[[0, 1, 2, 4, 5]], strict=True))
    assert language_model.bucket(context).tolist() == [32, 34, 39, 3, 1, 40] and grid.buckets > 40
    assert language_model.Grid.of(1000) == language_model.Grid() and grid.level(np.array([1.0])) == grid.levels - 1
    counts = language_model.Counts(token, context, np.minimum(token, context))
    cell, k = language_model.cells(counts, np.ones(6, bool), n, grid)
    assert len(cell) == 6 and k.sum() == 6
    w = language_model.learn(cell, k * 1e9, 10**8, grid)
    assert np.allclose(w.sum(axis=1), 1) and len(w) == grid.buckets


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_key_packing(keys):
    a = np.sort(np.array(keys, "u8"))
    assert exchange.unpack_keys(exchange.pack_keys(a)).tolist() == a.tolist()


@given(st.lists(st.integers(0, 2000), max_size=50))
def test_small_ints(xs):
    assert exchange.from_small_ints([exchange.small_ints(np.array(xs, "i8"))]).tolist() == xs


# ---- decontamination ------------------------------------------------------------------------------


def brute_hits(text, items):
    w, hit, ids = decontamination.item_words(text), set(), set()
    for item, t in items:
        own = decontamination.item_words(t)
        n = min(10, len(own))
        for k in range(len(own) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    if item is not None:
                        ids.add(item)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def test_decontamination(spark, corpus, scratch):
    items = [(1, "repeats a long shared passage that runs on for WELL over a hundred bytes"), (20, "one"), (3, "twice over!"), (3, "twice over!"), (4, None), (5, ""), (6, "nothing like any of these words stands in the documents at all"), (None, "number 7 holds")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontamination.scan(corpus, bench, scratch, "doc_id", "text").collect()
    assert len(got) == corpus.count()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(r.text, items) and r.contaminated == (r.n_hit > 0)
    clean = decontamination.clean(corpus, bench, scratch)
    assert clean.columns == corpus.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontamination.scan(corpus, bench.where("false"), scratch, "doc_id").where("contaminated").count() == 0
    assert decontamination.scan(corpus.where("false"), bench, scratch, "doc_id").count() == 0


# ---- substring dedup ------------------------------------------------------------------------------


def brute_substrings(docs):
    seen, out = set(), []
    for k, t in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((k, len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("chunk", [600, 5000, 1 << 21])
def test_substring_dedup(spark, corpus, scratch, monkeypatch, chunk):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", chunk)
    real = exchange.pack_chunks
    monkeypatch.setattr(substring_dedup, "pack_chunks", lambda d, s, ordered: real(d, s, ordered, chunk))
    rng = np.random.default_rng(3)
    more = [(100 + i, "".join(rng.choice(list("abc"), 150)) + "SHARED " * (20 + i) + "".join(rng.choice(list("abc"), 50))) for i in range(8)] + [(200, "ab" * 90), (201, "ab" * 90 + "c"), (202, "q" * 99), (203, "q" * 99), (204, "q" * 100), (205, "q" * 101)]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = substring_dedup.dedup(docs, scratch).collect()
    want = brute_substrings([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == Counter(want)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.dedup(docs.where("false"), scratch).count() == 0


# ---- chat -----------------------------------------------------------------------------------------


def test_chat(spark, scratch):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 5, "user", "hi"), (3, 9, "assistant", "yes"), (4, 0, "user", None), (4, 0, None, "x"), (4, 0, None, "x"), (None, 0, "user", "lost"), (6, None, "user", "hi"), (6, 3, "assistant", "no"), (7, 0, None, "x"), (8, 0, "", "")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.chat) for r in chat.render(chat.maximal(df, scratch)).collect()}
    assert set(got) == {2, 4, 6, 8} and got[2] == (2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n") and got[4][0] == 3
    assert chat.render(chat.maximal(df.where("false"), scratch)).count() == 0
    plan = chat.render(chat.maximal(df, scratch))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_and_long_conversations(spark, scratch):
    """Snapshots of one conversation that hold most of the rows, a turn of 20,000 words, and a copy of the longest."""
    long = " ".join(f"w{i}" for i in range(20_000))
    turns = [(k, t, "user" if t % 2 else None, long if t == 3 else f"turn {t}") for k in range(40) for t in range(k + 1)]
    turns += [(100, t, "user" if t % 2 else None, long if t == 3 else f"turn {t}") for t in range(40)] + [(200, t, "user" if t % 2 else None, f"turn {t}") for t in range(30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    kept = chat.maximal(df, scratch)
    got = {r.conv_id: r for r in chat.render(kept).collect()}
    assert set(got) == {39, 200} and got[39].n_turns == 40 and got[200].n_turns == 30
    assert got[39].chat == "".join(f"<|im_start|>user\n{long if t == 3 else f'turn {t}'}<|im_end|>\n" for t in range(40))


# ---- simhash --------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(n, linked):
    lab = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
    return lab


def test_simhash(spark, corpus, scratch):
    got = simhash.group(corpus, scratch, "text").collect()
    fps = [brute_fingerprint(r.text) for r in got]
    assert [r.fp & (1 << 64) - 1 for r in got] == fps
    lab = brute_components(len(got), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    for i, r in enumerate(got):
        ids = [g.doc_id for g, x in zip(got, lab, strict=True) if x == lab[i] and g.doc_id is not None]
        assert r.component_id == min(ids, default=None)
    kept = simhash.distinct_documents(corpus, scratch)
    assert kept.columns == corpus.columns and kept.count() == len(set(lab))
    assert simhash.group(corpus.where("false"), scratch).count() == 0


@given(st.integers(1, 6), st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_close_fingerprints_share_a_key_at_every_block_count(c, fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    masks = simhash.masks(4, c)
    assert any(fp & m == other & m for m in masks) and len(masks) == math.comb(4 + c, c) and min(m.bit_count() for m in masks) >= 64 * c // (4 + c) - c


def test_blocks_follow_the_fingerprints():
    found = [simhash.shared_blocks(10**k) for k in range(3, 15)]
    assert found == sorted(found) and found[0] == 2 and found[-1] > 3
    for n, c in zip((10**k for k in range(3, 13)), found, strict=False):
        assert n / 2 ** (64 * c / (4 + c)) < 4096  # a bucket of evenly spread fingerprints stays small


@pytest.mark.parametrize(("cap", "c"), [(3, 2), (4096, 2), (3, 1), (4096, 3), (5, 4), (4096, 5)])
def test_simhash_links_lose_nothing(spark, scratch, cap, c):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(6)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), cap=cap, c=c)
    roots = {r.node: r.root for r in components(edges, scratch).collect()}
    lab = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    groups = lambda of: sorted(sorted(g) for g in {x: [f for f, y in zip(fps, of, strict=True) if y == x] for x in of}.values())
    assert groups([roots.get(f, f) for f in fps]) == groups(lab)


def test_components_of_a_path_and_a_star(spark, scratch):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(1, 1)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert {roots[k] for k in range(100, 161)} == {100} and {roots[k] for k in range(5, 60)} == {5} and 1 not in roots


def test_split_hot_lets_every_pair_meet(spark):
    rows = split_hot(spark.range(50).selectExpr("0 as k", "id as m"), ["k"], "m", 8).collect()
    tasks = {}
    for r in rows:
        tasks.setdefault((r.lo, r.hi), set()).add(r.m)
    met = {(a, b) for t in tasks.values() for a in t for b in t if a < b}
    assert len(met) == 50 * 49 // 2 and max(map(len, tasks.values())) < 50


# ---- token counts ---------------------------------------------------------------------------------


def test_token_counts(spark, corpus, plain):
    edits = [(0, 3, "New start "), (10, 10, "insert"), (5, 40, ""), (10**6, 10**6, " end"), (None, None, None)]
    col = F.array(*[F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("stop"), F.lit(p).cast("string").alias("put")) for a, b, p in edits], F.lit(None))
    df = corpus.select("doc_id", "text", col.alias("edits"), F.lit("x").alias("tree"), F.lit(1).alias("n_tokens"))
    assert token_counts.build(df, tokenizer()).columns == ["doc_id", "text", "edits", "tree", "n_tokens"]
    got = sorted(((r.doc_id, r.n_tokens, r.n_edited, r.n_chars) for r in token_counts.apply(token_counts.build(df, tokenizer()), tokenizer()).collect()), key=str)
    want = []
    for k, t in docs_of(corpus):
        x = t or ""
        for a, b, p in edits:
            a = min(a or 0, len(x))
            b = min(max(a if b is None else b, a), len(x))
            x = x[:a] + (p or "") + x[b:]
        want.append((k, len(plain(t)), len(plain(x)), len(x)))
    assert got == sorted(want, key=str)
    assert token_counts.apply(token_counts.build(df.where("false"), tokenizer()), tokenizer()).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\x0b", "\r\n", "\x0c "])
def test_edits_encode_only_what_they_touch(plain, blank):
    """Whatever parts the words: the touched leaves, one more for the boundary, and what is put in."""
    encoder = token_store.WordEncoder.of(tokenizer())
    text = blank.join(f"word{i % 97}x{i}" for i in range(3000))
    tree = token_counts.build_tree(text, encoder)
    parts = token_counts.leaves(text)
    assert len(parts) > 3000 // token_counts.LEAF - 1
    ends = np.cumsum([len(p) for p in parts])
    for start, stop, put in ((0, 0, "x"), (7, 9, ""), (5000, 5000, "two words "), (9000, 9400, ""), (12_345, 12_346, blank), (len(text), len(text), " end"), (len(text) - 5, len(text), "")):
        new, grown, encoded = token_counts.edit(text, token_counts.CountTree.load(tree.dump()), start, stop, put, encoder)
        a, b = np.minimum(np.searchsorted(ends, [start, max(start, stop - 1)], "right"), len(parts) - 1)
        assert new == text[:start] + put + text[stop:] and grown.tokens == len(plain(new)) and grown.chars == len(new)
        assert encoded <= sum(len(p) for p in parts[a : b + 2]) + len(put)


def test_op9_query_encodes_little_again(spark):
    got = queries()["op9_token_counts"](spark, SF).agg(F.sum("n_encoded").alias("again"), F.sum("n_chars").alias("all"), F.count_if(F.col("n_encoded") > 6 * 2 * token_counts.LEAF * 40).alias("much")).first()
    long = spark.createDataFrame([(1, "\t".join(f"w{i}" for i in range(20_000)))], "doc_id long, text string")
    edits = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(i + 3).alias("stop"), F.lit("new text").alias("put")) for i in (10, 50_000, 90_000)])
    one = token_counts.apply(token_counts.build(long.withColumn("edits", edits), tokenizer()), tokenizer()).first()
    assert got.again < got.all and got.much == 0 and one.n_encoded < 0.03 * one.n_chars and one.n_edits == 3


# ---- embeddings -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("target", "cap"), [(2048, 2048), (2048, 6), (4, 6), (1, 64)])
def test_embeddings(spark, scratch, target, cap):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(30):
        c = rng.standard_normal(24)
        rows += [(len(rows) + k, (c + rng.standard_normal(24) * s).astype("f4").tolist(), g % 2) for k, s in enumerate((0, 0, 0.1, 0.25, 0.35))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [None] * 24, 1), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, [float("inf")] + [1.0] * 23, 0), (n + 7, rows[0][1], 0), (n + 8, None, 1)]
    got = {r.vec_id: r for r in embedding_dedup.link(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, c string"), scratch, target=target, cap=cap).collect()}
    good = [(i, np.array(v, "f8"), y) for i, v, y in rows if v and None not in v and np.isfinite(v).all() and any(v) and y is not None]
    links, near = Counter(), []
    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.update((i, j))
                near.append((i, j))
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and found <= sum(links.values()) and found >= 0.99 * sum(links.values())
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (n, n + 1, n + 2, n + 3, n + 4, n + 5, n + 6, n + 8))
    assert got[1].component_id == got[n + 7].component_id == 0 and not got[1].kept
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), scratch).count() == 0


@pytest.mark.parametrize(("n", "target"), [(300, 2048), (1500, 64), (4000, 16)])
def test_embedding_recall(spark, scratch, n, target):
    """Planted pairs just above the threshold, in labels of text, at sizes with few and many key bits."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 32))
    x[1::3] = x[::3][: len(x[1::3])] + rng.standard_normal((len(x[1::3]), 32)) * 0.35
    label = np.repeat(rng.integers(0, 2, n // 3 + 1), 3)[:n]
    rows = [(int(i), v.tolist(), f"label {y}", None) for i, (v, y) in enumerate(zip(x, label, strict=True))]
    rows += [(0, rows[1][1], rows[1][2], 1), (0, rows[0][1], rows[0][2], 1)]  # repeated ids
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, dim int"), scratch, target=target).collect()
    v, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(near, False)
    assert len(got) == len(rows) and 0.99 * near.sum() <= sum(r.n_links for r in got) <= near.sum()
    want = near.sum(axis=1)
    per = {}
    for i, r in enumerate(rows):
        per.setdefault(r[0], []).append(want[i])
    assert all(r.n_links <= max(per[r.vec_id]) for r in got)


def test_embedding_plan_follows_the_rows():
    assert embedding_dedup.plan(2048, 0.93) == (0, 1)
    found = [embedding_dedup.plan(2048 << k, 0.93) for k in range(1, 25)]
    assert [b for b, _ in found] == list(range(1, 25)) and [t for _, t in found] == sorted(t for _, t in found)
    assert all((1 - (1 - math.acos(0.93) / math.pi) ** b) ** t <= 0.002 for b, t in found)


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rot = embedding_dedup.rotation(64, 7)
    codes, factor = embedding_dedup.encode(x, rot)
    true = x @ x.T
    codes = embedding_dedup.signs_of(codes, 64)
    mean = embedding_dedup.upper_bound(x @ rot.T, codes, factor, 0.0)
    off = ~np.eye(400, dtype=bool)
    assert abs((mean - true)[off].mean()) < 0.01
    assert (embedding_dedup.upper_bound(x @ rot.T, codes, factor, embedding_dedup.SIGMA) >= true - 1e-9).mean() > 0.999


def test_quantised_vectors_are_bounded():
    rng = np.random.default_rng(8)
    for d in (1, 7, 64):
        y = rng.standard_normal((50, d))
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        packed, step, lost = embedding_dedup.quantise(y)
        back = embedding_dedup.restored(packed, step, d)
        assert packed.shape == (50, -(-d // 2)) and np.allclose(np.linalg.norm(y - back, axis=1), lost) and (lost < 0.2).all()
        assert (np.abs(y @ y.T - back @ y.T) <= lost[:, None] + 1e-12).all()


def test_vectors_are_fetched_for_survivors_alone(spark, scratch, monkeypatch):
    """At tens of tables, what goes to buckets holds no vector, and vectors move about once for each pair that is near."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x[1::30] = x[::30] + rng.standard_normal((100, 64)) * 0.2
    written = []
    monkeypatch.setattr(scratch, "write", lambda df, f=scratch.write: written.append(out := f(df)) or out)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.link(df, scratch, target=4).collect()
    keyed, left = (next(t for t in written if t.columns == [f.split()[0] for f in ddl.split(", ")]) for ddl in (embedding_dedup.INDEXED, embedding_dedup.LEFT))
    tables = keyed.selectExpr("max(length(keys) / width) as t").first().t
    assert tables > 15 and "v" not in left.columns and left.count() < 2 * 3000 and sum(r.n_links for r in got) == 200


# ---- the registered queries -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def given_docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_op1_query(spark, given_docs, plain):
    want, at = {}, 0
    for i, t in given_docs:
        ids = [*plain(t), 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op1_token_store"](spark, SF).collect()} == want


def test_op4_query(spark, given_docs):
    got = {r.doc_id: r for r in queries()["op4_language_model"](spark, SF).collect()}
    want = dict(brute_model(given_docs))
    assert set(got) == set(want) and all(math.isclose(got[i].score, want[i], rel_tol=2e-4) for i in want)


def test_op5_query(spark, given_docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {}
    for i, t in items:
        w = decontamination.item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            known.setdefault(tuple(w[k : k + 10]), set()).add(i)
    lengths = {len(w) for w in known}
    got = {r.doc_id: r for r in queries()["op5_decontaminate"](spark, SF).collect()}
    assert len(got) == len(given_docs)
    for i, t in given_docs:
        w, hit, ids = decontamination.item_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := known.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), sha, bool(hit))


def test_op6_query(spark, given_docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op6_substring_dedup"](spark, SF).collect()}
    assert got == {i: tuple(more) for i, *more, _ in brute_substrings(given_docs)}


def test_op8_query(spark, given_docs):
    fps = [brute_fingerprint(t) for _, t in given_docs]
    lab = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    want = {i: (f"{f:016x}", min(k for (k, _), y in zip(given_docs, lab, strict=True) if y == x)) for (i, _), f, x in zip(given_docs, fps, lab, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op8_simhash"](spark, SF).collect()} == want


def test_op9_query(spark, given_docs, plain):
    got = {r.doc_id: r for r in queries()["op9_token_counts"](spark, SF).collect()}
    for i, t in given_docs:
        x, n = t or "", len(t or "")
        for a, b, p in ((n // 3, n // 3 + 7, "edited words "), (n // 2, n // 2 + 10, ""), (n, n, " the end.")):
            x = x[: min(a, len(x))] + p + x[min(b, len(x)) :]
        assert (got[i].n_tokens, got[i].n_edited, got[i].n_chars) == (len(plain(t)), len(plain(x)), len(x))


def test_op10_query_on_planted_pairs(spark, tmp_path):
    """The given vectors hold no pair at the threshold, so near ones are added to them."""
    given_rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rng = np.random.default_rng(8)
    near = [(10_000 + i, [float(np.float32(x + e)) for x, e in zip(v, rng.standard_normal(len(v)) * 0.2 * np.std(v), strict=True)], y) for i, (_, v, y) in enumerate(given_rows[:100])]
    spark.createDataFrame(given_rows + near, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in queries()["op10_embedding_dedup"](spark, str(tmp_path)).collect()}
    ids = [i for i, _, _ in given_rows + near]
    v = np.array([v for _, v, _ in given_rows + near], "f4").astype("f8")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    y = np.array([y for _, _, y in given_rows + near])
    link = (v @ v.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(link, False)
    assert link.sum() > 150 and {i: r.n_links for i, r in got.items()} == dict(zip(ids, link.sum(axis=1).tolist(), strict=True))
    lab = brute_components(len(ids), lambda i, j: link[i, j])
    least = {x: min(i for i, z in zip(ids, lab, strict=True) if z == x) for x in lab}
    assert all(got[i].component_id == least[x] and got[i].kept == (least[x] == i) for i, x in zip(ids, lab, strict=True))


# ---- chunks in groups, and documents that share an id ------------------------------------------------


def test_chunks_answer_alike_in_groups(spark, scratch, monkeypatch):
    """Few chunks to a group: merged and spread again, every count, verdict and byte is that of one level."""
    rng = np.random.default_rng(5)
    hot = " ".join(f"hot{i}" for i in range(60))
    docs = [(i, " ".join([*(f"w{int(x)}" for x in rng.integers(0, 400, 30)), *([hot] if i % 3 else []), *(["the the the"] * (i % 4))])) for i in range(300)] + [(1000, None), (None, hot)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 9000)
    monkeypatch.setattr(exchange, "RANGE_KEYS", 2000)
    pack = exchange.pack_chunks
    for module in (language_model, substring_dedup):
        monkeypatch.setattr(module, "pack_chunks", lambda d, s, ordered=False, chunk_bytes=0: pack(d, s, ordered, 3000))
    got = []
    for most in (1 << 16, 7, 1):
        monkeypatch.setattr(exchange, "GROUP", most)
        model = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.score, 6)) for r in language_model.score(df, scratch).collect())
        left = sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(df, scratch).collect())
        got.append((model, left))
    assert got[0] == got[1] == got[2] and sum(r[1] for r in got[0][1]) > 10_000
    want = {str(i): more for i, *more in brute_substrings(docs)}
    assert all([n, s, h] == [want[i][1], want[i][2], want[i][3]] for i, n, s, h in got[0][1])


def test_anchors_are_even_over_ranges():
    """Anchors are the least of fifty-one hashes; the keys that ask for them must not be."""
    rng = np.random.default_rng(7)
    data = rng.integers(97, 123, 200_000).astype("u1")
    b = substring_dedup.Batch(data, np.array([0]), np.array([len(data)]), True)
    per = np.bincount((np.unique(b.anchor) >> np.uint64(60)).astype("i8"), minlength=16)
    assert per.min() > 0.8 * per.mean() and per.max() < 1.2 * per.mean()


def test_chunks_of_a_task_are_one_file(spark, scratch):
    """Numbers are chosen by Spark's own hash, so that a task's chunks share a bucket; they ascend with the task."""
    x = np.array([0, 1, 42, 2**31, 2**40 + 5, 2**62 + 12345], "i8")
    want = [r.h for r in spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "i int, v long").orderBy("i").select(F.hash("v").alias("h")).collect()]
    assert exchange._bucket_hash(x).tolist() == want
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(3000)], "doc_id long, text string")
    chunks = exchange.pack_chunks(df, scratch, ordered=True, chunk_bytes=4000)
    per = chunks.select((F.col("chunk").bitwiseAND(0) + F.shiftright("chunk", exchange.PLACES)).alias("task"), F.input_file_name().alias("f"), "chunk").groupBy("task").agg(F.count_distinct("f").alias("files"), F.count("*").alias("n")).collect()
    assert len(per) > 1 and all(r.files == 1 and r.n > 5 for r in per)
    ids = [k for r in chunks.orderBy("chunk").collect() for k in exchange.Chunk(r.doc_ids, r.known, r.ends, r.data).ids().to_pylist()]
    assert ids == list(range(3000))


def test_rows_without_ids_are_many_tasks(spark, scratch):
    """Null and repeated ids are ranged by their texts: several tasks, and the order of ids as ever."""
    rows = [(None, f"text number {i % 700} of many") for i in range(2000)] + [(7, f"another {i}") for i in range(2000)] + [(i, f"own {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chunks = exchange.pack_chunks(df, scratch, ordered=True, chunk_bytes=4000)
    read = [(r.chunk, exchange.Chunk(r.doc_ids, r.known, r.ends, r.data)) for r in chunks.orderBy("chunk").collect()]
    ids = [k for _, c in read for k in c.ids().to_pylist()]
    assert ids == sorted(ids, key=lambda k: (k is None, k or 0)) and len(ids) == len(rows)
    for key in (None, 7):
        assert len({chunk >> exchange.PLACES for chunk, c in read if key in c.ids().to_pylist()}) > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        container = token_store.store(df, tokenizer(), 2, scratch)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [(r.part, token_store.np.frombuffer(r.known, "u1")) for r in container.select("part", "known").collect()]
    assert len({p for p, known in parts if not known.all()}) > 1
    back = [r.doc_id for r in token_store.read_back(container).orderBy("start").collect()]
    assert back == sorted(back, key=lambda k: (k is None, k or 0)) and len(back) == len(rows)


def test_clashing_names_are_refused(spark, corpus, scratch):
    with pytest.raises(ValueError, match="score"):
        toxicity.score(corpus, toxicity.fit(corpus, spark.createDataFrame([], "doc_id long, toxic int")), "score")
    with pytest.raises(ValueError, match="fp"):
        simhash.group(corpus, scratch, "fp")


def test_chunk_tables_have_row_groups_of_a_few_chunks(spark, scratch):
    """A row group is held at once where it is written and where it is read, so it doesn't follow how much text a task packs."""
    import pyarrow.parquet as pq

    docs = spark.range(0, 48, 1, 1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 8192), i -> sha2(concat(id, ',', i), 512)), '')").alias("text"))
    chunks = exchange.pack_chunks(docs, scratch, chunk_bytes=1 << 20)
    assert chunks.agg(F.sum("bytes"), F.count("*")).first() == (48 << 20, 48)
    found = [pq.ParquetFile(p.removeprefix("file://")).metadata for p in chunks.inputFiles()]
    assert max(m.row_group(i).num_rows for m in found for i in range(m.num_row_groups)) <= 16
