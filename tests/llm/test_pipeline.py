import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import mixing, toxicity
from lodestrata.llm.queries import tokenizer
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_hits, brute_toxicity, learnt, made_up


@pytest.fixture
def planted(spark, tmp_path):
    """Tables with toxic documents, a copy group of a third of all rows, near copies, leaks, nulls, ties and clashing names."""
    rng = np.random.default_rng(12)
    long = [f"plain{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    prose = lambda n: " ".join(rng.choice(long, n))
    docs = [(i, t, y) for i, t, y in made_up(160, 9)]
    docs += [(1000 + i, prose(40), 0) for i in range(60)]
    hot = prose(80)
    docs += [(2000 + i, hot, 0) for i in range(120)]
    near = prose(400).split()
    docs += [(3000 + i, " ".join([*near[: 10 * i], "changed", *near[10 * i + 1 :]]), 0) for i in range(8)]
    item = prose(15)
    docs += [(4000 + i, f"{prose(12)} {item} {prose(9)}", 0) for i in range(5)]
    docs += [(5000, None, 0), (5001, "", 0), (5002, None, 0), (None, prose(30), 0), (1000, docs[160][1], 0), (1000, prose(20), 0)]
    rows = [(i, t, "en", None if k % 11 == 0 else f"s{k % 3}", None, "x", k, {"k": k}, 1.5) for k, (i, t, _) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th string, fp int, m map<string,int>, score double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, y) for i, _, y in docs if i is not None and i < 2000 and (i, y) != (1000, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, [(1, item)]


def test_pipeline_is_the_brute_force(spark, planted, tmp_path):
    """Each stage's rows against its definition over the rows that its predecessor kept."""
    sf, docs, items = planted
    given = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    df = given
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        assert name == "token_output" or df.columns == given.columns
        df.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = [(r.doc_id, getattr(r, "text", None)) for r in df.collect()]

    index = toxicity.fit(given, spark.read.parquet(f"{sf}/labels.parquet"))
    labelled = {i: y for i, _, y in docs if i is not None and i < 2000}
    texts = {i: min(t or "" for k, t, _ in docs if k == i) for i in labelled}
    train = sorted(learnt([(i, texts[i], y) for i, y in labelled.items()]), key=lambda r: index.ids.tolist().index(r[0]))
    scores = brute_toxicity(train, [t for _, t, _ in docs])
    clean = [(i, t) for (i, t, _), s in zip(docs, scores, strict=True) if s < 0.5]
    assert Counter(kept["toxicity"]) == Counter(clean)
    assert not {i for i, _, y in docs if y and i in dict(clean)} and sum(1 for i, _, y in docs if not y) == len(clean)

    fps = [brute_fingerprint(t) for _, t in clean]
    lab = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    groups = {}
    for row, x in zip(clean, lab, strict=True):
        groups.setdefault(x, []).append(row)
    one = kept["simhash_near_dedup"]
    assert len(one) == len(groups)
    least = [min((r for r in g if r[0] is not None), default=(None,))[0] for g in groups.values()]
    assert Counter(i for i, _ in one) == Counter(least) and set(one) <= set(clean)

    assert Counter(kept["decontamination"]) == Counter(r for r in one if not brute_hits(r[1], items)[1])
    assert {i for i, _ in one} - {i for i, _ in kept["decontamination"]} == {4000 + i for i in range(5)}

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/decontamination/*.parquet'")
    taken = Counter()
    for doc_id, size, _, _, words in con.execute(mixing.MIX_SQL).fetchall():
        taken[doc_id] += words // size if size else 0
    mixed = Counter(i for i, t in kept["mixing"] if (t or "").split())
    assert mixed == +taken and set(kept["mixing"]) <= set(kept["decontamination"])

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    want, at = [], 0
    for i, text in sorted(kept["mixing"], key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    rows = lambda df: sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])
    assert rows(df) == want and rows(corpus_pipeline.run(spark, sf)) == want


def test_stages_keep_clean_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        assert docs.select("doc_id").distinct().count() == sizes[-1]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    done = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in done} <= ids and min(r.start for r in done) == 0
    at = 0
    for r in sorted(done, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
