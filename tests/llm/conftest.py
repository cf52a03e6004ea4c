import pytest
from pyspark.sql import Row

from lodestrata.llm.common import Scratch

TEXTS = [
    None, "", " \t\n", "one", "Two words", "the same text twice over, in full", "the same text twice over, in full", "The SAME text twice over, in full",
    "é" * 40 + " ünï cödé " * 9, "a" * 700, "x y z " * 400, "repeat this line of twelve words again and again until it stops now\n" * 12,
    " ".join(f"w{i * 7919 % 9973}" for i in range(20_000)),
    *[f"document number {i} holds words {i * 7} and {i * 13} but otherwise repeats a long shared passage that runs on for well over a hundred bytes in every one of them {'tail ' * (i % 4)}" for i in range(30)],
]


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with null, empty and long texts, ties, repeated rows, null ids and sources, and clashing extra columns."""
    rows = [Row(doc_id=i, text=t, lang="en", source=None if i % 5 == 0 else f"s{i % 3}", n_chars=len(t or ""), fp="x", score=1.0, rid=7) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], Row(doc_id=3, text="another with an id that is taken", lang=None, source="s1", n_chars=None, fp=None, score=None, rid=None), Row(doc_id=None, text="no id at all", lang=None, source=None, n_chars=None, fp=None, score=None, rid=None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, rid int").repartition(3).cache()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")
