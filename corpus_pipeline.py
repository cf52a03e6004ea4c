"""The corpus pipeline: toxic documents go, near-duplicates go, benchmark leaks go, sources are mixed, tokens are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontamination, mixing, simhash, token_store, toxicity
from lodestrata.llm.common import Scratch, table
from lodestrata.llm.queries import tokenizer

ROW = "__ls_row"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score is below 0.5; the examples are labelled documents outside the held-out fold."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias(ROW)
    scored = toxicity.score(docs.select("text", rest), index, "text", ROW).where("predicted = 0")
    return scored.select(*["text" if c == "text" else F.col(ROW).getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of linked fingerprints the document with the smallest doc_id."""
    return simhash.distinct_documents(docs, Scratch(spark, "simhash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; a document taken no time goes."""
    return mixing.expand(docs, Scratch(spark, "mixing"))


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as packed token ids and returns what reading it back gives for each document."""
    return token_store.read_back(token_store.store(docs, tokenizer(), 2, Scratch(spark, "tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", store_tokens),
]

#: SQL can't express the toxicity stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written and read again for the next."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        after = stage(spark, docs, sf_dir)
        docs = after if name == STAGES[-1][0] else scratch.write(after)
    return docs
