"""The queries of the corpus operators: thin bindings of the driver's tables to the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, divergence, embedding_dedup, language_id, language_model, mixing, periodic_runs, simhash, substring_dedup, token_counts, token_store, toxicity
from .common import Scratch, table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op1")
    return token_store.read_back(token_store.store(table(spark, sf_dir, "documents"), tokenizer(), 2, scratch))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), "doc_id", evidence=True)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op5"), "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(chat.maximal(table(spark, sf_dir, "conversations"), Scratch(spark, "op7")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.group(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))

    def put(start, stop, text: str):
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), F.lit(text).alias("put"))

    edits = F.array(put(F.floor(n / 3), F.floor(n / 3) + 7, "edited words "), put(F.floor(n / 2), F.floor(n / 2) + 10, ""), put(n, n, " the end."))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", edits.alias("edits"))
    return token_counts.apply(token_counts.build(docs, tokenizer()), tokenizer())


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where a tenth, by the crc32 of the id, goes on from some word with the words from there over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("CAST(try_mod(g, n) AS INT)"))  # null where a text has no words
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    planted = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST(ceil((n - a) / p) AS INT))), 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.detect(with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("x.start"), F.col("x.length"), -F.col("x.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"))
    profiles = language_id.learn(docs.where(~held))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), profiles)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_store, op2_mix, op3_toxicity, op4_language_model, op5_decontaminate, op6_substring_dedup, op7_chat, op8_simhash, op9_token_counts, op10_embedding_dedup, op11_periodic_runs, op12_source_divergence, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": mixing.MIX_SQL, "op7_chat": chat.CHAT_SQL, "op12_source_divergence": divergence.AUDIT_SQL, "op13_language_id": language_id.PREDICT_SQL}
