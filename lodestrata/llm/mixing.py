"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times. Documents are ordered by size
and id within their source, the expected copies are summed up along that order from one random offset
a source, and a document is emitted once for each integer the sum passes. A partial sum is never more
than one copy off, so with sizes in order the words taken differ from the target by less than the
largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Adds ``target`` to ``sizes(source, source_size)``, one row a source.

    The budget is ``share`` of all sizes, dealt by weight; no target exceeds ``most`` times its
    source's size, and what is cut off is dealt again by weight. That end state is
    min(cap, weight * level), where the sources with the least cap / weight are at their caps; the
    level follows from one running sum in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source; null counts as an empty name."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit(""))), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row of ``docs(doc_id, text, source)``, and ``keep``.

    A null text has size 0; null is a source of its own, ordered last; equal rows are
    interchangeable, so reruns agree. The order within a source is a range exchange on (source, size,
    doc_id, nulls last): ranks are counted within its pieces and shifted by the pieces before, so a source with a
    third of the rows is spread over a third of the pieces.
    """
    keep = keep or []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[docs[c].alias(f"_k_{c}") for c in keep])
    pieces = scratch.write(scratch.write(sized).repartitionByRange(F.col("source"), F.col("size"), F.col("doc_id").asc_nulls_last()).withColumn("piece", F.spark_partition_id()))
    per = pieces.groupBy("source", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    before = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("source", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    plan = targets(pieces.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    per = per.join(plan, per.source.eqNullSafe(plan.source)).select(per.source.alias("s_source"), F.col("piece").alias("s_piece"), "before", "source_size", "target")
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("source", "piece").orderBy("size", F.col("doc_id").asc_nulls_last())))
    out = ranked.join(per, ranked.source.eqNullSafe(per.s_source) & (ranked.piece == per.s_piece))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, u = F.col("before") + F.col("r"), offset(F.col("source"), seed)
    copies = (F.floor(rate * at + u) - F.floor(rate * (at - 1) + u)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *[F.col(f"_k_{c}").alias(c) for c in keep])


def expand(docs: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, ``how`` being what ``mix`` takes.

    The mix is worked out on ids, sizes and a hash of each row and joined back once. Rows equal in all
    columns are interchangeable: one stands for them all and has the sum of their copies. Columns of any type
    are carried; maps, which have no hash, count by their JSON.
    """
    whole = [F.to_json(F.struct(docs[c])) if "map<" in kind or "variant" in kind else docs[c] for c, kind in docs.dtypes]
    mine = docs.withColumns({"__ls_row": F.xxhash64(*whole), "__ls_id": F.coalesce("doc_id", F.lit(-1))})
    narrow = mine.select("doc_id", "text", "source", "__ls_row", "__ls_id")
    taken = mix(narrow, scratch, keep=["__ls_row", "__ls_id"], **how)
    taken = scratch.write(taken.groupBy("__ls_row", "__ls_id").agg(F.sum("copies").alias("__ls_copies"), F.count("*").alias("__ls_rows")).where("__ls_copies > 0"))
    key = ["__ls_row", "__ls_id"]
    once = mine.join(taken.where("__ls_rows = 1"), key)
    more = mine.join(taken.where("__ls_rows > 1"), key).dropDuplicates(key)
    return once.union(more).withColumn("__ls_copy", F.explode(F.sequence(F.lit(1), F.col("__ls_copies")))).select(*docs.columns)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), v AS (
  SELECT arg_min(level, k) AS level FROM (SELECT level, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM l WHERE level * weight <= cap)
), t AS (
  SELECT l.source, source_size, coalesce(least(cap, weight * v.level), cap)::DOUBLE AS target,
    ('0x' || substr(sha256('17:' || coalesce(l.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l CROSS JOIN v
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS place FROM d
)
SELECT r.doc_id, r.size, t.source_size, t.target,
  (r.size * CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * place + u) - floor(t.target / t.source_size * (place - 1) + u) ELSE 0 END)::BIGINT AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
