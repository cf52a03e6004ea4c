"""Chat formatting: collapsing cumulative snapshots of a conversation, then rendering what is left.

Logs often hold a conversation again after each turn. A running hash over the turns gives one value
for each prefix of each conversation; a conversation whose whole hash is another's proper prefix is a
snapshot and goes by an anti-join; of equal conversations the smallest id stays. All of it is built-in
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(salt: int) -> Column:
    """A turn's hash by its place: xor over a prefix then is the prefix's hash, in any order of adding."""
    return F.xxhash64(F.lit(salt), F.col("pos"), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def maximal(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The turns (conv_id, pos, role, text) of conversations that no longer one begins with, ``pos`` from 1.

    Turns are in the order (turn, role, text), nulls first. Null roles and texts are values of their
    own. Rows without a conv_id belong to no conversation and are left out. Places and running hashes
    are found within the pieces of a range exchange on that order and shifted by the pieces before, so
    a conversation with a third of all rows is spread over its pieces.
    """
    order = ["turn", "role", "text"]
    rows = turns.select("conv_id", *order).where("conv_id is not null").repartitionByRange("conv_id", *order)
    pieces = scratch.write(rows.withColumn("piece", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "piece").orderBy(*order)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pieces.withColumn("r", F.row_number().over(inside))
    ahead = pieces.groupBy("conv_id", "piece").agg(F.count("*").alias("n")).select("conv_id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = ranked.join(ahead, ["conv_id", "piece"]).select("conv_id", "piece", (F.col("ahead") + F.col("r")).alias("pos"), "role", "text")
    placed = scratch.write(placed.withColumns({"h1": _turn_hash(1), "h2": _turn_hash(2)}))

    run = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("conv_id", "piece").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    sums = sums.select("conv_id", "piece", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"a{i}") for i in (1, 2)])
    prefixes = placed.select("conv_id", "piece", "pos", *[F.bit_xor(f"h{i}").over(run).alias(f"h{i}") for i in (1, 2)]).join(sums, ["conv_id", "piece"])
    prefixes = prefixes.select("conv_id", "pos", *[F.col(f"h{i}").bitwiseXOR(F.col(f"a{i}")).alias(f"p{i}") for i in (1, 2)])
    whole = placed.groupBy("conv_id").agg(F.max("pos").alias("n"), F.bit_xor("h1").alias("w1"), F.bit_xor("h2").alias("w2"))
    proper = prefixes.join(whole.select("conv_id", "n"), "conv_id").where("pos < n").select("pos", "p1", "p2").distinct()
    one = whole.groupBy("n", "w1", "w2").agg(F.min("conv_id").alias("conv_id"))
    kept = one.join(proper, (one.n == proper.pos) & (one.w1 == proper.p1) & (one.w2 == proper.p2), "left_anti")
    return placed.select("conv_id", "pos", "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi")


def render(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, n_turns, chat. A null role is ``user``, a null text is empty."""
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    lines = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", "n_turns", F.concat_ws("", F.col("lines.line")).alias("chat"))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, role, text,
    coalesce(length(role)::VARCHAR || ':' || role, '-') || '/' || coalesce(length(text)::VARCHAR || ':' || text, '-') || ';' AS enc
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n, md5(string_agg(enc, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS pre FROM t
), w AS (
  SELECT min(conv_id) AS conv_id, pos, pre FROM p WHERE pos = n GROUP BY pos, pre
), k AS (
  SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.pos AND p.pre = w.pre)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM t JOIN k USING (conv_id) GROUP BY conv_id
"""
