"""Row numbers over a whole table, or over groups of any size, without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import cut


def numbered(df: DataFrame, order: list, bucket: Column, name: str) -> DataFrame:
    """Adds ``name``, the 0-based place of each row by ``order``.

    ``bucket`` must not decrease along the order and is never null. Rows are numbered within their
    bucket; where a bucket starts is a running total over one row for each bucket, the only rows
    that a single task sees.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return rows.withColumn("_place", place).join(starts, "_bucket").withColumn(name, (F.col("_start") + F.col("_place")).cast("long")).drop("_bucket", "_start", "_place")


def ranked(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """Adds ``name``, the 0-based place of each row by ``order`` in its group of ``by``.

    Rows are exchanged by ranges of group and order, so a group of any size is spread over as many pieces as it fills; where
    a piece starts is a running total over one row for each piece of its group. The exchange is checkpointed: what
    lies in which piece must not change between the count and the numbering.
    """
    marked = cut(df.repartitionByRange(*by, *order).withColumn("_piece", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    per = marked.groupBy(*by, "_piece").agg(F.count("*").alias("_n")).select(*by, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order)) - 1
    met = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_l.{c}")) for c in (*by, "_piece")]
    both = marked.withColumn("_place", place).alias("_l").join(per.alias("_r"), met)
    return both.select(*[F.col(f"_l.{c}") for c in df.columns], (F.col("_start") + F.col("_place")).cast("long").alias(name))
