"""Tree digests of files of any size: parts are digested in tasks of their own and joined.

The digest is BLAKE3, plain or keyed, so that records of tools that use it can be verified.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blake3

#: The key of digests that hold a duplicate against its original, apart from those that found it.
KEY = b"lodestrata independent verifying"
PIECE = T.StructType().add("value", "binary").add("reason", "string")


def of_content(content: Column, key: bytes | None = None) -> Column:
    """The digest of a binary column, null for null."""

    @F.arrow_udf(T.StringType())
    def run(data: pa.Array) -> pa.Array:
        held, at, size = [], [], 0
        out: list[str | None] = [None] * len(data)

        def flush():
            for i, digest in zip(at, blake3.of_many(held, key), strict=True):
                out[i] = digest
            held.clear()
            at.clear()

        for i in range(len(data)):
            if (x := data[i].as_py()) is not None:
                held.append(x)
                at.append(i)
                size += len(x)
                if size > 1 << 22:
                    flush()
                    size = 0
        flush()
        return pa.array(out, pa.string())

    return run(content)


def tree_digests(files: DataFrame, key: bytes | None = None, part: int = blake3.PART) -> DataFrame:
    """``files(path, size)`` with ``digest`` and ``reason``; a file that can't be read, or isn't as long as listed, has a reason and no digest.

    ``part`` is a power of two of 1024 bytes. What comes together for a file is 32 bytes a part.
    """
    count = F.greatest(F.ceil(F.col("size") / part), F.lit(1)).cast("int")
    parts = files.select("path", "size").distinct().withColumn("_parts", count).withColumn("_n", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))

    @F.arrow_udf(PIECE)
    def read(path: pa.Array, size: pa.Array, number: pa.Array, of: pa.Array) -> pa.Array:
        values, reasons = [], []
        for p, s, n, parts in zip(*(x.to_pylist() for x in (path, size, number, of)), strict=True):
            try:
                with open(p, "rb") as f:
                    if os.fstat(f.fileno()).st_size != s:
                        raise OSError("the file changed since it was listed")
                    f.seek(n * part)
                    values.append(blake3.part(f.read(part), n, parts == 1, key, part))
                    reasons.append(None)
            except OSError as e:
                values.append(None)
                reasons.append(str(e))
        return pa.StructArray.from_arrays([pa.array(values, pa.binary()), pa.array(reasons, pa.string())], names=["value", "reason"])

    @F.arrow_udf(T.StringType())
    def join(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else blake3.digest(v, key) for v in values.to_pylist()], pa.string())

    dealt = parts.repartition(F.col("path"), F.col("_n")).withColumn("p", read("path", "size", "_n", "_parts"))
    per = dealt.groupBy("path", "size").agg(F.array_sort(F.collect_list(F.struct("_n", F.col("p.value").alias("value")))).alias("v"), F.max("p.reason").alias("reason"))
    made = per.select("path", "size", "reason", join(F.when(F.col("reason").isNull(), F.col("v.value"))).alias("digest"))
    return files.join(made, ["path", "size"], "left").select(*files.columns, "digest", "reason")
