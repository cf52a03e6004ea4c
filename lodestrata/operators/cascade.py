"""The duplicate cascade: sizes, then digests of heads and tails, then digests of whole contents.

A size that occurs once needs no digest, and whole contents count only where size and partial digest
agree. Files on disk (``classify_paths``) are opened no further than that. Contents in a table
(``classify``) are scanned twice: for sizes and ends, and again for the whole contents of those rows
alone whose size and ends another row shares. Only narrow rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_key
from ..runtime import cut
from ..sources.readers import full_digest_udf, partial_digest_udf
from .numbering import numbered

K = 64 * 1024


def partial_bytes(content: Column, k: int) -> Column:
    """All of up to k bytes, the head of up to 2k, head and tail of more."""
    size = F.octet_length(content)
    return F.when(size <= 2 * k, F.substring(content, 1, k)).otherwise(F.concat(F.substring(content, 1, k), F.substring(content, -k, k)))


def band(size: Column, k: int) -> Column:
    return F.when(size <= k, "whole").when(size <= 2 * k, "head").otherwise("head_tail")


#: So many shared (size, ends) are sent to the second scan as they are, 64 bytes each; more of them as bits.
EXACT = 1 << 20
#: Bits for each of them, and at most: 32 MB.
BITS, MOST_BITS = 32, 1 << 28


def classify(files: DataFrame, content: str = "content", path: str = "path", k: int = K) -> DataFrame:
    """The other columns of ``files`` with size, partial_digest, covers_whole, known_hash, copies, original_path, role and digested.

    ``role`` is unique, original (first of its group by depth, then path components), duplicate or, for
    null content, skipped; ``digested`` says that the second scan took the whole content's digest. Both scans'
    rows are checkpointed without their contents, so what reads the result scans no content. Counts are
    aggregates joined back, so a size that a third of all files share is combined before it is shuffled.
    """
    size, head = F.octet_length(content).cast("long"), F.sha2(partial_bytes(F.col(content), k), 256)
    rest = [F.col(c) for c in files.columns if c != content]
    first = cut(files.select(*rest, size.alias("size"), head.alias("_part")))
    again = _repeated(first.where(F.col("size") > k), "size", "_part")
    n = again.count()
    left = files.select(*rest, content, size.alias("size"), head.alias("_part")).where(F.col("size") > k)
    left = left.join(F.broadcast(again), ["size", "_part"], "left_semi") if n <= EXACT else _likely(left, again, n)
    whole = F.sha2(F.col(content), 256).alias("_full")
    second = cut(left.select(*rest, "size", "_part", whole)) if n else first.withColumn("_full", F.lit(None).cast("string")).where("false")
    met = second.select("size", "_part").distinct()
    ends = F.when(F.col("size") <= k, F.col("_part")).alias("_full")
    once = first.join(met, ["size", "_part"], "left_anti").select(*rest, "size", "_part", ends, F.lit(False).alias("digested"))
    read = once.union(second.withColumn("digested", F.lit(True)).select(once.columns))
    return _roles(read.withColumn("covers_whole", F.col("size") <= k), path)


def _likely(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose (size, _part) are among ``keys``, and a few others: keys are bits of a map of bounded size, which is what is broadcast."""
    bits = min(MOST_BITS, -(-n * BITS // 32768) * 32768)
    place = F.pmod(F.xxhash64("size", "_part"), F.lit(bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_map"))
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)}).join(F.broadcast(maps), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(_map, CAST(_bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(_bit % 8 AS INT))")) != 0).select(*rows.columns)


def classify_paths(files: DataFrame, k: int = K, threads: int | None = None) -> DataFrame:
    """``classify`` for ``files(path, size)`` that are still on disk: each step opens only what the step before left open.

    Adds ``skip_reason``; files that can't be read or whose size has changed are skipped. At most ``threads``
    tasks read files at a time, where that is given.
    """

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(threads) if threads else df

    shared = dealt(files.join(_repeated(files, "size"), "size", "left_semi").select("path", "size")).withColumn("p", partial_digest_udf(k)("path", "size"))
    part = cut(shared.select("path", "size", F.col("p.digest").alias("_part"), F.col("p.reason").alias("_why")))
    again = part.where(F.col("size") > k).join(_repeated(part.where("_part is not null"), "size", "_part"), ["size", "_part"], "left_semi")
    full = cut(dealt(again.select("path")).select("path", full_digest_udf("path").alias("f")).select("path", F.col("f.digest").alias("_digest"), F.col("f.reason").alias("_later")))
    met = files.join(part.drop("size"), "path", "left").join(full, "path", "left")
    met = met.withColumns({"covers_whole": F.col("size") <= k, "_full": F.when(F.col("size") <= k, F.col("_part")).otherwise(F.col("_digest")), "skip_reason": F.coalesce("_why", "_later")})
    return _roles(met.drop("_why", "_later", "_digest"), "path", F.col("skip_reason").isNull())


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")


def _roles(read: DataFrame, path: str, good: Column | None = None) -> DataFrame:
    """Roles of rows with size, covers_whole, _part and _full; the digests that a step would not have taken are nulled."""
    counted = F.col("size").isNotNull() if good is None else good & F.col("size").isNotNull()
    by_size = _repeated(read.where("size is not null"), "size").withColumn("_shared", F.lit(True))
    by_part = _repeated(read.where(counted & F.col("_part").isNotNull()), "size", "_part").withColumn("_again", F.lit(True))
    met = read.join(by_size, "size", "left").join(by_part, ["size", "_part"], "left")
    known = F.when(counted & F.col("_shared") & (F.col("covers_whole") | F.col("_again")), F.col("_full"))
    full = met.withColumns({"known_hash": known, "partial_digest": F.when(F.col("_shared"), F.col("_part"))}).drop("_part", "_full", "_shared", "_again")
    first = F.min(F.struct(F.size(F.split(path, "/")).alias("depth"), F.split(path, "/").alias("parts"), F.col(path).alias("first")))
    of = full.where("known_hash is not null").groupBy("size", "known_hash").agg(F.count("*").alias("copies"), first.alias("_o"))
    out = full.join(of, ["size", "known_hash"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    role = F.when(~counted, "skipped").when(F.col("copies") == 1, "unique").when(F.col(path) == F.col("_o.first"), "original").otherwise("duplicate")
    return out.withColumns({"role": role, "original_path": F.when(F.col("copies") > 1, F.col("_o.first"))}).drop("_o")


def groups(classified: DataFrame, path: str = "path") -> DataFrame:
    """One row a duplicate group: hash, size, copies, original, number (0-based by hash, then first path)."""
    g = classified.where("copies > 1").groupBy("known_hash", "size", "original_path").agg(F.count("*").alias("copies"))
    g = g.select(F.col("known_hash").alias("hash"), "size", "copies", F.col("original_path").alias("original"))
    return numbered(g, ["hash", *path_key(F.col("original"))], F.substring("hash", 1, 3), "number")


def group_directory(number: Column, root: str = "duplicates") -> Column:
    """duplicates/NNN, of three digits at least."""
    return F.concat(F.lit(f"{root}/"), F.format_string("%03d", number))


def work(classified: DataFrame, k: int = K) -> DataFrame:
    """One row: files and bytes in all, those whose ends were digested, those left with a size that others share, and those digested whole."""
    size = F.col("size")
    read = F.when(size <= k, size).when(size <= 2 * k, k).otherwise(2 * k)
    total = lambda rows, n: F.coalesce(F.sum(F.when(rows, n)), F.lit(0)).cast("long")
    shared, whole = F.col("partial_digest").isNotNull(), F.col("digested")
    return classified.where("size is not null").agg(
        F.count("*").alias("n_files"), total(F.lit(True), size).alias("n_bytes"), total(F.lit(True), read).alias("ends_bytes"),
        F.count_if(shared).alias("partial_files"), total(shared, read).alias("partial_bytes"), F.count_if(whole).alias("full_files"), total(whole, size).alias("full_bytes"),
    )


def keyed(rows: DataFrame, key: Column, member: Column) -> DataFrame:
    """(key, n, first) of rows grouped by any key; rows whose key can't be had (null) are one row of their own, the errors."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(member).alias("first"))
