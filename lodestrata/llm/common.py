"""What the corpus operators share: scratch tables, text helpers, hot-group splitting, components.

Scratch tables are Parquet under the folder that ``spark.checkpoint.dir`` names, which every
executor shares; they cut lineage, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import ready, shared_dir

#: Row groups of 8 MB as compressed: Parquet's own would take 100 rows, however large, before it looks at their size, and a group's rows are read at once.
LARGE_ROWS = {"parquet.block.size": 8 << 20, **{f"parquet.{what}.row.check.{end}": 1 for what in ("page.size", "block.size") for end in ("min", "max")}}


class Scratch:
    """Tables one query writes on its way; each can be dropped as soon as its successor is written.

    What a result still reads stays until ``close``, or the end of the process: a plan can outlive the frame it came from.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = ready(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.named: list[str] = []
        atexit.register(self._clear)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` once and returns it as a scan of what was written."""
        df.write.option("compression", "zstd").parquet(path := self.path())
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lodestrata_path = path
        return out

    def bucketed(self, df: DataFrame, buckets: int, key: str) -> DataFrame:
        """Writes ``df`` in buckets of ``key``, sorted by it; the catalogue names the table until ``close``."""
        self.named.append(name := f"lodestrata_{uuid.uuid4().hex}")
        out = df.write.option("compression", "zstd").option("path", self.path())
        for k, v in LARGE_ROWS.items():
            out = out.option(k, v)
        out.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        """Deletes all tables; for when nothing reads a result any more that was made with them."""
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.named.clear()
        self._delete(self.root)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._lodestrata_path)

    def release(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
        give_back()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def _clear(self) -> None:
        try:
            self.close()
        except Exception:  # noqa: BLE001 - the session is gone at exit, and its folder with it
            return


def _libc() -> ctypes.CDLL | None:
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such calls
        libc = ctypes.CDLL(None)
        libc.mallopt, libc.malloc_trim  # noqa: B018
        return libc
    return None


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def lean(fn):
    """``fn`` for mapInArrow in a worker that gives memory back: large arrays are mapped one by one, and freed pages returned at a partition's end."""

    def run(it):
        if libc := _libc():
            libc.mallopt(-3, 1 << 20)
        try:
            yield from fn(it)
        finally:
            give_back()

    return run


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``df``; columns beyond them, clashing names included, are left behind."""
    return df.select(*[df[n] for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than U+0020 and U+0009-000D, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def by_document() -> list:
    """The order of rows by doc_id, nulls last, then by the first characters of their text, then its hash: rows that share an id, or have none, are many keys of a range exchange."""
    return [F.col("doc_id").asc_nulls_last(), F.substring("text", 1, 64).asc_nulls_first(), F.xxhash64("text").asc()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(pdf_iter, limit: int, weight):
    """Splits an iterator of rows into lists whose summed ``weight`` passes ``limit`` by one row at most."""
    held, size = [], 0
    for row in pdf_iter:
        held.append(row)
        size += weight(row)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def split_hot(df: DataFrame, key: list[str], member: str, cap: int) -> DataFrame:
    """Deals the rows of each group of ``key`` to tasks of at most about two times ``cap`` rows so that every pair meets.

    A group of n rows is cut into g = ceil(n / cap) parts by a hash of ``member``; a row of part a goes
    to the tasks (a, b) for every b, so each pair of rows meets in the task of its two parts (pairs of
    one part meet in its task (a, a)). Groups of one row are left out: they hold no pair. Adds
    ``part``, ``lo`` and ``hi``.
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    cut = df.join(sizes, key).withColumn("_g", F.ceil(F.col("_n") / cap).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64(member, F.lit("part")), F.col("_g")).cast("int"))
    cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return cut.select(*df.columns, "part", F.least("part", "_o").alias("lo"), F.greatest("part", "_o").alias("hi"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps (each a min per node and one join) and writes the edges
    to the scratch folder after each round, until the edges stop changing, however many rounds that takes (their
    number follows the logarithm of the longest path). No neighbour list is ever
    gathered, so a hub costs rows and not memory. The minima are written before they are joined: only
    joins of plain shuffles are split when one node holds many of the edges.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = now.union(now.select("b", "a"))
        least = scratch.write(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("b > a").join(least, both.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < u").select("u", "m")).distinct()
        large = scratch.write(large)
        low = scratch.write(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(low, large.a == low.u)
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("u", "m")).distinct()
        new = scratch.write(new)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)")), F.sum(F.xxhash64("b", "a").cast("decimal(38)"))).first()
        scratch.drop(now, least, large, low)
        now = new
        if mark == last:
            break
        last = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))


class Forest:
    """Union-find over 0..n-1 by vectorised hooking; keeps one link of each union as a spanning edge."""

    def __init__(self, n: int):
        self.lab = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        lab = self.lab
        while len(i):
            a, b = lab[i], lab[j]
            m = a != b
            if not m.any():
                return
            i, j, a, b = i[m], j[m], a[m], b[m]
            low = np.minimum(a, b)
            np.minimum.at(lab, np.maximum(a, b), low)
            while True:
                nxt = lab[lab]
                if (nxt == lab).all():
                    break
                lab[:] = nxt

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of every node that isn't its own root."""
        i = np.flatnonzero(self.lab != np.arange(len(self.lab)))
        return i, self.lab[i]


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before, for tables of one row a partition or group."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def with_fields(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` followed by the fields of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
