"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A unit vector is rotated at random and kept as its signs; with the stored factor <o, code>, the code
gives an unbiased estimate of an inner product and a confidence bound. Signs of further rotations name the
buckets in which vectors meet. Their number follows the vectors of a label, so that buckets don't grow with the data:
up to ``TARGET`` vectors all meet, beyond that keys have a bit for each doubling, and as many tables are used as find a
pair at the threshold with probability ``RECALL``.

What goes to a table's buckets is codes alone: the signs and, as the side that is held against them, the rotated vector
in four bits a number, five bits of each in all. Within a bucket the bounds rule pairs out. Vectors
that have a pair left are fetched once for each table in which one of their pairs meets first, and recomputed in
double precision, so no pair below the threshold is linked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, split_hot, Forest, Scratch

TARGET, CAP, RECALL, SIGMA = 2048, 2048, 0.998, 4.0


def plan(n: int, threshold: float, target: int = TARGET, recall: float = RECALL) -> tuple[int, int]:
    """Key bits and tables for n vectors that may meet.

    A pair at the threshold agrees in a sign with probability p = 1 - acos(threshold) / pi, and so shares a bucket
    of some table with probability 1 - (1 - p^bits)^tables.
    """
    bits = min(30, max(0, math.ceil(math.log2(max(n, 1) / target))))
    if not bits:
        return 0, 1
    p = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - p**bits)))) if p < 1 else 1


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """tables * bits directions from rotations other than the codes' own."""
    need = tables * bits
    return np.concatenate([rotation(dim, 1000 + i) for i in range(-(-need // dim))])[:need]


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (packed to u64 words) and factors <o, code> of unit vectors."""
    y = x @ rot.T
    factor = np.abs(y).sum(axis=1) / np.sqrt(x.shape[1])
    bits = np.zeros((len(x), -(-x.shape[1] // 64) * 64), bool)
    bits[:, : x.shape[1]] = y > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8"), factor


def signs_of(codes: np.ndarray, d: int) -> np.ndarray:
    return np.unpackbits(codes.view("u1").reshape(len(codes), -1), axis=1, bitorder="little")[:, :d] * 2.0 - 1.0


def upper_bound(query: np.ndarray, signs: np.ndarray, factor: np.ndarray, sigma: float) -> np.ndarray:
    """Upper confidence bounds of <query, o>, for rotated queries (m, d) and vectors with these signs and factors (n)."""
    d = query.shape[1]
    return (query @ signs.T) / (np.sqrt(d) * factor) + sigma * np.sqrt((1 - factor**2) / factor**2 / max(1, d - 1))


def _usable(v: list | None) -> bool:
    return bool(v) and None not in v and bool(np.isfinite(v := np.asarray(v, "f8")).all()) and bool((v != 0).any())


def _shortest(v: np.ndarray) -> bytes:
    """Single-precision bytes where they lose nothing."""
    with np.errstate(over="ignore"):
        low = v.astype("f4")
    return low.tobytes() if (low == v).all() else v.tobytes()


def _vectors(data: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(d, "f4" if len(d) == 4 * dim else "f8").astype("f8") for d in data])


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def quantise(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors in four bits a number (two in a byte), the step of each vector, and how far it is from what is kept."""
    step = np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300) / 7
    whole = np.rint(y / step).astype("i8")
    pad = np.zeros((len(y), -(-y.shape[1] // 2) * 2), "i8")
    pad[:, : y.shape[1]] = whole
    packed = ((pad[:, ::2] + 8) | (pad[:, 1::2] + 8) << 4).astype("u1")
    return packed, step[:, 0], np.linalg.norm(y - whole * step, axis=1)


def restored(packed: np.ndarray, step: np.ndarray, d: int) -> np.ndarray:
    """What ``quantise`` kept."""
    out = np.empty((len(packed), packed.shape[1] * 2))
    out[:, ::2], out[:, 1::2] = (packed & 15).astype("f8") - 8, (packed >> 4).astype("f8") - 8
    return out[:, :d] * step[:, None]


INDEXED = "c string, label string, dim int, copies long, width int, keys binary, code binary, factor double, nibbles binary, step double, lost double, v binary"


def link(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, target: int = TARGET, cap: int = CAP, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Vectors meet only if their labels, of any type, are equal and not null. Null, empty and zero vectors and those
    with null or non-finite components link with nothing; vectors of different lengths don't meet.
    Equal vectors are one row of the index with a count, so a common vector costs nothing. Rows of one
    vec_id are rows like others. A null vec_id is left out of the smallest id of its component unless it is alone.
    """

    def index(it):
        for b in it:
            raws = b.column("v").to_pylist()
            by_plan: dict[tuple[int, int, int], list[int]] = {}
            for i, (v, n) in enumerate(zip(raws, b.column("n").to_pylist(), strict=True)):
                if _usable(v):
                    by_plan.setdefault((len(v), *plan(n, threshold, target, recall)), []).append(i)
            for (dim, bits, tables), rows in by_plan.items():
                x = np.array([raws[i] for i in rows], "f8")
                u = _unit(x)
                sides = (u @ planes_of(dim, tables, bits).T > 0).reshape(len(rows), tables, bits)
                keys = (sides * (1 << np.arange(bits))).sum(axis=2)
                codes, factor = encode(u, rotation_of(dim))
                nibbles, step, lost = quantise(u @ rotation_of(dim).T)
                width = 2 if bits <= 16 else 4
                own = b.select(["c", "label", "copies"]).take(pa.array(rows))
                cells = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.record_batch(
                    [own.column("c"), own.column("label"), pa.array([dim] * len(rows), pa.int32()), own.column("copies"), pa.array([width] * len(rows), pa.int32()), cells(keys.astype(f"<u{width}")), cells(codes), pa.array(factor), cells(nibbles), pa.array(step), pa.array(lost), pa.array([_shortest(r) for r in x])],
                    names=["c", "label", "dim", "copies", "width", "keys", "code", "factor", "nibbles", "step", "lost", "v"],
                )

    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = scratch.write(rows.withColumn("c", F.xxhash64("label", "v", F.lit(1)).cast("string")).withColumn("c", F.concat_ws("-", "c", F.xxhash64(F.lit(2), "v", "label"))))
    classes = scratch.write(rows.groupBy("c").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least")))
    sizes = scratch.write(classes.where("label is not null and v is not null").groupBy("label").agg(F.count("*").alias("n")))  # read back, so that its size decides how it is joined
    meeting = classes.where("v is not null").select("c", "label", "v", "copies").join(sizes, "label").select("c", "label", "v", "copies", "n")
    keyed = scratch.write(meeting.mapInArrow(lean(index), INDEXED))
    codes = keyed.drop("v").select("*", F.explode(F.sequence(F.lit(0), F.expr("cast(length(keys) / width as int) - 1"))).alias("t"))
    codes = codes.withColumn("key", F.hex(F.expr("substring(keys, t * width + 1, width)"))).withColumn("keys", F.expr("substring(keys, 1, t * width)"))
    tasks = split_hot(codes, ["label", "dim", "t", "key"], "c", cap)
    group = ["label", "dim", "t", "key", "lo", "hi"]
    grouped = lambda df: df.repartition(*group).sortWithinPartitions(*group)
    left = scratch.write(grouped(tasks).mapInArrow(lean(lambda it: _by_group(it, group, lambda rows: _likely(rows, threshold))), LEFT))
    fetched = left.join(keyed.select("c", "v"), "c")
    found = scratch.write(grouped(fetched).mapInArrow(lean(lambda it: _by_group(it, group, lambda rows: _meet(rows, threshold))), "c string, other string, n long"))
    counts = found.where("n > 0").groupBy("c").agg(F.sum("n").alias("n"))
    roots = scratch.write(components(found.where("other is not null").select(F.col("c").alias("a"), F.col("other").alias("b")), scratch))
    named = classes.join(counts, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = scratch.write(named.groupBy("root").agg(F.min("least").alias("component_id")))  # a plain table: a hot root's rows can then be split
    by_class = named.join(least, "root").select("c", "copies", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    usable = F.col("label").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    out = rows.join(by_class, "c").withColumn("u", F.coalesce(usable, F.lit(False)))
    component = F.when(F.col("u"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("u"), F.col("n") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


LEFT = "label string, dim int, t int, key string, lo int, hi int, part int, c string, copies long, width int, keys binary"


def _by_group(it, group: list[str], work):
    """``work`` of the rows of each group, which come sorted."""
    held: list[dict] = []
    for b in it:
        for r in b.to_pylist():
            if held and any(held[0][g] != r[g] for g in group):
                yield work(held)
                held = []
            held.append(r)
    if held:
        yield work(held)


class _Bucket:
    """Who of a bucket may pair with whom: rows of two parts pair across, and a pair counts in the first table in which it meets."""

    def __init__(self, rows: list[dict]):
        self.t, self.cut = rows[0]["t"], rows[0]["lo"] != rows[0]["hi"]
        self.part = np.array([r["part"] for r in rows])
        self.keys = np.frombuffer(b"".join(r["keys"] for r in rows), f"<u{rows[0]['width']}").reshape(len(rows), -1)

    def pairs(self, likely: np.ndarray, lo: int):
        """The pairs (i < j) among ``likely`` (rows from ``lo`` on, by all) that count here, some at a time."""
        i, j = np.nonzero(likely)
        i = i + lo
        use = i < j
        if self.cut:
            use &= self.part[i] != self.part[j]
        i, j = i[use], j[use]
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            first = ~(self.keys[a] == self.keys[b]).any(axis=1) if self.t else np.ones(len(a), bool)
            yield a[first], b[first]


def _likely(rows: list[dict], threshold: float) -> pa.RecordBatch:
    """The rows of a bucket that have a pair left, by their codes: either may be the side that is held against the other's signs."""
    dim, n = rows[0]["dim"], len(rows)
    signs = signs_of(np.frombuffer(b"".join(r["code"] for r in rows), "<u8").reshape(n, -1), dim)
    factor, step, lost = (np.array([r[k] for r in rows]) for k in ("factor", "step", "lost"))
    query = restored(np.frombuffer(b"".join(r["nibbles"] for r in rows), "u1").reshape(n, -1), step, dim)
    bucket, left = _Bucket(rows), np.zeros(n, bool)
    for lo in range(0, n, 256):
        own = slice(lo, min(n, lo + 256))
        there = upper_bound(query[own], signs, factor, SIGMA) + lost[own, None] >= threshold
        back = (upper_bound(query, signs[own], factor[own], SIGMA) + lost[:, None] >= threshold).T
        for a, b in bucket.pairs(there | back, lo):
            left[a] = left[b] = True
    kept = [r for r, x in zip(rows, left.tolist(), strict=True) if x]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in LEFT.split(", ")]
    return pa.record_batch([pa.array([r[name] for r in kept], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _meet(rows: list[dict], threshold: float) -> pa.RecordBatch:
    """Of the rows of a bucket that were fetched: (c, null, other vectors linked) and spanning edges (c, other, 0)."""
    x, n = _unit(_vectors([r["v"] for r in rows], rows[0]["dim"])), np.zeros(len(rows), "i8")
    copies, bucket, forest = np.array([r["copies"] for r in rows]), _Bucket(rows), Forest(len(rows))
    for lo in range(0, len(rows), 256):
        for a, b in bucket.pairs(x[lo : lo + 256] @ x.T >= threshold - 1e-9, lo):
            near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[near], b[near]
            forest.link(a, b)
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
    c = np.array([r["c"] for r in rows], object)
    i, j = forest.edges()
    k = np.flatnonzero(n)
    return pa.record_batch([pa.array([*c[k], *c[i]], pa.string()), pa.array([*[None] * len(k), *c[j]], pa.string()), pa.array([*n[k].tolist(), *[0] * len(i)], pa.int64())], names=["c", "other", "n"])


_planes: dict[tuple[int, int, int], np.ndarray] = {}


def planes_of(dim: int, tables: int, bits: int) -> np.ndarray:
    if (dim, tables, bits) not in _planes:
        if len(_planes) > 16:
            _planes.clear()
        _planes[dim, tables, bits] = planes(dim, tables, bits) if bits else np.zeros((0, dim))
    return _planes[dim, tables, bits]


_rotations: dict[int, np.ndarray] = {}


def rotation_of(dim: int) -> np.ndarray:
    if dim not in _rotations:
        _rotations[dim] = rotation(dim, 7)
    return _rotations[dim]
