"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most d bits, cut into d + c blocks, agree in at least c of them; so every
choice of c blocks is a join key of about 64 c / (d + c) bits, close pairs share one of the keys, and what
meets is verified by Hamming distance. c follows the number of fingerprints, so that buckets don't grow with
them. Equal fingerprints are one row throughout. A meeting bucket
gives the edges of a spanning forest, never all its pairs; buckets beyond ``cap`` rows are cut into
parts that meet two by two.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, components, lean, split_hot, with_fields, Forest, Scratch

SHINGLE, SEED, BITS, CAP = 4, 42, 4, 4096


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 values of the word shingles; no word: 0."""
    words = ascii_words(text)
    if not words:
        return 0
    joined, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    h = xxhash.xxh64_intdigest
    total, n = np.zeros(64, "i8"), len(words) - width + 1
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        some = np.array([h(joined[a:b], SEED) for a, b in zip(starts[lo:hi], ends[lo + width - 1 : hi + width - 1], strict=True)], "<u8")
        total += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs(text)`` with the columns of ``keep`` and ``fp``, the fingerprint as a signed long."""

    def run(it):
        for b in it:
            fps = np.array([fingerprint(t.as_py()) for t in b.column("text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), with_fields(docs.select(*keep), "fp long"))


#: What making and moving a key costs, in comparisons.
KEY_COST = 16


def shared_blocks(n: int, bits: int = BITS) -> int:
    """How many of bits + c blocks make a key, for n fingerprints: where keys and the comparisons they lead to are least in sum.

    Two at least: fingerprints of one language agree in many bits, so single blocks make uneven buckets.
    """
    return min(range(2, 9), key=lambda c: comb(bits + c, c) * (KEY_COST + n / 2 ** (64 * c / (bits + c))))


def masks(bits: int, c: int) -> list[int]:
    """The bits of each key: every choice of c of bits + c blocks."""
    bounds = [round(64 * i / (bits + c)) for i in range(bits + c + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [sum(some) for some in combinations(blocks, c)]


def links(fps: DataFrame, bits: int = BITS, cap: int = CAP, c: int = 2) -> DataFrame:
    """Spanning edges (a, b) over distinct fingerprints ``fps(fp)`` that differ in at most ``bits`` bits; keys are of ``c`` blocks."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(bits, c)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("k", "key"))
    tasks = split_hot(keyed, ["k", "key"], "fp", cap)
    group = ["k", "key", "lo", "hi"]
    return tasks.repartition(*group).sortWithinPartitions(*group).mapInArrow(lean(lambda it: _meet(it, bits)), "a long, b long")


def _meet(it, bits: int):
    """Sorted rows in, the forest edges of each group out; rows of a group cut by a batch's end are carried over."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray):
        same = (rows[1:, :4] == rows[:-1, :4]).all(axis=1)
        group = np.concatenate([[0], np.cumsum(~same)])
        fp, part, cut = rows[:, 4].view("u8"), rows[:, 5], rows[:, 2] != rows[:, 3]
        forest, at = Forest(len(rows)), np.arange(len(rows))
        lag = 1
        while len(at := at[at + lag < len(rows)]):
            at = at[group[at] == group[at + lag]]
            other = at + lag
            meet = (np.bitwise_count(fp[at] ^ fp[other]) <= bits) & (~cut[at] | (part[at] != part[other]))
            forest.link(at[meet], other[meet])
            lag += 1
        i, j = forest.edges()
        return pa.record_batch([pa.array(fp[i].view("i8")), pa.array(fp[j].view("i8"))], names=["a", "b"])

    for b in it:
        rows = np.stack([np.asarray(b.column(c)).astype("i8") for c in ("k", "key", "lo", "hi", "fp", "part")], axis=1)
        held.append(rows)
        whole = np.concatenate(held)
        differs = np.flatnonzero((whole[:, :4] != whole[-1, :4]).any(axis=1))
        if len(differs):
            cut = differs[-1] + 1
            yield flush(whole[:cut])
            held = [whole[cut:]]
    if held and len(whole := np.concatenate(held)):
        yield flush(whole)


def group(docs: DataFrame, scratch: Scratch, *keep: str, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """(``keep``, fp, component_id) for every row of ``docs(doc_id, text)``; component_id is the smallest doc_id reachable.

    Null and wordless texts have fingerprint 0 and link like any other; null doc_ids never name a
    component that has another id. One row a document; copies meet as one fingerprint. Columns to keep mustn't be called like those
    added here.
    """
    if clash := {"fp", "component_id", "root", "least"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    rows = scratch.write(fingerprints(docs, *dict.fromkeys(["doc_id", *keep])))
    fps = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = scratch.write(components(links(fps.select("fp"), bits, cap, shared_blocks(fps.count(), bits)), scratch))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = scratch.write(named.groupBy("root").agg(F.min("least").alias("component_id")))  # a plain table: a hot root's rows can then be split
    by_fp = named.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return rows.join(by_fp, "fp").select(*dict.fromkeys(["doc_id", *keep]), "fp", "component_id", "root")


def distinct_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each component the document with the smallest doc_id stays.

    Rows that share that doc_id in one component are told apart by their text's hash, and of rows equal
    in both one stays. The rest of each component goes by an anti-join on (doc_id, hash of text).
    """
    rows = group(docs.withColumn("th", F.xxhash64("text")), scratch, "th")
    one = scratch.write(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("s")))
    keys = rows.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n")).join(one, "root")
    best = (F.col("doc_id").eqNullSafe(F.col("s.doc_id"))) & (F.col("th") == F.col("s.th"))
    keys = scratch.write(keys.select(F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("dn"), "th", best.alias("best"), "n"))
    mine = docs.withColumns({"__ls_d": F.coalesce("doc_id", F.lit(0)), "__ls_dn": F.col("doc_id").isNull(), "__ls_th": F.xxhash64("text")})

    def on(k: DataFrame):
        return (mine["__ls_d"] == k.d) & (mine["__ls_dn"] == k.dn) & (mine["__ls_th"] == k.th)

    gone, twice = keys.where("not best"), keys.where("best and n > 1")
    out = mine.join(gone, on(gone), "left_anti")
    alone = out.join(twice, (out["__ls_d"] == twice.d) & (out["__ls_dn"] == twice.dn) & (out["__ls_th"] == twice.th), "left_anti")
    again = out.join(twice, (out["__ls_d"] == twice.d) & (out["__ls_dn"] == twice.dn) & (out["__ls_th"] == twice.th), "left_semi").dropDuplicates(["__ls_d", "__ls_dn", "__ls_th"])
    return alone.union(again).select(*docs.columns)
