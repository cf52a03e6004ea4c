"""Counting keys over a corpus in blocks rather than rows.

Documents are packed into chunks of a megabyte or a few, one row each, in a table bucketed by chunk. A chunk
asks about its distinct 64-bit keys with one row of packed arrays for each range of keys; a range's
task answers every chunk that asked. Keys are distinct within a chunk, so a key that is everywhere costs
one entry a chunk, and ranges of hashed keys are even. Answers come back to the chunk's bucket
without moving its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_document, lean, shuffle_partitions, Scratch
from .token_store import _rows

CHUNK_BYTES = 1 << 20
#: Bytes of text in a bucket of chunks at least; more text makes more buckets, not larger ones.
BUCKET_BYTES = 64 << 20
#: Keys a range's task holds at a time, about.
RANGE_KEYS = 1 << 20
PACKED = "chunk long, doc_ids binary, known binary, ends binary, data binary, bytes long"
ASKED = "chunk long, kind int, span int, keys binary, checks binary, counts binary"
ANSWERED = "chunk long, kind int, span int, answer binary"


class Chunk:
    """Documents of one row: ids (with which are not null), ends of their bytes, the bytes."""

    def __init__(self, doc_ids: bytes, known: bytes, ends: bytes, data: bytes):
        self.doc_ids, self.known = np.frombuffer(doc_ids, "<i8"), np.frombuffer(known, "u1").astype(bool)
        self.ends, self.data = np.frombuffer(ends, "<i8"), data
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype("i8")

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            yield self.data[a:b]

    def ids(self) -> pa.Array:
        return pa.array(self.doc_ids, mask=~self.known)


#: Bits of a chunk's number below those of the task that made it.
PLACES = 40


def _bucket_hash(x: np.ndarray) -> np.ndarray:
    """The hash of 64-bit integers by which Spark deals rows to buckets: 32-bit Murmur3 with seed 42, signed."""
    low, high = (x & 0xFFFFFFFF).astype("u4"), (x >> 32).astype("u4")
    turn = lambda v, n: v << np.uint32(n) | v >> np.uint32(32 - n)
    h = np.full(len(x), 42, "u4")
    for k in (low, high):
        h = turn(h ^ turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(by)
    return (h ^ h >> np.uint32(16)).view("i4")


def _numbers(part: int, buckets: int) -> Iterator[int]:
    """Ascending numbers for the chunks of a task, such that all fall into one bucket: it then writes one file, not one a chunk."""
    block = max(1 << 12, 16 * buckets)
    for lo in range(part << PLACES, (part + 1) << PLACES, block):
        x = np.arange(lo, lo + block, dtype="i8")
        yield from x[_bucket_hash(x) % buckets == part % buckets].tolist()


def pack_chunks(docs: DataFrame, scratch: Scratch, ordered: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` as a table of chunks, bucketed by chunk; with ``ordered``, chunks ascend with doc_id (nulls last), rows of one doc_id as ``by_document`` says.

    Null texts are empty. A text longer than a chunk is a chunk of its own. The buckets follow the bytes.
    """
    rows = docs.select("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-total // BUCKET_BYTES))
    if ordered:
        rows = rows.repartitionByRange(buckets, *by_document()).sortWithinPartitions(*by_document())

    def run(it):
        part = TaskContext.get().partitionId()
        for number, some in zip(_numbers(part, buckets), batches(((k, (t or "").encode()) for k, t in _rows(it, "doc_id", "text")), chunk_bytes, lambda r: len(r[1]) + 16), strict=False):
            data = b"".join(t for _, t in some)
            ends = np.cumsum([len(t) for _, t in some]).astype("<i8")
            ids, known = np.array([k or 0 for k, _ in some], "<i8"), np.array([k is not None for k, _ in some], "u1")
            yield pa.record_batch([pa.array([number]), pa.array([ids.tobytes()]), pa.array([known.tobytes()]), pa.array([ends.tobytes()]), pa.array([data], pa.binary()), pa.array([len(data)])], names=["chunk", "doc_ids", "known", "ends", "data", "bytes"])

    return scratch.bucketed(rows.mapInArrow(lean(run), PACKED), buckets, "chunk")


def spans_for(keys: float) -> int:
    return max(8, int(keys / RANGE_KEYS) + 1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane, so that the planes of high zeros compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view("u1").reshape(-1, 8).T.tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype="u8")


def ask(chunk: int, kind: int, spans: int, keys: np.ndarray, checks: np.ndarray | None = None, counts: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each range that holds some of the sorted distinct ``keys``, with check bits and counts beside them.

    The work follows the keys, however many ranges there are.
    """
    of = keys // np.uint64((1 << 64) // spans + 1)
    cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)]
    own = [(int(of[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    cols = [[pack_keys(keys[a:b]) for _, a, b in own], *[[x[a:b].tobytes() if x is not None else b"" for _, a, b in own] for x in (checks, counts)]]
    return pa.record_batch([pa.array([chunk] * len(own), pa.int64()), pa.array([kind] * len(own), pa.int32()), pa.array([i for i, _, _ in own], pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["chunk", "kind", "span", "keys", "checks", "counts"])


class Answers:
    """How a range answers the chunks that asked: rows are (chunk, keys, checks, counts) bytes, ascending by chunk.

    ``reduce`` yields (chunk, bytes) for each row, and may add rows of negative chunks. Where there are too many chunks for
    one task to hold their rows, ``merge`` makes one row (keys, checks, counts) of those of a group of neighbouring chunks, which
    asks in their place, and ``spread`` hands the answer that it got on: called with the merged row's keys, checks and
    answer, it returns what answers the group's rows one after the other.
    """

    def reduce(self, kind: int, rows: list[tuple]) -> Iterator[tuple[int, bytes]]:
        raise NotImplementedError

    def merge(self, kind: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        raise NotImplementedError

    def spread(self, kind: int, keys: np.ndarray, checks: bytes, answer: bytes) -> Callable[[tuple], bytes]:
        raise NotImplementedError


#: Chunks whose rows one task holds for a range; more are asked for in groups of so many.
GROUP = 1 << 16


def _grouped(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    """Lists of the rows that agree in their first ``n`` cells, which come together."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:n] != row[:n]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _answered(rows: list[tuple]) -> pa.RecordBatch:
    """(chunk, kind, span, answer) as a batch."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "kind", "span", "answer"])


def _at_once(asked: DataFrame, how: Answers) -> DataFrame:
    def run(it):
        for held in _grouped(_rows(it, "kind", "span", "chunk", "keys", "checks", "counts"), 2):
            kind, span = held[0][:2]
            yield _answered([(c, kind, span, a) for c, a in how.reduce(kind, [r[2:] for r in held])])

    return asked.repartition("kind", "span").sortWithinPartitions("kind", "span", "chunk").mapInArrow(lean(run), ANSWERED)


def answer(asked: DataFrame, how: Answers, scratch: Scratch, chunks: DataFrame) -> DataFrame:
    """The answers of ``how`` to what the chunks asked.

    A key that is in every chunk costs its range a row a chunk, so beyond GROUP chunks neighbouring ones are merged first: then a
    range's task holds a row for each of a group's chunks, and another one a row for each group.
    """
    number, last = chunks.agg(F.count("*"), F.max("chunk")).first()
    if number <= GROUP:
        return _at_once(asked, how)
    parts = max(1, GROUP * ((last >> PLACES) + 1) // number)  # a chunk's number begins with its task's
    by = ["kind", "span", "group"]
    asked = scratch.write(asked.withColumn("group", F.floor(F.shiftright("chunk", PLACES) / parts).cast("long")))

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, "chunk")

    def merge(it):
        for held in _grouped(_rows(it, *by, "chunk", "keys", "checks", "counts"), 3):
            kind, span, group = held[0][:3]
            keys, checks, counts = how.merge(kind, [r[3:] for r in held])
            cells = [pack_keys(keys), *(b"" if x is None else x.tobytes() for x in (checks, counts))]
            yield pa.record_batch([pa.array([group], pa.int64()), pa.array([kind], pa.int32()), pa.array([span], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["chunk", "kind", "span", "keys", "checks", "counts"])

    def spread(it):
        state, on = None, None
        for kind, span, group, chunk, keys, checks, found in _rows(it, *by, "chunk", "keys", "checks", "answer"):
            if found is not None:
                state, on = (kind, span, group), how.spread(kind, unpack_keys(keys), checks, found)
            else:
                assert state == (kind, span, group)
                yield _answered([(chunk, kind, span, on((chunk, keys, checks)))])

    merged = scratch.write(together(asked).mapInArrow(lean(merge), ASKED))
    top = scratch.write(_at_once(merged, how))
    got = merged.join(top, ["chunk", "kind", "span"]).select("kind", "span", F.col("chunk").alias("group"), F.lit(-1).cast("long").alias("chunk"), "keys", "checks", "answer")
    rows = asked.select("kind", "span", "group", "chunk", "keys", "checks", F.lit(None).cast("binary").alias("answer")).union(got)
    return together(rows).mapInArrow(lean(spread), ANSWERED).union(top.where("chunk < 0"))


def gathered(answers: DataFrame, name: str) -> DataFrame:
    """One row a chunk: its answers of every kind in the order of ranges."""
    return answers.where("chunk >= 0").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("kind", "span", "answer"))).alias(name))


def of_kind(found: list[dict] | None, kind: int) -> bytes:
    return b"".join(x["answer"] for x in found or [] if x["kind"] == kind)


def small_ints(x: np.ndarray) -> bytes:
    """Mostly small counts: bytes up to 254, then 255 and the rest as 64-bit integers in order."""
    big = x >= 255
    return np.uint32(len(x)).tobytes() + np.where(big, 255, x).astype("u1").tobytes() + x[big].astype("<i8").tobytes()


def from_small_ints(parts: list[bytes]) -> np.ndarray:
    out = []
    for p in parts:
        n = int(np.frombuffer(p, "<u4", 1)[0])
        x = np.frombuffer(p, "u1", n, 4).astype("i8")
        x[x == 255] = np.frombuffer(p, "<i8", -1, 4 + n)
        out.append(x)
    return np.concatenate(out) if out else np.zeros(0, "i8")
