"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart only through ``LENGTH`` bytes, in passes from the most significant digit. The
first digit is a suffix's anchor: the least-hashed ``GRAM`` bytes among its first ``LENGTH``. Equal windows
have equal anchors, and neighbouring suffixes share theirs in runs, so this pass handles a
twenty-fifth of the text. The bytes that a run's windows span are the second digit: where every run of
an anchor spans the same bytes, all its windows are settled at once. Only anchors with runs that differ
go on to the last digit, the window itself, as 128 bits of two independent hashes. Suffixes equal
in all digits are a repeated window; the first of them (smaller doc_id, then earlier start) stays, and
all others cover bytes that go. Documents that are copies as a whole are found by one key each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, Scratch
from .exchange import ASKED, Answers, Chunk, answer, ask, gathered, of_kind, pack_chunks, spans_for, unpack_keys
from .token_store import _rows

LENGTH, GRAM = 100, 50
#: Bytes of whole documents that are hashed at a time.
BATCH = 1 << 18
ANCHOR, WHOLE, WINDOW = 0, 1, 2

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(0, 1 << 64, (2, 256), "u8")
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.cumprod(out, dtype="u8")


class _Powers:
    """Powers of the two bases and their inverses, as long as the longest batch so far."""

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def to(self, n: int) -> _Powers:
        if n > self.n:
            self.n = max(n, BATCH * 2)
            self.up, self.down = [_powers(b, self.n) for b in _BASE], [_powers(b, self.n) for b in _INVERSE]
        return self


_held = _Powers()


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, "u8")
    np.cumsum(_TABLE[which][data] * _held.to(len(data) + 1).up[which][: len(data)], out=out[1:], dtype="u8")
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)


def _hashes(sums: np.ndarray, at: np.ndarray | slice, n: int, which: int) -> np.ndarray:
    if isinstance(at, slice):
        return _mix((sums[n:] - sums[:-n]) * _held.down[which][: len(sums) - n])
    return _mix((sums[at + n] - sums[at]) * _held.down[which][at])


def _slide(x: np.ndarray, span: int, op) -> np.ndarray:
    """op over x[i : i + span] for every i, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        x = op(x[: len(x) - step], x[step:])
        width += step
    return x


class Batch:
    """Some documents' bytes in a row, with the runs of windows (inside a document) that share an anchor.

    Of each run: ``anchor``, ``context`` (a hash of the bytes it spans, never 0), ``start`` of its first window,
    ``size`` in windows. With ``look``, ``twice`` tells runs whose anchor stands at two places in them, the
    only ones that can hold equal windows.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, look: bool):
        self.data = data
        self.sums, self.others = _sums(data, 0), _sums(data, 1)
        edge = np.zeros(len(data) + 1, "i4")
        has = ends - starts >= LENGTH
        np.add.at(edge, starts[has], 1)
        np.add.at(edge, ends[has] - LENGTH + 1, -1)
        if len(data) < LENGTH or not has.any():
            self.anchor = self.context = np.zeros(0, "u8")
            self.start = self.size = np.zeros(0, "i8")
            self.twice = np.zeros(0, bool)
            return
        gram = _hashes(self.sums, slice(None), GRAM, 0)
        low = _slide(gram, LENGTH - GRAM + 1, np.minimum)
        inside = np.cumsum(edge[: len(low)]) > 0
        at = np.flatnonzero(inside)
        least = low[at]
        begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.size = np.diff(np.append(begin, len(at)))
        # The least of many hashes is small: mixed once more, anchors are even over the ranges that answer for them.
        self.start, self.anchor = at[begin], _mix(least[begin])
        stop = self.start + self.size - 1 + LENGTH
        span = (self.others[stop] - self.others[self.start]) * _held.down[1][self.start]
        self.context = np.maximum(_mix(span ^ (stop - self.start).astype("u8") * np.uint64(_BASE[0])), np.uint64(1))
        if look:
            # Grams that are some window's anchor: equal to the greatest of the least hashes around them.
            around = np.zeros(len(gram) + LENGTH - GRAM, "u8")
            around[LENGTH - GRAM :][: len(low)] = np.where(inside, low, 0)
            place = np.flatnonzero(_slide(around, LENGTH - GRAM + 1, np.maximum) == gram)
            order = np.lexsort((place, gram[place]))
            place, value = place[order], gram[place[order]]
            near = (value[1:] == value[:-1]) & (place[1:] - place[:-1] <= LENGTH - GRAM + 1)
            self.twice = np.isin(self.anchor, _mix(value[1:][near]))

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and 128-bit names of the windows of some runs."""
        n = self.size[runs]
        at = np.repeat(self.start[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, _hashes(self.sums, at, LENGTH, 0), _hashes(self.others, at, LENGTH, 1)


def _batches(chunk: Chunk, skip: np.ndarray, look: bool):
    """(first byte in the chunk, Batch) over whole documents; those to skip have no windows."""
    data, starts, ends = np.frombuffer(chunk.data, "u1"), chunk.starts, chunk.ends
    k = 0
    while k < len(ends):
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + BATCH, "right")))
        lo = int(starts[k])
        own = np.arange(k, j)
        own = own[~skip[own]]
        if len(own):
            yield lo, Batch(data[lo : int(ends[j - 1])], starts[own] - lo, ends[own] - lo, look)
        k = j


def _whole(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Names of whole documents: 64 and 64 bits."""
    h = [xxhash.xxh3_128_intdigest(t) for t in chunk.texts()]
    return np.array([x & (1 << 64) - 1 for x in h], "u8"), np.array([x >> 64 for x in h], "u8")


def _named(keys: np.ndarray, checks: np.ndarray):
    """Distinct (key, check), ascending: keys, checks, first place, and each entry's number."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
    number = np.empty(len(k), "i8")
    number[order] = np.cumsum(new) - 1
    return k[new], c[new], order[new], number


STAYS, COPY, MIXED = 0, 1, 2


class Firsts(Answers):
    """Of whole documents and windows: STAYS for the first chunk that has it, else COPY. Of anchors the same, or MIXED if their runs differ."""

    def reduce(self, kind, rows):
        sizes = [len(r[1]) // 8 for r in rows]
        keys = np.concatenate([unpack_keys(r[1]) for r in rows])
        answer = np.full(len(keys), COPY, "u1")
        if kind == ANCHOR:
            contexts = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows])
            first, mixed, at = self._anchors(keys, contexts)
            answer[first] = STAYS  # rows come in the order of chunks, and the first place is the least
            answer[mixed[at]] = MIXED
        else:
            _, _, first, _ = _named(keys, np.concatenate([np.frombuffer(r[2], "<u8") for r in rows]))
            answer[first] = STAYS
        ends = np.cumsum(sizes)
        for r, a, b in zip(rows, ends - sizes, ends, strict=True):
            yield r[0], answer[a:b].tobytes()

    @staticmethod
    def _anchors(keys: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct anchors: the first place, and whether contexts differ or one is 0; each entry's number."""
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        return first, np.bincount(at, weights=(contexts != contexts[first][at]) | (contexts == 0)) > 0, at

    def merge(self, kind, rows):
        keys = np.concatenate([unpack_keys(r[1]) for r in rows])
        if kind == ANCHOR:
            contexts = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows])
            first, mixed, _ = self._anchors(keys, contexts)
            return keys[first], None, np.where(mixed, np.uint64(0), contexts[first])
        return *_named(keys, np.concatenate([np.frombuffer(r[2], "<u8") for r in rows]))[:2], None

    def spread(self, kind, keys, checks, answer):
        """A group that has the first leaves it to its own first chunk."""
        verdict, taken = np.frombuffer(answer, "u1"), np.zeros(len(keys), bool)
        names = None if kind == ANCHOR else np.frombuffer(checks, "<u8")

        def one(row: tuple) -> bytes:
            own = unpack_keys(row[1])
            if kind == ANCHOR:
                at = np.searchsorted(keys, own)
            else:  # where equal keys have several checks, on to the one that fits
                at, own_names = np.searchsorted(keys, own), np.frombuffer(row[2], "<u8")
                while (off := np.flatnonzero(names[at] != own_names)).size:
                    at[off] += 1
            out = np.where((verdict[at] == STAYS) & taken[at], COPY, verdict[at]).astype("u1")
            taken[at] = True
            return out.tobytes()

        return one


class Runs:
    """A chunk's whole-document keys, which documents are copies of earlier ones in it, and the runs of the others."""

    def __init__(self, chunk: Chunk, look: bool):
        self.chunk = chunk
        self.whole, self.whole_checks, first, self.whole_number = _named(*_whole(chunk))
        copy = np.ones(len(self.whole_number), bool)
        copy[first] = False
        self.copy = copy & (chunk.ends - chunk.starts >= LENGTH)
        self.batches = list(_batches(chunk, self.copy, look))
        cols = [np.concatenate([np.zeros(0, kind), *[getattr(b, name) for _, b in self.batches]]) for name, kind in (("anchor", "u8"), ("context", "u8"), ("size", "i8"))]
        self.anchor, self.context, self.size = cols
        self.start = np.concatenate([np.zeros(0, "i8"), *[b.start + lo for lo, b in self.batches]])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's distinct anchors, and the context of each; 0 if its runs differ or one may hold equal windows."""
        twice = np.concatenate([np.zeros(0, bool), *[b.twice for _, b in self.batches]])
        known, first, at = np.unique(self.anchor, return_index=True, return_inverse=True)
        context = self.context[first]
        return known, np.where(np.bincount(at, weights=(self.context != context[at]) | twice, minlength=len(known)) > 0, np.uint64(0), context)


class Judged(Runs):
    """Runs with their answers; ``at``, ``keys`` and ``checks`` are the windows left to the last digit."""

    def __init__(self, chunk: Chunk, found: list[dict]):
        super().__init__(chunk, False)
        known = np.unique(self.anchor)
        verdict = np.frombuffer(of_kind(found, ANCHOR), "u1")[np.searchsorted(known, self.anchor)] if len(self.anchor) else np.zeros(0, "u1")
        _, _, first, _ = _named(self.anchor, self.context)
        leads = np.zeros(len(self.anchor), bool)
        leads[first] = True
        self.gone = ~leads | (verdict == COPY)
        # A copy of another chunk's document took part as that one does, which is enough: none of its windows stays.
        again = (np.frombuffer(of_kind(found, WHOLE), "u1")[self.whole_number] == COPY) & (chunk.ends - chunk.starts >= LENGTH)
        self.copy |= again
        open_ = leads & (verdict == MIXED) & ~again[np.searchsorted(chunk.ends, self.start, "right")]
        at, keys, checks, lo = [np.zeros(0, "i8")], [np.zeros(0, "u8")], [np.zeros(0, "u8")], 0
        for begin, b in self.batches:
            a, k, c = b.windows(np.flatnonzero(open_[lo : lo + len(b.anchor)]))
            at.append(a + begin)
            keys.append(k)
            checks.append(c)
            lo += len(b.anchor)
        self.at = np.concatenate(at)
        self.keys, self.checks, self.first, self.number = _named(np.concatenate(keys), np.concatenate(checks))

    def removed(self, last: np.ndarray) -> np.ndarray:
        """True for each byte of the chunk that goes; ``last``: the answers for the distinct windows."""
        chunk = self.chunk
        stays = np.zeros(len(self.at), bool)
        stays[self.first] = last == STAYS
        edge = np.zeros(len(chunk.data) + 1, "i4")
        at = self.at[~stays]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + LENGTH, -1)
        np.add.at(edge, self.start[self.gone], 1)
        np.add.at(edge, (self.start + self.size - 1 + LENGTH)[self.gone], -1)
        out = np.cumsum(edge[:-1]) > 0
        for k in np.flatnonzero(self.copy).tolist():
            out[chunk.starts[k] : chunk.ends[k]] = True
        return out


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"


def dedup(docs: DataFrame, scratch: Scratch, texts: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` the spans and the bytes kept.

    Null texts are empty. Rows without a doc_id come after all others; rows of one doc_id are ordered
    by the start of their text, then its hash. Chunks are cut along that order, so the first chunk with a window has its first occurrence.
    """
    chunks = pack_chunks(docs, scratch, ordered=True)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    scratch.release()
    body = ("doc_ids", "known", "ends", "data")

    def anchors(it):
        for number, *rest in _rows(it, "chunk", *body):
            r = Runs(Chunk(*rest), True)
            keys, contexts = r.anchors()
            yield ask(number, ANCHOR, spans_for(total / 26), keys, None, contexts)
            yield ask(number, WHOLE, spans_for(total / 2048), r.whole, r.whole_checks)

    first = scratch.write(answer(chunks.select("chunk", *body).mapInArrow(lean(anchors), ASKED), Firsts(), scratch, chunks))
    scratch.release()
    read = chunks.join(gathered(first, "found"), "chunk")

    def windows(it):
        for number, *rest, found in _rows(it, "chunk", *body, "found"):
            j = Judged(Chunk(*rest), found)
            yield ask(number, WINDOW, spans_for(total / 4), j.keys, j.checks)  # how many are left is not known yet: at most four times as many keys in a range

    second = scratch.write(answer(read.select("chunk", *body, "found").mapInArrow(lean(windows), ASKED), Firsts(), scratch, chunks))
    scratch.release()

    def finish(it):
        for *rest, found, last in _rows(it, *body, "found", "last"):
            chunk = Chunk(*rest)
            gone = Judged(chunk, found).removed(np.frombuffer(of_kind(last, WINDOW), "u1").astype(bool))
            data, out = np.frombuffer(chunk.data, "u1"), []
            for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view("i1"), [0]])))
                kept = data[a:b][~own].tobytes()
                out.append((b - a, int(own.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), [{"start": s, "stop": e} for s, e in edges.reshape(-1, 2).tolist()] if texts else None, kept if texts else None))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([chunk.ids(), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3]), pa.array(cols[4], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(cols[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    both = read.join(gathered(second, "last"), "chunk", "left").select(*body, "found", "last")
    return both.mapInArrow(lean(finish), OUT)
