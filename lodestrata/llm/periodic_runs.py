"""Periodic runs of words, by the tandem-repeat method of Gusfield and Stoye.

A document's words are symbols. Lempel-Ziv blocks give squares that cover the leftmost occurrence of
every square; walks along suffix links complete them to the vocabulary of squares; the vocabulary is
located in the suffix tree, and occurrences that touch merge into runs. Only primitively rooted squares
are carried on, since a run's smallest period is such a root.

Each step is done for all documents of a batch at once, over arrays. The suffix tree is its sorted
leaves and the depths of neighbours' forks: an inner node is an interval of leaves. Before it is built,
words that no repeated stretch of the least length covers are left out: no run can hold them.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, lean, with_fields

#: Words of the shortest run.
LEAST = 12
#: Bytes of text that a batch takes, about; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start:long,length:long,period:long>"


class Minima:
    """Minima over stretches of 2^k entries, to find how far from a slot entries stay at or above a floor."""

    def __init__(self, x: np.ndarray):
        self.n, self.rows = len(x), [x]
        while (1 << len(self.rows)) < self.n:
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))

    def left(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The least slot such that all entries after it, up to ``at``, are at or above the floor."""
        at = at.copy()
        for k in reversed(range(len(self.rows))):
            to = at - (1 << k)
            at = np.where((to >= 0) & (self.rows[k][np.maximum(to + 1, 0)] >= floor), to, at)
        return at

    def right(self, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The last slot such that all entries after ``at``, up to it, are at or above the floor."""
        at = at.copy()
        for k, row in reversed([*enumerate(self.rows)]):
            to = at + (1 << k)
            at = np.where((to < self.n) & (row[np.minimum(at + 1, len(row) - 1)] >= floor), to, at)
        return at


class SuffixTree:
    """Suffixes of a string of symbols in order, with the ranks of all stretches of 2^k symbols, which give extensions both ways."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        self.leaves = np.argsort(s, kind="stable")
        self.ranks: list[np.ndarray] = []
        slots, key = np.arange(n), s[self.leaves]
        rank, h = np.zeros(n, "i4"), 1
        while True:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[self.leaves[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            self.ranks.append(rank.copy())
            alone = new & np.concatenate([new[1:], [True]])
            slots = slots[~alone]
            if not len(slots):
                break
            own = self.leaves[slots]
            beyond = own + h < n
            key = rank[own].astype("i8") * (n + 1) + np.where(beyond, rank[np.where(beyond, own + h, 0)] + 1, 0)
            order = np.argsort(key, kind="stable")
            self.leaves[slots], key, h = own[order], key[order], 2 * h
        self.rank = rank
        self.depth = np.zeros(n, "i4")
        if n > 1:
            self.depth[1:] = self.ahead(self.leaves[:-1], self.leaves[1:])
        self.forks = Minima(self.depth)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` on equal those from ``j`` on; nothing at or beyond the end."""
        i, j = np.array(i), np.array(j)
        begin = i.copy()
        for k in reversed(range(len(self.ranks))):
            a, b = np.minimum(i, self.n - 1), np.minimum(j, self.n - 1)
            same = (self.ranks[k][a] == self.ranks[k][b]) & (i < self.n) & (j < self.n) & (i != j)
            i, j = i + (same << k), j + (same << k)
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to and with ``i`` equal those up to and with ``j``."""
        i, j = np.array(i), np.array(j)
        begin = i.copy()
        for k in reversed(range(len(self.ranks))):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            same = (a >= 0) & (b >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])
            i, j = i - (same << k), j - (same << k)
        return begin - i

    def locus(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the point where the stretch of ``length`` symbols at ``i`` ends."""
        at = self.rank[i].astype("i8")
        return self.forks.left(at, length), self.forks.right(at, length)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and the end: each is the longest stretch that also starts earlier, or one new symbol."""
        sa, slot = self.leaves, np.arange(self.n)
        less, before = Minima(sa), np.zeros(self.n, "i8")
        left, right = less.left(slot, sa), less.right(slot, sa) + 1
        for at, fine in ((left, sa[left] < sa), (np.minimum(right, self.n - 1), right < self.n)):
            before[sa[fine]] = np.maximum(before[sa[fine]], self.ahead(sa[at[fine]], sa[fine]))
        step, out, h = np.maximum(before, 1).tolist(), [], 0
        while h < self.n:
            out.append(h)
            h += step[h]
        return np.array([*out, self.n])


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n[i]`` items of i: i, and the item's number from 0."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def covering_squares(t: SuffixTree, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of squares among which every square's leftmost occurrence is a shift to the right of one within its run."""
    cut = t.blocks()
    h, h1 = cut[:-1], cut[1:]
    size = h1 - h
    of, k = _spread(np.where(h1 < t.n, size, 0))  # squares that reach beyond the block, with the last symbol of a half at most a root before its end
    k, at = k + 1, h1[of]
    near = s[at] == s[at - k]
    k, at = k[near], at[near]
    q = at - k
    ahead, behind = t.ahead(at, q), t.behind(at - 1, q - 1)
    fine = ahead + behind >= k
    found = [(np.maximum(q - behind, q - k + 1)[fine], k[fine])]
    of, k = _spread(np.where(h > 0, np.minimum(size + np.append(size[1:], 0), t.n - 1 - h), 0))  # that start before it, with the last symbol of their first half in it
    k, at, end = k + 1, h[of], h1[of]
    near = (s[at] == s[at + k]) & (s[at - 1] == s[at + k - 1])
    k, at, end = k[near], at[near], end[near]
    ahead, behind = t.ahead(at, at + k), t.behind(at - 1, at + k - 1)
    start = np.maximum(at - behind, at - k + 1)
    fine = (ahead + behind >= k) & (start + k <= end)
    found.append((start[fine], k[fine]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def primitive(t: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the root of the square isn't a power: no quotient of its length by a prime is a period too."""
    top = int(k.max(initial=1))
    least = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, top + 1, p)] = p
    fine, rest = np.ones(len(k), bool), k.copy()
    while (more := np.flatnonzero(rest > 1)).size:
        p = least[rest[more]]
        d = k[more] // p
        fine[more] &= t.ahead(start[more], start[more] + d) < 2 * k[more] - d
        rest[more] //= p
    return fine


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run of at least two periods in a string of symbols, by period and start."""
    none = np.zeros(0, "i8")
    if len(s) < 2:
        return none, none, none
    t = SuffixTree(s)
    start, k = covering_squares(t, s)
    own = primitive(t, start, k)
    start, k = start[own], k[own]
    if not len(k):
        return none, none, none
    first = start - t.behind(start - 1, start + k - 1)
    order = np.lexsort((start, first, k))
    start, k, first = start[order], k[order], first[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (k[1:] != k[:-1])])
    start, k = start[new], k[new]
    # Suffix links: the square one word on has the same root turned by one; beyond k - 1 turns, or where the run ends, they are marked already.
    of, turn = _spread(np.minimum(t.ahead(start, start + k) - k, k - 1) + 1)
    start, k = start[of] + turn, k[of]
    lo, hi = t.locus(start, 2 * k)
    _, one = np.unique(lo * (t.n + 1) + k, return_index=True)
    lo, hi, k = lo[one], hi[one], k[one]
    of, nth = _spread(hi - lo + 1)
    at, k = t.leaves[lo[of] + nth], k[of]
    order = np.lexsort((at, k))
    at, k = at[order], k[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(new[1:], len(at)) - 1
    return at[new], at[last] + 2 * k[new] - at[new], k[new]


def repeated(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Words that a stretch of least / 2 words covers which its document holds twice.

    A run of period q and length L repeats its first L - q words q later, at least half of ``least``, and these
    two stretches cover it. Stretches are compared by hash: a chance equality only leaves more words in.
    """
    w = least // 2
    if len(ids) < w:
        return np.zeros(len(ids), bool)
    n = len(ids) - w + 1
    key = doc[:n].astype("u8") * _M
    mixed = (ids.astype("u8") + np.uint64(1)) * _M
    mixed ^= mixed >> np.uint64(29)
    for i in range(w):
        key = (key ^ mixed[i : i + n]) * _M
        key ^= key >> np.uint64(31)
    inside = doc[:n] == doc[w - 1 :]
    ordered = np.sort(key[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(ids), bool)
    hit = inside & (twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
    edge = np.zeros(len(ids) + 1, "i4")
    edge[:n] += hit
    edge[w : w + n] -= hit
    return np.cumsum(edge)[:-1] > 0


def runs_of(words: list[list[bytes]], least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each document (start, length, period) of its runs of at least ``least`` words, by start, then period."""
    sizes = np.array([len(w) for w in words], "i8")
    firsts = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), "i8", int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    at = np.flatnonzero(repeated(ids, doc, least))
    # Stretches that nothing joins are apart: a word of one isn't a word of another, so that no repeat spans or crosses them.
    piece = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])])) if len(at) else at
    _, symbols = np.unique(piece * len(number) + ids[at], return_inverse=True)
    start, length, period = runs(symbols)
    long = length >= least
    start, length, period = at[start[long]] if len(at) else start, length[long], period[long]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    cuts = np.searchsorted(start, np.append(firsts, sizes.sum()))
    return [(start[a:b] - f, length[a:b], period[a:b]) for a, b, f in zip(cuts[:-1].tolist(), cuts[1:].tolist(), firsts.tolist(), strict=True)]


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, "i8")
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def detect(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Adds ``runs`` (start, length, period of words, by start, then period) and ``collapsed``, the text with each run's first period only, to the other columns.

    Words are parted by U+0020 and U+0009-000D and joined by one space. Null and empty texts have no runs and collapse to the empty text.
    Each row is judged by itself, so equal rows give equal rows, an empty table an empty one, and null ids or sources don't
    matter; a column called ``runs`` or ``collapsed`` beside the text is refused. Nothing is shuffled: a task holds some
    megabytes of texts, or one text of any length with about 150 bytes a word of its repeated stretches.
    """
    rest = [c for c in docs.columns if c != text]
    if clash := {"runs", "collapsed"} & set(rest):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    fields = with_fields(docs.select(*[docs[c] for c in rest]), f"runs array<{RUN}>, collapsed string")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(it):
        for batch in it:
            texts = batch.column(text)
            begin = 0
            for some in batches((texts[i].as_py() for i in range(batch.num_rows)), BATCH_BYTES, lambda x: len(x or "") + 64):
                words = [(x or "").encode().split() for x in some]
                found = runs_of(words, least)
                ends = np.cumsum([0, *[len(f[0]) for f in found]])
                parts = [pa.array(np.concatenate([f[i] for f in found]).astype("i8")) for i in range(3)]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(run_type.value_type)))
                short = pa.array([b" ".join(collapse(w, *f)) for w, f in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
                kept = [batch.column(c).slice(begin, len(some)) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, listed, short], names=[*rest, "runs", "collapsed"])
                begin += len(some)

    return docs.select(*[docs[c] for c in docs.columns]).mapInArrow(lean(work), fields)
