"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of the uniform, unigram and bigram maximum-likelihood
estimates. The weights depend on how often the context was seen in training, in buckets of powers of
two, and are learned by expectation-maximisation on held-out counts: each training token is taken out
of the counts that predict it. All training tokens enter, as a histogram whose cells follow the logarithm of their number.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, Scratch
from .exchange import ASKED, Answers, Chunk, answer, ask, from_small_ints, gathered, pack_chunks, small_ints, spans_for, unpack_keys
from .token_store import _rows

END, BEGIN = np.uint64(1), np.uint64(2)
_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BUCKETS, LEVELS, STEP = 32, 64, 2.0


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@dataclass
class Tokens:
    """A chunk's tokens as hashes: words of each document, then its end; ``doc`` is each token's document."""

    unigram: np.ndarray
    bigram: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    trained: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, chunk: Chunk) -> Tokens:
        hashes, sizes = [], []
        for text in chunk.texts():
            words = text.lower().split()
            hashes += map(xxhash.xxh3_64_intdigest, words)
            hashes.append(1)
            sizes.append(len(words) + 1)
        u = np.array(hashes, "u8")
        n = np.array(sizes, "i8")
        first = np.cumsum(n) - n
        before = np.concatenate([[BEGIN], u[:-1]]).astype("u8")
        before[first] = BEGIN
        b = (before * _M ^ u) * _N
        b ^= b >> np.uint64(31)
        b *= _M
        held = np.array([is_held_out(int(k)) if known else False for k, known in zip(chunk.doc_ids, chunk.known, strict=True)])
        doc = np.repeat(np.arange(len(n)), n)
        return cls(u, b, first, doc, ~held[doc], held)


def _distinct(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(keys, return_inverse=True)
    return u, np.bincount(at, weights=trained, minlength=len(u)).astype("<u4")


class Totals(Answers):
    """Training counts of each chunk's keys; and as chunk -1 how many distinct keys were trained on and their tokens."""

    @staticmethod
    def _summed(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        keys = [unpack_keys(r[1]) for r in rows]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        # Chunks count in 32 bits, groups of them in 64.
        counts = [np.frombuffer(r[3], "<u4" if len(r[3]) == 4 * len(k) else "<i8") for r, k in zip(rows, keys, strict=True)]
        return keys, u, at, np.bincount(at, weights=np.concatenate(counts), minlength=len(u)).astype("i8")

    def reduce(self, kind, rows):
        keys, u, at, total = self._summed(rows)
        ends = np.cumsum([len(k) for k in keys])
        for r, a, b in zip(rows, ends - [len(k) for k in keys], ends, strict=True):
            yield r[0], small_ints(total[at[a:b]])
        yield -1, np.array([(total > 0).sum(), total.sum()], "<i8").tobytes()

    def merge(self, kind, rows):
        _, u, _, total = self._summed(rows)
        return u, None, total.astype("<i8")

    def spread(self, kind, keys, checks, answer):
        total = from_small_ints([answer])
        return lambda row: small_ints(total[np.searchsorted(keys, unpack_keys(row[1]))])


@dataclass
class Counts:
    """Training counts at each token of a chunk: of the token, of its context, of both in order."""

    token: np.ndarray
    context: np.ndarray
    both: np.ndarray

    @classmethod
    def of(cls, t: Tokens, found: list[dict], documents: int) -> Counts:
        one, two = (from_small_ints([x["answer"] for x in found if x["kind"] == k]) for k in (0, 1))
        _, at = np.unique(t.unigram, return_inverse=True)
        token = one[at]
        _, at = np.unique(t.bigram, return_inverse=True)
        context = np.concatenate([[documents], token[:-1]])
        context[t.first] = documents
        return cls(token, context, two[at])


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the floor of log2 of its count."""
    return np.where(context > 0, 1 + np.frexp(np.maximum(context, 1).astype("f8"))[1] - 1, 0).astype("i8")


@dataclass(frozen=True)
class Grid:
    """Cells of the histogram: buckets of contexts and levels of probabilities, as many as the training tokens call for.

    The least estimate that isn't 0 is one count among n, so levels follow the logarithm of n, and so do buckets: a
    corpus of any size has each of its estimates in a level of its own octave.
    """

    buckets: int = BUCKETS
    levels: int = LEVELS

    @classmethod
    def of(cls, n: int) -> Grid:
        octaves = max(n, 1).bit_length()
        return cls(max(BUCKETS, octaves + 1), max(LEVELS, math.ceil(STEP * octaves) + 2))

    def level(self, p: np.ndarray) -> np.ndarray:
        """0 for p = 0, else a step of 1 / STEP octaves, finest at 1."""
        with np.errstate(divide="ignore"):
            return np.where(p > 0, self.levels - 1 + np.rint(STEP * np.log2(np.maximum(p, 1e-300))), 0).astype("i8")

    def value(self) -> np.ndarray:
        """The probability of each level."""
        k = np.arange(self.levels)
        return np.where(k > 0, 2.0 ** ((k - self.levels + 1) / STEP), 0.0)


def cells(c: Counts, trained: np.ndarray, n: int, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """The histogram of (bucket, unigram level, bigram level) of training tokens, each without itself."""
    token, context, both = (x[trained] for x in (c.token, c.context, c.both))
    p1 = (token - 1) / max(n - 1, 1)
    p2 = (both - 1) / np.maximum(context - 1, 1)
    return np.unique((bucket(context - 1) * grid.levels + grid.level(p1)) * grid.levels + grid.level(p2), return_counts=True)


def learn(cell: np.ndarray, count: np.ndarray, v: int, grid: Grid = Grid(), rounds: int = 200) -> np.ndarray:
    """Weights (bucket x uniform, unigram, bigram) by EM on the histogram; buckets without counts take the nearest fuller one's."""
    b, p1, p2 = cell // grid.levels**2, cell // grid.levels % grid.levels, cell % grid.levels
    value = grid.value()
    p = np.stack([np.full(len(cell), 1 / (v + 1)), value[p1], value[p2]], axis=1)
    w = np.full((grid.buckets, 3), 1 / 3)
    w[0] = 0.5, 0.5, 0.0
    for _ in range(rounds):
        r = w[b] * p
        r *= (count / r.sum(axis=1))[:, None]
        new = np.stack([np.bincount(b, r[:, k], grid.buckets) for k in range(3)], axis=1) + [1e-3, 1e-3, 0]
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    seen = np.bincount(b, count, grid.buckets) > 0
    seen[0] = True
    return w[[np.flatnonzero(seen[: i + 1])[-1] for i in range(grid.buckets)]]


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)``: base and interpolated log10 probability, token counts.

    Null texts are empty and hold only their end. Rows without a doc_id are trained on; repeated rows count and are
    scored each time; other columns, whatever their names, are left behind; an empty table gives no rows. The weights (a row for each bucket) and three totals are all that
    the driver sees, besides the histogram: its cells (see ``Grid``) number 32 x 64 x 64 up to 2^31 tokens, and 48 x 98 x 98 at 2^47.
    """
    chunks = pack_chunks(docs, scratch, chunk_bytes=4 << 20)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    spans = spans_for(total / 6)

    def request(it):
        for chunk, *rest in _rows(it, "chunk", "doc_ids", "known", "ends", "data"):
            t = Tokens.of(Chunk(*rest))
            for kind, keys in ((0, t.unigram), (1, t.bigram)):
                u, n = _distinct(keys, t.trained)
                yield ask(chunk, kind, spans, u, None, n)

    answers = scratch.write(answer(chunks.select("chunk", "doc_ids", "known", "ends", "data").mapInArrow(lean(request), ASKED), Totals(), scratch, chunks))
    scratch.release()
    sums = [np.frombuffer(r.answer, "<i8") for r in answers.where("chunk < 0 and kind = 0").select("answer").collect()]  # one row a range
    v, n = (int(sum(s[i] for s in sums)) for i in (0, 1))
    read = chunks.join(gathered(answers, "found"), "chunk").select("doc_ids", "known", "ends", "data", "found")
    documents = int(docs.select("doc_id").where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))).count())

    grid = Grid.of(n)

    def histogram(it):
        for *rest, found in _rows(it, "doc_ids", "known", "ends", "data", "found"):
            t = Tokens.of(Chunk(*rest))
            cell, count = cells(Counts.of(t, found, documents), t.trained, n, grid)
            yield pa.record_batch([pa.array(cell), pa.array(count)], names=["cell", "n"])

    hist = read.mapInArrow(lean(histogram), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn(np.array([r.cell for r in hist], "i8"), np.array([r.n for r in hist], "f8"), v, grid)

    def judge(it):
        for *rest, found in _rows(it, "doc_ids", "known", "ends", "data", "found"):
            chunk = Chunk(*rest)
            t = Tokens.of(chunk)
            c = Counts.of(t, found, documents)
            w = weights[bucket(c.context)]
            p = w[:, 0] / (v + 1) + w[:, 1] * c.token / max(n, 1) + w[:, 2] * c.both / np.maximum(c.context, 1)
            base = np.log10((c.token + 1) / (n + v + 1))
            add = lambda x: np.add.reduceat(x, t.first)
            yield pa.record_batch([chunk.ids(), pa.array(t.held), pa.array(np.bincount(t.doc)), pa.array(add((c.token > 0).astype("i8"))), pa.array(np.full(len(t.held), n)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return read.mapInArrow(lean(judge), OUT)
