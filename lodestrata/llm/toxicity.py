"""Toxicity from the nearest labelled examples.

A bounded sample of labelled documents is turned into TF-IDF vectors over all of their words; a word's
weight is also scaled by its association with the labels (the phi coefficient), so that neighbours are
near in what tells the labels apart. No word is left out, however rare. Each text is compared with the
examples by exact cosine: an inverted index holds the postings of each word in blocks of examples with
the block's greatest weight; the most common words, whose postings would name nearly every example,
are plain rows instead and multiplied for many texts at a time. Words are added up from the one that
can add most; a block is opened for the rest only if the sum of their weights times its maxima can lift
one of its examples among the nearest. Votes weighted by distance are calibrated on the sample itself, each example judged without itself.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, lean, with_fields

#: Bounds of the sample: examples of each label, and bytes of their texts together.
EXAMPLES, EXAMPLE_BYTES = 4000, 24 << 20
#: Neighbours that vote, examples in a block of postings.
NEIGHBOURS, BLOCK = 15, 64
#: Words held as rows over all examples (64 bits each), and texts multiplied with them at a time.
COMMON, TEXTS = 512, 64
#: Words added up before the bound is first used, and the share of the k-th best sum that the others must stay below.
FIRST, SHARE = 64, 0.5
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters in lower case: a-z and everything beyond ASCII."""
    return text.lower().encode(errors="replace").translate(_KEEP).split() if text else []


def family(words: list[bytes], n: int = 4) -> int:
    """The least hash of the runs of n words: copies and near-copies mostly share it, other texts don't."""
    return min(zlib.crc32(b" ".join(words[i : i + n])) for i in range(max(1, len(words) - n + 1)))


def _weights(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Weight of words that are in a of n1 families of label 1 and b of n0 of label 0; 0 for words in none."""
    c, d = n1 - a, n0 - b
    phi = np.abs(a * d - b * c) / np.sqrt(np.maximum((a + b) * (c + d) * n1 * n0, 1e-9)) if n1 > 0 and n0 > 0 else 1.0
    return np.where(a + b > 0, np.log(1 + (n1 + n0) / np.maximum(a + b, 1)) * phi, 0.0)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi in a row, and how many each range has."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


@dataclass
class Index:
    """The examples' unit vectors, and what their votes mean.

    Words are numbered from the most common one down; the first are also ``rows`` over all examples. Word w
    has segments ``word_at[w]..word_at[w + 1]``, one for each block that holds it; segment s has the
    block ``block[s]``, its greatest weight ``most[s]`` and the postings ``at[s]..at[s + 1]``, which are
    ``example`` and ``value``. ``top[w]`` is the greatest of all of a word's weights. Examples are
    numbered so that alike ones share blocks.
    """

    words: bytes
    weight: np.ndarray
    word_at: np.ndarray
    block: np.ndarray
    most: np.ndarray
    at: np.ndarray
    example: np.ndarray
    value: np.ndarray
    top: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    shares: np.ndarray
    prior: float
    bare: float
    without: np.ndarray | None
    knots: np.ndarray = field(default_factory=lambda: np.array([[0.0, 0.0], [1.0, 1.0]]))
    #: The index on the executors, once it is there; ``without`` and the first knots go with it.
    shared: Broadcast | None = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("shared", "vocabulary", "rows")}

    @cached_property
    def vocabulary(self) -> dict[bytes, int]:
        """Words' numbers; made where texts are judged."""
        return {w: i for i, w in enumerate(self.words.split())}

    @cached_property
    def rows(self) -> np.ndarray:
        """The weights of the COMMON first words in all examples; made where texts are judged."""
        n = min(len(self.weight), COMMON)
        out, ends = np.zeros((n, len(self.ids))), self.at[self.word_at[: n + 1]]
        out[np.repeat(np.arange(n), np.diff(ends)), self.example[: ends[-1]]] = self.value[: ends[-1]]
        return out

    def share(self, sc: SparkContext) -> Broadcast:
        """Broadcasts the index, whose size EXAMPLES and EXAMPLE_BYTES bound, once."""
        if self.__dict__.get("shared") is None:
            self.shared = sc.broadcast(self)
        return self.shared

    @classmethod
    def build(cls, ids: list[int], labels: list[int], families: list[int], sizes: np.ndarray, coded: pa.DictionaryArray, counts: np.ndarray, totals: tuple[int, int]) -> Index:
        """From how many distinct words each example has, these in a row and their counts; ``totals`` are the rows of label 0 and 1 in the population."""
        y = np.array(labels, "i8")
        shares = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
        prior = totals[1] / max(1, sum(totals))
        own = np.repeat(np.arange(len(y), dtype="i4"), sizes)
        size = len(coded.dictionary)
        word = coded.indices.to_numpy()
        common = np.argsort(-np.bincount(word, minlength=size), kind="stable")
        number = np.empty(size, "i4")
        number[common] = np.arange(size)
        word, joined = number[word], b" ".join(coded.dictionary.take(pa.array(common)).to_pylist())
        del coded, number
        # Copies of one document would make its rare words look telling: families count, not documents.
        kin, kin_at = np.unique(np.stack([np.array(families, "i8").reshape(len(y)), y]), axis=1, return_inverse=True)
        n = max(1, kin.shape[1])
        pairs = word * np.int64(n)
        pairs += kin_at[own]
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        a = np.bincount(pairs // n, weights=kin[1][pairs % n], minlength=size)
        b = np.bincount(pairs // n, minlength=size) - a
        del pairs
        n1, n0 = float(kin[1].sum()), float((1 - kin[1]).sum())
        weight = _weights(a, b, n1, n0)
        without = np.stack([_weights(a, np.maximum(b - 1, 0), n1, n0 - 1), _weights(np.maximum(a - 1, 0), b, n1 - 1, n0)])
        value = (1 + np.log(counts)) * weight[word]
        norm = np.sqrt(np.bincount(own, value**2, len(y)))
        value /= np.where(norm > 0, norm, 1)[own]
        bare = norm == 0
        # Numbered by label, then by their heaviest word.
        order = np.lexsort((value, own))
        first = np.full(len(y), -1)
        first[own[order]] = word[order]
        by = np.lexsort((np.array(ids, "i8"), first, y))
        rank = np.empty(len(y), "i4")
        rank[by] = np.arange(len(y))
        held = np.flatnonzero(value > 0)
        word, own, value = word[held], rank[own[held]], value[held].astype("f4")
        order = np.lexsort((own, word))
        word, own, value = word[order], own[order], value[order]
        del order, held
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (own[1:] // BLOCK != own[:-1] // BLOCK)
        start = np.flatnonzero(new)
        most = np.maximum.reduceat(value, start) if len(start) else value
        word_at = np.searchsorted(word[start], np.arange(size + 1))
        top = np.zeros(size, "f4")
        np.maximum.at(top, word[start], most)
        of_bare = float(((shares * y)[bare].sum() + prior) / (shares[bare].sum() + 1))
        return cls(joined, weight, word_at, (own[start] // BLOCK).astype("i4"), most, np.append(start, len(word)).astype("i8"), own, value, top, np.array(ids, "i8")[by], y[by].astype("f8"), shares[by], prior, of_bare, without)

    def vector(self, text: str | None, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and weights of a text's unit vector over the known words; none if it has none that weighs.

        For example ``but`` as the other examples see it: words weigh what they would without it, on both
        sides of the product.
        """
        words = Counter(tokens(text))
        at = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), "i8", len(words))
        n = np.fromiter(words.values(), "f8", len(words))[at >= 0]
        at = at[at >= 0]
        w = (1 + np.log(n)) * (self.weight if but < 0 else self.without[int(self.labels[but])])[at]
        order = np.argsort(at)
        order = order[w[order] > 0]
        at, w = at[order], w[order] / max(np.linalg.norm(w), 1e-300)
        return at, w if but < 0 else w * self.without[int(self.labels[but])][at] / np.maximum(self.weight[at], 1e-300)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, but: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k examples of greatest cosine above 0, ties by number, as (numbers, cosines); the vector's example in ``but`` is passed over."""
        for lo in range(0, len(vectors), TEXTS):
            some = vectors[lo : lo + TEXTS]
            weights = np.zeros((len(some), len(self.rows)))
            cuts = [int(np.searchsorted(at, len(self.rows))) for at, _ in some]
            for i, ((at, w), n) in enumerate(zip(some, cuts, strict=True)):
                weights[i, at[:n]] = w[:n]
            for i, (cosine, (at, w), n) in enumerate(zip(weights @ self.rows, some, cuts, strict=True)):
                yield self._rest(cosine, at[n:], w[n:], k, but[lo + i] if but else -1)

    def _rest(self, cosine: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, but: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` for one vector, ``cosine`` being what its common words add up to.

        The words that can add most are added up over all their postings, until the others together can add less than a share
        of the k-th best sum. For those the blocks' maxima bound what an example can still gain; only blocks
        with an example that may be among the k are opened for them.
        """
        adds = w * self.top[at]
        order = np.argsort(-adds, kind="stable")
        at, w = at[order], w[order]
        rest = np.append(np.cumsum(adds[order][::-1])[::-1], 0.0)
        least, j = 0.0, 0
        if but >= 0:
            cosine[but] = 0
        if len(cosine) > k:
            least = np.partition(cosine, -k)[-k]
        while j < len(at) and rest[j] >= SHARE * least:
            some = slice(j, max(2 * j, FIRST))
            lo, hi = self.at[self.word_at[at[some]]], self.at[self.word_at[at[some] + 1]]
            posts = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            value = np.repeat(w[some], hi - lo)
            value *= np.concatenate([self.value[p] for p in posts])
            cosine += np.bincount(np.concatenate([self.example[p] for p in posts]), value, len(cosine))
            if but >= 0:
                cosine[but] = 0
            least = np.partition(cosine, -k)[-k] if len(cosine) > k else 0.0
            j = max(2 * j, FIRST)
        if j < len(at):
            segments, n = _ranges(self.word_at[at[j:]], self.word_at[at[j:] + 1])
            own, block = np.repeat(w[j:], n), self.block[segments]
            room = np.bincount(block, own * self.most[segments], -(-len(cosine) // BLOCK))
            found = np.flatnonzero(cosine + np.repeat(room, BLOCK)[: len(cosine)] >= least - 1e-6)
            found = found[found != but]
            open_ = np.zeros(len(room), bool)
            open_[found // BLOCK] = True
            use = np.flatnonzero(open_[block])
            posts, n = _ranges(self.at[segments[use]], self.at[segments[use] + 1])
            cosine += np.bincount(self.example[posts], np.repeat(own[use], n) * self.value[posts], len(cosine))
        else:
            found = np.flatnonzero(cosine >= least)
        found = found[cosine[found] > 0]
        found = found[np.lexsort((found, -cosine[found]))][:k]
        return found, cosine[found]

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        """Share of label 1, by 1 / (distance + 0.1) and the label's share in the population."""
        w = self.shares[best] / (1.1 - np.minimum(score, 1.0))
        return float((w * self.labels[best]).sum() / w.sum())

    def judge(self, texts: list[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Score and neighbours of each text. A text without a word that weighs is scored as the examples without one are."""
        for best, score in self.nearest([self.vector(t) for t in texts]):
            yield float(np.interp(self.vote(best, score), *self.knots.T)) if len(best) else self.bare, best, score

    def calibrated(self, number: np.ndarray, votes: np.ndarray) -> np.ndarray:
        """Isotonic regression (pool adjacent violators) of the labels of some examples on their votes; one knot for each vote.

        Examples of one vote are one pool from the start, so a stray label among them shifts it by its share only.
        A pool's value is drawn towards the prior by the weight of one example.
        """
        if not len(votes):
            return self.knots
        x, at = np.unique(votes, return_inverse=True)
        w = np.bincount(at, self.shares[number])
        pools: list[list[float]] = []
        for lo, s, n in zip(x, np.bincount(at, (self.shares * self.labels)[number]), w, strict=True):
            pools.append([lo, lo, s, n])
            while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        one = float(self.shares[number].mean())
        knots = np.array([(v, (s + self.prior * one) / (n + one)) for lo, hi, s, n in pools for v in ((lo, hi) if hi > lo else (lo,))])
        knots[:, 1] = np.maximum.accumulate(knots[:, 1])
        return knots


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fitting(rows: list, most: int) -> list[int]:
    """doc_ids of the rows (doc_id, y, bytes), in order, that fit into ``most`` bytes of each label together."""
    left, out = {0: most // 2, 1: most // 2}, []
    for r in rows:
        if r.bytes <= left[r.y]:
            left[r.y] -= r.bytes
            out.append(r.doc_id)
    return out


BAGS = "doc_id long, y int, family long, words array<binary>, counts array<int>"


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES) -> Index:
    """Learns from ``labels(doc_id, toxic)`` outside the held-out fold.

    A doc_id with several labels has the greatest; null labels are none; of several texts of one doc_id
    the least is taken. Of each label the ``examples`` with the least hash of doc_id are taken, whole
    texts, as far as they fit into half of ``example_bytes``; each weighs as many as its label has for
    each taken. These two bounds hold for all that reaches the driver or is broadcast.
    """
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    totals = {r.y: r["count"] for r in lab.groupBy("y").count().collect()}
    picks = [lab.where(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect() for y in (0, 1)]  # bounded by ``examples``
    chosen = spark.createDataFrame([(r.doc_id, r.y) for p in picks for r in p], "doc_id long, y int")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    sample = sample.persist()  # at most 2 x ``examples`` rows; Spark recomputes what a lost executor held
    sizes = sample.select("doc_id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.xxhash64("doc_id").alias("h")).collect()
    kept = spark.createDataFrame([(k,) for k in _fitting(sorted(sizes, key=lambda r: (r.h, r.doc_id)), example_bytes)], "doc_id long")
    taken = sample.join(F.broadcast(kept), "doc_id")

    def bags(it):
        for b in it:
            texts = [tokens(t) for t in b.column("text").to_pylist()]
            some = [Counter(t) for t in texts]
            yield pa.record_batch([b.column("doc_id"), b.column("y"), pa.array(map(family, texts), pa.int64()), pa.array([list(c) for c in some], pa.list_(pa.binary())), pa.array([list(c.values()) for c in some], pa.list_(pa.int32()))], names=["doc_id", "y", "family", "words", "counts"])

    got = taken.select("doc_id", "y", "text").mapInArrow(lean(bags), BAGS).orderBy("doc_id").toArrow()
    ids, y, families = (got.column(c).to_pylist() for c in ("doc_id", "y", "family"))
    sizes, counts = pc.list_value_length(got.column("words")).to_numpy(), pc.list_flatten(got.column("counts")).to_numpy()
    coded = pc.list_flatten(got.column("words")).combine_chunks().dictionary_encode()
    del got
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    index = Index.build(ids, y, families, sizes, coded, counts, (totals.get(0, 0), totals.get(1, 0)))
    del coded, counts
    give_back()
    shared, number = index.share(spark.sparkContext), {int(k): i for i, k in enumerate(index.ids)}

    def alone(it):
        own = shared.value
        numbers = {int(k): i for i, k in enumerate(own.ids)}
        for b in it:
            but = [numbers[k] for k in b.column("doc_id").to_pylist()]
            near = own.nearest([own.vector(t, i) for t, i in zip(b.column("text").to_pylist(), but, strict=True)], but=but)
            votes = [own.vote(best, score) if len(best) else None for best, score in near]
            yield pa.record_batch([b.column("doc_id"), pa.array(votes, pa.float64())], names=["doc_id", "vote"])

    judged = taken.select("doc_id", "text").mapInArrow(lean(alone), "doc_id long, vote double").where("vote is not null").collect()
    index.knots = index.calibrated(np.array([number[r.doc_id] for r in judged], "i8"), np.array([r.vote for r in judged], "f8"))
    index.without = None
    give_back()
    sample.unpersist()
    return index


EVIDENCE = "array<struct<doc_id:long,cosine:double,toxic:int>>"


def score(docs: DataFrame, index: Index, *keep: str, evidence: bool = False) -> DataFrame:
    """``docs(text)`` with the columns of ``keep``, ``score`` and ``predicted``, and the neighbours if asked for.

    A null, empty or wordless text, or one without a word of the examples, has no neighbour and gets
    the share of label 1 among examples without words. The text is the only input. Equal texts are
    judged once for each task, so repeated rows score alike; columns to keep mustn't be called like those added here.
    """
    if clash := {"score", "predicted", "evidence"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    shared, knots = index.share(docs.sparkSession.sparkContext), index.knots

    def run(it):
        own, seen = shared.value, {}
        own.knots = knots
        for b in it:
            texts = [t.as_py() or "" for t in b.column("text")]
            keys = [xxhash.xxh3_128_digest(t.encode(errors="replace")) for t in texts]
            if len(seen) >= 20_000:
                seen = {}
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
            seen.update(zip(new, (g[: 3 if evidence else 1] for g in own.judge(list(new.values()))), strict=True))
            got = [seen[k] for k in keys]
            s = np.array([g[0] for g in got], "f8")
            more = [pa.array([[{"doc_id": int(own.ids[i]), "cosine": min(float(c), 1.0), "toxic": int(own.labels[i])} for i, c in zip(best, cos, strict=True)] for _, best, cos in got], pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))] if evidence else []
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s), pa.array((s >= 0.5).astype("i4")), *more], names=[*keep, "score", "predicted", *["evidence"] * evidence])

    schema = with_fields(docs.select(*keep), "score double, predicted int" + f", evidence {EVIDENCE}" * evidence)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), schema)
