"""How the sources of a language differ in their words, by mergeable radix tries.

Tasks count terms by language and source and hold them as radix tries in preorder, which is the UTF-8
order of the terms: a leaf keeps how many bytes it shares with the leaf before it, the bytes it adds, how
many documents of the language hold it and a counter for each source. Tries are cut at the same
terms into prefix ranges, and the slices of a range are merged. A last walk over the merged tries in
UTF-8 order gives the pairs' sums and each group's candidates, ties in order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, only, Scratch, shuffle_partitions
from .token_store import _rows

#: Documents of its language that hold a kept term, at least.
DOCUMENTS = 30
#: Ranks of terms that are reported.
TERMS = 50
#: What counts are smoothed by, and the scale of shares.
SMOOTH, SCALE = 5, 1_000_000_000
#: Counters of documents that a task holds before it writes its tries: 8 bytes each, and a term at most.
HELD = 1 << 22
#: Leaves of one row, between two leads, and of a prefix range, about.
PIECE, LEAD, RANGE = 4096, 64, 1 << 18
#: Numbers of a block of shares (terms x sources) that a task holds.
BLOCK = 1 << 20

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
TRIE = "sources array<string>, shared binary, sizes binary, tails binary, documents binary, widths binary, source binary, count binary"
_COLUMNS = [c.split()[0] for c in TRIE.split(", ")]


def terms(text: str | None) -> list[bytes]:
    """Stretches of letters A-Z and characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_TERM).split()


def _same(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    i = 0
    while a[i] == b[i]:
        i += 1
    return i


def forks(terms: list[bytes]) -> np.ndarray:
    """How many bytes each of the ascending terms shares with the one before it."""
    out = np.zeros(len(terms), "<u4")
    if len(terms) > 1:
        heads = np.array(terms, f"S{_HEAD}").view("u1").reshape(len(terms), _HEAD)
        differ = heads[1:] != heads[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), _HEAD)
        for i in np.flatnonzero(out == _HEAD).tolist():  # the first bytes don't tell
            out[i] = _same(terms[i - 1], terms[i])
    return out


_HEAD = 16


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their ``n``."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], np.add.reduceat(n, at)


class Trie:
    """A radix trie as its leaves in preorder: terms ascend, leaf i has ``documents[i]`` and ``widths[i]`` counters, each of a number of ``sources``."""

    def __init__(self, terms: list[bytes], documents: np.ndarray, widths: np.ndarray, sources: list[str], source: np.ndarray, count: np.ndarray):
        self.terms, self.documents, self.widths, self.sources, self.source, self.count = terms, documents, widths, sources, source, count
        self.ends = np.concatenate([[0], np.cumsum(widths, dtype="i8")])

    def __len__(self) -> int:
        return len(self.terms)

    @classmethod
    def of(cls, terms: list[bytes], documents: np.ndarray, sources: list[str], row: np.ndarray, source: np.ndarray, count: np.ndarray) -> Trie:
        """From terms in any order, each once, and counters (number of the term, number of the source, count) with repeats."""
        order = sorted(range(len(terms)), key=terms.__getitem__)
        place = np.empty(len(terms), "i8")
        place[order] = np.arange(len(terms))
        key, count = summed(place[row] * max(len(sources), 1) + source, count)
        row, source = key // max(len(sources), 1), key % max(len(sources), 1)
        return cls([terms[i] for i in order], documents[order], np.bincount(row, minlength=len(terms)), sources, source, count)

    @classmethod
    def load(cls, sources, shared, sizes, tails, documents, widths, source, count) -> Trie:
        """From the cells of a row: leaf i forks off the path to leaf i - 1 after ``shared[i]`` bytes and adds ``sizes[i]`` of ``tails``."""
        u4 = [np.frombuffer(x, "<u4") for x in (shared, sizes, widths, source)]
        terms, term, at = [], b"", 0
        for n, size in zip(u4[0].tolist(), u4[1].tolist(), strict=True):
            end = at + size
            term = term[:n] + tails[at:end]
            terms.append(term)
            at = end
        return cls(terms, np.frombuffer(documents, "<i8"), u4[2], list(sources), u4[3], np.frombuffer(count, "<i8"))

    def pack(self, a: int = 0, b: int | None = None) -> tuple:
        """The cells of a row that holds the leaves from ``a`` to ``b``, with those sources alone that they count."""
        b = len(self) if b is None else b
        terms, own = self.terms[a:b], slice(self.ends[a], self.ends[b])
        shared = forks(terms)
        used, source = np.unique(self.source[own], return_inverse=True)
        tails = b"".join([t[n:] for t, n in zip(terms, shared.tolist(), strict=True)])
        sizes = np.fromiter(map(len, terms), "<u4", len(terms)) - shared
        cells = (shared, sizes, tails, self.documents[a:b].astype("<i8"), self.widths[a:b].astype("<u4"), source.astype("<u4"), self.count[own].astype("<i8"))
        return ([self.sources[i] for i in used.tolist()], *(x if isinstance(x, bytes) else x.tobytes() for x in cells))

    def rows(self) -> np.ndarray:
        """The number of the leaf that each counter is of."""
        return np.repeat(np.arange(len(self)), self.widths)

    def kept(self, mask: np.ndarray) -> Trie:
        """The leaves that ``mask`` holds."""
        counters = mask[self.rows()]
        return Trie([self.terms[i] for i in np.flatnonzero(mask).tolist()], self.documents[mask], self.widths[mask], self.sources, self.source[counters], self.count[counters])

    def totals(self, a: int, b: int) -> dict[str, int]:
        """Occurrences of the leaves from ``a`` to ``b`` by source."""
        own = slice(self.ends[a], self.ends[b])
        key, n = summed(self.source[own], self.count[own])
        return {self.sources[s]: x for s, x in zip(key.tolist(), n.tolist(), strict=True)}


def merged(tries: Iterable[Trie]) -> Trie:
    """One trie of all leaves, equal terms added up."""
    number: dict[bytes, int] = defaultdict(counter().__next__)
    names: dict[str, int] = defaultdict(counter().__next__)
    ids, documents, rows, source, count = ([np.zeros(0, "i8")] for _ in range(5))
    for t in tries:
        own = np.fromiter(map(number.__getitem__, t.terms), "i8", len(t))
        ids.append(own)
        documents.append(t.documents)
        rows.append(own[t.rows()])
        source.append(np.array([names[s] for s in t.sources], "i8")[t.source])
        count.append(t.count)
    held = np.zeros(len(number), "i8")
    np.add.at(held, np.concatenate(ids), np.concatenate(documents))
    return Trie.of(list(number), held, list(names), np.concatenate(rows), np.concatenate(source), np.concatenate(count))


def _batch(types: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch with the columns of a DDL string."""
    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in types.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


PART = f"lang string, leads array<binary>, leaves long, {TRIE}"
SLICE = f"range int, lang string, {TRIE}"
KEPT = f"lang string, terms long, totals array<long>, {TRIE}"


class Tally:
    """Terms of one language as they are counted: numbers of terms, and for each document its source, distinct terms and their counts."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(counter().__next__)
        self.sources: dict[str, int] = defaultdict(counter().__next__)
        self.held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def add(self, source: str, words: list[bytes]) -> int:
        """Adds a document; returns how many counters it is."""
        ids, n = np.unique(np.fromiter(map(self.number.__getitem__, words), "i4", len(words)), return_counts=True)
        self.held.append((self.sources[source], ids, n.astype("i4")))
        return len(ids)

    def trie(self) -> Trie:
        ids, n = (np.concatenate([h[i] for h in self.held]) for i in (1, 2))
        source = np.repeat([h[0] for h in self.held], [len(h[1]) for h in self.held])
        return Trie.of(list(self.number), np.bincount(ids, minlength=len(self.number)), list(self.sources), ids, source, n.astype("i8"))


def count(docs: DataFrame) -> DataFrame:
    """Tries of the documents of each task, in rows of at most PIECE leaves; ``leads`` are every LEAD-th of their terms."""

    def work(it):
        tallies: dict[str, Tally] = defaultdict(Tally)

        def flush():
            for lang in list(tallies):
                trie = tallies.pop(lang).trie()
                for a in range(0, len(trie), PIECE):
                    b = min(a + PIECE, len(trie))
                    yield _batch(PART, [(lang, trie.terms[a:b:LEAD], b - a, *trie.pack(a, b))])

        since = 0
        for lang, source, text in _rows(it, "lang", "source", "text"):
            if own := terms(text):
                since += tallies[lang].add(source, own)
            if since >= HELD:
                yield from flush()
                since = 0
        yield from flush()

    return docs.select("lang", "source", "text").mapInArrow(lean(work), PART)


def _cuts(parts: DataFrame, ranges: int) -> list[tuple[str, bytes]]:
    """Where prefix ranges begin, so that each holds about as many leaves: the least (lang, lead) of each part of a range exchange."""
    if ranges < 2:
        return []
    leads = parts.select("lang", F.explode("leads").alias("lead")).repartitionByRange(ranges, "lang", "lead").groupBy(F.spark_partition_id()).agg(F.min(F.struct("lang", "lead")).alias("x"))
    return sorted(((r.x.lang, bytes(r.x.lead)) for r in leads.collect()), key=lambda c: (c[0].encode(), c[1]))[1:]


def merge(parts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Merges the tries by prefix ranges; rows of at most PIECE leaves with those terms that enough documents of their language hold."""
    spark = parts.sparkSession
    leaves = parts.agg(F.sum("leaves")).first()[0] or 0
    ranges = max(1, min(-(-leaves // (1 << 12)), max(shuffle_partitions(spark), -(-leaves // RANGE))))
    cuts = [(lang.encode(), lead) for lang, lead in _cuts(parts, ranges)]

    def deal(it):
        for lang, *cells in _rows(it, "lang", *_COLUMNS):
            key, trie = lang.encode(), Trie.load(*cells)
            at, r = 0, bisect_right(cuts, (key, trie.terms[0]))
            while at < len(trie):
                end = bisect_left(trie.terms, cuts[r][1], at) if r < len(cuts) and cuts[r][0] == key else len(trie)
                if end > at:
                    yield _batch(SLICE, [(r, lang, *(cells if (at, end) == (0, len(trie)) else trie.pack(at, end)))])
                at, r = end, r + 1

    def join(it):
        held, key = [], None

        def out():
            trie = merged(Trie.load(*c) for c in held)
            trie = trie.kept(trie.documents >= documents)
            for a in range(0, len(trie), PIECE):
                b = min(a + PIECE, len(trie))
                cells, totals = trie.pack(a, b), trie.totals(a, b)
                yield _batch(KEPT, [(key[1], b - a, [totals[s] for s in cells[0]], *cells)])

        for r, lang, *cells in _rows(it, "range", "lang", *_COLUMNS):
            if held and key != (r, lang):
                yield from out()
                held = []
            key = (r, lang)
            held.append(cells)
        if held:
            yield from out()

    slices = parts.select("lang", *_COLUMNS).mapInArrow(lean(deal), SLICE)
    return slices.repartition(ranges, "range").sortWithinPartitions("range", "lang").mapInArrow(lean(join), KEPT)


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE x (count + SMOOTH) / (total + SMOOTH x kept)), exact for totals below 9 x 10^15: three digits at a time."""
    under = total + SMOOTH * kept
    rest, out = count + SMOOTH, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // under, rest % under
    return out + 1


SUMS = "lang string, at int, sums array<long>"
CANDIDATES = "lang string, source string, item string, value long"


def _blocks(it):
    """For each block of kept terms: lang, its sources, terms, shares (terms x sources), shares in the whole language, and counts."""
    for lang, every, totals, kept, *cells in _rows(it, "lang", "every", "all_totals", "kept", *_COLUMNS):
        trie, number = Trie.load(*cells), {s: i for i, s in enumerate(every)}
        column = np.array([number[s] for s in trie.sources], "i8")
        total = np.array(totals, "i8")
        names, row = trie.terms, trie.rows()
        step = max(1, BLOCK // max(1, len(every)))
        for a in range(0, len(names), step):
            b = min(a + step, len(names))
            own = slice(*np.searchsorted(row, [a, b]))
            count = np.zeros((b - a, len(every)), "i8")
            count[row[own] - a, column[trie.source[own]]] = trie.count[own]
            whole = count.sum(axis=1, keepdims=True)
            yield lang, every, names[a:b], shares(count, total, kept), shares(whole, total.sum(), kept), count


def sums(tries: DataFrame) -> DataFrame:
    """Sums over a block's terms of how far the shares of source number ``at`` and of each later one are apart."""

    def work(it):
        for lang, every, _, p, _, _ in _blocks(it):
            p = np.ascontiguousarray(p.T)
            for i in range(len(every) - 1):
                yield _batch(SUMS, [(lang, i, np.abs(p[i + 1 :] - p[i]).sum(axis=1).tolist())])

    return tries.mapInArrow(lean(work), SUMS)


def candidates(tries: DataFrame, ranks: int = TERMS) -> DataFrame:
    """Each block's terms whose share in a source exceeds that in the language, at most ``ranks`` for each source: the greatest, ties in UTF-8 order."""

    def work(it):
        for lang, every, names, p, q, n in _blocks(it):
            over = np.where(n > 0, p - q, 0)
            out = []
            for i, source in enumerate(every):
                order = np.argsort(-over[:, i], kind="stable")[:ranks]
                out += [(lang, source, names[t].decode(), int(over[t, i])) for t in order.tolist() if over[t, i] > 0]
            if out:
                yield _batch(CANDIDATES, out)

    return tries.mapInArrow(lean(work), CANDIDATES)


def audit(docs: DataFrame, scratch: Scratch, documents: int = DOCUMENTS, ranks: int = TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language, ``term`` the terms.

    Reads ``docs(text, lang, source)``, null taken as empty; other columns, clashing names included, don't matter. Repeated rows
    count each time. A group without a kept term has equal shares for all, so its pairs still come, and a language without
    kept terms gives pairs of value 0. Equal values rank in UTF-8 order of the item. An empty table gives no rows.

    A task holds HELD counters, a range about RANGE leaves (more only where one term's leaves, one for each trie that
    has it, are more), and a block BLOCK shares. A common word costs one counter a trie, however often it occurs. The result
    itself has a row for each two sources of a language, and a task one vector of a language's sources.
    """
    empty = F.lit("")
    docs = only(docs, "text", "lang", "source").select("text", F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"))
    groups = scratch.write(docs.select("lang", "source").distinct())
    kept = scratch.write(merge(scratch.write(count(docs)), documents))
    size = kept.groupBy("lang").agg(F.sum("terms").alias("kept"))
    total = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("n"))
    filled = groups.join(total, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    every = F.sort_array(F.collect_list(F.struct("source", "n")))
    langs = scratch.write(filled.groupBy("lang").agg(every.alias("x")).join(size, "lang", "left").select("lang", F.col("x.source").alias("every"), F.col("x.n").alias("all_totals"), F.coalesce("kept", F.lit(0)).alias("kept")))
    tries = kept.join(langs, "lang").select("lang", "every", "all_totals", "kept", *_COLUMNS)

    apart = sums(tries).select("lang", "at", F.posexplode("sums").alias("k", "v")).groupBy("lang", "at", "k").agg(F.sum("v").alias("v"))
    one = langs.select("lang", "every", F.posexplode("every").alias("i", "source"))
    two = one.select("lang", "i", "source", F.posexplode("every").alias("j", "item")).where("i <> j")
    near = F.least("i", "j").alias("at"), (F.abs(F.col("i") - F.col("j")) - 1).alias("k")
    pairs = two.select("lang", "source", "item", *near).join(apart, ["lang", "at", "k"], "left")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("v", F.lit(0)).alias("value")).withColumn("rank", place)
    words = candidates(tries, ranks).select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", place).where(F.col("rank") <= ranks)
    return pairs.union(words)


AUDIT_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
         1 + ({SCALE}::HUGEINT * (coalesce(n, 0) + {SMOOTH})) // (total + {SMOOTH} * v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(n) + {SMOOTH})) // (any_value(t.total) + {SMOOTH} * any_value(v)) AS q
  FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM s GROUP BY lang) t USING (lang) GROUP BY lang, term),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT i.lang, i.source, j.source AS other, sum(abs(i.p - j.p)) AS value
             FROM p i JOIN p j ON i.lang = j.lang AND i.term = j.term AND i.source <> j.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
y AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM x)
SELECT * FROM y WHERE part = 'pair' OR rank <= {TERMS}
"""
