"""Language by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams of one to three letters in rank order. A text's own
most frequent n-grams are held against each profile: every n-gram adds how far its two ranks are
apart, or the length of a profile where the profile lacks it. The profile with the least sum wins.

N-grams are taken within words, a word being a stretch of letters in lower case with a blank at either
end. Three code points of 21 bits fit a 64-bit integer, so n-grams are exact integers whose order is that
of their code points, and counting is sorting.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, lean, with_fields

#: N-grams of a profile and at most of a text.
RANKS = 300
#: Profiles are broadcast: RANKS x 12 bytes each. More languages than this are refused rather than held.
LANGUAGES = 10_000
#: Characters that a batch takes, about; a longer text is a batch of its own.
BATCH_CHARS = 1 << 20
UNKNOWN = "und"
BLANK = 0x20


@cache
def _letters() -> np.ndarray:
    """For each code point its lower case, or a blank if it isn't a letter."""
    out = np.full(0x110000, BLANK, "u4")
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts in order, and where each text's begin and end."""
    raw = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    x = _letters()[raw]
    blank = x == BLANK
    kept = np.concatenate([[True], ~(blank[1:] & blank[:-1])])
    ends = np.cumsum([1, *[len(t) + 1 for t in texts]])
    x, blank = x[kept].astype("u8"), blank[kept]
    at = np.flatnonzero(~blank)
    # Each letter holds one n-gram of each length that ends at it or has it in its middle, and one more at a word's end.
    here, before, after = x[at] << np.uint64(42), x[at - 1], x[at + 1]
    last = blank[at + 1]
    width = 3 + last.astype("i8")
    stop = np.cumsum(width)
    out = np.empty(int(stop[-1]) if len(stop) else 0, "u8")
    first = stop - width
    out[first] = here
    out[first + 1] = before << np.uint64(42) | x[at] << np.uint64(21)
    out[first + 2] = before << np.uint64(42) | x[at] << np.uint64(21) | after
    out[first[last] + 3] = here[last] | np.uint64(BLANK << 21)
    letters = np.searchsorted(at, np.cumsum(kept)[ends - 1])  # letters before each text's end in the squeezed stream
    return out, np.concatenate([[0], stop])[letters]


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, with how often each occurs."""
    x = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, "i8")
    return x[at], np.diff(np.append(at, len(x)))


def top(codes: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equally frequent ones ascend."""
    u, n = counted(codes)
    return u[np.argsort(-n, kind="stable")[:ranks]]


@dataclass
class Profiles:
    """N-grams of all profiles, ascending, and each language's rank of them, or ``ranks`` where it lacks one."""

    languages: list[str]
    codes: np.ndarray
    rank: np.ndarray
    ranks: int

    @classmethod
    def of(cls, ranked: list[tuple[str, int, int]], ranks: int) -> Profiles:
        """From (language, n-gram, rank from 0)."""
        languages = sorted({r[0] for r in ranked}, key=str.encode)
        codes = np.unique(np.array([r[1] for r in ranked], "u8"))
        rank = np.full((len(languages), len(codes) + 1), ranks, "i4")
        number = {x: i for i, x in enumerate(languages)}
        for language, code, r in ranked:
            rank[number[language], np.searchsorted(codes, np.uint64(code))] = r
        return cls(languages, codes, rank, ranks)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """For each text the nearest language (of equally near ones the first in byte order), and 1 - its distance / the greatest possible."""
        codes, cuts = grams(texts)
        tops = [top(codes[a:b], self.ranks) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(tops) if len(t)]
        if not some or not self.languages:
            return named, score
        sizes = np.array([len(tops[i]) for i in some])
        first = np.cumsum(sizes) - sizes
        own = np.concatenate([tops[i] for i in some])
        place = np.arange(len(own)) - np.repeat(first, sizes)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at[self.codes[at] != own] = len(self.codes)
        best, winner = np.full(len(some), np.iinfo("i8").max), np.zeros(len(some), "i8")
        for k, rank in enumerate(self.rank):
            r = rank[at]
            far = np.add.reduceat(np.where(r < self.ranks, np.abs(r - place), self.ranks).astype("i8"), first)
            less = far < best
            best[less], winner[less] = far[less], k
        score[some] = 1.0 - best / (self.ranks * sizes)
        for i, k in zip(some, winner.tolist(), strict=True):
            named[i] = self.languages[k]
        return named, score


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id's digits leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, ranks: int = RANKS) -> Profiles:
    """Profiles of every non-null ``lang`` of ``docs(lang, text)``: n-grams are counted in tasks and summed by key, and only the ranked ones are collected.

    Null texts and texts without letters add nothing, but their language, if it has nothing else, has no profile
    and can't be predicted. Repeated rows count each time.
    Equally frequent n-grams rank in the order of their code points. An empty table gives no profile.
    """

    def count(it):
        for batch in it:
            rows = zip(batch.column("lang").to_pylist(), (x.as_py() for x in batch.column("text")), strict=True)
            for some in batches(rows, BATCH_CHARS, lambda r: len(r[1]) + 64):
                some.sort(key=lambda r: r[0])
                codes, cuts = grams([t for _, t in some])
                names = [r[0] for r in some]
                edge = [i for i in range(len(some)) if i == 0 or names[i] != names[i - 1]]
                for a, b in zip(edge, [*edge[1:], len(some)], strict=True):
                    u, n = counted(codes[cuts[a] : cuts[b]])
                    yield pa.record_batch([pa.array([names[a]] * len(u), pa.string()), pa.array(u.astype("i8")), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    sums = rows.mapInArrow(lean(count), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    ranked = sums.withColumn("place", place).where(F.col("place") <= ranks).select("lang", "code", (F.col("place") - 1).alias("place"))
    found = ranked.limit(LANGUAGES * ranks + 1).collect()
    if len(found) > LANGUAGES * ranks:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    return Profiles.of([tuple(r) for r in found], ranks)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the other columns of every row.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if there is no profile. A text none of whose
    n-grams any profile has gets the first language with score 0. Equal rows give equal rows, an empty table an empty one. Each
    row is judged by itself: nothing is shuffled. Columns called ``lang_pred`` or ``score`` beside the text are refused.
    """
    rest = [c for c in docs.columns if c != text]
    if clash := {"lang_pred", "score"} & set(rest):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")
    fields = with_fields(docs.select(*[docs[c] for c in rest]), "lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(it):
        for batch in it:
            begin = 0
            for some in batches((x.as_py() or "" for x in batch.column(text)), BATCH_CHARS, lambda x: len(x) + 64):
                named, score = shared.value.judge(some)
                kept = [batch.column(c).slice(begin, len(some)) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(named, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])
                begin += len(some)

    return docs.mapInArrow(lean(work), fields)


#: The crc32 of an id's digits in SQL: a table made by its rule, then a fold over the digits.
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
_CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ord(y)::BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"

PREDICT_SQL = f"""
WITH {_CRC},
d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce({_CRC_OF} % 4 = 2, false) AS held_out,
         ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\pL]+', ' ', 'g')) || ' ' AS x
  FROM documents, crc),
l AS (SELECT r, x, unnest(range(1, length(x) + 1)) AS i FROM d WHERE length(x) > 2),
g AS (
  SELECT r, x[i] AS gram FROM l WHERE x[i] <> ' '
  UNION ALL SELECT r, x[i:i + 1] FROM l WHERE i < length(x)
  UNION ALL SELECT r, x[i:i + 2] FROM l WHERE i < length(x) - 1 AND x[i + 1] <> ' '),
n AS (SELECT r, gram, count(*) AS n FROM g GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, gram) - 1 AS place FROM n QUALIFY place < {RANKS}),
learnt AS (SELECT lang, gram, sum(n.n) AS n FROM n JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
profile AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS place FROM learnt QUALIFY place < {RANKS}),
size AS (SELECT r, count(*) AS m FROM own GROUP BY r),
met AS (
  SELECT r, p.lang, sum({RANKS} - abs(own.place - p.place)) AS saved FROM own JOIN profile p USING (gram) GROUP BY ALL),
far AS (
  SELECT r, m, k.lang, {RANKS} * m - coalesce(saved, 0) AS far
  FROM size CROSS JOIN (SELECT DISTINCT lang FROM profile) k LEFT JOIN met USING (r, lang)),
best AS (SELECT r, m, lang, far FROM far QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, '{UNKNOWN}') AS lang_pred, coalesce(1.0::DOUBLE - far::DOUBLE / ({RANKS} * m)::DOUBLE, 0.0::DOUBLE) AS score
FROM d LEFT JOIN best USING (r)
"""
