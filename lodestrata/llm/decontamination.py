"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` consecutive word ``GRAM``-grams the least hash is selected, on both sides, and
the selected positions are joined: a passage of n words has about 2n/7 of them. Two texts that share
``WINDOW`` words share all the grams in them and so a selected one. Each pair of positions is extended to the
left and the right on the words themselves, and a stretch of ``WINDOW`` words or more is a hit: no shared window
is missed, and none is taken for one by its hash alone.

Documents move the stretches of words around their selected positions, once, and only where a filter of the
benchmark's windows lets one pass. Items that hold a gram in the same surroundings are joined as one; which items
a hit belongs to is found at the end, once for each set of stretches that documents hit.
Items shorter than a window are looked for whole, with every gram of their length kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, with_fields, Scratch
from .token_store import _rows

WINDOW, GRAM = 10, 5
#: Slots of the fixed-size filter of benchmark fingerprints that every task gets: 2 MB at any size.
SLOTS = 1 << 24
_M = np.uint64(0x9E3779B97F4A7C15)
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII, with A-Z in lower case."""
    return text.encode().translate(_KEEP).split() if text else []


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words with the hashes ``h``; n is part of it."""
    if len(h) < n:
        return np.zeros(0, "u8")
    out = np.full(len(h) - n + 1, n, "u8")
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * _M
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, span: int = WINDOW - GRAM + 1) -> np.ndarray:
    """The places of the least hash of each run of ``span``, the last of equal ones, ascending and each once."""
    n = len(hashes)
    if n < span:
        return np.zeros(0, "i8")
    at, width = np.arange(n), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[left] < hashes[right], left, right)
        width += step
    return np.unique(at)


def _beside(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the three words before and after the grams at ``at``, 0 where there are fewer: of a shared window one of them is shared."""
    three = grams(h, 3)
    if not len(three):
        return np.zeros(len(at), "u8"), np.zeros(len(at), "u8")
    before, after = at - 3, at + GRAM
    return np.where(before >= 0, three[np.maximum(before, 0)], 0).astype("u8"), np.where(after < len(three), three[np.minimum(after, len(three) - 1)], 0).astype("u8")


SEED = "struct<pos:int,n:int,h:long,l:long,r:long>"
_SEEDS = pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("l", pa.int64()), ("r", pa.int64())]))


def seeds(h: np.ndarray, lengths: Iterable[int], known=None) -> list[dict]:
    """Selected grams of words with the hashes ``h``, and every gram of the short ``lengths``; with ``known``, only those where a window passes it."""
    g = grams(h, GRAM)
    at = winnow(g)
    if known is not None and len(at):
        passed = np.flatnonzero(known(grams(h, WINDOW)))
        first = np.searchsorted(passed, at - (WINDOW - GRAM))
        at = at[(first < len(passed)) & (passed[np.minimum(first, max(len(passed) - 1, 0))] <= at)] if len(passed) else at[:0]
    left, right = _beside(h, at)
    out = [{"pos": i, "n": GRAM, "h": x, "l": l, "r": r} for i, x, l, r in zip(at.tolist(), g[at].view("i8").tolist(), left.view("i8").tolist(), right.view("i8").tolist(), strict=True)]
    for n in lengths:
        g = grams(h, n)
        at = np.arange(len(g)) if known is None else np.flatnonzero(known(g))
        out += [{"pos": i, "n": -n, "h": x, "l": 0, "r": 0} for i, x in zip(at.tolist(), g[at].view("i8").tolist(), strict=True)]
    return out


def slices(words: list[bytes], found: list[dict]) -> list[dict]:
    """The stretches of words around seeds that a window through one of them can reach, with their seeds; each word is in one stretch at most."""
    reach = WINDOW - GRAM
    out: list[dict] = []
    spans = [(max(s["pos"] - reach, 0), min(s["pos"] + GRAM + reach, len(words)), s) if s["n"] > 0 else (s["pos"], s["pos"] - s["n"], s) for s in found]
    for a, b, s in sorted(spans, key=lambda x: x[0]):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
            out[-1]["seeds"].append(s)
        else:
            out.append({"at": a, "end": b, "seeds": [s]})
    for x in out:
        end = x.pop("end")
        x["text"] = b" ".join(words[x["at"] : end]).decode()
        x["seeds"] = [{**s, "pos": s["pos"] - x["at"]} for s in x["seeds"]]
    return out


def extend(mine: list[str], theirs: list[str], pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in mine, start in theirs, length) of the equal stretches through pairs of places, at least a window or the whole of ``theirs``; each once."""
    out, done = [], {}
    for i, j in sorted(pairs):
        if done.get(i - j, -1) > i:  # inside a stretch that is known already
            continue
        a = 0
        while i > a and j > a and mine[i - a - 1] == theirs[j - a - 1]:
            a += 1
        b = 0
        while i + b < len(mine) and j + b < len(theirs) and mine[i + b] == theirs[j + b]:
            b += 1
        done[i - j] = i + b
        if a + b >= min(WINDOW, len(theirs)):
            out.append((i - a, j - a, a + b))
    return out


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def scan(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """(``keep``, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs(text)`` against ``benchmark(item_id, text)``.

    Null and wordless texts have no words and no windows. Equal benchmark rows count once; an item
    without an id marks words but isn't listed. Joins are ordinary ones of plain tables, which Spark splits where a
    passage is in many documents, so the benchmark may be of any size. Columns to keep mustn't be called like those added here.
    """
    spark = docs.sparkSession
    if clash := {"n_words", "n_hit", "n_items", "items_sha256", "contaminated", "__ls_rid"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them first")

    def number(it):
        at, part = 0, TaskContext.get().partitionId()
        for b in it:
            words = [item_words(t) for t in b.column("text").to_pylist()]
            tid = (part << 33) + at + np.arange(len(words))
            at += len(words)
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(tid), pa.array([b" ".join(w).decode() for w in words]), pa.array([len(w) for w in words], pa.int32())], names=["text", "tid", "words", "n"])

    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = scratch.write(given.select("text").distinct().mapInArrow(lean(number), "text string, tid long, words string, n int").where("n > 0"))
    owners = scratch.write(given.where("item_id is not null").join(items.select("text", "tid"), "text").select("tid", F.col("item_id").cast("string").alias("item_id")).distinct())
    lengths = sorted(r.n for r in items.select("n").where(F.col("n") < WINDOW).distinct().collect())  # at most nine

    def prints(it):
        for tid, text in _rows(it, "tid", "words"):
            words = text.encode().split()
            h, own = hashes(words), len(words)
            found = seeds(h, [own] if own < WINDOW else [])
            around = [b" ".join(words[max(s["pos"] - WINDOW + GRAM, 0) : s["pos"]]) + b"|" + b" ".join(words[s["pos"] : s["pos"] + WINDOW]) for s in found]
            cells = [[s[k] for s in found] for k in ("h", "n", "l", "r", "pos")]
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in cells], pa.array([tid] * len(found), pa.int64()), pa.array(around, pa.binary())], names=["h", "n", "l", "r", "pos", "tid", "around"])

    def windows_of(it):
        for tid, text in _rows(it, "tid", "words"):
            words = text.encode().split()
            n = min(WINDOW, len(words))
            g = grams(hashes(words), n).view("i8")
            yield pa.record_batch([pa.array([tid] * len(g), pa.int64()), pa.array(np.arange(len(g))), pa.array(g), pa.array([b" ".join(words[i : i + n]) for i in range(len(g))], pa.binary())], names=["tid", "at", "h", "w"])

    windows = scratch.write(items.select("tid", "words").mapInArrow(lean(windows_of), "tid long, at long, h long, w binary"))
    same = scratch.write(windows.select("w", "tid", "at").join(windows.groupBy("w").agg(F.min(F.struct("tid", "at")).alias("wid")), "w").select("tid", "at", "wid"))
    places = items.select("tid", "words").mapInArrow(lean(prints), "h long, n long, l long, r long, pos long, tid long, around binary")
    places = scratch.write(places.groupBy("h", "n", "l", "r", "around").agg(F.min(F.struct("tid", "pos")).alias("x")).select("h", "n", F.col("l").alias("il"), F.col("r").alias("ir"), "x.tid", F.col("x.pos").alias("ipos")))
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
    one = F.expr(f"shiftleft(1L, cast(h & {SLOTS - 1} & 63 as int))")
    filled = windows.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(one).alias("v")).collect()  # at most SLOTS / 64 rows
    bits = np.zeros(SLOTS // 64, "i8")
    bits[[r.w for r in filled]] = [r.v for r in filled]
    shared = spark.sparkContext.broadcast(bits.view("u8"))

    def pick(it):
        at, part = 0, TaskContext.get().partitionId()
        table = shared.value

        def known(g: np.ndarray) -> np.ndarray:
            s = g & np.uint64(SLOTS - 1)
            return table[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1)

        for b in it:
            sizes, met = [], []
            for t in b.column("text").to_pylist():
                words = item_words(t)
                sizes.append(len(words))
                met.append(slices(words, seeds(hashes(words), lengths, known)))
            rid = (part << 33) + at + np.arange(len(sizes))
            at += len(sizes)
            kind = pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string()), ("seeds", _SEEDS)]))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(rid, pa.int64()), pa.array(sizes, pa.int64()), pa.array(met, kind)], names=[*keep, "__ls_rid", "n_words", "met"])

    schema = with_fields(docs.select(*keep), f"__ls_rid long, n_words long, met array<struct<at:int,text:string,seeds:array<{SEED}>>>")
    rows = scratch.write(docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(pick), schema))

    parts = rows.select("__ls_rid", F.explode("met").alias("m"))
    sown = parts.select("__ls_rid", F.col("m.at").alias("at"), F.explode("m.seeds").alias("s")).select("__ls_rid", "at", "s.*")
    near = (F.col("n") < 0) | ((F.col("l") == F.col("il")) & (F.col("l") != 0)) | ((F.col("r") == F.col("ir")) & (F.col("r") != 0))
    met = sown.join(places, ["h", "n"]).where(near).groupBy("__ls_rid", "at", "tid").agg(F.collect_set(F.struct("pos", "ipos")).alias("pairs"))
    both = scratch.write(met).join(items.select("tid", "words"), "tid").join(parts.select("__ls_rid", F.col("m.at").alias("at"), F.col("m.text").alias("mine")), ["__ls_rid", "at"])

    def stretch(it):
        for rid, at, tid, mine, theirs, pairs in _rows(it, "__ls_rid", "at", "tid", "mine", "words", "pairs"):
            got = extend(mine.split(" "), theirs.split(" "), [(p["pos"], p["ipos"]) for p in pairs])
            if got:
                cells = zip(*got, strict=True)
                start, a, n = (np.array(c, "i8") for c in cells)
                yield pa.record_batch([pa.array([rid] * len(got), pa.int64()), pa.array([tid] * len(got), pa.int64()), pa.array(at + start), pa.array(a), pa.array(n)], names=["__ls_rid", "tid", "start", "a", "n"])

    hits = both.select("__ls_rid", "at", "tid", "mine", "words", "pairs").mapInArrow(lean(stretch), "__ls_rid long, tid long, start long, a long, n long")
    # Of stretches in the order of their starts: the words up to ``stop`` are counted in ``n``.
    nothing = F.struct(F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "n"))), nothing, lambda a, x: F.struct(F.greatest(a.stop, x["start"] + x["n"]).alias("stop"), (a["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(a.stop, x["start"]))).alias("n")))
    by_row = hits.groupBy("__ls_rid").agg(covered["n"].alias("n_hit"), F.array_sort(F.collect_set(F.struct("tid", "a", "n"))).alias("hit"))
    by_row = scratch.write(by_row.withColumn("sid", F.sha2(F.to_json("hit"), 256)))
    sets = by_row.groupBy("sid").agg(F.first("hit").alias("hit")).select("sid", F.explode("hit").alias("x")).select("sid", "x.*")
    starts = sets.select("sid", "tid", F.explode(F.sequence("a", F.greatest("a", F.col("a") + F.col("n") - WINDOW))).alias("at"))
    wids = starts.join(same, ["tid", "at"]).select("sid", "wid").distinct()
    ids = scratch.write(wids).join(same.select("wid", "tid").distinct(), "wid").select("sid", "tid").distinct().join(owners, "tid").groupBy("sid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    listed = scratch.write(ids.select("sid", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")))
    out = rows.select(*keep, "__ls_rid", "n_words").join(by_row.select("__ls_rid", "n_hit", "sid").join(listed, "sid", "left"), "__ls_rid", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(*keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` without a hit; a verdict hangs on the text alone, so rows go by their text's hash."""
    found = scan(docs.select("text"), benchmark, scratch, "text").where("contaminated").select(F.xxhash64("text").alias("__ls_th"), F.length("text").alias("__ls_n")).distinct()
    mine = docs.withColumns({"__ls_th": F.xxhash64("text"), "__ls_n": F.length("text")})
    return mine.join(found, ["__ls_th", "__ls_n"], "left_anti").select(*docs.columns)
