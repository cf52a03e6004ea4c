"""Collision-free names: the first free of name, name-1, name-2, ... in order, directory by directory."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .numbering import numbered, ranked

ATTEMPTS = 10_000


def candidate(name: str, attempt: int) -> str:
    if attempt == 0:
        return name
    at = name.rfind(".")
    return f"{name[:at]}-{attempt}{name[at:]}" if at > 0 else f"{name}-{attempt}"


def claim(names: list[str], taken: set[str], most: int = ATTEMPTS) -> list[str]:
    """The names in order, each as the first candidate that is free; after ``most`` the name itself, unclaimed."""
    out, tried = [], {}
    for name in names:
        for k in range(tried.get(name, 0), most):
            if (c := candidate(name, k)) not in taken:
                taken.add(c)
                tried[name] = k + 1
                out.append(c)
                break
        else:
            out.append(name)
    return out


def _split(name: Column) -> tuple[Column, Column]:
    """A name before the number that candidates put to it, and after."""
    split = r"(?s)^(.+)(\.[^.]*)\z"
    whole = name.rlike(split)
    return F.when(whole, F.regexp_extract(name, split, 1)).otherwise(name), F.when(whole, F.regexp_extract(name, split, 2)).otherwise("")


def candidate_column(name: Column, attempt: Column) -> Column:
    """``candidate`` as an expression."""
    stem, ext = _split(name)
    return F.when(attempt == 0, name).otherwise(F.concat(stem, F.lit("-"), attempt.cast("string"), ext))


def _number(most: int | None) -> str:
    """Numbers that candidates can have: no zero before them, as many digits as ``most`` calls for, or a 64-bit integer holds."""
    return f"-[1-9][0-9]{{0,{17 if most is None else max(3, len(str(most - 1)) - 1)}}}"


def family(name: Column, most: int | None = ATTEMPTS) -> Column:
    """The name without any numbers that candidates could have put to it: a name's candidates are of its own family."""
    stem, ext = _split(name)
    return F.concat(F.regexp_replace(stem, rf"(?s)^(.+?)(?:{_number(most)})+\z", "$1"), ext)


def parent(name: Column, most: int | None = ATTEMPTS) -> Column:
    """(name, attempt) of which this name is a candidate; null if it is none's."""
    stem, ext = _split(name)
    parts = rf"(?s)^(.+)({_number(most)})\z"
    made = F.struct(F.concat(F.regexp_extract(stem, parts, 1), ext).alias("name"), (-F.regexp_extract(stem, parts, 2).try_cast("long")).alias("attempt"))
    return F.when(stem.rlike(parts), made)


def _held(existing: DataFrame | None, names: DataFrame, most: int | None) -> DataFrame | None:
    """(directory, name, attempt) of the candidates of ``names(directory, name)`` that exist."""
    if existing is None:
        return None
    own = existing.select("directory", "name", F.lit(0).cast("long").alias("attempt"))
    above = existing.select("directory", parent(F.col("name"), most).alias("x")).where("x is not null").select("directory", "x.name", "x.attempt")
    return own.union(above).join(names.select("directory", "name"), ["directory", "name"], "left_semi").distinct()


def contest(events: list[tuple[str, int, int, str | None]]) -> list[tuple[str, int]]:
    """(name, attempt) that a name's rows find taken, of (name, attempt, rows of the name before, who has it else).

    An attempt of a name is another planned name, or one that exists (no rows before, nobody). Row n of a name with b
    attempts taken tries attempt n + b; so attempt k is tried by row k - b, and the other name's first row came before it
    if no more than k - b rows did. If not, the attempt goes to this name, and the other one finds its own first candidate taken.
    """
    of: dict[str, dict[int, tuple[int, str | None]]] = {}
    for name, k, before, other in events:
        now = of.setdefault(name, {})
        if k not in now or other is None:  # what exists is nobody's
            now[k] = before, other
    out, lost = [], set()
    for name in sorted(of, key=len):  # a candidate is longer than its name
        taken = 0
        if name in lost:
            of[name][0] = 0, None
        for k, (before, other) in sorted(of[name].items()):
            if other is None or k - taken >= before:
                out.append((name, k))
                taken += 1
            else:
                lost.add(other)
    return out + [(name, 0) for name in lost if name not in of]


def _decided(places: DataFrame, order: list[str], held: DataFrame | None, met: DataFrame, most: int | None) -> DataFrame:
    """(directory, name, attempt) that are taken where planned names are candidates of planned names, ``met(directory, name, child, attempt)``.

    How many rows of a name come before another's first row follows from ranks over both. What is then left to decide one after the
    other is a row of four narrow cells for each such pair, and each existing candidate, of a family of a directory.
    """
    turn = [f"_o{i}" for i in range(len(order))]
    turns = [F.col(c).alias(t) for c, t in zip(order, turn, strict=True)]
    child, none = met.select("directory", F.col("child").alias("name"), F.col("name").alias("_parent"), "attempt"), F.lit(None)
    first = places.where("_n = 0").join(child, ["directory", "name"]).select("directory", F.col("_parent").alias("name"), *turns, "attempt", F.col("name").alias("child"), F.lit(0).alias("_row"))
    rows = places.join(met.select("directory", "name").distinct(), ["directory", "name"], "left_semi").select("directory", "name", *turns, none.cast("long").alias("attempt"), none.cast("string").alias("child"), F.lit(1).alias("_row"))
    both = ranked(first.union(rows), ["directory", "name"], [*turn, "_row", "attempt"], "_at").where("_row = 0")
    both = ranked(both, ["directory", "name"], ["_at"], "_nth")
    events = both.select("directory", "name", "attempt", (F.col("_at") - F.col("_nth")).alias("before"), "child")
    events = events.withColumn("family", family(F.col("name"), most))
    if held is not None:
        there = held.withColumn("family", family(F.col("name"), most)).join(events.select("directory", "family").distinct(), ["directory", "family"], "left_semi")
        events = events.unionByName(there.select("directory", "name", "attempt", F.lit(0).cast("long").alias("before"), none.cast("string").alias("child"), "family"))

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [pdf[c].tolist() for c in ("name", "attempt", "before", "child")]
        cells[3] = [c if isinstance(c, str) else None for c in cells[3]]
        out = pd.DataFrame(contest(list(zip(*cells, strict=True))), columns=["name", "attempt"])
        return out.assign(directory=key[0])[["directory", "name", "attempt"]]

    found = events.groupBy("directory", "family").applyInPandas(settle, "directory string, name string, attempt long")
    if held is None:
        return found
    settled = events.select("directory", "family").distinct()
    rest = held.withColumn("family", family(F.col("name"), most)).join(settled, ["directory", "family"], "left_anti")
    return found.union(rest.select("directory", "name", "attempt"))


def assign(planned: DataFrame, order: list[str], existing: DataFrame | None = None, bounded: bool = True) -> DataFrame:
    """Adds ``final_name`` to ``planned(directory, name)``; ``existing(directory, name)`` is what the directories hold already.

    Rows of one name claim its candidates, and those of another name claim them too only if that name is itself a candidate, as
    ``a-1.jpg`` is of ``a.jpg``, and both are planned. The n-th row of a name by ``order`` has the n-th candidate that
    isn't taken: places are counted in pieces of a range exchange, so a name that a third of all rows have is no single task,
    and the candidate is the place among rows and taken candidates together. Which of two names gets a candidate of both is decided
    family by family of a directory, over pairs of names and not over rows. Rows that find no candidate in ATTEMPTS keep their
    name, unless ``bounded`` is false: then every row gets one.
    """
    most = ATTEMPTS if bounded else None
    places = cut(ranked(planned, ["directory", "name"], order, "_n"))
    names = places.where("_n = 0").select("directory", "name")
    below = names.select("directory", F.col("name").alias("child"), parent(F.col("name"), most).alias("x")).where("x is not null").select("directory", F.col("x.name").alias("name"), "child", "x.attempt")
    met = cut(below.join(names, ["directory", "name"], "left_semi"))
    held = _held(existing, names, most)
    if not met.isEmpty():
        held = _decided(places, order, None if held is None else cut(held), met, most)
    attempt = F.col("_n")
    if held is None:
        placed = places
    else:
        # The i-th taken attempt a comes after a - i free ones: the place of a row among both is its attempt.
        taken = cut(ranked(held, ["directory", "name"], ["attempt"], "_i").select("directory", "name", (F.col("attempt") - F.col("_i")).alias("_key"), F.lit(0).alias("_row")))
        marked = places.join(taken.select("directory", "name").distinct().withColumn("_some", F.lit(True)), ["directory", "name"], "left").select(*places.columns, "_some")
        own = marked.where("_some").drop("_some").withColumn("_key", F.col("_n")).withColumn("_row", F.lit(1))
        both = ranked(own.unionByName(taken, allowMissingColumns=True), ["directory", "name"], ["_key", "_row"], "_at").where("_row = 1")
        placed = both.drop("_key", "_row", "_n").withColumnRenamed("_at", "_n").select(places.columns).union(marked.where("_some is null").drop("_some"))
    free = candidate_column(F.col("name"), attempt)
    final = free if most is None else F.when(attempt < most, free).otherwise(F.col("name"))
    return placed.withColumn("final_name", final).select(*planned.columns, "final_name")


def chunks(planned: DataFrame, order: list, size: int, bucket: Column) -> DataFrame:
    """Numbers rows into chunks of ``size`` by ``order``; 0 is one chunk. ``bucket`` follows the order, as ``numbered`` needs it."""
    if not size:
        return planned.withColumn("chunk", F.lit(0).cast("long"))
    return numbered(planned, order, bucket, "_row").withColumn("chunk", F.floor(F.col("_row") / size).cast("long")).drop("_row")
