"""Coordinates and the nearest place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kdtree import KdTree


def valid(lat: Column, lon: Column) -> Column:
    """Finite and within 90 and 180 degrees, ends included."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def iso6709(text: Column) -> Column:
    """struct(lat, lon) of +lat+lon[+alt]/, null fields unless both are valid; altitude is ignored."""
    lat, lon = (F.regexp_extract(text, r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)(?:[+-]|/|$)", g).try_cast("double") for g in (1, 2))
    ok = valid(lat, lon)
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))


#: Side of a cell in degrees, which divides 180; there are 4,050 cells.
CELL = 4.0
#: Points of a task, about, and places that are held against all cells at a time.
TASK, BATCH = 100_000, 4096


def _cell(lat: Column, lon: Column) -> Column:
    """Number of a point's cell, row by row from the south; the poles and the antimeridian are in their last cells."""
    rows, columns = round(180 / CELL), round(360 / CELL)
    row = F.least(F.floor((lat + 90) / CELL), F.lit(rows - 1))
    return (row * columns + F.least(F.floor((lon + 180) / CELL), F.lit(columns - 1))).cast("int")


def on_sphere(lat, lon) -> np.ndarray:
    """Points on the unit sphere; their straight distances order as the great circle does."""
    a, b = np.radians(np.asarray(lat, "f8")), np.radians(np.asarray(lon, "f8"))
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _centres(cells: np.ndarray) -> np.ndarray:
    columns = round(360 / CELL)
    return on_sphere((cells // columns + 0.5) * CELL - 90, (cells % columns + 0.5) * CELL - 180)


def _batches(it):
    """(batch, places on the sphere) of at most BATCH places."""
    for b in it:
        for k in range(0, b.num_rows, BATCH):
            some = b.slice(k, BATCH)
            yield some, on_sphere(some.column("lat"), some.column("lon"))


def nearest(points: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, place, country) of the nearest of ``places(name, country, lat, lon)`` for each point with valid (lat, lon).

    Points go to their cell, once, and meet there a k-d tree of the places that can be nearest to any point of the
    cell: if the place nearest to its centre is d away and its corners r, those within d + 2r of the centre. Only cells that
    hold points are looked at; cells with many are dealt to several tasks. What the driver sees is a row a cell at most.
    Ties go to the first by name, then country. Points that are invalid, or any if there is no place, have none.
    """
    fine = valid(F.col("lat"), F.col("lon"))
    at = points.where(fine).select(key, "lat", "lon").withColumn("_cell", _cell(F.col("lat"), F.col("lon")))
    held = {r._cell: r.n for r in at.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # at most 4,050 rows
    cells = np.array(sorted(held), "i8")
    known = places.where(valid(F.col("lat"), F.col("lon"))).select("name", "country", "lat", "lon")
    centres, reach = _centres(cells), np.radians(CELL * 0.70711)

    def closest(it):
        best = np.full(len(cells), np.inf)
        for _, x in _batches(it):
            best = np.minimum(best, 2 - 2 * (x @ centres.T).max(axis=0))
        some = np.flatnonzero(np.isfinite(best))
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(best[some])], names=["i", "d"])

    near = np.full(len(cells), np.inf)
    for r in known.select("lat", "lon").mapInArrow(closest, "i int, d double").groupBy("i").agg(F.min("d").alias("d")).collect():
        near[r.i] = r.d
    # A squared distance by a product of unit vectors is off by some 1e-15; 1e-6 is 6 metres more than is needed.
    limit = 1 - (np.sqrt(np.maximum(near, 0)) + 2 * reach + 1e-6) ** 2 / 2
    parts = np.array([-(-held[c] // TASK) for c in cells.tolist()], "i4")

    def meet(it):
        for b, x in _batches(it):
            row, i = np.nonzero(x @ centres.T >= limit)
            n = parts[i]
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, row = np.repeat(i, n), np.repeat(row, n)
            own = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cells[i], pa.int32()), pa.array(part, pa.int32()), *own.columns], names=["_cell", "_part", *own.schema.names])

    sent = known.mapInArrow(meet, "_cell int, _part int, name string, country string, lat double, lon double")
    many = F.create_map(*[F.lit(x) for c, n in held.items() if n > TASK for x in (int(c), -(-n // TASK))]) if any(n > TASK for n in held.values()) else None
    salt = F.pmod(F.xxhash64(key, "lat", "lon"), F.coalesce(many[F.col("_cell")], F.lit(1))) if many is not None else F.lit(0)
    kind = f"`{key}` {points.schema[key].dataType.simpleString()}, place string, country string"

    def look(own: pa.Table, there: pa.Table) -> pa.Table:
        names = [key, "place", "country"]
        if not there.num_rows or not own.num_rows:
            nothing = pa.nulls(own.num_rows, pa.string())
            return pa.table([own.column(key), nothing, nothing], names=names)
        there = there.sort_by([("name", "ascending"), ("country", "ascending")])
        spots, back = np.unique(np.stack([own.column("lat").to_numpy(), own.column("lon").to_numpy()], axis=1), axis=0, return_inverse=True)
        found = KdTree(on_sphere(there.column("lat"), there.column("lon"))).nearest(on_sphere(spots[:, 0], spots[:, 1]))
        chosen = there.take(pa.array(found[back.reshape(-1)]))
        return pa.table([own.column(key), chosen.column("name"), chosen.column("country")], names=names)

    dealt = at.withColumn("_part", salt.cast("int")).groupBy("_cell", "_part").cogroup(sent.groupBy("_cell", "_part")).applyInArrow(look, kind)
    none = points.where(~fine).select(key, F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("country"))
    return dealt.union(none)
