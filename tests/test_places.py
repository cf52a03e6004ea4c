import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import geo, kdtree
from lodestrata.sources import gazetteer


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(0, 50), st.sampled_from([1, 3, 32]))
def test_tree_is_the_brute_force(seed, n, m, leaf):
    """Ties included: points of a coarse grid, the least number wins."""
    rng = np.random.default_rng(seed)
    points, queries = rng.integers(0, 5, (n, 3)).astype("f8"), rng.integers(0, 5, (m, 3)) + rng.choice([0, 0.5], (m, 3))
    before, kdtree.LEAF, kdtree.QUERIES = (kdtree.LEAF, kdtree.QUERIES), leaf, 7
    try:
        got = kdtree.KdTree(points).nearest(queries)
    finally:
        kdtree.LEAF, kdtree.QUERIES = before
    d = ((queries[:, None] - points[None]) ** 2).sum(axis=2)
    assert got.tolist() == (d.argmin(axis=1).tolist() if m else [])


def made_up(n, seed):
    """Places in clusters and on their own, at both meridians and both poles."""
    rng = np.random.default_rng(seed)
    lat = np.concatenate([np.degrees(np.arcsin(rng.uniform(-1, 1, n // 2))), 48 + rng.normal(0, 3, n - n // 2)])
    lon = np.concatenate([rng.uniform(-180, 180, n // 2), 8 + rng.normal(0, 5, n - n // 2)])
    lat[:6], lon[:6] = [90, -90, 0, 0, 10, 89.99], [0, 0, 180, -180, 0, 179.99]
    return lat, lon


def far(lat, lon, p_lat, p_lon):
    return ((geo.on_sphere(lat, lon)[:, None] - geo.on_sphere(p_lat, p_lon)[None]) ** 2).sum(axis=2)


@pytest.mark.parametrize("task", [100_000, 5])
def test_a_million_places(spark, monkeypatch, task):
    monkeypatch.setattr(geo, "TASK", task)
    p_lat, p_lon = made_up(1_000_000, 1)
    places = spark.createDataFrame(pa.table({"name": pa.array(np.arange(len(p_lat)).astype(str)), "country": pa.array(["x"] * len(p_lat)), "lat": p_lat, "lon": p_lon})).repartition(4)
    lat, lon = made_up(200, 2)
    lat, lon = np.concatenate([lat, np.full(30, 48.123), [0, 0, 89.9, -89.9, 1]]), np.concatenate([lon, 8 + np.arange(30) / 1000, [179.999, -179.999, 10, -170, -0.0]])
    rows = [*zip(range(len(lat)), lat.tolist(), lon.tolist(), strict=True), (9000, None, 1.0), (9001, 91.0, 0.0), (9002, float("nan"), 0.0)]
    got = {r.k: r.place for r in geo.nearest(spark.createDataFrame(rows, "k long, lat double, lon double"), places, "k").collect()}
    assert len(got) == len(rows) and [got[k] for k in (9000, 9001, 9002)] == [None] * 3
    for k in range(0, len(lat), 25):
        d = far(lat[k : k + 25], lon[k : k + 25], p_lat, p_lon)
        for i, row in enumerate(d):
            assert row[int(got[k + i])] <= row.min() * (1 + 1e-9) + 1e-30


def test_few_and_no_places(spark):
    points = spark.createDataFrame([(i, lat, lon) for i, (lat, lon) in enumerate([(0.0, 0.0), (0.0, -179.0), (-90.0, 5.0), (1.0, 1.0)])], "k int, lat double, lon double")
    one = spark.createDataFrame([("b", "y", 10.0, 179.0), ("a", "z", 10.0, 179.0), ("a", "x", 10.0, 179.0), ("bad", "x", 99.0, 0.0)], "name string, country string, lat double, lon double")
    assert {(r.place, r.country) for r in geo.nearest(points, one, "k").collect()} == {("a", "x")}
    assert {(r.place, r.country) for r in geo.nearest(points, one.where("false"), "k").collect()} == {(None, None)}
    assert geo.nearest(points.where("false"), one, "k").count() == 0


def test_points_are_shuffled_once(spark):
    points = spark.range(100).select("id", (F.col("id") % 50).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    places = spark.createDataFrame([("a", "x", 1.0, 2.0)], "name string, country string, lat double, lon double")
    plan = geo.nearest(points, places, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of points, and of the places sent to cells


def test_gazetteer(spark, tmp_path):
    line = lambda i, name, lat, lon, kind="P", country="FR": "\t".join([str(i), name, name.encode("ascii", "ignore").decode(), "", str(lat), str(lon), kind, "PPL", country, *[""] * 5, "5", "", "3", "Europe/Paris", "2020-01-01"])
    (tmp_path / "places.txt").write_text("\n".join([line(1, 'Aix "en" P.', 43.5, 5.4), line(2, "Lac", 46, 6, "H"), line(3, "Genève", 46.2, 6.1, country="CH"), line(4, "Broken", "n/a", 1), line(5, "Nowhere", 1, 2, country="ZZ")]) + "\n")
    (tmp_path / "countries.txt").write_text("# ISO\tISO3\nFR\tFRA\t250\tFR\tFrance\tParis\nCH\tCHE\t756\tSZ\tSwitzerland\n")
    at = str(tmp_path / "places.txt")
    assert {tuple(r) for r in gazetteer.read(spark, at).collect()} == {('Aix "en" P.', "FR", 43.5, 5.4), ("Genève", "CH", 46.2, 6.1), ("Nowhere", "ZZ", 1.0, 2.0)}
    assert gazetteer.read(spark, at, populated=False).count() == 4
    assert {r.country for r in gazetteer.load(spark, at, str(tmp_path / "countries.txt")).collect()} == {"France", "Switzerland", "ZZ"}
    table = gazetteer.read(spark, at)
    table.write.parquet(str(tmp_path / "p.parquet"))
    table.write.option("header", True).csv(str(tmp_path / "p.csv"))
    want = sorted(map(tuple, table.collect()))
    assert sorted(map(tuple, gazetteer.load(spark, str(tmp_path / "p.parquet")).collect())) == want == sorted(map(tuple, gazetteer.load(spark, str(tmp_path / "p.csv")).collect()))
