"""Tiles with halos against whole planes: images wider than a tile, borders, ties, missing and null samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import align, spatial, tiles

SHAPE = (150, 301)


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(5)
    return {"a": np.round(rng.normal(size=SHAPE), 1), None: rng.normal(size=(140, 3))}


@pytest.fixture(scope="module")
def images(spark, planes):
    rows = [(k, y, x, float(v), y + 1) for k, p in planes.items() for (y, x), v in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "frame string, y int, x int, v double, extra int").repartition(6).cache()


def arrays(df, shapes, v="v"):
    out = {k: np.full(s, np.nan) for k, s in shapes.items()}
    for r in df.select("frame", "y", "x", v).collect():
        assert math.isnan(out[r.frame][r.y, r.x])
        out[r.frame][r.y, r.x] = np.nan if r[v] is None else r[v]
    return out


def direct(plane, step):
    """Tap by tap, over a padded plane."""
    pad = np.pad(plane, 2 * step, mode="edge")
    weight = np.array([1, 4, 6, 4, 1]) / 16
    h, w = plane.shape
    return sum(weight[i] * weight[j] * pad[i * step : i * step + h, j * step : j * step + w] for i in range(5) for j in range(5))


@pytest.mark.parametrize("step", [1, 8, 64])
def test_smoothing(images, planes, step):
    got = arrays(spatial.smoothed(images, ["frame"], step), {k: p.shape for k, p in planes.items()})
    assert all(np.allclose(got[k], direct(p, step)) for k, p in planes.items())


def test_scales_of_one_pass_and_extra_columns(images, planes):
    out = spatial.scales_of(images, ["frame"], [1, 2, 4, 8, 16], to=("c0", "c1", "c2", "c3", "c4"))
    assert out.columns == [*images.columns, "c0", "c1", "c2", "c3", "c4"] and out.where("extra <> y + 1").isEmpty()
    want, shapes = planes, {k: p.shape for k, p in planes.items()}
    for k in range(5):
        want = {n: direct(p, 1 << k) for n, p in want.items()}
        got = arrays(out, shapes, f"c{k}")
        assert all(np.allclose(got[n], want[n]) for n in want)


def test_each_sample_is_shuffled_little_more_than_once(images):
    n = images.count()
    assert tiles.with_halos(images, 2, tiles.side_of(2)).count() < 1.15 * n
    plan = spatial.scales_of(images, ["frame"], [1, 2, 4, 8, 16], to=tuple("abcde"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(frame") <= 3 and "Generate" in plan  # sizes, their join, and the tiles


def test_missing_null_and_no_samples(spark, images, planes):
    holes = images.where("NOT (frame = 'a' AND y BETWEEN 60 AND 70 AND x BETWEEN 100 AND 110)").withColumn("v", F.when(~((F.col("y") == 20) & (F.col("x") == 1)), F.col("v")))
    plane = planes["a"].copy()
    plane[60:71, 100:111] = plane[20, 1] = 0
    got = arrays(spatial.smoothed(holes, ["frame"]), {k: p.shape for k, p in planes.items()})["a"]
    seen = ~np.isnan(got)
    assert seen.sum() == plane.size - 121 and np.allclose(got[seen], direct(plane, 1)[seen])
    one = spark.createDataFrame([("n", 0, 0, None)], "frame string, y int, x int, v double")
    assert [r.v for r in spatial.smoothed(one, ["frame"]).collect()] == [None]
    assert spatial.smoothed(images.where("false"), ["frame"]).isEmpty() and spatial.local_maxima(images.where("false"), ["frame"]).isEmpty()
    whole = spatial.smoothed(images.where("frame = 'a'").drop("frame"), [])
    assert whole.columns == ["y", "x", "v"] and whole.count() == SHAPE[0] * SHAPE[1]


def test_denoised_by_tiles(images, planes):
    """Six scales, of which the last has a pass of its own."""
    got = arrays(spatial.denoised(images, ["frame"], 6), {k: p.shape for k, p in planes.items()})
    for name, plane in planes.items():
        smooth, total, noise = plane, 0, None
        for k in range(6):
            soft = direct(smooth, 1 << k)
            detail = smooth - soft
            noise = np.median(np.abs(detail)) * 1.4826 if k == 0 else noise
            cut = noise * spatial.scale_noise(k) * spatial.THRESHOLDS[min(k, 4)]
            total, smooth = total + np.sign(detail) * np.maximum(np.abs(detail) - cut, 0), soft
        assert np.allclose(got[name], np.maximum(total + smooth, 0), atol=1e-9)


@pytest.mark.parametrize("radius", [1, 7])
def test_maxima_with_ties(images, planes, radius):
    rows = images.withColumn("v", F.when((F.col("x") == 40) & (F.col("y") < 3), F.lit(float("inf"))).otherwise(F.col("v")))
    got = {(r.frame, r.y, r.x) for r in spatial.local_maxima(rows, ["frame"], radius, 0.5).collect()}
    want = set()
    for name, p in planes.items():
        q = np.where(p > 0.5, p, -np.inf)
        if name == "a":
            q[:3, 40] = -np.inf
        for y, x in np.argwhere(np.isfinite(q)):
            t, le = max(y - radius, 0), max(x - radius, 0)
            near = q[t : y + radius + 1, le : x + radius + 1]
            first = divmod(int(near.argmax()), near.shape[1])
            if (t + first[0], le + first[1]) == (y, x):
                want.add((name, y, x))
    assert got == want


TURN = math.radians(30)


@pytest.mark.parametrize("terms", [(1, 0, 0, 0, 1, 0), (math.cos(TURN), -math.sin(TURN), 20.5, math.sin(TURN), math.cos(TURN), -10.25), (-1, 0, 300, 0, -1, 149), (40.0, 0, 3, 0, 30.0, 2), (0.01, 0, 150, 0, 0.01, 60), (1, 0, 1e9, 0, 1, 0)])
def test_warps(spark, images, planes, terms):
    found = spark.createDataFrame([(k, *map(float, terms)) for k in planes], "frame string, a double, b double, tx double, c double, d double, ty double")
    got = arrays(align.warped(images, found), {k: p.shape for k, p in planes.items()})
    a, b, tx, c, d, ty = terms
    for name, p in planes.items():
        y, x = np.indices(p.shape)
        sx, sy = a * x + b * y + tx, c * x + d * y + ty
        inside = (sx >= 0) & (sx <= p.shape[1] - 1) & (sy >= 0) & (sy <= p.shape[0] - 1)
        want = np.zeros(p.shape)
        for v, u in np.argwhere(inside):
            iy, ix = math.floor(sy[v, u]), math.floor(sx[v, u])
            taps = [(min(max(iy + i, 0), p.shape[0] - 1), min(max(ix + j, 0), p.shape[1] - 1), weight(sy[v, u] - iy - i) * weight(sx[v, u] - ix - j)) for i in range(-1, 3) for j in range(-1, 3)]
            want[v, u] = sum(p[i, j] * w for i, j, w in taps)
        assert np.allclose(got[name], want)


def weight(t):
    t = abs(t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0
