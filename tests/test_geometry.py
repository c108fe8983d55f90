"""Edge cases of resampling and registration."""

import numpy as np
from pyspark.sql import functions as F

from nebulark.operators import registration, sampling, spectral

MATCH = "x double, y double, u double, w double"


def image(spark, plane):
    rows = [(int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "y long, x long, v double")


def plane_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def test_resized_matches_whole_plane(spark):
    plane = np.random.default_rng(1).normal(size=(7, 5))
    assert np.allclose(plane_of(sampling.resized(image(spark, plane), [], 4, 9), (4, 9)), spectral.resampled(plane, 4, 9))


def test_whole_shift_moves_samples(spark):
    plane = np.arange(12.0).reshape(3, 4)
    got = plane_of(sampling.shifted(image(spark, plane), [], 1, 0), (3, 4))
    assert np.allclose(got, np.vstack((plane[1:], np.zeros((1, 4)))))


def test_no_pixels(spark):
    none = spark.createDataFrame([], "y long, x long, v double")
    assert sampling.resized(none, [], 3, 3).isEmpty()
    assert sampling.shifted(none, [], 0.5, 0.5).isEmpty()


def test_offsets_find_the_shift(spark):
    plane = np.random.default_rng(2).normal(size=(12, 12))
    target = image(spark, plane).select((F.col("y") + 1).alias("y"), (F.col("x") - 2).alias("x"), "v")
    best = sampling.offset_scores(image(spark, plane), target).orderBy(F.desc("score")).first()
    assert (best.dy, best.dx) == (1, -2) and abs(best.score - 1) < 1e-9


def test_robust_fit_needs_enough_that_agree(spark):
    few = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (5.0, 0.0, 6.0, 1.0), (0.0, 5.0, 1.0, 6.0)], MATCH)
    assert registration.robust_affine(few, F.col("x"), rounds=20).isEmpty()
    assert registration.robust_affine(spark.createDataFrame([], MATCH), F.col("x"), rounds=20).isEmpty()
    line = spark.createDataFrame([(float(k), float(k), float(k), float(k)) for k in range(6)], MATCH)
    assert registration.robust_affine(line, F.col("x"), rounds=20).isEmpty()


def test_rigid_fit_of_a_quarter_turn(spark):
    pairs = spark.createDataFrame([(x, y, -y + 3, x - 2) for x, y in ((0.0, 0.0), (4.0, 1.0), (2.0, 7.0))], MATCH)
    r = registration.rigid_fit(pairs, []).first()
    assert np.allclose((r.rotation, r.tx, r.ty), (90, 3, -2))
