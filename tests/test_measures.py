"""Point-spread functions and photometric calibration of planted stars."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.functions.sky import Wcs
from nebulark.operators import photometry, psf, stats

PLACES = [(40.3, 45.2), (60.0, 90.4), (90.7, 50.0), (100.2, 100.9), (75.5, 70.5), (45.0, 115.0)]


def field(sigma, ground=0.05, size=150, places=PLACES):
    y, x = np.mgrid[:size, :size]
    v = np.full((size, size), ground) + 0.001 * ((7 * y + 13 * x) % 17) / 17
    for k, (cy, cx) in enumerate(places):
        v += (0.5 + 0.05 * k) * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * sigma**2))
    v[5, 5] = 1.0  # the greatest sample, so that no star is saturated
    return v


def frames(spark, **planes):
    rows = [(n, y, x, float(p[y, x])) for n, p in planes.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "frame string, y int, x int, v double")


def test_two_frames(spark):
    pixels = frames(spark, a=field(2.0), b=field(3.0))
    kernels, facts = psf.estimated(pixels, ["frame"])
    facts = {r.frame: r for r in facts.collect()}
    assert {n: (r.stars, r.rejected) for n, r in facts.items()} == {"a": (6, 0), "b": (6, 0)}
    # Moments of what lies above half of the maximum are those of a truncated Gaussian: 0.8 of its width or so.
    assert facts["b"].fwhm / facts["a"].fwhm == pytest.approx(1.5, rel=0.1) and facts["a"].fwhm > 2.5
    k = {n: np.zeros((31, 31)) for n in "ab"}
    for r in kernels.collect():
        k[r.frame][r.y, r.x] = r.v
    for n in "ab":
        assert k[n].sum() == pytest.approx(1) and np.unravel_index(k[n].argmax(), (31, 31)) == (15, 15)
    assert k["a"].max() > k["b"].max() and all(0 < f.spread < 15 * 2**0.5 for f in facts.values())


def test_positions_and_rules(spark):
    found = psf.measured(frames(spark, a=field(2.0)), ["frame"]).collect()
    got = sorted((r.y, r.x) for r in found)
    assert np.allclose(got, sorted(PLACES), atol=0.35)  # the background pulls a centroid towards the window's middle
    assert all(r.ellipticity < 0.15 for r in found)
    near = psf.chosen(psf.measured(frames(spark, a=field(2.0)), ["frame"]), ["frame"], psf.Rules(stars=2)).collect()
    assert len(near) == 2 and {r.candidates for r in near} == {6}
    with pytest.raises(ValueError, match="no star"):
        psf.estimated(frames(spark, a=np.full((100, 100), 0.5)), ["frame"])


def test_cutouts_stay_inside(spark):
    stars = spark.createDataFrame([(1, 2, 2, 9, 9), (2, 1, 4, 9, 9)], "star long, iy long, ix long, h int, w int")
    pixels = frames(spark, a=np.arange(81.0).reshape(9, 9)).drop("frame")
    cut = psf.cutouts(stars, pixels, [], 2).collect()
    assert len(cut) == 25 and {r.star for r in cut} == {1} and {(r.y, r.x): r.v for r in cut}[2, 3] == 21.0
    moved = psf.recentred(spark.createDataFrame([(1, y, x, float(y == 2 and x == 3)) for y in range(5) for x in range(5)], "star long, y long, x long, v double"), [], 2)
    assert {(r.y, r.x) for r in moved.where("v > 0").collect()} == {(2, 2)}


def test_calibration(spark):
    places = [(20 + 17 * (k // 8), 20 + 15 * (k % 8)) for k in range(40)]
    light = frames(spark, a=field(1.8, places=places)).drop("frame")
    rgb = light.select("y", "x", (2 * F.col("v")).alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    wcs = Wcs((75.0, 75.0), (10.0, 0.0), (-1e-4, 0.0, 0.0, 1e-4))
    grey = spark.createDataFrame([(k, 10.0 - 1e-4 * (x + 1 - 75), 1e-4 * (y + 1 - 75), 0.85) for k, (y, x) in enumerate(places)], "cat_id long, ra double, dec double, bp_rp double")
    got = photometry.calibrated(rgb, wcs, grey, "flat").first()
    same = photometry.calibrated(rgb.withColumn("r", F.col("g")), wcs, grey, "flat").first()
    # Twice the red light takes half the factor.
    assert got.matched == got.stars > 30 and got.r_factor / same.r_factor == pytest.approx(0.5, rel=0.02) and got.g_factor == 1
    with pytest.raises(Exception, match="stars matched"):
        photometry.calibrated(rgb, wcs, grey.where("cat_id < 2")).first()
    with pytest.raises(ValueError, match="are needed"):
        photometry.calibrated(rgb, wcs, grey, signal=1e9)


def test_medians_of_frames_beyond_the_sketch(spark):
    """Exact where the sketch approximates: many distinct values, one far outlier, heavy ties, few samples, none."""
    rng = np.random.default_rng(11)
    frames = {"wide": np.append(rng.normal(100, 5, 60_000), 1e9), "even": rng.normal(size=40_000), "ties": np.repeat([1.0, 2.0, 3.0], [20_000, 20_001, 2]), "two": np.array([1.0, 4.0]), None: np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, a in frames.items() for v in a], "frame string, v double").repartition(5)
    for upper in (False, True):
        got = {r.frame: (r.n, r.median) for r in stats.medians(df, ["frame"], upper).collect()}
        assert got == {k: (len(a), float(np.sort(a)[len(a) // 2] if upper else np.median(a))) for k, a in frames.items()}
    none = df.where("false")
    assert stats.medians(none, ["frame"]).isEmpty() and tuple(stats.medians(none.select("v"), []).first()) == (0, None)
    r = stats.image_stats(none, []).first()
    assert (r["median"], r["mad"], r["sigma"], r["valid_count"]) == (0.0, 0.0, 0.0, 0)
