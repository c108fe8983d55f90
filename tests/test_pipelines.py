"""Pipelines from folders of files, and cubes reduced where they are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import cubes, pipelines
from nebulark.sources import fits


@pytest.fixture(scope="module")
def lights(tmp_path_factory):
    """Three shifted frames of a few stars, with bias, dark and flat."""
    base = tmp_path_factory.mktemp("lights")
    y, x = np.mgrid[:96, :96]
    sky = lambda dy, dx: 5 + sum(a * np.exp(-((y - cy - dy) ** 2 + (x - cx - dx) ** 2) / 8) for cy, cx, a in ((30, 40, 90), (60, 25, 70), (50, 70, 80), (75, 60, 60)))
    flat = 1 + 0.2 * (x / 95 - 0.5)
    for name, planes in {"R": [sky(0, 0) * flat + 3, sky(2, -3) * flat + 3, sky(1, 2) * flat + 3], "bias": [np.full((96, 96), 1.0)] * 3, "dark": [np.full((96, 96), 3.0)] * 2, "flat": [flat * 10 + 3] * 3}.items():
        (base / name).mkdir()
        for k, p in enumerate(planes):
            (base / name / f"{k}.fits").write_bytes(fits.encode(p, bitpix=-64))
    return base


def test_files_to_images(spark, lights):
    made = pipelines.masters(spark, f"{lights}/bias", f"{lights}/dark", f"{lights}/flat")
    assert made.dark.agg(F.min("v"), F.max("v")).first() == (2.0, 2.0)
    frame = pipelines.calibrated(spark, f"{lights}/R", made)
    assert frame.select("frame").distinct().count() == 3 and abs(frame.where("y = 5 AND frame LIKE '%0.fits'").agg(F.max("v") - F.min("v")).first()[0]) < 1e-6  # flat sky
    stack = pipelines.stacked(spark, f"{lights}/R", made).where("y BETWEEN 10 AND 85 AND x BETWEEN 10 AND 85")
    apart = stack.join(frame.where("frame LIKE '%0.fits'"), ["y", "x"]).agg(F.avg(F.abs(F.col("result") - F.col("v")))).first()[0]
    assert apart < 1.0
    grid = pipelines.drizzled(spark, f"{lights}/R", made, scale=2.0)
    top = grid.orderBy(F.desc("value")).first()
    assert abs(top.y - 60) <= 2 and abs(top.x - 80) <= 2
    rgb = pipelines.drizzled_rgb(spark, {"r": f"{lights}/R", "g": f"{lights}/R"}, made, scale=1.0, method="none")
    assert rgb.count() == 96 * 96


def test_batch(spark, lights, tmp_path):
    made = pipelines.masters(spark, flat=f"{lights}/flat")
    stack, facts, rgb = pipelines.batch(spark, {c: f"{lights}/R" for c in "RGB"}, made)
    facts = {r.channel: r for r in facts.collect()}
    assert set(facts) == set("RGB") and all(r.lights == 3 and r["mean"] == pytest.approx(1, abs=0.1) for r in facts.values())
    assert stack.count() == 3 * 96 * 96 and rgb.count() == 96 * 96 and rgb.agg(F.max("g")).first()[0] == pytest.approx(1)
    assert pipelines.batch(spark, {"R": f"{lights}/R"}, made)[2] is None
    (tmp_path / "odd").mkdir()
    for k, n in enumerate((5, 6)):
        (tmp_path / "odd" / f"{k}.fits").write_bytes(fits.encode(np.ones((n, 5))))
    with pytest.raises(ValueError, match="several sizes"):
        pipelines.batch(spark, {"R": f"{tmp_path}/odd"}, pipelines.Masters())
    with pytest.raises(ValueError, match="no channels"):
        pipelines.batch(spark, {}, pipelines.Masters())


@pytest.mark.parametrize("samples", [7, 40, 1 << 22])
def test_collapse_like_voxels(spark, tmp_path, samples):
    rng = np.random.default_rng(3)
    cube = rng.integers(0, 4, (6, 9, 8)).astype(float)
    cube[2, 1, 1] = np.nan
    cube[:, 4, 4] = 0
    (tmp_path / "c.fits").write_bytes(fits.encode(cube))
    opened = fits.open_cubes(spark, str(tmp_path))
    voxels = fits.read_frames(opened).withColumnRenamed("file", "cube")
    for how in ("mean", "median"):
        want = {(r.y, r.x): r.v for r in cubes.collapsed(voxels, how).collect()}
        got = fits.collapse(opened, how, samples).collect()
        assert len(got) == 72 and all(r.v == pytest.approx(want[r.y, r.x]) for r in got)
