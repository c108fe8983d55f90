"""Round trips of files, streams and planes."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.functions.sky import Wcs
from nebulark.operators import background, masked, spatial, spectral, stacking, stats, synth
from nebulark.sources import fits, png
from nebulark.streaming import frames
from tests.conftest import SMALL


@pytest.mark.parametrize("bitpix", [8, 16, 32, -32, -64])
def test_fits_round_trip(spark, tmp_path, bitpix):
    plane = np.arange(35, dtype=float).reshape(5, 7)
    (tmp_path / "a.fits").write_bytes(fits.encode(plane, [("OBJECT", "M 42"), ("EXPTIME", "30.0")], bitpix))
    (tmp_path / "note.txt").write_text("no image")
    got = np.zeros((5, 7))
    for r in fits.read_pixels(spark, str(tmp_path)).collect():
        got[r.y, r.x] = r.v
    assert np.allclose(got, plane, atol=1e-3)
    cards = {r.key: r.value for r in fits.read_headers(spark, str(tmp_path)).collect()}
    assert (cards["OBJECT"], cards["EXPTIME"], cards["NAXIS1"]) == ("M 42", "30.0", "7")


def test_best_unit_and_merged_header(spark, tmp_path):
    primary = fits.encode(np.zeros(0).reshape(0, 0), [("OBJECT", "sky")])
    extension = fits.encode(np.ones((2, 3)), [("EXTNAME", "SCI"), ("OBJECT", "star")]).replace(b"SIMPLE  = ", b"XTENSION= ", 1)
    (tmp_path / "b.fits").write_bytes(primary + extension + b"rubbish" * 1000)
    assert fits.read_pixels(spark, str(tmp_path)).count() == 6
    header = fits.merged_header(fits.read_headers(spark, str(tmp_path)), 1).first().header
    assert header["OBJECT"] == "star" and "SIMPLE" not in header
    with pytest.raises(Exception, match="no unit"):
        fits.read_pixels(spark, str(tmp_path), hdu=5).count()


def test_frames_to_files(spark, tmp_path):
    rows = [(f, y, x, float(f * 100 + y * 10 + x)) for f in (1, 2) for y in range(3) for x in range(4)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, v double")
    fits.save(fits.to_files(df, "frame"), str(tmp_path))
    got = {(r.file[-6:-5], r.y, r.x): r.v for r in fits.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(str(f), y, x): v for f, y, x, v in rows}


def test_png(spark):
    plane = np.linspace(0, 1, 12).reshape(3, 4)
    data = png.encode(plane)
    assert struct.unpack(">II", data[16:24]) == (4, 3)
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert [raw[k * 5 + 1 : k * 5 + 5] for k in range(3)] == [bytes((plane[k] * 255).astype(int).tolist()) for k in range(3)]
    image = spark.range(40 * 30).select((F.col("id") / 40).cast("int").alias("y"), (F.col("id") % 40).cast("int").alias("x"), F.lit(0.5).alias("v"))
    assert {(r.level, r.ty, r.tx) for r in png.tiles(image, 16).collect()} == {(0, 0, 0), (1, 0, 0), (1, 0, 1)} | {(2, y, x) for y in range(2) for x in range(3)}


def test_stream_matches_batch(spark):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    stream = frames.read(spark, SMALL, schema, "events.parquet")
    got = frames.run(frames.windowed_stats(stream, ["event_type"], v="value"), "stats", "complete")
    want = spark.read.parquet(f"{SMALL}/events.parquet").groupBy("event_type").count()
    assert {r.event_type: r["n"] for r in got.groupBy("event_type").agg(F.sum("n").alias("n")).collect()} == {r.event_type: r["count"] for r in want.collect()}


def test_spectral(spark):
    y, x = np.indices((64, 64))
    base = np.random.default_rng(3).random((64, 64)) * 100 + np.hypot(y - 30, x - 20)
    moved = np.roll(base, (5, -3), (0, 1))
    dy, dx, confidence = spectral.shift_of(base, moved)
    assert abs(dy - 5) < 0.6 and abs(dx + 3) < 0.6 and confidence > spectral.LEAST_CONFIDENCE
    assert np.allclose(spectral.convolved(base, np.eye(3)[1:2, :].T @ np.eye(3)[1:2, :]), base)
    point = np.zeros((32, 32))
    point[16, 16] = 1
    blurred = spectral.convolved(point, spectral.gaussian(9, 1.5))
    assert spectral.richardson_lucy(blurred, spectral.gaussian(9, 1.5), 30).max() > 3 * blurred.max()
    assert np.allclose(spectral.resampled(base, 64, 64), base)
    rows = [(f, int(i), int(j), float(p[i, j])) for f, p in ((0, base), (1, moved)) for i in range(64) for j in range(64)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, v double").cache()
    found = {r.frame: r for r in spectral.phase_correlation(df, df.where("frame = 0").drop("frame"), "frame").collect()}
    assert abs(found[1].dy - 5) < 0.6 and abs(found[0].dx) < 0.5
    assert spectral.power_spectrum(df, "frame").count() == 2 * 64 * 64


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(1)
    plane = (rng.random((10, 14)) < 0.45).astype(float)
    rows = [(int(y), int(x), float(plane[y, x])) for y in range(10) for x in range(14)]
    got = {(r.y, r.x): r.label for r in spatial.labelled(spark.createDataFrame(rows, "y int, x int, v double"), [], 0.5).collect()}
    seen = {}
    for y, x in sorted(map(tuple, np.argwhere(plane > 0.5).tolist())):
        if (y, x) in seen:
            continue
        todo = [(y, x)]
        while todo:
            p = todo.pop()
            if p in seen or not (0 <= p[0] < 10 and 0 <= p[1] < 14 and plane[p] > 0.5):
                continue
            seen[p] = y * 14 + x
            todo += [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    inside = {label for (y, x), label in seen.items() if 0 < y < 9 and 0 < x < 13}  # components of the outermost samples alone don't count
    assert got == {p: label for p, label in seen.items() if label in inside}


def test_star_dedup_is_greedy(spark):
    from nebulark.operators import stars

    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), float(f)) for i, (a, b, f) in enumerate(zip(rng.random(120) * 40, rng.random(120) * 40, rng.integers(0, 30, 120)))]
    got = {r.star_id for r in stars.deduplicated(spark.createDataFrame(rows, "star_id long, x double, y double, flux double"), 4.0).collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all((r[1] - k[1]) ** 2 + (r[2] - k[2]) ** 2 >= 16 for k in kept):
            kept.append(r)
    assert got == {r[0] for r in kept}


def test_sigma_clip_edges(spark):
    groups = {1: [10, 10.1, 9.9, 10, 10.2], 2: [10, 10.1, 9.9, 10, 500], 3: [42], 4: [float("nan"), float("inf"), 5], 5: [7, 7, 7, 7]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    got = {r.pixel: (round(r.result, 6), r.rejected) for r in stacking.sigma_clip(spark.createDataFrame(rows, "pixel int, v double"), ["pixel"], 2.0, 2.0).collect()}
    assert got[2] == (10.0, 1) and got[3] == (42.0, 0) and got[4] == (5.0, 0) and got[5] == (7.0, 0)


def test_statistics_of_nothing(spark):
    rows = [("a", float("nan")), ("a", 0.0), ("b", 1.0), ("b", 3.0), (None, 2.0), ("b", None)]
    got = {r.frame: r for r in stats.image_stats(spark.createDataFrame(rows, "frame string, v double"), ["frame"]).collect()}
    assert got["a"].valid_count == 0 and got["a"].median == 0.0 and got["b"].median == 2.0 and got[None].valid_count == 1


def test_background_and_masked_stretch(spark):
    image = synth.canvas(spark, 64, 64).withColumn("v", 100 + 50 * F.col("y") / 64).cache()
    fit = background.fit(background.samples(image, 6), 1)
    flat = background.corrected(background.model(image, fit, 1)).agg(F.max("v") - F.min("v")).first()[0]
    assert flat < 2.0
    field = synth.noisy(synth.rendered(synth.star_field(spark, 20, 64, 64)).join(synth.canvas(spark, 64, 64), ["y", "x"], "right").fillna(0.0, ["v"])).cache()
    stars = spark.createDataFrame([(32.0, 32.0, 4.0)], "x double, y double, fwhm double")
    mask = masked.star_mask(stars)
    out = masked.masked_stretch(field, mask, ceiling=None)  # the field isn't scaled to 0 to 1
    beside = out.join(mask, ["y", "x"], "left").withColumn("mask", F.coalesce("mask", F.lit(0.0)))
    assert abs(stats.masked_median(beside, []).first()["median"] - 0.25) < 0.05


def test_wcs_round_trip(spark):
    points = spark.createDataFrame([(float(x), float(y)) for x in (0, 100, 511) for y in (0, 300)], "x double, y double")
    for kind in ("TAN", "SIN", "ARC", "CAR"):
        header = {"CRPIX1": "256", "CRPIX2": "256", "CRVAL1": "180.0", "CRVAL2": "45.0", "CDELT1": "-0.001", "CDELT2": "0.001", "CROTA2": "12", "CTYPE1": f"RA---{kind}"}
        wcs = Wcs.from_header(header)
        ra, dec = wcs.to_world("x", "y")
        x, y = wcs.to_pixel("ra", "dec")
        back = points.select("x", "y", ra.alias("ra"), dec.alias("dec")).select("x", "y", x.alias("x2"), y.alias("y2"))
        assert all(abs(r.x - r.x2) < 1e-6 and abs(r.y - r.y2) < 1e-6 for r in back.collect())
