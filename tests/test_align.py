"""Alignment of planted shifts and rotations, stacks and drizzle of aligned frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import align, masked, spatial
from nebulark.operators.detection import detected

STARS = [(30.0, 25.0, 900.0), (80.0, 30.0, 700.0), (50.0, 70.0, 800.0), (95.0, 90.0, 650.0), (22.0, 95.0, 600.0), (70.0, 50.0, 750.0), (40.0, 45.0, 500.0), (100.0, 60.0, 550.0), (60.0, 100.0, 450.0)]


def field(move, n=128):
    y, x = np.indices((n, n))
    out = 100.0 + ((7 * y + 13 * x) % 17) * 0.5
    for sx, sy, peak in STARS:
        u, w = move(sx, sy)
        out += peak * np.exp(-((x - u) ** 2 + (y - w) ** 2) / 8.0)
    return out


def table(spark, frames):
    rows = [(name, int(r), int(c), float(p[r, c])) for name, p in frames.items() for r in range(p.shape[0]) for c in range(p.shape[1])]
    return spark.createDataFrame(rows, "frame string, y int, x int, v double")


@pytest.fixture(scope="module")
def frames(spark):
    turn = math.radians(2)
    moves = {"a": lambda x, y: (x, y), "b": lambda x, y: (x + 4, y - 3), "c": lambda x, y: (math.cos(turn) * x - math.sin(turn) * y + 3, math.sin(turn) * x + math.cos(turn) * y - 2)}
    return table(spark, {k: field(m) for k, m in moves.items()}).cache()


def one(frames, name):
    return frames.where(F.col("frame") == name).select("y", "x", "v")


def test_detection_of_planted_stars(frames):
    got = detected(one(frames, "a"), [], 5.0).orderBy(F.desc("flux")).collect()
    assert len(got) == len(STARS)
    assert all(min(math.hypot(r.x - x, r.y - y) for x, y, _ in STARS) < 0.3 and r.snr > 20 and 3 < r.fwhm < 6 for r in got)


def test_transforms(frames):
    found = {r.frame: r for r in align.transforms(frames, "a", "affine").collect()}
    assert {n: r.method for n, r in found.items()} == {"a": "identity", "b": "affine", "c": "affine"}
    turn = math.radians(2)
    for x, y, _ in STARS:
        at = lambda n: (found[n].a * x + found[n].b * y + found[n].tx, found[n].c * x + found[n].d * y + found[n].ty)  # noqa: B023, E731
        assert math.dist(at("b"), (x + 4, y - 3)) < 0.5 and at("a") == (x, y)
        assert math.dist(at("c"), (math.cos(turn) * x - math.sin(turn) * y + 3, math.sin(turn) * x + math.cos(turn) * y - 2)) < 0.5
    phase = {r.frame: r for r in align.transforms(frames.where("frame <> 'c'"), "a").collect()}
    assert phase["b"].method == "phase" and abs(phase["b"].tx - 4) < 0.6 and abs(phase["b"].ty + 3) < 0.6
    flat = frames.where("frame <> 'c'").withColumn("v", F.lit(1.0))
    assert {r.method for r in align.transforms(flat, "a", "affine").collect()} == {"identity"}


def test_jobs_do_not_grow_with_frames(spark, frames):
    """As many jobs for two frames as for one, but for a few rounds of the star lists."""
    tracker = spark.sparkContext.statusTracker()

    def jobs(df, group):
        spark.sparkContext.setJobGroup(group, group)
        align.transforms(df, "a").collect()
        return len(tracker.getJobIdsForGroup(group))

    many = frames
    for k in range(4):
        many = many.unionByName(frames.where("frame = 'b'").withColumn("frame", F.lit(f"b{k}")))
    assert jobs(many, "many") <= jobs(frames.where("frame <> 'c'"), "few") + 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_channels(frames):
    """Composites align their channels, make up a missing one, and need two."""
    from nebulark.operators import compose

    channels = frames.where("frame <> 'c'").select(F.when(F.col("frame") == "a", "r").otherwise("b").alias("channel"), "y", "x", "v")
    moved = align.aligned_channels(channels, "r").where("y BETWEEN 20 AND 100 AND x BETWEEN 20 AND 100")
    apart = lambda df: df.groupBy("y", "x").pivot("channel", ["r", "b"]).sum("v").agg(F.avg(F.abs(F.col("r") - F.col("b")))).first()[0]
    assert apart(moved) < 0.5 * apart(channels.where("y BETWEEN 20 AND 100 AND x BETWEEN 20 AND 100"))
    out = compose.composed(channels, align="phase")
    assert out.columns == ["y", "x", "r", "g", "b"] and out.count() == 128 * 128
    with pytest.raises(ValueError, match="two channels"):
        compose.composed(channels.where("channel = 'r'"))
    half = channels.where("channel = 'r'").unionByName(channels.where("channel = 'b' AND y < 64 AND x < 64"))
    assert compose.harmonised(half).groupBy("channel").agg(F.max("y").alias("y"), F.max("x").alias("x")).where("y = 127 AND x = 127").count() == 2


def test_stack_of_aligned_frames(frames):
    out = align.stacked(frames.where("frame <> 'c'"), "a").where("y BETWEEN 10 AND 110 AND x BETWEEN 10 AND 110")
    worst = out.join(one(frames, "a"), ["y", "x"]).agg(F.avg(F.abs(F.col("result") - F.col("v")))).first()[0]
    plain = align.stacked(frames.where("frame <> 'c'"), "a", align=False).where("y BETWEEN 10 AND 110 AND x BETWEEN 10 AND 110")
    assert worst < 0.6 * plain.join(one(frames, "a"), ["y", "x"]).agg(F.avg(F.abs(F.col("result") - F.col("v")))).first()[0]
    pair = frames.where("frame <> 'c'")
    grid = align.drizzle_stack(pair, "a", scale=2.0)
    assert grid.where("n > 1").count() > 20_000 and all(253 <= m <= 255 for m in grid.agg(F.max("y"), F.max("x")).first())
    # The brightest star of the reference lies at twice its place; a sample's footprint ends where the sample begins.
    top = grid.where("y BETWEEN 40 AND 60 AND x BETWEEN 50 AND 70").orderBy(F.desc("value")).first()
    assert abs(top.y - 50) <= 1 and abs(top.x - 60) <= 1
    for kernel in ("gaussian", "lanczos3"):
        assert align.drizzle_stack(pair, "a", kernel=kernel, method="none").count() > 60_000
    with pytest.raises(ValueError):
        align.drizzle_stack(frames.where("frame = 'a'"), "a")
    with pytest.raises(ValueError):
        align.drizzle_stack(frames.where("frame = 'a' OR (frame = 'b' AND y < 100)"), "a")


def test_drizzled_composite(frames):
    rows = frames.where("frame <> 'c'").select("frame", "y", "x", "v", F.lit("r").alias("channel"))
    both = rows.unionByName(rows.withColumn("channel", F.lit("b")))
    out = align.drizzle_rgb(both, {"r": "a", "b": "a"}, scale=1.0, method="none")
    assert out.columns == ["y", "x", "r", "g", "b"] and out.count() == 128 * 128


def test_border_components_and_mask(spark):
    rows = [(0, y, x, 5.0 if (y == 0 or (y, x) in ((4, 4), (5, 5))) else 0.0) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "frame int, y int, x int, v double")
    assert {r.label for r in spatial.labelled(df, ["frame"], 1.0).collect()} == {36}
    star = spark.createDataFrame([(20.0, 20.0, 2.0)], "x double, y double, fwhm double")
    mask = {(r.y, r.x): r.mask for r in masked.star_mask(star).collect()}
    assert mask[20, 25] == 1.0 and 0 < mask[20, 27] < 1 and (20, 30) not in mask  # radius 2 * 2.5, soft to 4 more


def test_denoised_flat_and_noise(spark):
    rng = np.random.default_rng(3)
    plane = 10 + rng.normal(size=(40, 40))
    noisy = table(spark, {"n": plane, "f": np.full((40, 40), 10.0)})
    out = spatial.denoised(noisy, ["frame"], 4).groupBy("frame").agg(F.stddev("v").alias("s"), F.avg("v").alias("m")).collect()
    got = {r.frame: r for r in out}
    assert got["f"].s < 1e-9 and abs(got["f"].m - 10) < 1e-9
    assert got["n"].s < 0.5 and abs(got["n"].m - 10) < 0.2
