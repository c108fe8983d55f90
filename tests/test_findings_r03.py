"""What the third round of findings found."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import align, background, sampling, spatial, stars, stats
from nebulark.operators.lineage import checkpointed
from nebulark.plans import registry
from nebulark.plans.composites import stem
from nebulark.sources import asdf, fits
from tests.conftest import SMALL
from tests.oracle import check, connect


def test_stars_without_flux_go_last(spark):
    rows = [(1, 5.0, 5.0, None), (2, 6.0, 5.0, 1.0), (3, 50.0, 5.0, None), (4, 50.5, 5.0, None), (5, float("nan"), 5.0, 9.0), (6, None, 5.0, 9.0)]
    got = stars.deduplicated(spark.createDataFrame(rows, "star_id long, x double, y double, flux double"), 3.0)
    assert sorted(r.star_id for r in got.collect()) == [2, 3, 5, 6]


def test_rounds_of_joins_keep_a_true_size(spark):
    """Planning works on estimated sizes, which rounds of joins squared."""
    df = spark.range(10).select("id", F.lit(1).alias("k"))
    for _ in range(6):
        df = checkpointed(df.join(df.select(F.col("id").alias("other"), "k"), "k").where("id = other").select("id", "k"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20


def test_moments_far_from_the_origin(spark):
    near = [(0, k // 4, k % 4, 1.0 + k) for k in range(16)]
    rows = spark.createDataFrame([*near, *((1, y + 300_000_000, x, v) for _, y, x, v in near)], "label long, y long, x long, v double")
    a, b = sorted(spatial.component_moments(rows, []).collect(), key=lambda r: r.label)
    assert b.fwhm == pytest.approx(a.fwhm, abs=1e-5) and b.eccentricity == pytest.approx(a.eccentricity, abs=1e-5)


def test_preview_of_zeros(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1), k, "view", float(k % 7) if k % 5 else 0.0, "") for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/t")
    (part,) = (tmp_path / "t").glob("*.parquet") if len(list((tmp_path / "t").glob("*.parquet"))) == 1 else (None,)
    if part is None:
        spark.read.parquet(f"{tmp_path}/t").coalesce(1).write.parquet(f"{tmp_path}/one")
        (part,) = (tmp_path / "one").glob("*.parquet")
    (tmp_path / "sf").mkdir()
    part.rename(tmp_path / "sf" / "events.parquet")
    check(registry.QUERIES["robust_asinh_preview"](spark, f"{tmp_path}/sf"), connect(f"{tmp_path}/sf"), registry.ORACLE["robust_asinh_preview"])


def test_rounded_ties_of_a_match(spark):
    asked = spark.createDataFrame([(1, 10.0, 0.0)], "star_id long, ra double, dec double")
    entries = spark.createDataFrame([(5, 10.0, 1e-4 + 1e-12), (6, 10.0, 1e-4), (4, 50.0, 0.0), (9, 10.0, 1e-4)], "cat_id long, ra double, dec double")
    assert [(r.star_id, r.cat_id) for r in stars.cross_match(asked, entries, 3600.0).collect()] == [(1, 5)]


def test_stars_that_look_again(spark):
    """With many entries elsewhere the first radius is small, and the only entry near a star lies beyond it."""
    asked = spark.createDataFrame([(1, 200.0, 40.0), (2, 100.0, -40.0)], "star_id long, ra double, dec double")
    crowd = spark.range(20_000).select(F.col("id").alias("cat_id"), (F.col("id") % 200 / 100).alias("ra"), (F.col("id") / 20_000).alias("dec"))
    entries = crowd.unionByName(spark.createDataFrame([(99_999, 200.0, 40.99)], crowd.schema))
    assert [(r.star_id, r.cat_id) for r in stars.cross_match(asked, entries, 3600.0).collect()] == [(1, 99_999)]


def test_frames_are_not_shuffled(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("frame"), (F.col("id") * 1.0).alias("v"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        plan = stats.medians(rows, ["frame"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan


def test_apertures_explode_cells_only(spark):
    pixels = spark.range(40 * 40).select(F.floor(F.col("id") / 40).alias("y"), (F.col("id") % 40).alias("x"), (F.col("id") % 7 * 1.0).alias("v"))
    own = spark.createDataFrame([(1, 15.4, 15.6), (2, 0.0, 39.0)], "star_id long, x double, y double")
    found = stars.aperture_flux(own, pixels, 3.0, 4.0, 6.0)
    inside = lambda cx, cy, r: [(y * 40 + x) % 7 for y in range(40) for x in range(40) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r]
    assert {r.star_id: (r.total, r.npix) for r in found.collect()} == {k: (sum(inside(x, y, 3)), len(inside(x, y, 3))) for k, x, y in ((1, 15.4, 15.6), (2, 0, 39))}
    assert "round(sx" not in found._jdf.queryExecution().analyzed().toString()


def test_a_last_frame_with_fewer_rows(spark, tmp_path):
    import duckdb

    duckdb.sql(f"COPY (SELECT * FROM '{SMALL}/embeddings.parquet' ORDER BY vec_id LIMIT (SELECT count(*) - 27 FROM '{SMALL}/embeddings.parquet')) TO '{tmp_path}/embeddings.parquet'")
    check(registry.QUERIES["batch_pipeline"](spark, str(tmp_path)), connect(str(tmp_path)), registry.ORACLE["batch_pipeline"])


def test_samples_are_not_exploded_to_offsets(spark):
    rows = spark.range(300 * 5).select(F.floor(F.col("id") / 5).alias("y"), (F.col("id") % 5).alias("x"), F.when(F.col("id") % 11 > 0, F.sin("id")).alias("v"))
    found = sampling.offset_scores(rows, rows, 1)
    at = {(r.y, r.x): r.v for r in rows.collect()}
    for r in found.collect():
        pairs = [(at[y - r.dy, x - r.dx], v) for (y, x), v in at.items() if (y - r.dy, x - r.dx) in at]
        some = [p for p in pairs if None not in p]
        assert r.n == len(pairs) and r.score == pytest.approx(np.corrcoef(np.array(some).T)[0, 1], abs=1e-12)
    assert "Generate" not in found._jdf.queryExecution().analyzed().toString()


def test_cells_that_read_the_last_sample(spark):
    """1.1 * 2 + 0.2 * 3 + 0.2 is 3, the last column, though in doubles it is more."""
    frame = spark.createDataFrame([(0, y, x, 1.0 + 4 * y + x) for y in range(4) for x in range(4)], "frame int, y long, x long, v double")
    moved = spark.createDataFrame([(0, 1.1, 0.2, 0.2, 0.0, 1.0, 0.0)], "frame int, a double, b double, tx double, c double, d double, ty double")
    got = {(r.y, r.x): r.v for r in align.warped(frame, moved).collect()}
    assert got[3, 2] == 16.0 and got[3, 3] == 0.0


def test_reading_is_dealt_to_tasks(spark, tmp_path):
    """A list of files is short, whatever is in them; its partitions aren't joined to one."""
    for k in range(12):
        (tmp_path / f"a.{k}.fits").write_bytes(fits.encode(np.full((3, 4), float(k))))
        (tmp_path / f"b.{k}.asdf").write_bytes(asdf.encode(np.full((3, 4), float(k))))
    for read in (fits.read_pixels, asdf.read_images):
        rows = read(spark, str(tmp_path)).select("v", stem(), F.spark_partition_id().alias("task")).collect()
        assert sorted({(r.file[2:], r.v) for r in rows}) == sorted((str(k), float(k)) for k in range(12)) and len({r.task for r in rows}) > 1


def test_stems(spark):
    names = ["file:/a.b/c.d.fits", "x.fits", "/a.b/c", "c", "a/.fits", "a/b."]
    got = [r.file for r in spark.createDataFrame([(n,) for n in names], "file string").select(stem()).collect()]
    assert got == ["c.d", "x", "", "", "", "b"]


def test_tiles_are_counted_where_they_are_clipped(spark):
    """One join, with the sizes of the frames; tiles of less than eight valid samples don't count."""
    rows = spark.createDataFrame([(y, x, 1.0 + (y * 7 + x) % 5) for y in range(40) for x in range(40) if x < 32 or y < 7 and x == 32], "y long, x long, v double")
    found = background.tile_background(rows, [])
    assert found.first().tiles == 2 and found._jdf.queryExecution().analyzed().toString().count("Join") == 1
