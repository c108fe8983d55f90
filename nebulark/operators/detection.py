"""Star detection from end to end: background, threshold, components, moments, ranges, brightest first, no two too close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions.color import luminance_or_zero
from nebulark.functions.validity import finite
from nebulark.operators.background import tile_background
from nebulark.operators.lineage import checkpointed
from nebulark.operators.spatial import component_moments, labelled, size_of
from nebulark.operators.stars import deduplicated
from nebulark.operators.stats import join_keys, normalized

#: Samples of a star, its width, distance of two stars, least side of an image.
SAMPLES, WIDTH, APART, LEAST_SIDE = (3, 5000), (0.5, 30.0), 3.0, 3


def levels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Background and sigma of each frame; 0 and 1 where no tile has enough samples."""
    tiles = tile_background(pixels, keys)
    frames = size_of(pixels, keys)
    out = join_keys(frames, tiles, keys, "left") if keys else frames.join(tiles, F.lit(True), "left")  # one row each
    return out.select(*keys, "h", "w", F.coalesce("background", F.lit(0.0)).alias("background"), F.greatest(F.coalesce("sigma", F.lit(1.0)), F.lit(1e-10)).alias("sigma"))


def snr(peak: Column, sigma: Column) -> Column:
    """Peak above the background over its sigma; 0 without one."""
    return F.when(sigma <= 2.220446049250313e-16, 0.0).otherwise(F.try_divide(peak, sigma))


def detected(pixels: DataFrame, keys: list[str], sigma: float = 5.0) -> DataFrame:
    """Stars of each frame (y, x, v, dense): keys, star_id (the first sample of the component in row order), x, y, flux,
    fwhm, eccentricity, peak, npix, snr, background and sigma.

    Of components of samples above background + sigma times its deviation, those count that have 3 to 5000 samples and a
    width of 0.5 to 30; of stars within 3 samples of each other the brightest stays. Frames with less than 3 rows or
    columns have none. Background, components and neighbours are joins and aggregates by frame and tile, run or cell.
    """
    pixels = checkpointed(pixels.select(*keys, "y", "x", "v").repartition(*keys, "y"))  # read several times from here on
    ground = checkpointed(levels(pixels, keys))
    rows = join_keys(pixels, ground.drop("h", "w"), keys)
    found = labelled(rows, keys, F.col("background") + sigma * F.col("sigma"))
    own = join_keys(found, ground, keys).where((F.col("h") >= LEAST_SIDE) & (F.col("w") >= LEAST_SIDE))
    above = own.withColumn("v", F.greatest(F.col("v") - F.col("background"), F.lit(0.0))).select(*keys, "y", "x", "v", "label")
    stars = component_moments(above, keys).where(F.col("npix").between(*SAMPLES) & F.col("fwhm").between(*WIDTH))
    stars = checkpointed(join_keys(stars.withColumnRenamed("label", "star_id"), ground.drop("h", "w"), keys))
    return deduplicated(stars.withColumn("snr", snr(F.col("peak"), F.col("sigma"))), APART, keys)


def detected_composite(rgb: DataFrame, keys: list[str], sigma: float = 5.0) -> DataFrame:
    """Stars of composites (keys, y, x, r, g, b): of their luminance, scaled to 0 to 1."""
    light = rgb.select(*keys, "y", "x", luminance_or_zero(*(F.when(finite(c), F.col(c)) for c in "rgb")).alias("v"))
    return detected(normalized(light, keys, "minmax").select(*keys, "y", "x", F.col("norm").alias("v")), keys, sigma)


def brightest(stars: DataFrame, n: int = 200, by: str = "flux") -> DataFrame:
    """The n first stars by flux, or by signal to noise."""
    return stars.orderBy(F.desc(by), "star_id").limit(n)
