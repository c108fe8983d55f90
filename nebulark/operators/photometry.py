"""Photometric colour calibration: stars of a composite, their place in the sky, catalogue colours, and factors of channels."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.functions.color import luminance
from nebulark.functions.sky import Wcs
from nebulark.functions.validity import valid
from nebulark.operators.compose import colour_index, white_reference
from nebulark.operators.detection import brightest, detected
from nebulark.operators.lineage import checkpointed
from nebulark.operators.psf import samples_around
from nebulark.operators.spatial import size_of
from nebulark.operators.stars import color_factors, cross_match
from nebulark.operators.stats import join_keys

#: Level of detection, least signal, part of the greatest sample, margin, stars that are used, fewest of them, fewest matches, and a match's reach in samples.
SIGMA, SIGNAL, SATURATION, MARGIN, STARS, FEWEST, MATCHES, REACH = 5.0, 20.0, 0.90, 10, 200, 5, 3, 3.0
#: An aperture in widths, at least in samples, and its ring in apertures.
APERTURE, LEAST, RING = 1.5, 3.0, (1.2, 1.8)


def usable(rgb: DataFrame, signal: float = SIGNAL, saturation: float = SATURATION, most: int = STARS) -> DataFrame:
    """Stars of a composite's luminance with enough signal that are neither saturated nor near the edge, the strongest first."""
    light = checkpointed(rgb.select("y", "x", luminance(*map(F.col, "rgb")).alias("v")))
    facts = size_of(light, []).crossJoin(F.broadcast(light.where(valid("v")).agg(F.max("v").alias("most"))))  # one row each
    inside = (F.col("x") >= MARGIN) & (F.col("y") >= MARGIN) & (F.col("x") < F.col("w") - MARGIN) & (F.col("y") < F.col("h") - MARGIN)
    good = join_keys(detected(light, [], SIGMA), facts, []).where((F.col("snr") >= signal) & (F.col("peak") < saturation * F.col("most")) & inside)
    return brightest(good, most, "snr")


def channel_fluxes(stars: DataFrame, rgb: DataFrame) -> DataFrame:
    """star_id and r, g and b: the light within 1.5 widths (3 samples at least) less that of as large an area of the ring, not below 0."""
    own = stars.select("star_id", "y", "x", F.greatest(APERTURE * F.col("fwhm"), F.lit(LEAST)).alias("radius"))
    met = samples_around(own, rgb, [], "y", "x", F.ceil(RING[1] * F.col("radius")) + 1, ("r", "g", "b"))
    d2, r2 = F.pow(F.col("py") - F.col("y"), 2) + F.pow(F.col("px") - F.col("x"), 2), F.pow("radius", F.lit(2.0))
    disc, ring = d2 <= r2, (d2 > r2) & (d2 >= RING[0] ** 2 * r2) & (d2 <= RING[1] ** 2 * r2)
    light = lambda c: F.greatest(F.coalesce(F.sum(F.when(disc, F.col(c))), F.lit(0.0)) - F.coalesce(F.avg(F.when(ring, F.col(c))), F.lit(0.0)) * pi * F.first(r2), F.lit(0.0)).alias(c)
    return met.groupBy("star_id").agg(*map(light, "rgb"))


def calibrated(rgb: DataFrame, wcs: Wcs, catalog: DataFrame | None = None, white: str = "spiral", custom: tuple[float, float, float] = (1.0, 1.0, 1.0), signal: float = SIGNAL, saturation: float = SATURATION, most: int = STARS) -> DataFrame:
    """One row: factors of red, green (1) and blue of a composite (y, x, r, g, b), its stars, matches and their mean colour index.

    catalog: cat_id, ra, dec and bp_rp; a star's entry is the nearest within three samples. Without a catalogue a star's
    index is guessed from its shape. Fewer than five stars or three matches with light in all channels are an error.
    """
    stars = checkpointed(usable(rgb, signal, saturation, most))
    total = stars.count()
    if total < FEWEST:
        raise ValueError(f"only {total} stars passed the quality rules, {FEWEST} are needed")
    if catalog is None:
        indexed = stars.withColumn("bp_rp", colour_index(F.col("flux"), F.col("peak"), F.col("fwhm")))
    else:
        ra, dec = wcs.to_world("x", "y")
        found = cross_match(stars.select("star_id", ra.alias("ra"), dec.alias("dec")), catalog, REACH * wcs.pixel_scale())
        indexed = stars.join(found, "star_id").join(catalog.select("cat_id", "bp_rp"), "cat_id")
    matched = checkpointed(indexed.join(channel_fluxes(indexed, rgb), "star_id").select("star_id", "bp_rp", "r", "g", "b"))
    out = color_factors(matched, white_reference(white, custom)).withColumn("stars", F.lit(total).cast("long")).withColumnRenamed("n", "matched")
    few = F.concat(F.lit("only "), F.col("matched").cast("string"), F.lit(f" stars matched, {MATCHES} are needed"))
    return out.withColumn("matched", F.when(F.col("matched") < MATCHES, F.raise_error(few).cast("long")).otherwise(F.col("matched")))
