"""Masked stretch: midtones pulled to a target background, stars held back by a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions.color import luminance_or_zero
from nebulark.functions.stretch import clamp, masked_mtf
from nebulark.functions.validity import finite, valid
from nebulark.operators.detection import detected
from nebulark.operators.lineage import checkpointed
from nebulark.operators.stats import masked_median

#: Target background, steps, part of the mask that protects, tolerance of the target, ceiling of luminance.
TARGET, ROUNDS, PROTECTION, TOLERANCE, CEILING = 0.25, 10, 0.85, 1e-5, 0.85


def smoothstep(t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * (3 - 2 * t)


def star_mask(stars: DataFrame, growth: float = 2.5, softness: float = 4.0) -> DataFrame:
    """Pixels (y, x) with mask: the greatest, over stars (x, y, fwhm within 1.5 to 30), of a soft disc of radius fwhm times
    growth.

    A star is exploded to the pixels of its own square; no join with all pixels.
    """
    r = F.col("fwhm") * growth
    reach = F.ceil(r + softness + 1).cast("int")
    rows = stars.where(F.col("fwhm").between(1.5, 30)).withColumns({"r": r, "k": reach, "cy": F.round("y").cast("int"), "cx": F.round("x").cast("int")})
    rows = rows.withColumn("py", F.explode(F.sequence(F.col("cy") - F.col("k"), F.col("cy") + F.col("k")))).withColumn("px", F.explode(F.sequence(F.col("cx") - F.col("k"), F.col("cx") + F.col("k"))))
    d2 = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
    inner, outer = F.col("r") * F.col("r"), F.pow(F.col("r") + softness, 2)
    value = F.when(d2 <= inner, 1.0).when(d2 > outer, 0.0).otherwise(1 - smoothstep((d2 - inner) / F.greatest(outer - inner, F.lit(1e-10))))
    return rows.where("py >= 0 AND px >= 0").groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max(value).alias("mask")).where("mask > 0")


def protected(pixels: DataFrame, mask: DataFrame, ceiling: float | None = 0.85) -> DataFrame:
    """pixels (y, x, v) with mask: that of the stars, or where it is less, how far a sample exceeds the ceiling; None: stars only."""
    rows = pixels.join(mask.select(F.col("y").cast(pixels.schema["y"].dataType).alias("y"), F.col("x").cast(pixels.schema["x"].dataType).alias("x"), "mask"), ["y", "x"], "left").withColumn("mask", F.coalesce("mask", F.lit(0.0)))
    if ceiling is None:
        return rows
    excess = smoothstep((F.col("v") - ceiling) / (1 - ceiling if ceiling < 1 else 1.0))
    return rows.withColumn("mask", F.when(finite("v") & (F.col("v") > ceiling) & (F.col("mask") < 1), F.greatest(F.col("mask"), excess)).otherwise(F.col("mask")))


def stretched(rows: DataFrame, target: float = TARGET, rounds: int = ROUNDS, protection: float = PROTECTION, tolerance: float = TOLERANCE) -> DataFrame:
    """rows (y, x, v, mask) scaled to 0 to 1 and stretched by midtone steps, with rounds, background and converged.

    Each step moves the median of unmasked samples to the target, and a sample as far as its mask lets it. It ends at the
    target, or once a step moves the median by less than a tenth of the tolerance. The driver learns one number a round,
    and each step's samples are checkpointed.
    """
    low, high = rows.where(valid("v")).agg(F.min("v"), F.max("v")).first()
    flat = high is None or high - low < 1e-10
    x = F.when(~finite("v") | (F.col("v") <= 0) | F.lit(flat), 0.0).otherwise(clamp((F.col("v") - F.lit(low or 0.0)) / F.lit(1.0 if flat else high - low)))
    rows = checkpointed(rows.select("y", "x", x.alias("v"), "mask"))
    now, held, before, run, converged = F.col("v"), F.col("mask") * protection, None, 0, False
    background = lambda: masked_median(rows, []).first()["median"] or 0.0
    for k in range(rounds):
        run, median = k + 1, background()
        converged = abs(median - target) < tolerance
        if converged or (k and abs(median - before) < tolerance / 10):
            break
        below = 2 * target * median - target - median
        midtone = 0.5 if abs(below) < 1e-15 else min(max(median * (target - 1) / below, 1e-4), 0.9999)
        step = F.when(now <= 0, 0.0).when(now >= 1, 1.0).otherwise(masked_mtf(now, F.lit(midtone)))
        rows, before = checkpointed(rows.withColumn("v", now * held + step * (1 - held))), median
    return rows.select("y", "x", clamp(now).alias("v"), F.lit(run).alias("rounds"), F.lit(background()).alias("background"), F.lit(converged).alias("converged"))


def masked_stretch(pixels: DataFrame, mask: DataFrame, target: float = TARGET, rounds: int = ROUNDS, protection: float = PROTECTION, ceiling: float | None = CEILING) -> DataFrame:
    """pixels (y, x, v) stretched about a mask of stars (y, x, mask)."""
    return stretched(protected(pixels, mask, ceiling), target, rounds, protection).select("y", "x", "v")


def masked_stretch_rgb(rgb: DataFrame, sigma: float = 5.0, ceiling: float | None = CEILING, **options) -> DataFrame:
    """Composites (y, x, r, g, b) stretched channel by channel about one mask, that of the stars of their luminance."""
    light = rgb.select("y", "x", luminance_or_zero(*(F.when(finite(c), F.col(c)) for c in "rgb")).alias("v"))
    mask = checkpointed(protected(light, star_mask(detected(light, [], sigma)), ceiling).select("y", "x", "mask"))
    out = None
    for c in "rgb":
        one = stretched(rgb.select("y", "x", F.col(c).alias("v")).join(mask, ["y", "x"]), **options).select("y", "x", F.col("v").alias(c))
        out = one if out is None else out.join(one, ["y", "x"])
    return out
