"""Point-spread functions measured on stars: candidates, widths at half maximum, signal, quality, cutouts and their mean.

A star meets the samples around it through cells of the image: it looks into the few cells that its window touches.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.operators.lineage import checkpointed
from nebulark.operators.spatial import local_maxima
from nebulark.operators.stats import join_keys, upper_median

#: Side of the cells through which stars meet samples.
CELL = 16
#: Fixed value: width at half maximum of a Gaussian of unit deviation.
WIDTH = 2 * sqrt(2 * log(2))
#: A width where none can be measured, and the bounds of one.
UNKNOWN, BOUNDS = 4.0, (1.0, 30.0)


@dataclass(frozen=True)
class Rules:
    """Fixed values, by default: of candidates sigma, search radius and margin, reach of centroid, ring and moments, and the widths
    and least signal that count; of stars for a kernel peak (over the image's greatest), ellipticity, distance from the
    centre (over half the diagonal), number and cutout radius."""

    sigma: float = 5.0
    search: int = 5
    margin: int = 30
    centroid: int = 3
    ring: int = 10
    moments: int = 12
    widths: tuple[float, float] = (1.5, 20.0)
    signal: float = 10.0
    peaks: tuple[float, float] = (0.10, 0.95)
    ellipticity: float = 0.3
    centre: float = 0.7
    stars: int = 30
    radius: int = 15


def levels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame h, w, deviation (of the population), greatest sample and upper median, of all samples."""
    return pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.stddev_pop("v").alias("deviation"), F.max("v").alias("most"), upper_median("v").alias("median"))


def samples_around(stars: DataFrame, pixels: DataFrame, keys: list[str], y: str, x: str, reach: Column | int, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Rows of stars with each sample (py, px, values) of their frame that is within reach of (y, x) in rows and in columns."""
    reach = F.lit(reach) if isinstance(reach, int) else reach
    cells = lambda c: F.sequence(F.floor((F.col(c) - reach) / CELL), F.floor((F.col(c) + reach) / CELL))
    asked = stars.withColumn("gy", F.explode(cells(y))).withColumn("gx", F.explode(cells(x)))
    rows = pixels.select(*keys, F.col("y").alias("py"), F.col("x").alias("px"), *values, F.floor(F.col("y") / CELL).alias("gy"), F.floor(F.col("x") / CELL).alias("gx"))
    met = join_keys(asked, rows, [*keys, "gy", "gx"]).drop("gy", "gx")
    return met.where((F.abs(F.col("py") - F.col(y)) <= reach) & (F.abs(F.col("px") - F.col(x)) <= reach))


def nine(y: str, x: str) -> list[Column]:
    """Aggregates of the nine samples about (y, x), v00 to v22; null beyond the image."""
    at = lambda i, j: (F.col("py") - F.col(y) == i - 1) & (F.col("px") - F.col(x) == j - 1)
    return [F.max(F.when(at(i, j), F.col("v"))).alias(f"v{i}{j}") for i in range(3) for j in range(3)]


def peak() -> Column:
    """The greatest value of the paraboloid through nine samples; the middle one where it has none within a sample's reach."""
    v = lambda i, j: F.col(f"v{i}{j}")
    c = v(1, 1)
    gx, gy = (v(1, 2) - v(1, 0)) / 2, (v(2, 1) - v(0, 1)) / 2
    xx, yy, xy = v(1, 2) + v(1, 0) - 2 * c, v(2, 1) + v(0, 1) - 2 * c, (v(2, 2) + v(0, 0) - v(0, 2) - v(2, 0)) / 4
    det = xx * yy - xy * xy
    sx, sy = F.try_divide(xy * gy - yy * gx, det), F.try_divide(xy * gx - xx * gy, det)
    inside = (det >= 1e-12) & (F.abs(sx) <= 1) & (F.abs(sy) <= 1)
    return F.when(F.coalesce(inside, F.lit(False)), c + (gx * sx + gy * sy) / 2).otherwise(c)


def middle_mean(values: Column) -> Column:
    """The mean of the middle half of some values, one at least; 0 for none."""
    n, ordered = F.size(values), F.array_sort(values)
    low = (n / 4).cast("int")
    high = F.least(F.greatest((n * 3 / 4).cast("int"), low + 1), n)
    return F.when(n > 0, F.aggregate(F.slice(ordered, low + 1, F.greatest(high - low, F.lit(1))), F.lit(0.0), lambda s, x: s + x) / (high - low)).otherwise(0.0)


def candidates(pixels: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """Local maxima beyond median + sigma deviations and away from the edge: keys, y, x, what levels() gives, the centroid (cy,
    cx) of the samples about it, and its peak. Of equal samples within the search radius the first in row order counts."""
    ground = checkpointed(levels(pixels, keys))
    lit = join_keys(pixels.select(*keys, "y", "x", "v"), ground, keys).where(F.col("v") >= F.col("median") + rules.sigma * F.col("deviation"))
    tops = join_keys(local_maxima(lit.select(*keys, "y", "x", "v"), keys, rules.search, float("-inf")).drop("v"), ground, keys)
    inner = lambda c, side: (F.col(c) >= rules.margin) & (F.col(c) < F.col(side) - rules.margin)
    own = [c for c in tops.columns]
    met = samples_around(tops.where(inner("y", "h") & inner("x", "w")), pixels, keys, "y", "x", rules.centroid)
    total = lambda x: F.sum(x * F.col("v"))
    found = met.groupBy(*own).agg(F.sum("v").alias("s"), total(F.col("py")).alias("sy"), total(F.col("px")).alias("sx"), *nine("y", "x"))
    centre = lambda c: F.when(F.col("s") > 0, F.col(f"s{c}") / F.col("s")).otherwise(F.col(c)).alias(f"c{c}")
    return found.select(*own, centre("y"), centre("x"), peak().alias("peak"))


def widths(stars: DataFrame, pixels: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """stars (cy, cx) with iy, ix, background (of a ring) and major and minor width at half maximum, by the moments of the
    samples above it. A window's samples, at most (2 moments + 1) squared, are one list."""
    own = stars.withColumns({"iy": F.round("cy").cast("long"), "ix": F.round("cx").cast("long")})
    reach = max(rules.moments, rules.ring)
    met = samples_around(own, pixels, keys, "iy", "ix", reach)
    near = (F.abs(F.col("py") - F.col("iy")) <= rules.moments) & (F.abs(F.col("px") - F.col("ix")) <= rules.moments)
    d2 = F.pow(F.col("py") - F.col("iy"), 2) + F.pow(F.col("px") - F.col("ix"), 2)
    in_ring = (d2 >= (0.6 * rules.ring) ** 2) & (d2 <= rules.ring**2)
    sample = F.struct((F.col("py") - F.col("cy")).alias("y"), (F.col("px") - F.col("cx")).alias("x"), "v")
    got = met.groupBy(*own.columns).agg(F.collect_list(F.when(near, sample)).alias("window"), F.collect_list(F.when(in_ring, F.col("v"))).alias("around"), *nine("iy", "ix"))
    got = got.withColumns({"background": middle_mean(F.col("around")), "top": peak()})
    net, half = F.col("top") - F.col("background"), (F.col("top") + F.col("background")) / 2
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("w", "yy", "xx", "xy")))
    add = lambda s, p, w: F.struct((s["w"] + w).alias("w"), (s["yy"] + w * p["y"] * p["y"]).alias("yy"), (s["xx"] + w * p["x"] * p["x"]).alias("xx"), (s["xy"] + w * p["x"] * p["y"]).alias("xy"))
    m = F.aggregate(F.filter("window", lambda p: p["v"] >= half), zero, lambda s, p: add(s, p, p["v"] - F.col("background")))
    got = got.withColumn("m", m)
    yy, xx, xy = (F.try_divide(F.col(f"m.{c}"), F.col("m.w")) for c in ("yy", "xx", "xy"))
    root = F.sqrt(F.greatest((xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy), F.lit(0.0)))
    known = (net > 0) & (F.col("m.w") > 0)
    width = lambda sign: F.when(known, F.least(F.greatest(WIDTH * F.sqrt(F.greatest((xx + yy + sign * root) / 2, F.lit(0.0))), F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))).otherwise(UNKNOWN)
    return got.select(*own.columns, "background", width(1).alias("major"), width(-1).alias("minor"))


def measured(pixels: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """Stars for a point-spread function: keys, star (its place in row order), y and x of the centroid, iy and ix, peak, flux
    (the sum within 1.5 widths), fwhm, ellipticity, distance from the centre, snr, and the frame's h, w and most."""
    stars = checkpointed(widths(candidates(pixels, keys, rules), pixels, keys, rules))
    fwhm = (F.col("major") + F.col("minor")) / 2
    stars = stars.withColumns({"fwhm": fwhm, "ellipticity": 1 - F.least("major", "minor") / F.greatest("major", "minor")})
    own = ["y", "x", "cy", "cx", "iy", "ix", "h", "w", "most", "peak", "fwhm", "ellipticity"]
    met = samples_around(stars.select(*keys, *own), pixels, keys, "iy", "ix", F.ceil(3 * F.col("fwhm")) + 1)
    d2 = F.pow(F.col("py") - F.col("cy"), 2) + F.pow(F.col("px") - F.col("cx"), 2)
    size = F.col("fwhm")
    light, ring = d2 <= F.pow(1.5 * size, 2), (d2 >= F.pow(2 * size, 2)) & (d2 <= F.pow(3 * size, 2))
    got = met.groupBy(*keys, *own).agg(F.coalesce(F.sum(F.when(light, F.col("v"))), F.lit(0.0)).alias("flux"), F.collect_list(F.when(ring, F.col("v"))).alias("around"))  # at most 90 samples wide
    got = got.withColumn("ground", middle_mean(F.col("around")))
    snr = F.when(F.col("ground") > 0, F.col("flux") / F.sqrt("ground")).otherwise(F.col("flux"))
    away = F.hypot(F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2)
    out = got.select(*keys, (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("star"), F.col("cy").alias("y"), F.col("cx").alias("x"), "iy", "ix", "peak", "flux", "fwhm", "ellipticity", away.alias("distance"), snr.alias("snr"), "h", "w", "most")
    return out.where((F.col("fwhm") > rules.widths[0]) & (F.col("fwhm") < rules.widths[1]) & (F.col("snr") > rules.signal))


def good(rules: Rules = Rules()) -> Column:
    """Whether a measured star is away from the edge, neither saturated nor faint, round, and near the centre."""
    part, far = F.col("peak") / F.col("most"), F.hypot(F.col("w") / 2, F.col("h") / 2) * rules.centre
    inside = (F.col("x") >= rules.margin) & (F.col("y") >= rules.margin) & (F.col("x") < F.col("w") - rules.margin) & (F.col("y") < F.col("h") - rules.margin)
    return inside & (part < rules.peaks[1]) & (part > rules.peaks[0]) & (F.col("ellipticity") < rules.ellipticity) & (F.col("distance") < far)


def score() -> Column:
    """How fit a star is: round, bright, near the centre, and of a usual width."""
    return 0.35 * (1 - F.col("ellipticity")) + 0.30 * F.least(F.col("snr") / 100, F.lit(1.0)) + 0.15 / (1 + F.col("distance") / 500) + 0.20 / (1 + F.abs(F.col("fwhm") - 4) / 4)


def chosen(stars: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """The best good stars of each frame, with score and candidates, the number of good ones; ties go to the first in row order."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = stars.where(good(rules)).withColumn("score", score())
    ranked = ranked.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("score"), "star")), "candidates": F.count("*").over(own)})
    return ranked.where(F.col("rank") <= rules.stars)


def cutouts(stars: DataFrame, pixels: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Squares of samples (keys, star, y, x from 0 to 2 radius, v) about each star (iy, ix) whose square lies in its frame."""
    whole = lambda c, side: (F.col(c) >= radius) & (F.col(c) + radius < F.col(side))
    met = samples_around(stars.where(whole("iy", "h") & whole("ix", "w")).select(*keys, "star", "iy", "ix"), pixels, keys, "iy", "ix", radius)
    return met.select(*keys, "star", (F.col("py") - F.col("iy") + radius).alias("y"), (F.col("px") - F.col("ix") + radius).alias("x"), "v")


def recentred(cuts: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Cutouts moved, between samples linearly, so that their centroid is the middle sample; 0 flows in from outside.

    A cutout moves by one offset, so each of its samples goes to four cells with the same four weights.
    """
    own = [*keys, "star"]
    v = F.col("v")
    m = cuts.groupBy(*own).agg(F.sum("v").alias("s"), F.sum(v * F.col("y")).alias("sy"), F.sum(v * F.col("x")).alias("sx"))
    back = lambda c: F.when(F.col("s") > 0, F.col(f"s{c}") / F.col("s") - radius).otherwise(0.0)  # noqa: E731  where a cell reads from
    m = m.select(*own, back("y").alias("by"), back("x").alias("bx"))
    rows = join_keys(cuts, m, own)
    part = lambda c: F.col(f"b{c}") - F.floor(f"b{c}")
    to = lambda c, k: (F.col(c) - F.floor(f"b{c}") - k).alias(c)
    weight = lambda c, k: part(c) if k else 1 - part(c)
    cells = F.array(*(F.struct(to("y", i), to("x", j), (weight("y", i) * weight("x", j)).alias("p")) for i in (0, 1) for j in (0, 1)))
    moved = rows.select(*own, v, F.explode(cells).alias("c")).where(F.col("c.y").between(0, 2 * radius) & F.col("c.x").between(0, 2 * radius))
    return moved.groupBy(*own, F.col("c.y").alias("y"), F.col("c.x").alias("x")).agg(F.sum(v * F.col("c.p")).alias("v"))


def unit_sum(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Samples over their sum, where it is above 0."""
    total = cuts.groupBy(*keys).agg(F.sum("v").alias("s"))
    return join_keys(cuts, total, keys).select(*keys, "y", "x", F.when(F.col("s") > 0, F.col("v") / F.col("s")).otherwise(F.col("v")).alias("v"))


def kernel(stars: DataFrame, pixels: DataFrame, keys: list[str], radius: int = 15) -> DataFrame:
    """The point-spread function of each frame (keys, y, x, v, dense, summing to 1): the mean of its stars' recentred cutouts."""
    each = unit_sum(recentred(cutouts(stars, pixels, keys, radius), keys, radius), [*keys, "star"])
    n = each.groupBy(*keys).agg(F.count_distinct("star").alias("n")).where("n > 0")
    side = F.sequence(F.lit(0).cast("long"), F.lit(2 * radius).cast("long"))
    grid = n.withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    total = each.groupBy(*keys, "y", "x").agg(F.sum("v").alias("t"))
    mean = join_keys(grid, total, [*keys, "y", "x"], "left").select(*keys, "y", "x", (F.coalesce("t", F.lit(0.0)) / F.col("n")).alias("v"))
    return unit_sum(mean, keys)


def spread(kernels: DataFrame, keys: list[str]) -> DataFrame:
    """The root of the mean squared distance from the middle, weighed by a kernel; 0 for an empty one."""
    middle = kernels.groupBy(*keys).agg((F.max("y") / 2).alias("my"), (F.max("x") / 2).alias("mx"))
    d2 = F.pow(F.col("y") - F.col("my"), 2) + F.pow(F.col("x") - F.col("mx"), 2)
    s = join_keys(kernels, middle, keys).groupBy(*keys).agg(F.sum(d2 * F.col("v")).alias("a"), F.sum("v").alias("b"))
    return s.select(*keys, F.when(F.col("b") > 0, F.sqrt(F.col("a") / F.col("b"))).otherwise(0.0).alias("spread"))


def estimated(pixels: DataFrame, keys: list[str], rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """The kernel of each frame, and its mean fwhm and ellipticity, stars (with a whole cutout), rejected (good stars that it
    isn't made of) and spread. Frames without good stars have neither; if no frame has any, it is an error."""
    pixels = checkpointed(pixels.select(*keys, "y", "x", F.col("v").cast("double").alias("v")))
    stars = checkpointed(chosen(measured(pixels, keys, rules), keys, rules))
    if stars.isEmpty():
        raise ValueError("no star passed the quality rules")
    found = checkpointed(kernel(stars, pixels, keys, rules.radius))
    whole = (F.col("iy") >= rules.radius) & (F.col("ix") >= rules.radius) & (F.col("iy") + rules.radius < F.col("h")) & (F.col("ix") + rules.radius < F.col("w"))
    means = stars.groupBy(*keys).agg(F.avg("fwhm").alias("fwhm"), F.avg("ellipticity").alias("ellipticity"), F.sum(whole.cast("long")).alias("stars"), (F.max("candidates") - F.sum(whole.cast("long"))).alias("rejected"))
    return found, join_keys(means, spread(found, keys), keys)
