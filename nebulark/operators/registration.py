"""Transforms between star lists: rigid fits, robust affine fits, residuals and plausibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.operators.stars import affine_fit
from nebulark.operators.stats import join_keys

#: Hypotheses, distance of an inlier, least inliers and least part of them; stars that take part.
ROUNDS, REACH, LEAST, PART, STARS = 2000, 3.0, 4, 0.2, 120


def rigid_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rotation and translation that take (x, y) to (u, w) with least squares, from sums alone."""
    means = pairs.groupBy(*keys).agg(*(F.avg(c).alias(f"m{c}") for c in "xyuw"), F.count("*").alias("n"))
    x, y, u, w = (F.col(c) - F.col(f"m{c}") for c in "xyuw")
    s = join_keys(pairs, means, keys).groupBy(*keys, *(f"m{c}" for c in "xyuw"), "n").agg(F.sum(x * u + y * w).alias("dot"), F.sum(x * w - y * u).alias("cross"))
    angle = F.atan2("cross", "dot")
    c, si = F.cos(angle), F.sin(angle)
    return s.select(*keys, "n", F.degrees(angle).alias("rotation"), (F.col("mu") - c * F.col("mx") + si * F.col("my")).alias("tx"), (F.col("mw") - si * F.col("mx") - c * F.col("my")).alias("ty"))


def mean_residual(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the mean distance of (u, w) from where a fit (a, b, tx, c, d, ty) takes (x, y)."""
    u = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("tx")
    w = F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("ty")
    j = join_keys(pairs, fits.select(*keys, "a", "b", "tx", "c", "d", "ty"), keys)
    return j.groupBy(*keys).agg(F.avg(F.hypot(F.col("u") - u, F.col("w") - w)).alias("residual"))


def plausible(width: int, height: int) -> Column:
    """Whether a fit (a, b, tx, c, d, ty) moves, turns and scales an image within reason."""
    turn = F.abs(F.degrees(F.atan2("c", "a")))
    scales = F.hypot("a", "c").between(0.7, 1.4) & F.hypot("b", "d").between(0.7, 1.4)
    return (F.abs("tx") <= 0.4 * width) & (F.abs("ty") <= 0.4 * height) & (turn <= 30) & scales


def robust_affine(matches: DataFrame, order: Column, rounds: int = ROUNDS, reach: float = REACH, keys: list[str] = ()) -> DataFrame:
    """One row a key, or none if too few agree: an affine fit of its matches (x, y, u, w) to those that the best hypothesis
    takes within `reach`, with n, their number, and total.

    Only the first STARS matches of a key in the given order take part, which bounds the one array of them that each
    hypothesis reads. Hypotheses are rows, three matches each by hash of their number, so that reruns agree.
    """
    keys = list(keys)
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = matches.select(*keys, "x", "y", "u", "w", order.alias("o")).withColumn("rank", F.row_number().over(own.orderBy("o", "x", "y", "u", "w")))
    one = ranked.where(F.col("rank") <= STARS).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "y", "u", "w"))).alias("ms")).where(F.size("ms") >= LEAST)
    tried = one.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))))
    picks = [F.element_at("ms", (F.pmod(F.xxhash64("round", F.lit(k)), F.size("ms")) + 1).cast("int")).alias(f"p{k}") for k in range(3)]
    tried = tried.select(*keys, "round", "ms", *picks)
    side = lambda k, c: F.col(f"p{k}.{c}") - F.col(f"p0.{c}")
    det = side(1, "x") * side(2, "y") - side(2, "x") * side(1, "y")
    solve = lambda t: (F.try_divide(side(1, t) * side(2, "y") - side(2, t) * side(1, "y"), det), F.try_divide(side(1, "x") * side(2, t) - side(2, "x") * side(1, t), det))
    (a, b), (c, d) = solve("u"), solve("w")
    tried = tried.where(F.abs(det) > 1e-6).select(*keys, "round", "ms", F.col("p0").alias("p"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    off = lambda m: F.hypot(m["u"] - F.col("p.u") - F.col("a") * (m["x"] - F.col("p.x")) - F.col("b") * (m["y"] - F.col("p.y")), m["w"] - F.col("p.w") - F.col("c") * (m["x"] - F.col("p.x")) - F.col("d") * (m["y"] - F.col("p.y")))
    judged = tried.select(*keys, "round", F.size("ms").alias("total"), F.filter("ms", lambda m: off(m) < reach).alias("inliers"))
    best = judged.groupBy(*keys).agg(F.max_by(F.struct("inliers", "total"), F.struct(F.size("inliers"), -F.col("round"))).alias("s")).select(*keys, "s.*")
    agreed = best.where((F.size("inliers") >= LEAST) & (F.size("inliers") >= PART * F.col("total"))).select(*keys, "total", F.explode("inliers").alias("m")).select(*keys, "total", "m.*")
    return affine_fit(agreed, [*keys, "total"])


def psf_score(roundness: Column, snr: Column, distance: Column, fwhm: Column) -> Column:
    """How well a star serves for a point-spread function."""
    return 0.35 * roundness + 0.3 * F.least(snr / 100, F.lit(1.0)) + 0.15 / (1 + distance / 500) + 0.2 / (1 + F.abs(fwhm - 4) / 4)
