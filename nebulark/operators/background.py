"""Background models: samples on a grid, a polynomial through them, and its correction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions.validity import finite, positive, valid
from nebulark.operators.spatial import size_of
from nebulark.operators.stacking import clipped_stats
from nebulark.operators.stats import join_keys, upper_median


def tile_background(pixels: DataFrame, keys: list[str], tile: int | None = None) -> DataFrame:
    """Per frame background and sigma: upper medians of clipped statistics of tiles that have eight valid samples."""
    dims = size_of(pixels, keys)
    side = F.lit(tile) if tile else F.greatest(F.lit(32), F.least(F.lit(256), F.floor(F.least("h", "w") / 8)))
    rows = join_keys(pixels.where(valid("v")), dims.withColumn("s", side), keys)
    rows = rows.select(*keys, F.floor(F.col("y") / F.col("s")).alias("ty"), F.floor(F.col("x") / F.col("s")).alias("tx"), "v")
    tiles = clipped_stats(rows, [*keys, "ty", "tx"], 3.0, 2, least=8)
    return tiles.groupBy(*keys).agg(upper_median("median").alias("background"), upper_median("sigma").alias("sigma"), F.count("*").alias("tiles"))


def samples(pixels: DataFrame, grid: int = 8, kappa: float = 2.5, passes: int = 3) -> DataFrame:
    """Grid cells' medians over the inner half of each (y, x in -0.5 to 0.5, v), within kappa sigma of all samples.

    A cell with more than 30 % of invalid samples is skipped; the clipping of the few cells repeats `passes` times.
    """
    cells = size_of(pixels, [])
    rows = join_keys(pixels, cells, [])
    cy, cx = F.col("h") / grid, F.col("w") / grid
    gy, gx = F.floor(F.col("y") / cy), F.floor(F.col("x") / cx)
    inner = lambda at, g, c: (at >= g * c + c / 4) & (at < (g + 1) * c - c / 4)
    rows = rows.where(inner(F.col("y"), gy, cy) & inner(F.col("x"), gx, cx))
    ok = positive("v")
    found = rows.groupBy(gy.alias("gy"), gx.alias("gx")).agg(F.median(F.when(ok, F.col("v"))).alias("v"), F.avg(ok.cast("int")).alias("part")).where("part >= 0.7")
    found = found.select(((F.col("gy") + 0.5) / grid - 0.5).alias("y"), ((F.col("gx") + 0.5) / grid - 0.5).alias("x"), "v")
    for _ in range(passes):
        m = found.agg(F.median("v").alias("m"))
        d = join_keys(found, m, []).groupBy("m").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("d"))
        found = join_keys(found, d, []).where(F.abs(F.col("v") - F.col("m")) <= kappa * F.greatest(F.col("d") * 1.4826, F.lit(1e-10))).select("y", "x", "v")
    return found


def basis(y: Column, x: Column, degree: int) -> list[Column]:
    """Monomials by total degree, then falling powers of y."""
    return [F.pow(y, F.lit(float(k - j))) * F.pow(x, F.lit(float(j))) for k in range(degree + 1) for j in range(k + 1)]


def fit(found: DataFrame, degree: int = 3, ridge: float = 1e-8) -> list[float]:
    """Coefficients of the polynomial through samples; Spark sums the normal equations, whose size the degree bounds."""
    terms = basis(F.col("y"), F.col("x"), degree)
    n = len(terms)
    sums = found.agg(F.count("*").alias("n"), *(F.sum(a * b) for a in terms for b in terms), *(F.sum(a * F.col("v")) for a in terms)).first()
    if sums[0] < n + 2:
        raise ValueError("too few background samples for this degree")
    values = np.array(sums[1:], float)
    return np.linalg.solve(values[: n * n].reshape(n, n) + ridge * np.eye(n), values[n * n :]).tolist()


def model(pixels: DataFrame, coefficients: list[float], degree: int) -> DataFrame:
    rows = join_keys(pixels, size_of(pixels, []), [])
    terms = basis(F.col("y") / F.col("h") - 0.5, F.col("x") / F.col("w") - 0.5, degree)
    return rows.select("y", "x", "v", sum((c * t for c, t in zip(coefficients[1:], terms[1:])), coefficients[0] * terms[0]).alias("bg"))


def corrected(modelled: DataFrame, how: str = "subtract") -> DataFrame:
    """Samples less the model plus its median, or over the model times its median."""
    m = modelled.where("bg > 0").agg(F.coalesce(F.median("bg"), F.lit(0.0)).alias("m"))
    j = join_keys(modelled, m, [])
    v = F.col("v") - F.col("bg") + F.col("m") if how == "subtract" else F.when(F.abs("bg") > 1e-10, F.try_divide(F.col("v"), F.col("bg")) * F.col("m")).otherwise(F.col("v"))
    return j.select("y", "x", F.when(finite("v"), v).otherwise(F.col("v")).alias("v"))


def residual(found: DataFrame, coefficients: list[float], degree: int) -> DataFrame:
    """n and rms of samples (y, x, v) about a polynomial."""
    value = sum((c * t for c, t in zip(coefficients, basis(F.col("y"), F.col("x"), degree))), F.lit(0.0))
    return found.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("v") - value, F.lit(2.0)))).alias("rms"))
