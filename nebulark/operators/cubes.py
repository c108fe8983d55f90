"""Spectral cubes: voxels (cube, z, y, x, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.functions.validity import finite, nonzero
from nebulark.operators.stats import MAD_SIGMA, join_keys, medians, order_stats, upper_median


def collapsed(voxels: DataFrame, how: str = "mean", ok=nonzero) -> DataFrame:
    """Mean or upper median along z of the samples that count; 0 for a pixel without any."""
    agg = F.avg("s") if how == "mean" else upper_median("s")
    return voxels.withColumn("s", F.when(ok("v"), F.col("v").cast("double"))).groupBy("cube", "y", "x").agg(F.coalesce(agg, F.lit(0.0)).alias("v"))


def spectrum(voxels: DataFrame, y: int, x: int) -> DataFrame:
    return voxels.where((F.col("y") == y) & (F.col("x") == x)).select("cube", "z", "v")


def global_stats(voxels: DataFrame, ok=nonzero) -> DataFrame:
    """Per cube upper median, sigma, and the samples at 1 % and 99.9 % of the sorted ones."""
    some = voxels.where(ok("v")).select("cube", F.col("v").cast("double").alias("v"))
    centre = medians(some, ["cube"], upper=True)
    away = join_keys(some, centre.select("cube", "median"), ["cube"]).select("cube", F.abs(F.col("v") - F.col("median")).alias("v"))
    spread = medians(away, ["cube"], upper=True).select("cube", (F.col("median") * MAD_SIGMA).alias("sigma"))
    return centre.join(spread, "cube").join(order_stats(voxels, ["cube"], {"low": 0.01, "high": 0.999}, ok=ok), "cube")


def asinh_frames(voxels: DataFrame, stats: DataFrame, alpha: float = 10.0) -> DataFrame:
    """Finite voxels clamped to the cube's low and high, about its median, as asinh; others 0."""
    j = join_keys(voxels, stats.select("cube", "median", "sigma", "low", "high"), ["cube"])
    v = F.greatest("low", F.least("high", F.col("v").cast("double")))
    y = F.asinh(alpha * (v - F.col("median")) / F.greatest("sigma", F.lit(1e-10)))
    return j.select("cube", "z", "y", "x", F.when(finite("v"), y).otherwise(0.0).alias("v"))


def sampled_frames(voxels: DataFrame, step: int) -> DataFrame:
    return voxels.where(F.col("z") % step == 0)
