"""Synthetic star fields, vignettes and noise from hashes of positions: the same rows on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*key: Column | int | str) -> Column:
    """In (0, 1), from a hash of the key."""
    parts = [F.lit(k) if isinstance(k, (int, str)) else k for k in key]
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def normal(*key: Column | int | str) -> Column:
    return F.sqrt(-2 * F.ln(uniform(*key, 1))) * F.cos(2 * F.pi() * uniform(*key, 2))


def star_field(spark: SparkSession, n: int, width: int, height: int, seed: int = 1, alpha: float = 2.5, low: float = 10.0, high: float = 1e4) -> DataFrame:
    """star_id, x, y and flux; fluxes follow a power law."""
    i, k = F.col("id"), 1 - alpha
    flux = F.pow(low**k + uniform(i, seed, 3) * (high**k - low**k), F.lit(1 / k))
    return spark.range(n).select(i.alias("star_id"), (uniform(i, seed, 1) * width).alias("x"), (uniform(i, seed, 2) * height).alias("y"), flux.alias("flux"))


def rendered(stars: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Sums of Gaussian discs of four sigma around stars: y, x, v; each star is exploded to its own pixels."""
    k = int(4 * sigma) + 1
    rows = stars.withColumns({"cy": F.round("y").cast("int"), "cx": F.round("x").cast("int")})
    rows = rows.withColumn("py", F.explode(F.sequence(F.col("cy") - k, F.col("cy") + k))).withColumn("px", F.explode(F.sequence(F.col("cx") - k, F.col("cx") + k)))
    d2 = F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2)
    light = F.col("flux") * F.exp(-d2 / (2 * sigma * sigma)) / (2 * F.pi() * sigma * sigma)
    return rows.where((d2 <= 16 * sigma * sigma) & (F.col("py") >= 0) & (F.col("px") >= 0)).groupBy(F.col("py").alias("y"), F.col("px").alias("x")).agg(F.sum(light).alias("v"))


def canvas(spark: SparkSession, width: int, height: int) -> DataFrame:
    return spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


def vignette(spark: SparkSession, width: int, height: int, strength: float = 0.3, seed: int = 1) -> DataFrame:
    """A flat field: 1 less strength times the squared distance from the centre, with one per cent of noise."""
    r2 = (F.pow(F.col("y") / height - 0.5, 2) + F.pow(F.col("x") / width - 0.5, 2)) / 0.5
    noise = 1 + 0.01 * (2 * uniform(F.col("y"), F.col("x"), seed) - 1)
    return canvas(spark, width, height).withColumn("v", F.greatest(F.lit(0.01), (1 - strength * r2) * noise))


def noisy(pixels: DataFrame, gain: float = 1.0, read_noise: float = 5.0, bias: float = 100.0, seed: int = 1) -> DataFrame:
    """Shot noise (in its normal limit), read noise and bias; never below 0."""
    electrons = F.greatest(F.col("v") * gain, F.lit(0.0))
    shot = electrons + F.sqrt(electrons) * normal(F.col("y"), F.col("x"), seed, 1)
    out = (F.greatest(shot, F.lit(0.0)) + read_noise * normal(F.col("y"), F.col("x"), seed, 2)) / gain + bias
    return pixels.withColumn("v", F.greatest(out, F.lit(0.0)))
