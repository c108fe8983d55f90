"""Neighbourhoods, grids and resampling: smoothing and maxima work on tiles with halos; other neighbours come by exploding a
sample to the cells that read it, never by joining every pixel with every other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.functions.stretch import hard_threshold, soft_threshold
from nebulark.functions.validity import finite
from nebulark.operators import tiles
from nebulark.operators.lineage import checkpointed
from nebulark.operators.stats import MAD_SIGMA, join_keys, medians

#: The B3 spline, thresholds of scales and noise of scales of white noise; width at half maximum of a unit Gaussian.
B3 = (1, 4, 6, 4, 1)
FWHM = 2.3548200450309493
THRESHOLDS = (3.0, 2.5, 2.0, 1.5, 1.0)
SCALE_NOISE = (0.8908, 0.2007, 0.0856, 0.0413, 0.0205, 0.0103, 0.0051)
#: Scales that come from one pass, with a halo of 62 samples.
TOGETHER = 5


def size_of(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def b3(plane: np.ndarray, step: int) -> np.ndarray:
    """Separable B3 smoothing with holes of `step`; samples beyond the edge are the edge's."""
    for axis in (0, 1):
        n = plane.shape[axis]
        taps = (w / 16 * np.take(plane, np.clip(np.arange(n) + k * step, 0, n - 1), axis) for k, w in zip(range(-2, 3), B3))
        plane = sum(taps)
    return plane


def scales_of(pixels: DataFrame, keys: list[str], steps: list[int], v: str = "v", to: tuple[str, ...] = ("c",)) -> DataFrame:
    """pixels with a column of `to` for each step: v smoothed with the first step, the next with the second, and so on.

    Squares have a halo of all the steps together, so the scales come out of one shuffle, side by side in a sample's row.
    Missing and null samples count as nothing; a sample that is null and finds no other is null.
    """
    halo = 2 * sum(steps)
    rows = join_keys(pixels, size_of(pixels, keys).select(*keys, F.col("h").alias("image_h"), F.col("w").alias("image_w")), keys)

    def work(table, y, x, tile):
        top, left, side = tile
        ends = [max(top - halo, 0), max(left - halo, 0), min(top + side + halo, table["image_h"][0].as_py()), min(left + side + halo, table["image_w"][0].as_py())]
        plane, seen = tiles.plane_of(table[v], y, x, *ends, 0.0)
        at, out, whole = (y - ends[0], x - ends[1]), [], seen.all()
        for step in steps:
            plane = b3(plane, step)
            seen = seen if whole else b3(seen.astype(float), step) > 0
            out.append((plane[at], ~seen[at]))
        return None, out

    return tiles.over_tiles(rows, keys, halo, work, to, ("image_h", "image_w"))


def smoothed(pixels: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """Separable B3 smoothing of dense images (keys, y, x, v) with holes of `step`, samples beyond the edge being the edge's."""
    return scales_of(pixels.select(*keys, "y", "x", "v"), keys, [step]).select(*keys, "y", "x", F.col("c").alias("v"))


def wavelet_noise(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """1.4826 times the median of |first wavelet plane|."""
    plane = scales_of(pixels.select(*keys, "y", "x", "v"), keys, [1])
    detail = F.col("v") - F.col("c")
    return noise_of(plane.where(finite(detail)).select(*keys, F.abs(detail).alias("v")), keys)


def noise_of(details: DataFrame, keys: list[str]) -> DataFrame:
    return medians(details, keys).select(*keys, (F.col("median") * MAD_SIGMA).alias("noise"))


def scale_noise(scale: int) -> float:
    """Noise of a wavelet scale of white noise of unit noise; halved with each scale beyond the table."""
    last = len(SCALE_NOISE) - 1
    return SCALE_NOISE[min(scale, last)] / 2.0 ** max(0, scale - last)


def denoised(pixels: DataFrame, keys: list[str], scales: int = 5, thresholds: tuple = THRESHOLDS, soft: bool = True) -> DataFrame:
    """Dense images without the noise of their wavelet scales: details below a scale's threshold go, the rest is added up.

    The noise is that of the finest scale; results that are negative or not finite are 0. The first five scales come from
    one pass over tiles, each coarser one from a pass of its own; all stand side by side in a sample's row, without joins.
    """
    scales, cut = min(max(scales, 1), 8), soft_threshold if soft else hard_threshold
    rows, done = pixels.select(*keys, "y", "x", F.col("v").cast("double").alias("v")), 0
    while done < scales:
        more = min(scales, TOGETHER) if done == 0 else 1
        rows = scales_of(rows, keys, [1 << (done + k) for k in range(more)], f"c{done - 1}" if done else "v", tuple(f"c{done + k}" for k in range(more)))
        done += more
    rows = checkpointed(rows)
    detail = [F.col("v" if k == 0 else f"c{k - 1}") - F.col(f"c{k}") for k in range(scales)]
    noise = noise_of(rows.where(finite(detail[0])).select(*keys, F.abs(detail[0]).alias("v")), keys)
    rows = join_keys(rows, noise, keys, "left") if keys else join_keys(rows, noise, [])
    level = lambda k: F.coalesce("noise", F.lit(0.0)) * scale_noise(k) * thresholds[min(k, len(thresholds) - 1)]
    total = sum((cut(d, level(k)) for k, d in enumerate(detail)), F.col(f"c{scales - 1}"))
    return rows.select(*keys, "y", "x", F.when(finite(total) & (total >= 0), total).otherwise(0.0).alias("v"))


def block_means(pixels: DataFrame, keys: list[str], sy: float, sx: float, ok=finite) -> DataFrame:
    """Means of valid samples over blocks [floor(o s), ceil((o + 1) s)), which overlap where s is no integer; 0 for none."""
    dims = size_of(pixels, keys)
    rows = join_keys(pixels, dims, keys)
    for axis, side, s in (("y", "h", sy), ("x", "w", sx)):
        # Output o reads sample i if floor(o s) <= i < ceil((o + 1) s).
        last = F.floor(F.col(side) / s) - 1
        first = F.greatest(F.ceil((F.col(axis) + 1) / s) - 2, F.lit(0))
        rows = rows.withColumn(f"o{axis}", F.explode(F.sequence(first, first + 2)))
        o = F.col(f"o{axis}")
        rows = rows.where((F.floor(o * s) <= F.col(axis)) & (F.col(axis) < F.ceil((o + 1) * s)) & (o <= last))
    mean = F.coalesce(F.avg(F.when(ok("v"), F.col("v"))), F.lit(0.0))
    return rows.groupBy(*keys, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(mean.alias("v"))


def area_means(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Dense images averaged down to at most their size over blocks [trunc(o s), trunc((o + 1) s)), which don't overlap."""
    rows = join_keys(pixels, size_of(pixels, keys), keys)
    for axis, side, n in (("y", "h", height), ("x", "w", width)):
        s = F.col(side) / F.lit(float(n))
        guess = F.floor(F.col(axis) / s)
        inside = lambda o, s=s, axis=axis: (F.floor(o * s) <= F.col(axis)) & (F.col(axis) < F.floor((o + 1) * s))
        rows = rows.withColumn(f"o{axis}", F.when(inside(guess), guess).when(inside(guess + 1), guess + 1).otherwise(guess - 1))
    return rows.groupBy(*keys, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.avg("v").alias("v"))


def halved(pixels: DataFrame, keys: list[str], values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Means of finite samples over 2 x 2 cells, fewer at an odd edge; 0 for none."""
    mean = lambda v: F.coalesce(F.avg(F.when(finite(v), F.col(v))), F.lit(0.0)).alias(v)
    return pixels.groupBy(*keys, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(*map(mean, values))


def nearest(pixels: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """The nearest sample for each cell of a grid of at most the image's size."""
    rows = join_keys(pixels, size_of(pixels, keys), keys)
    for axis, side, n in (("y", "h", height), ("x", "w", width)):
        ratio = F.col(side) / n
        first = F.greatest(F.floor(F.col(axis) / ratio) - 1, F.lit(0))
        rows = rows.withColumn(f"o{axis}", F.explode(F.sequence(first, first + 2 + F.ceil(1 / ratio))))
        o = F.col(f"o{axis}")
        rows = rows.where((o < n) & (F.least(F.floor(o * ratio), F.col(side) - 1) == F.col(axis)))
    return rows.select(*keys, F.col("oy").alias("y"), F.col("ox").alias("x"), "v")


def crop(pixels: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    inside = pixels.where(F.col("y").between(top, bottom - 1) & F.col("x").between(left, right - 1))
    return inside.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})


def autocrop(pixels: DataFrame, frame: str, least: float = 1e-6) -> DataFrame:
    """One row: the region in which every frame has samples beyond `least`; bottom and right are exclusive."""
    seen = pixels.where(F.abs("v") > least)
    each = seen.groupBy(frame).agg(F.min("y").alias("t"), F.min("x").alias("l"), (F.max("y") + 1).alias("b"), (F.max("x") + 1).alias("r"))
    return each.agg(F.max("t").alias("top"), F.max("l").alias("left"), F.min("b").alias("bottom"), F.min("r").alias("right"))


def window_max(plane: np.ndarray, low: int, high: int, axis: int) -> np.ndarray:
    """The greatest of the samples from low to high places on along an axis; minus infinity beyond the edge and for none."""
    n, out = plane.shape[axis], np.full(plane.shape, -np.inf)
    at = lambda a, b: tuple(slice(a, b) if k == axis else slice(None) for k in (0, 1))
    for k in range(max(low, -n), min(high, n) + 1):
        to, of = at(max(0, -k), n - max(0, k)), at(max(0, k), n - max(0, -k))
        np.maximum(out[to], plane[of], out=out[to])
    return out


def local_maxima(pixels: DataFrame, keys: list[str], radius: int = 5, above: float = 0.0) -> DataFrame:
    """Samples that no sample within `radius` rows and columns exceeds; of equal ones the first in row order.

    Samples that aren't finite or not greater than `above` are left out; missing ones are exceeded by all.
    """
    rows = pixels.where(finite("v") & (F.col("v") > above)).select(*keys, "y", "x", "v")

    def work(table, y, x, tile):
        top, left, bottom, right = y.min(), x.min(), y.max() + 1, x.max() + 1
        plane, _ = tiles.plane_of(table["v"], y, x, top, left, bottom, right, -np.inf)
        wide = window_max(plane, -radius, radius, 1)
        before = np.maximum(window_max(wide, -radius, -1, 0), window_max(plane, -radius, -1, 1))
        best = (plane >= window_max(wide, -radius, radius, 0)) & (plane > before)
        return best[y - top, x - left], []

    return tiles.over_tiles(rows, keys, radius, work)


def labelled(pixels: DataFrame, keys: list[str], threshold: float | Column) -> DataFrame:
    """Samples above the threshold with label, the least position of their 8-connected component in row order.

    The threshold is a number or an expression over the samples' columns. Components that lie in the outermost rows and
    columns alone don't count, as none starts there. Runs in rows are joined first, then runs of neighbouring rows; labels
    pass along runs until none changes.
    """
    dims = size_of(pixels, keys)
    rows = join_keys(pixels.where(finite("v") & (F.col("v") > threshold)).select(*keys, "y", "x", "v"), dims, keys)
    along = Window.partitionBy(*keys, "y").orderBy("x")
    rows = rows.withColumn("start", F.when(F.col("x") - F.lag("x").over(along) == 1, 0).otherwise(1)).withColumn("run", F.sum("start").over(along))
    rows = rows.withColumn("position", F.col("y").cast("long") * F.col("w") + F.col("x"))
    inside = F.col("y").between(1, F.col("h") - 2) & F.col("x").between(1, F.col("w") - 2)
    rows = checkpointed(rows.select(*keys, "y", "x", "v", "run", "position", inside.alias("inside")))
    runs = rows.groupBy(*keys, "y", "run").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("position").alias("label"))
    below = runs.select(*keys, (F.col("y") - 1).alias("y"), F.col("run").alias("run2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("label").alias("id2"))
    links = join_keys(runs.withColumnRenamed("label", "id"), below, [*keys, "y"]).where("a <= b2 + 1 AND a2 <= b + 1").select(*keys, "id", "id2")
    links = checkpointed(links.unionAll(links.select(*keys, F.col("id2").alias("id"), F.col("id").alias("id2"))))
    labels = runs.select(*keys, F.col("label").alias("id"), "label")
    while True:
        reached = join_keys(links, labels.withColumnRenamed("id", "id2"), [*keys, "id2"]).groupBy(*keys, "id").agg(F.min("label").alias("near"))
        moved = join_keys(labels, reached, [*keys, "id"], "left").select(*keys, "id", F.least("label", F.coalesce("near", "label")).alias("label"), (F.coalesce(F.col("near") < F.col("label"), F.lit(False))).alias("moved"))
        # Then every run takes the label of the run that its label names.
        jump = checkpointed(join_keys(moved, moved.select(*keys, F.col("id").alias("label"), F.col("label").alias("next")), [*keys, "label"]).select(*keys, "id", F.least("label", "next").alias("label"), "moved"))
        labels = jump.drop("moved")
        if jump.where("moved").isEmpty():
            break
    named = join_keys(runs.select(*keys, "y", "run", F.col("label").alias("id")), labels, [*keys, "id"]).select(*keys, "y", "run", "label")
    out = join_keys(rows, named, [*keys, "y", "run"]).select(*keys, "y", "x", "v", "inside", "label")
    counted = out.groupBy(*keys, "label").agg(F.max("inside").alias("some")).where("some").drop("some")
    return join_keys(out.drop("inside"), counted, [*keys, "label"]).select(*keys, "y", "x", "v", "label")


def component_moments(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per component flux, centroid, peak, npix, fwhm and eccentricity, from its samples' first moments and the second ones
    about the centroid; those about the origin lose their digits far from it."""
    v, own = F.col("v"), [*keys, "label"]
    first = labels.groupBy(*own).agg(F.sum("v").alias("flux"), F.max("v").alias("peak"), F.count("*").alias("npix"), *(F.sum(v * F.col(c)).alias(f"s{c}") for c in "yx")).where("flux > 0")
    first = first.select(*own, "flux", "peak", "npix", *((F.col(f"s{c}") / F.col("flux")).alias(f"c{c}") for c in "yx"))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    same = [F.first(c).alias(c) for c in ("flux", "peak", "npix", "cy", "cx")]
    s = join_keys(labels, first, own).groupBy(*own).agg(*same, *(F.sum(v * e).alias(n) for n, e in {"syy": dy * dy, "sxx": dx * dx, "sxy": dx * dy}.items()))
    myy, mxx, mxy = F.greatest(F.lit(0.0), F.col("syy") / F.col("flux")), F.greatest(F.lit(0.0), F.col("sxx") / F.col("flux")), F.col("sxy") / F.col("flux")
    root = F.sqrt((mxx - myy) * (mxx - myy) + 4 * mxy * mxy)
    big, small = (mxx + myy + root) / 2, F.greatest(F.lit(0.0), (mxx + myy - root) / 2)
    return s.select(*own, F.col("cx").alias("x"), F.col("cy").alias("y"), "flux", "peak", "npix", (FWHM * F.sqrt((mxx + myy) / 2)).alias("fwhm"), F.when(big > 1e-10, F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(small, big)))).otherwise(0.0).alias("eccentricity"))
