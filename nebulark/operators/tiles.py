"""Tiles with halos: a neighbourhood operator reads each sample once for its own square and once more for each neighbour whose
border it lies in, in one shuffle; a task holds one square with its border as an array.

Images are rows (keys, y, x, v), dense, one row a sample; samples that are missing or null count as nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sides of squares: the least, and the greatest unless a halo needs more (1024 and two halos of 256 are 2.4 M samples).
SIDE, GREATEST = 128, 1024
#: Rows and columns of an image that a square of a warped one reads at most, beyond the taps, unless it is a single cell.
READ = 256
#: Decimals up to which the terms of a transform are taken as they are written.
DECIMALS = 9


def side_of(halo: int) -> int:
    """The side of squares with a halo: wide halos go with wide squares, so that borders stay below the squares."""
    return max(SIDE, min(8 * halo, GREATEST), 2 * halo)


def with_halos(pixels: DataFrame, halo: int, side: int) -> DataFrame:
    """pixels once for each square (tile_y, tile_x) that they lie in or within `halo` of: a halo is at most a side."""
    near = lambda axis: F.explode(F.sequence(F.floor((F.col(axis) - halo) / side), F.floor((F.col(axis) + halo) / side)))
    return pixels.withColumn("tile_y", near("y")).withColumn("tile_x", near("x"))


def over_tiles(pixels: DataFrame, keys: list[str], halo: int, work: Callable, added: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    """The rows of pixels, without the columns of drop, that work keeps, with the double columns that it adds.

    work takes a table of a square's rows with those of its halo, their y and x, and the square's (top, left, side). It gives
    a mask of the rows to keep, or None for all, and for each added column its values and a mask of those that are null.
    """
    side = side_of(halo)
    kept = [c for c in pixels.columns if c not in drop]
    schema = T.StructType([pixels.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in added])

    def run(table: pa.Table) -> pa.Table:
        y, x = (table[c].to_numpy().astype(np.int64) for c in "yx")
        top, left = (table[c][0].as_py() * side for c in ("tile_y", "tile_x"))
        own = (y >= top) & (y < top + side) & (x >= left) & (x < left + side)
        columns: list = [((), ())] * len(added)
        if own.any():
            keep, columns = work(table, y, x, (top, left, side))
            own = own if keep is None else own & keep
        out = table.select(kept).filter(pa.array(own))
        for name, (values, missing) in zip(added, columns):
            some = len(out) > 0
            out = out.append_column(name, pa.array(values[own], pa.float64(), mask=missing[own]) if some else pa.array([], pa.float64()))
        return out

    return with_halos(pixels, halo, side).groupBy(*keys, "tile_y", "tile_x").applyInArrow(run, schema)


def plane_of(values: pa.ChunkedArray, y: np.ndarray, x: np.ndarray, top: int, left: int, bottom: int, right: int, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """Samples within bounds as an array, and where there is one."""
    plane, seen = np.full((bottom - top, right - left), fill), np.zeros((bottom - top, right - left), bool)
    there = values.is_valid().to_numpy()
    plane[y[there] - top, x[there] - left] = values.to_numpy()[there]
    seen[y[there] - top, x[there] - left] = True
    return plane, seen


def packed(pixels: DataFrame, keys: list[str], side: int = SIDE) -> DataFrame:
    """keys, block_y, block_x and samples: a row a square of an image, its samples as (place in row order, v)."""
    block = {f"block_{a}": F.floor(F.col(a) / side) for a in "yx"}
    place = (F.pmod(F.col("y"), F.lit(side)) * side + F.pmod(F.col("x"), F.lit(side))).cast("int")
    some = pixels.where("v IS NOT NULL").select(*keys, *(c.alias(n) for n, c in block.items()), F.struct(place.alias("at"), F.col("v").cast("double").alias("v")).alias("s"))
    return some.groupBy(*keys, *block).agg(F.collect_list("s").alias("samples"))  # side * side samples at most


def reads_of(tile: Column, side: Column, factors: dict[str, Column], shift: Column, last: dict[str, Column], end: Column) -> tuple[Column, Column]:
    """The first and last row (or column) of an image of `end` that the taps of a square's cells read."""
    low = high = shift
    for axis, factor in factors.items():
        a = factor * (tile[axis] * side)
        b = factor * F.least(tile[axis] * side + side - 1, last[axis])
        low, high = low + F.least(a, b), high + F.greatest(a, b)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(v, end - 1.0)).cast("long")
    return inside(F.floor(low - 1e-3) - 1.0), inside(F.floor(high + 1e-3) + 2.0)  # as positions in doubles are rounded


def cubic(t):
    """The cubic kernel with slope -1/2 at distances t up to 1, and from 1 to 2; for columns and arrays alike."""
    return (1.5 * t - 2.5) * t * t + 1, ((2.5 - 0.5 * t) * t - 4) * t + 2


def kernel(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    near, far = cubic(t)
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


def parts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole parts and the rests of positions."""
    whole = np.floor(at)
    return whole.astype(np.int64), at - whole


def positions(a: float, b: float, shift: float, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a x + b y + shift for whole x and y.

    Terms of up to DECIMALS decimals are those decimals, worked out in whole numbers, so a position on the image's edge is
    not outside by a rounding; others are worked out in doubles.
    """
    terms = [Decimal(repr(float(t))) for t in (a, b, shift)]
    if all(t.is_finite() for t in terms):
        scale = 10 ** max(0, *(-t.normalize().as_tuple().exponent for t in terms))
        reach = sum(abs(t) * int(np.abs(k).max(initial=0)) for t, k in zip(terms, (x, y, np.ones(1, np.int64))))
        if scale <= 10**DECIMALS and reach * scale < 1 << 62:
            p, q, s = (int(t * scale) for t in terms)
            whole, rest = np.divmod(p * x + q * y + s, scale)
            return whole, rest / scale
    return parts(a * x + b * y + shift)


def within_image(at: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    whole, rest = at
    return (whole >= 0) & ((whole < n - 1) | ((whole == n - 1) & (rest == 0)))


def cubic_reads(plane: np.ndarray, top: int, left: int, sy: tuple, sx: tuple, height: int, width: int) -> np.ndarray:
    """Samples of an image of (height, width) at real positions, given by their parts, 4 by 4 taps each, edges repeated; plane is its part from (top, left) on."""
    (iy, fy), (ix, fx) = sy, sx
    out = np.zeros(iy.shape)
    for i in range(-1, 3):
        for j in range(-1, 3):
            weight = kernel(fy - i) * kernel(fx - j)
            tap = plane[np.clip(iy + i, 0, height - 1) - top, np.clip(ix + j, 0, width - 1) - left]
            out += np.where(weight != 0, tap, 0.0) * weight  # a tap without weight isn't read, so it may be no number
    return out


def affine_reads(pixels: DataFrame, transforms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x and v of each cell of dense images read at (a x + b y + tx, c x + d y + ty) of themselves; 0 outside.

    transforms are a row an image: keys, a, b, tx, c, d, ty, and its height h and width w. A square of cells reads a
    rectangle of the image: the squares of samples that cover it are sent to it, packed, in one equi join. Where an image
    shrinks, squares of cells are smaller, so that the rectangle stays bounded.
    """
    from nebulark.operators.stats import join_keys

    terms = ["a", "b", "tx", "c", "d", "ty", "h", "w"]
    grows = F.greatest(F.abs("a") + F.abs("b"), F.abs("c") + F.abs("d"), F.lit(READ / SIDE))
    tiles = transforms.select(*(F.col(k).cast(pixels.schema[k].dataType).alias(k) for k in keys), *terms, F.greatest(F.lit(1), F.floor(READ / grows)).alias("side"))
    for axis, end in (("y", "h"), ("x", "w")):
        tiles = tiles.withColumn(f"tile_{axis}", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(end) - 1) / F.col("side")))))
    at, last = {a: F.col(f"tile_{a}") for a in "yx"}, {"y": F.col("h") - 1, "x": F.col("w") - 1}
    for axis, end, factors, shift in (("y", "h", "cd", "ty"), ("x", "w", "ab", "tx")):
        low, high = reads_of(at, F.col("side"), {"x": F.col(factors[0]), "y": F.col(factors[1])}, F.col(shift), last, F.col(end))
        tiles = tiles.withColumn(f"block_{axis}", F.explode(F.sequence(F.floor(low / SIDE), F.floor(high / SIDE))))
    met = join_keys(tiles, packed(pixels, keys), [*keys, "block_y", "block_x"], "left")
    schema = T.StructType([*(pixels.schema[k] for k in keys), T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        one = {c: table[c][0].as_py() for c in [*terms, "side", "tile_y", "tile_x"]}
        by, bx = (table[f"block_{a}"].to_numpy() for a in "yx")
        top, left = int(by.min()) * SIDE, int(bx.min()) * SIDE
        plane = np.zeros(((int(by.max()) + 1) * SIDE - top, (int(bx.max()) + 1) * SIDE - left))
        for row, (i, j) in enumerate(zip(by * SIDE - top, bx * SIDE - left)):
            samples = table["samples"][row].values
            if samples is not None:
                place = samples.field("at").to_numpy()
                plane[i + place // SIDE, j + place % SIDE] = samples.field("v").to_numpy()
        own = [np.arange(one[f"tile_{a}"] * one["side"], min((one[f"tile_{a}"] + 1) * one["side"], one[n])) for a, n in (("y", "h"), ("x", "w"))]
        y, x = (g.ravel() for g in np.meshgrid(*own, indexing="ij"))
        sx, sy = positions(one["a"], one["b"], one["tx"], x, y), positions(one["c"], one["d"], one["ty"], x, y)
        inside = within_image(sx, one["w"]) & within_image(sy, one["h"])
        v = np.zeros(len(y))
        v[inside] = cubic_reads(plane, top, left, *(tuple(p[inside] for p in at) for at in (sy, sx)), one["h"], one["w"])
        out = {k: pa.array([table[k][0].as_py()] * len(y), table[k].type) for k in keys}
        return pa.table(out | {"y": pa.array(y, pa.int64()), "x": pa.array(x, pa.int64()), "v": pa.array(v)})

    return met.groupBy(*keys, "tile_y", "tile_x").applyInArrow(run, schema)
