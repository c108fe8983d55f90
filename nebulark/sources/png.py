"""PNG contents from planes of numbers, by the standard library alone, and tiles of an image pyramid."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions.validity import finite
from nebulark.operators.lineage import checkpointed
from nebulark.operators.spatial import halved, nearest, size_of
from nebulark.operators.stats import order_stats


def encode(plane: np.ndarray, bits: int = 8) -> bytes:
    """A plane (y, x), or (y, x, 3), of values in 0 to 1, truncated to 8 or 16 bits."""
    top = (1 << bits) - 1
    data = (np.clip(np.nan_to_num(plane), 0, 1) * top).astype(">u2" if bits == 16 else "u1")
    rows = data.reshape(data.shape[0], -1).view("u1").reshape(data.shape[0], -1)
    raw = np.concatenate((np.zeros((len(rows), 1), "u1"), rows), axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", plane.shape[1], plane.shape[0], bits, 2 if plane.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def level_count(height: int, width: int, side: int) -> int:
    return max(0, ceil(log2(max(height, width, 1) / side))) + 1


def pyramid(pixels: DataFrame, side: int = 256, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """All levels of an image (y, x, values): level (0 is the coarsest), y, x and values. A level is made of the one below it, by
    means of 2 x 2 cells, and written, so all levels cost a third more than the image."""
    size = size_of(pixels, []).first()
    n = level_count(size["h"], size["w"], side) if size["h"] else 1
    one = checkpointed(pixels.select("y", "x", *values))
    out = one.select(F.lit(n - 1).alias("level"), "y", "x", *values)
    for k in range(n - 2, -1, -1):
        one = checkpointed(halved(one, [], values))
        out = out.unionByName(one.select(F.lit(k).alias("level"), "y", "x", *values))
    return out


def percentile_bounds(pixels: DataFrame, low: float = 0.001, high: float = 0.999) -> tuple[float, float]:
    """The samples at two parts of the sorted valid ones; the least and greatest finite sample where none is valid."""
    found = order_stats(pixels, [], {"low": low, "high": high}).first()
    if found is None or found["low"] is None:
        found = pixels.where(finite("v")).agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
    return (found["low"], found["high"]) if found["low"] is not None else (0.0, 0.0)


def byte_of(v: Column | str, low: float, high: float) -> Column:
    """A sample over a range as 0 to 255, rounded; 0 if it isn't finite."""
    x = F.col(v) if isinstance(v, str) else v
    return F.when(finite(x), F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - low) * (255 / max(high - low, 1e-10)))))).otherwise(0.0).cast("int")


def tiles(pixels: DataFrame, side: int = 256, bounds: tuple[float, float] | None = None) -> DataFrame:
    """PNG tiles of all levels of one image (y, x, v): level (0 is the coarsest), ty, tx and content, side * side samples each,
    black beyond the image, over the range from 0.1 % to 99.9 % of its valid samples, or a given one."""
    low, high = bounds or percentile_bounds(pixels)
    return tiled(pyramid(pixels, side).withColumn("v", byte_of("v", low, high)), side, ("v",))


def tiles_rgb(rgb: DataFrame, side: int = 256, render: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """PNG tiles of all levels of a composite (y, x, r, g, b): samples in 0 to 1, or what a function of each channel makes of them."""
    shown = lambda c: (render[c](F.col(c)) if render else F.col(c))
    return tiled(pyramid(rgb, side, ("r", "g", "b")).withColumns({c: byte_of(shown(c), 0.0, 1.0) for c in "rgb"}), side, ("r", "g", "b"))


def tiled(rows: DataFrame, side: int, values: tuple[str, ...]) -> DataFrame:
    """Bytes of levels (level, y, x, values) as PNG contents; a tile is one group of at most side * side samples."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((side, side, len(values)))
        plane[pdf["y"] % side, pdf["x"] % side] = pdf[list(values)].to_numpy() / 255 + 1e-9
        return pd.DataFrame({"level": [pdf["level"].iloc[0]], "ty": [pdf["y"].iloc[0] // side], "tx": [pdf["x"].iloc[0] // side], "content": [encode(plane if len(values) > 1 else plane[:, :, 0])]})

    return rows.groupBy("level", F.floor(F.col("y") / side), F.floor(F.col("x") / side)).applyInPandas(build, "level int, ty int, tx int, content binary")


def levels(height: int, width: int, side: int = 256) -> list[dict]:
    """What the levels of a pyramid are like, coarsest first: size, tiles and scale."""
    n, out = level_count(height, width, side), []
    for k in range(n):
        out.append({"level": n - 1 - k, "width": width, "height": height, "cols": -(-width // side), "rows": -(-height // side), "scale": 1 / (1 << k)})
        height, width = -(-height // 2), -(-width // 2)
    return out[::-1]


def preview_rgb(rgb: DataFrame, most: int = 4096, render: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Bytes (y, x, r, g, b) of a preview no longer than `most` on either side, of the nearest samples: samples in 0 to 1, or what
    a function of each channel makes of them."""
    size = size_of(rgb, []).first()
    scale = most / max(size["h"], size["w"]) if size["h"] else 1.0
    rows = rgb.select("y", "x", F.struct("r", "g", "b").alias("v"))
    if scale < 1:
        whole = lambda n: max(1, int(n * scale + 0.5))
        rows = nearest(rows, [], whole(size["h"]), whole(size["w"]))
    shown = lambda c: (render[c](F.col(f"v.{c}")) if render else F.col(f"v.{c}"))
    return rows.select("y", "x", *(byte_of(shown(c), 0.0, 1.0).alias(c) for c in "rgb"))


def byte_sums(frames):
    """Sums of the three channels of tiles' bytes (level, ty, tx, content), read back from unfiltered PNG contents."""
    for pdf in frames:
        rows = []
        for level, ty, tx, content in pdf.itertuples(index=False):
            width, height = struct.unpack(">II", content[16:24])
            raw = np.frombuffer(zlib.decompress(content[content.index(b"IDAT") + 4 : content.index(b"IEND") - 8]), "u1").reshape(height, 1 + 3 * width)
            rows.append((level, ty, tx, *raw[:, 1:].reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()))
        yield pd.DataFrame(rows, columns=["level", "ty", "tx", "r", "g", "b"])
