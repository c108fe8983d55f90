"""Frames as byte buffers: previews and transfers, one frame a buffer, so one frame a group."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.operators.spatial import nearest, size_of


def plane(pdf: pd.DataFrame, v: str = "v") -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.float64)
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[v].to_numpy()
    return out


def per_frame(rows: DataFrame, frame: str, build) -> DataFrame:
    kind = rows.schema[frame].dataType.simpleString()
    return rows.groupBy(frame).applyInPandas(lambda pdf: pd.DataFrame({frame: [pdf[frame].iloc[0]], "content": [build(pdf)]}), f"{frame} {kind}, content binary")


def raw(pixels: DataFrame, frame: str, most: int | None = None) -> DataFrame:
    """frame and content: width, height, least and greatest finite sample, then samples as 32-bit floats, all little-endian;
    0 for samples that aren't finite, and 0 to 1 as the range if none is. With `most`, no side is longer: nearest samples."""

    def build(pdf: pd.DataFrame) -> bytes:
        p = plane(pdf).astype("<f4")
        some = p[np.isfinite(p)]
        low, high = (float(some.min()), float(some.max())) if len(some) else (0.0, 1.0)
        return struct.pack("<IIff", p.shape[1], p.shape[0], low, high) + np.where(np.isfinite(p), p, np.float32(0)).tobytes()

    if most is not None:
        size = size_of(pixels, []).first()
        scale = max(1.0, max(size["h"] or 1, size["w"] or 1) / most)
        if scale > 1:
            pixels = nearest(pixels, [frame], max(1, int(size["h"] / scale)), max(1, int(size["w"] / scale)))
    return per_frame(pixels, frame, build)


def spectrum_bytes(pixels: DataFrame, frame: str) -> DataFrame:
    """frame and content: a 32-byte header (width, height, least, greatest, then zeros) and samples scaled to 0 to 255."""

    def build(pdf: pd.DataFrame) -> bytes:
        p = plane(pdf)
        low, high = float(p.min()), float(p.max())
        scaled = (p - low) / (high - low) * 255 if high > low else np.zeros_like(p)
        return struct.pack("<IIff", p.shape[1], p.shape[0], low, high).ljust(32, b"\0") + scaled.astype("u1").tobytes()

    return per_frame(pixels, frame, build)


def preview_u16(pixels: DataFrame, frame: str) -> DataFrame:
    """frame and text: samples over their range as 16-bit little-endian numbers, in base 64."""

    def build(pdf: pd.DataFrame) -> bytes:
        p = plane(pdf)
        low, span = p.min(), p.max() - p.min()
        return ((p - low) / span * 65535 if span > 0 else np.zeros_like(p)).astype("<u2").tobytes()

    return per_frame(pixels, frame, build).select(frame, F.translate(F.base64("content"), "\r\n", "").alias("text"))


def preview_rgb(rgb: DataFrame, frame: str) -> DataFrame:
    """frame and text: r, g and b in 0 to 1 as bytes, pixel by pixel, in base 64."""

    def build(pdf: pd.DataFrame) -> bytes:
        return (np.stack([np.clip(plane(pdf, c), 0, 1) for c in "rgb"], axis=2) * 255).astype("u1").tobytes()

    return per_frame(rgb, frame, build).select(frame, F.translate(F.base64("content"), "\r\n", "").alias("text"))


def star_catalogue(stars: DataFrame) -> DataFrame:
    """A line a star: id and, with four decimals, x, y, z, flux and temperature."""
    numbers = [F.format_string("%.4f", F.col(c).cast("double")) for c in ("x", "y", "z", "flux", "temperature")]
    return stars.select(F.concat_ws(",", F.col("star_id").cast("string"), *numbers).alias("line"))
