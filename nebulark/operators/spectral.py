"""Operators on whole planes that no relational form expresses: Fourier transforms, registration and deconvolution.

Spark deals planes to tasks, one group each; NumPy works within a plane.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from nebulark.operators.tiles import cubic_reads, parts

#: Shifts found with less confidence are doubtful.
LEAST_CONFIDENCE = 2.0


def plane_of(pdf: pd.DataFrame) -> np.ndarray:
    """Samples (y, x, v) as a plane; missing and non-finite ones are 0."""
    plane = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
    plane[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = np.nan_to_num(pdf["v"].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
    return plane


def rows_of(plane: np.ndarray, key: str, value) -> pd.DataFrame:
    y, x = np.indices(plane.shape)
    return pd.DataFrame({key: value, "y": y.ravel(), "x": x.ravel(), "v": plane.ravel()})


def per_plane(pixels: DataFrame, key: str, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    kind = pixels.schema[key].dataType.simpleString()
    return pixels.groupBy(key).applyInPandas(lambda pdf: rows_of(work(plane_of(pdf)), key, pdf[key].iloc[0]), f"{key} {kind}, y int, x int, v double")


def next_power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def hann(n: int, periodic: bool) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n if periodic else max(n - 1, 1))))


def spectrum(plane: np.ndarray) -> np.ndarray:
    """The shifted log magnitude of a windowed plane, padded to a square of a power of two."""
    side = next_power(max(plane.shape))
    windowed = plane * np.outer(hann(plane.shape[0], False), hann(plane.shape[1], False))
    return np.fft.fftshift(np.log1p(np.abs(np.fft.fft2(windowed, (side, side)))))


def power_spectrum(pixels: DataFrame, key: str) -> DataFrame:
    return per_plane(pixels, key, spectrum)


def parabola(a: float, b: float, c: float) -> float:
    """The top of a parabola through three neighbours, within half a step."""
    below = a - 2 * b + c
    return 0.0 if abs(below) < 1e-15 else float(np.clip(0.5 * (a - c) / below, -0.5, 0.5))


def shift_of(reference: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """The shift (dy, dx) that takes the reference to the target, and its confidence, by phase correlation."""
    h, w = (min(a, b) for a, b in zip(reference.shape, target.shape))
    a, b = reference[:h, :w], target[:h, :w]
    if min(np.ptp(a), np.ptp(b)) < 1e-10:
        return 0.0, 0.0, 0.0
    window = np.outer(hann(h, True), hann(w, True))
    shape = next_power(h), next_power(w)
    cross = np.conj(np.fft.fft2((a - a.mean()) * window, shape)) * np.fft.fft2((b - b.mean()) * window, shape)
    size = np.abs(cross)
    surface = np.fft.ifft2(np.where(size > 1e-12, cross / np.maximum(size, 1e-12), 0)).real
    y, x = np.unravel_index(surface.argmax(), shape)
    dy = y + parabola(surface[y - 1, x], surface[y, x], surface[(y + 1) % shape[0], x])
    dx = x + parabola(surface[y, x - 1], surface[y, x], surface[y, (x + 1) % shape[1]])
    wrap = lambda p, n: p - n if p > n / 2 else p
    return wrap(dy, shape[0]), wrap(dx, shape[1]), float((surface[y, x] - surface.mean()) / max(surface.std(), 1e-15))


def phase_correlation(pixels: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Per frame dy, dx and confidence of its shift from the reference plane, which meets each frame in a cogroup-free way:
    its samples are added to every frame by a join on the pixel, so that no task holds more than two planes."""
    joined = pixels.join(reference.select("y", "x", reference["v"].alias("r")), ["y", "x"])
    kind = pixels.schema[key].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        dy, dx, confidence = shift_of(plane_of(pdf.assign(v=pdf["r"])), plane_of(pdf))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "dy": [dy], "dx": [dx], "confidence": [confidence], "doubtful": [confidence < LEAST_CONFIDENCE]})

    return joined.groupBy(key).applyInPandas(work, f"{key} {kind}, dy double, dx double, confidence double, doubtful boolean")


def gaussian(size: int = 15, sigma: float = 2.0) -> np.ndarray:
    at = np.arange(size) - size // 2
    k = np.exp(-0.5 * (at[:, None] ** 2 + at[None, :] ** 2) / sigma**2)
    return k / k.sum()


def convolved(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    shape = tuple(next_power(a + b - 1) for a, b in zip(plane.shape, kernel.shape))
    wrapped = np.zeros(shape)
    wrapped[: kernel.shape[0], : kernel.shape[1]] = kernel
    wrapped = np.roll(wrapped, tuple(-(k // 2) for k in kernel.shape), (0, 1))
    return np.fft.ifft2(np.fft.fft2(plane, shape) * np.fft.fft2(wrapped)).real[: plane.shape[0], : plane.shape[1]]


def richardson_lucy(plane: np.ndarray, kernel: np.ndarray, rounds: int = 20, damping: float = 1e-3, dering: float | None = None) -> np.ndarray:
    """Deconvolution; stops early, after three rounds, once the estimate moves by less than 1e-6 in the root mean square."""
    estimate, flipped = np.maximum(plane, 0), kernel[::-1, ::-1]
    for k in range(rounds):
        new = np.maximum(estimate * convolved(plane / (convolved(estimate, kernel) + 1e-6), flipped) / (1 + damping), 0)
        if dering is not None:
            new = np.minimum(plane * (1 + dering), np.maximum(np.maximum(plane * (1 - dering), 0), new))
        moved = np.sqrt(np.mean((new - estimate) ** 2))
        estimate = new
        if k >= 2 and moved < 1e-6:
            break
    return estimate


def deconvolved(pixels: DataFrame, key: str, sigma: float = 2.0, rounds: int = 20) -> DataFrame:
    kernel = gaussian(15, sigma)
    return per_plane(pixels, key, lambda plane: richardson_lucy(plane, kernel, rounds))


def resampled(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane resampled to a size, centres aligned, edges repeated."""
    y = (np.arange(height) + 0.5) * plane.shape[0] / height - 0.5
    x = (np.arange(width) + 0.5) * plane.shape[1] / width - 0.5
    return cubic_reads(plane, 0, 0, parts(np.repeat(y[:, None], width, 1)), parts(np.repeat(x[None, :], height, 0)), *plane.shape)
