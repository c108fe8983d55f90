"""Display stretches and tone, as column expressions."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulark.functions.validity import col, finite, valid

#: Fixed values of the automatic stretch.
SHADOW_K, TARGET, SHADOW_MOST = -2.8, 0.25, 0.98
#: Samples of a tone curve.
CURVE = 4096


def clamp(x: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mtf(x: Column, m: Column) -> Column:
    """Midtone transfer of x in 0 to 1."""
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise((m - 1) * x / ((2 * m - 1) * x - m))


def mtf_balance(median: Column, target: Column | float) -> Column:
    """The midtone that takes median to target."""
    t = F.lit(target)
    below = 2 * t * median - t - median
    return F.when(F.abs(below) < 1e-15, 0.5).otherwise(clamp(F.try_divide(median * (t - 1), below), 1e-4, 0.9999))


def auto_stf(median: Column, sigma: Column, low: Column, high: Column, k: float = SHADOW_K, target: float = TARGET) -> dict[str, Column]:
    """Shadow, midtone and highlight from an image's statistics; the neutral 0, 0.5, 1 where there is no range."""
    span = high - low
    n = F.try_divide(median - low, span)
    shadow = clamp(n + k * F.try_divide(sigma, span), 0.0, SHADOW_MOST)
    some = span > 0
    return {"shadow": F.when(some, shadow).otherwise(0.0), "midtone": F.when(some, mtf_balance((n - shadow) / (1 - shadow), target)).otherwise(0.5), "highlight": F.lit(1.0)}


def apply_stf(v: Column | str, shadow: Column, midtone: Column, highlight: Column, low: Column, high: Column) -> Column:
    """0 for invalid samples, else the transfer of the clipped, normalised sample, in 0 to 1."""
    v = col(v)
    n = F.try_divide(v - low, high - low)
    x = clamp(F.try_divide(n - shadow, highlight - shadow))
    return F.when(valid(v) & (high > low), mtf(x, midtone)).otherwise(0.0)


def to_u8(x: Column) -> Column:
    return F.round(clamp(x) * 255).cast("int")


def arcsinh(v: Column | str, low: Column, high: Column, factor: float, gamma: float = 1.0) -> Column:
    v = col(v)
    n = clamp(F.try_divide(v - low, high - low))
    y = n if abs(factor) < 1e-10 else F.asinh(n * factor) / F.asinh(F.lit(factor))
    y = y if gamma == 1.0 else F.pow(y, F.lit(gamma))
    return F.when(~finite(v) | (high - low < 1e-10), 0.0).otherwise(y)


def robust_asinh(v: Column | str, median: Column, mad: Column, low: Column, high: Column, alpha: float = 10.0, ok=valid) -> Column:
    """asinh(alpha (v - median) / sigma) of samples clamped between two order statistics; 0 for those that aren't ok."""
    v = col(v)
    return F.when(ok(v), F.asinh(alpha * (F.greatest(low, F.least(high, v)) - median) / F.greatest(mad * 1.4826, F.lit(1e-10)))).otherwise(0.0)


def levels(v: Column | str, black: float, white: float, gamma: float) -> Column:
    v = col(v)
    power = 1 / min(max(gamma, 0.01), 10.0)
    x = clamp((v - black) / max(white - black, 1e-10))
    return F.when(~finite(v) | (v < 0), 0.0).otherwise(x if power == 1.0 else F.pow(x, F.lit(power)))


def curve_lut(points: list[tuple[float, float]], n: int = CURVE) -> list[float]:
    """A monotone cubic through points (and (0, 0) and (1, 1)), sampled n times; Fritsch-Carlson tangents."""
    kept: list[tuple[float, float]] = []
    for x, y in sorted([(0.0, 0.0)] * (min((p[0] for p in points), default=1) > 1e-9) + list(points) + [(1.0, 1.0)] * (max((p[0] for p in points), default=0) < 1 - 1e-9)):
        if not kept or x - kept[-1][0] > 1e-9:
            kept.append((x, y))
    xs, ys = zip(*kept)
    slope = [(b - a) / (d - c) for a, b, c, d in zip(ys, ys[1:], xs, xs[1:])]
    m = [slope[0], *(0.0 if a * b <= 0 else (a + b) / 2 for a, b in zip(slope, slope[1:])), slope[-1]]
    for k, s in enumerate(slope):
        if abs(s) < 1e-12:
            m[k] = m[k + 1] = 0.0
        elif (tau := (m[k] / s) ** 2 + (m[k + 1] / s) ** 2) > 9:
            m[k], m[k + 1] = 3 / sqrt(tau) * m[k], 3 / sqrt(tau) * m[k + 1]
    out, k = [], 0
    for i in range(n):
        x = i / (n - 1)
        while k < len(slope) - 1 and x > xs[k + 1]:
            k += 1
        h = xs[k + 1] - xs[k]
        t = (x - xs[k]) / h
        y = ys[k] * (1 + 2 * t) * (1 - t) ** 2 + h * m[k] * t * (1 - t) ** 2 + ys[k + 1] * t * t * (3 - 2 * t) + h * m[k + 1] * t * t * (t - 1)
        out.append(min(max(y, 0.0), 1.0))
    return out


def apply_curve(v: Column | str, lut: list[float]) -> Column:
    """The sample of a curve at trunc(clamp(v) * (n - 1)); invalid samples give 0."""
    v = col(v)
    at = F.floor(clamp(v) * (len(lut) - 1)).cast("int") + 1
    return F.when(~finite(v), 0.0).otherwise(F.element_at(F.array(*map(F.lit, lut)), at))


def soft_threshold(v: Column | str, t: Column | float) -> Column:
    v, t = col(v), t if isinstance(t, Column) else F.lit(t)
    return F.when(F.abs(v) <= t, 0.0).otherwise(F.signum(v) * (F.abs(v) - t))


def hard_threshold(v: Column | str, t: Column | float) -> Column:
    v, t = col(v), t if isinstance(t, Column) else F.lit(t)
    return F.when(F.abs(v) <= t, 0.0).otherwise(v)


def deringed(estimate: Column, original: Column, t: float) -> Column:
    return F.least(original * (1 + t), F.greatest(F.greatest(original * (1 - t), F.lit(0.0)), estimate))


def masked_mtf(x: Column, m: Column) -> Column:
    below = (2 * m - 1) * x - m
    return clamp(F.when(F.abs(below) < 1e-10, x).otherwise(F.try_divide((m - 1) * x, below)))
