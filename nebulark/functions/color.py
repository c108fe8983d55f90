"""Colour of composites, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulark.functions.stretch import clamp

#: Luminance weights of the sRGB primaries.
LUMINANCE = (0.2126, 0.7152, 0.0722)

#: Blends of narrowband channels, as (channel, r, g, b).
PRESETS = {
    "rgb": (("r", 1.0, 0.0, 0.0), ("g", 0.0, 1.0, 0.0), ("b", 0.0, 0.0, 1.0)),
    "sho": (("sii", 1.0, 0.0, 0.0), ("ha", 0.0, 1.0, 0.0), ("oiii", 0.0, 0.0, 1.0)),
    "hubble_legacy": (("sii", 0.7, 0.3, 0.0), ("ha", 0.3, 0.8, 0.2), ("oiii", 0.0, 0.15, 0.85)),
    "hoo": (("ha", 1.0, 0.0, 0.0), ("oiii", 0.0, 0.5, 0.5)),
    "dynamic_hoo": (("ha", 0.9, 0.4, 0.0), ("oiii", 0.1, 0.6, 1.0)),
    "foraxx": (("sii", 0.8, 0.2, 0.0), ("ha", 0.2, 0.7, 0.1), ("oiii", 0.0, 0.1, 0.9)),
}


def luminance(r: Column, g: Column, b: Column) -> Column:
    return LUMINANCE[0] * r + LUMINANCE[1] * g + LUMINANCE[2] * b


def luminance_or_zero(r: Column, g: Column, b: Column) -> Column:
    return luminance(*(F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(x) for x in (r, g, b)))


def scnr(r: Column, g: Column, b: Column, amount: float = 1.0, method: str = "average", keep_luminance: bool = False) -> tuple[Column, Column, Column]:
    """Green lowered to what red and blue suggest; the luminance lost can be given to red and blue, up to 1."""
    limit = (r + b) / 2 if method == "average" else F.greatest(r, b)
    green = g + amount * (F.least(g, limit) - g)
    if not keep_luminance:
        return r, green, b
    lift = LUMINANCE[1] * (g - green) / (LUMINANCE[0] + LUMINANCE[2])
    lifted = (lift > 0) & (r <= 1) & (b <= 1)
    return F.when(lifted, F.least(F.lit(1.0), r + lift)).otherwise(r), green, F.when(lifted, F.least(F.lit(1.0), b + lift)).otherwise(b)


def lrgb(l: Column, c: Column, r: Column, g: Column, b: Column, lightness: float = 1.0, chrominance: float = 1.0) -> Column:
    """Channel c of a composite with its lightness replaced by l."""
    y = luminance(r, g, b)
    ratio = F.try_divide(l * lightness + y * (1 - lightness), y)
    return F.when(y < 1e-10, l * lightness).otherwise(clamp(c * ratio * chrominance + l * (1 - chrominance)))


def luminance_scaled(c: Column, l: Column, r: Column, g: Column, b: Column) -> Column:
    y = luminance(r, g, b)
    return clamp(c * F.when(y <= 1e-10, 1.0).otherwise(F.try_divide(l, y)))


def channel_or_synth(primary: Column, one: Column, two: Column) -> Column:
    """A missing channel from the others: their mean, the one there is, or 0."""
    return F.coalesce(primary, (one + two) / 2, one, two, F.lit(0.0))


def white_balance(medians: dict[str, Column], mads: dict[str, Column]) -> dict[str, Column]:
    """Factors from the channel with the least relative noise, red before green before blue in a tie."""
    order = ("r", "g", "b")
    noise = {c: F.when(medians[c] > 0, F.try_divide(mads[c], medians[c])).otherwise(float("inf")) for c in order}
    least = F.least(*(noise[c] for c in order))
    reference = F.coalesce(*(F.when(noise[c] == least, medians[c]) for c in order))
    return {c: F.greatest(F.lit(1e-6), F.coalesce(F.try_divide(reference, medians[c]), F.lit(1.0))) for c in order}
