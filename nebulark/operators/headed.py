"""Images that carry their headers: a map of cards by frame that follows what is done to the samples.

headers: frame, header (a map of text by key). World coordinates are moved and scaled with the image; other cards stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.operators import sampling, spatial
from nebulark.operators.stats import join_keys


def number(header: Column, key: str) -> Column:
    """A card's value as a number; null where it is none."""
    return F.trim(F.try_element_at(header, F.lit(key))).try_cast("double")


def updated(header: Column, values: dict[str, Column]) -> Column:
    """A header with the values of some keys replaced or added; null values change nothing."""
    keys = F.array(*map(F.lit, values))
    new = F.map_filter(F.map_from_arrays(keys, F.array(*(v.cast("string") for v in values.values()))), lambda k, v: v.isNotNull())
    kept = F.map_filter(header, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def scaled_cards(header: Column, sy: Column, sx: Column, height: Column, width: Column) -> Column:
    """The header of an image that has shrunk by factors sy and sx to a size: its reference pixel and its matrix, or else steps."""
    has_matrix = number(header, "CD1_1").isNotNull()
    point = lambda k, s: (number(header, k) - 0.5) / s + 0.5
    term = lambda k, s: F.when(has_matrix, number(header, k) * s)
    step = lambda k, s: F.when(~has_matrix, number(header, k) * s)
    return updated(header, {
        "CRPIX1": point("CRPIX1", sx), "CRPIX2": point("CRPIX2", sy), "CD1_1": term("CD1_1", sx), "CD1_2": term("CD1_2", sy), "CD2_1": term("CD2_1", sx), "CD2_2": term("CD2_2", sy),
        "CDELT1": step("CDELT1", sx), "CDELT2": step("CDELT2", sy), "NAXIS1": width.cast("long"), "NAXIS2": height.cast("long"),
    })


def shifted_cards(header: Column, top: Column, left: Column, height: Column | None = None, width: Column | None = None) -> Column:
    """The header of an image whose rows and columns before (top, left) are gone, cut to a size."""
    values = {"CRPIX1": number(header, "CRPIX1") - left, "CRPIX2": number(header, "CRPIX2") - top}
    values |= {} if height is None else {"NAXIS1": width.cast("long"), "NAXIS2": height.cast("long")}
    return updated(header, values)


def resampled(headers: DataFrame, pixels: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Headers and samples (frame, y, x, v) of images resampled to a size."""
    size = spatial.size_of(pixels, ["frame"])
    own = join_keys(headers, size, ["frame"], "left")
    cards = scaled_cards(F.col("header"), F.col("h") / F.lit(float(height)), F.col("w") / F.lit(float(width)), F.lit(height), F.lit(width))
    return own.select("frame", cards.alias("header")), sampling.resized(pixels, ["frame"], height, width)


def cropped(headers: DataFrame, pixels: DataFrame, top: int, left: int, bottom: int, right: int) -> tuple[DataFrame, DataFrame]:
    """Headers and samples of images cut to [top, bottom) and [left, right), as far as they reach."""
    size = spatial.size_of(pixels, ["frame"])
    own = join_keys(headers, size, ["frame"], "left")
    side = lambda end, n, begin: F.greatest(F.lit(0), F.least(F.lit(end), F.col(n)) - begin)
    cards = shifted_cards(F.col("header"), F.lit(top), F.lit(left), side(bottom, "h", top), side(right, "w", left))
    return own.select("frame", cards.alias("header")), spatial.crop(pixels, top, left, bottom, right)


def solution_cards(ra: Column, dec: Column, scale: Column, orientation: Column, width: Column, height: Column) -> Column:
    """Cards of a solution by its centre (degrees), arc seconds a pixel and orientation (degrees): a tangent plane about the middle."""
    turn, step = F.radians(orientation), scale / 3600
    term = lambda x: F.regexp_replace(F.format_string("%.12E", x), r"E\+?(-?)0*(\d)", "E$1$2")
    values = {
        "CRVAL1": F.format_string("%.8f", ra), "CRVAL2": F.format_string("%.8f", dec), "CRPIX1": F.format_string("%.1f", width / 2), "CRPIX2": F.format_string("%.1f", height / 2),
        "CD1_1": term(-step * F.cos(turn)), "CD1_2": term(step * F.sin(turn)), "CD2_1": term(-step * F.sin(turn)), "CD2_2": term(step * F.cos(turn)), "CTYPE1": F.lit("RA---TAN"), "CTYPE2": F.lit("DEC--TAN"),
    }
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
