"""Header cards and file names, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulark.functions.validity import col

# Patterns and keyword lists of header metadata.
FILTERS = {
    "Ha": r"(?i)(\bH[\-_]?(?:alpha|a)\b|656\s*(?:nm|\.?\d)|H_?α)",
    "OIII": r"(?i)(\bO\s*III\b|\[?OIII\]?|502\s*(?:nm|\.?\d)|O3\b)",
    "SII": r"(?i)(\bS\s*II\b|\[?SII\]?|673\s*(?:nm|\.?\d)|S2\b)",
}
DISCOVERY = ("FILTER", "FILTER1", "FILTER2", "FILTER3", "INSTRUME", "OBJECT", "IMAGETYP", "FILT_ID", "FILTNAM", "FILTNAME")
IN_NAME = {"Ha": ("_HA", "_HALPHA", "-HA", "_H_ALPHA", "656"), "OIII": ("_OIII", "-OIII", "_O3", "-O3", "502"), "SII": ("_SII", "-SII", "_S2", "-S2", "673")}
CHANNELS = {"SII": "R", "Ha": "G", "OIII": "B"}
PRODUCT = r"(?i)[_-](i2d|segm|cal|rate|rateints|x1d|s2d|s3d|uncal|crf|bsub|srctype|outlier|tweakreg|skymatch|whtlt)(?:\.fits|\.fit|\.fts|\.asdf)$"
#: Category, its keys, and starts of further keys.
CATEGORIES = (
    ("wcs", ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CDELT1", "CDELT2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "CTYPE1", "CTYPE2", "LONPOLE", "LATPOLE", "RADESYS", "EQUINOX", "WCSAXES", "A_ORDER", "B_ORDER"), ("A_", "B_", "AP_", "BP_")),
    ("observation", ("DATE-OBS", "MJD-OBS", "EXPTIME", "EXPOSURE", "OBJECT", "OBSERVER", "TELESCOP", "INSTRUME", "FILTER", "FILTER1", "FILTER2", "AIRMASS", "RA", "DEC", "EPOCH", "GAIN", "OFFSET", "CCD-TEMP", "SET-TEMP"), ()),
    ("image", ("NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "BITPIX", "BSCALE", "BZERO", "DATAMIN", "DATAMAX", "BLANK"), ()),
    ("processing", ("SWCREATE", "SOFTWARE", "HISTORY", "COMMENT", "PROGRAM", "CREATOR", "ORIGIN", "PIPELINE"), ("HISTORY", "COMMENT")),
    ("instrument", (), ("TELESCOP", "INSTRUME", "CAMERA", "CCD", "SENSOR")),
)
SPECTRAL_TYPES = ("WAVE", "FREQ", "VELO", "AWAV", "VRAD", "VOPT", "ZOPT", "BETA", "ENER")
SPECTRAL_UNITS = ("M", "CM", "MM", "UM", "NM", "ANGSTROM", "A", "HZ", "KHZ", "MHZ", "GHZ", "M/S", "KM/S", "EV", "KEV")
#: Unit, factor, unit that comes out.
UNITS = (("M", 1e6, "um"), ("CM", 1e4, "um"), ("MM", 1e3, "um"), ("UM", 1.0, "um"), ("NM", 1.0, "nm"), ("ANGSTROM", 0.1, "nm"), ("A", 0.1, "nm"), ("HZ", 1e-9, "GHz"))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def filter_of_value(value: Column | str) -> Column:
    """The narrowband filter that a header value names; H alpha before OIII before SII."""
    return F.coalesce(*(F.when(col(value).rlike(p), name) for name, p in FILTERS.items()))


def filter_of_wavelength(nm: Column | str) -> Column:
    """Of a wavelength in nm, or in Angstrom beyond 1000."""
    x = F.when(col(nm) > 1000, col(nm) / 10).otherwise(col(nm))
    return F.when(x.between(649, 663), "Ha").when(x.between(495, 510), "OIII").when(x.between(666, 680), "SII")


def filter_of_name(name: Column | str) -> Column:
    upper = F.upper(col(name))
    return F.coalesce(*(F.when(any_of(F.contains(upper, F.lit(x)) for x in parts), f) for f, parts in IN_NAME.items()))


def filter_of_header(cards: Column, name: Column) -> Column:
    """struct(filter, confidence, keyword): from an array of (key, value) cards, then from the file name.

    Keywords of discovery first, in their order; then any key with FILT, BAND or LINE; then wavelengths; then the name.
    """
    first = lambda key: F.try_element_at(F.filter(cards, lambda c: c["key"] == key), F.lit(-1))["value"]
    named = [F.when(filter_of_value(first_or_null(first(k))).isNotNull(), F.struct(filter_of_value(first_or_null(first(k))).alias("filter"), F.lit("High").alias("confidence"), F.lit(k).alias("keyword"))) for k in DISCOVERY]
    loose = F.filter(cards, lambda c: any_of(F.contains(F.upper(c["key"]), F.lit(x)) for x in ("FILT", "BAND", "LINE")) & filter_of_value(c["value"]).isNotNull())
    other = F.when(F.size(loose) > 0, F.struct(filter_of_value(F.get(loose, F.lit(0))["value"]).alias("filter"), F.lit("High").alias("confidence"), F.get(loose, F.lit(0))["key"].alias("keyword")))
    wave = F.coalesce(*(F.trim(first(k)).try_cast("double") for k in ("WAVELEN", "CRVAL3", "WAVELENG")))
    number = F.when(filter_of_wavelength(wave).isNotNull(), F.struct(filter_of_wavelength(wave).alias("filter"), F.lit("Medium").alias("confidence"), F.lit("WAVELEN").alias("keyword")))
    file = F.when(filter_of_name(name).isNotNull(), F.struct(filter_of_name(name).alias("filter"), F.lit("Low").alias("confidence"), F.lit("filename").alias("keyword")))
    return F.coalesce(*named, other, number, file)


def first_or_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(None).cast("string"))


def channel_of_filter(name: Column | str) -> Column:
    return F.coalesce(*(F.when(col(name) == f, c) for f, c in CHANNELS.items()))


def product_type(name: Column | str) -> Column:
    found = F.lower(F.regexp_extract(col(name), PRODUCT, 1))
    return F.when(found != "", found)


def category(key: Column | str) -> Column:
    """The category of a header keyword; null for cards that no category shows."""
    upper = F.upper(col(key))
    found = F.when(upper.isin("SIMPLE", "END", "EXTEND"), F.lit(None).cast("string"))
    for name, keys, starts in CATEGORIES:
        found = found.when(any_of([upper.isin(*keys)] * bool(keys) + [upper.startswith(s) for s in starts]), name)
    return found.otherwise("other")


def is_spectral(ctype: Column, cunit: Column, cdelt: Column, crval: Column, planes: Column) -> Column:
    """Whether the third axis of a cube is a spectrum's."""
    kind, unit = (F.upper(F.trim(F.regexp_replace(F.trim(x), "^'+|'+$", ""))) for x in (ctype, cunit))
    typed = F.coalesce(any_of(F.contains(kind, F.lit(s)) for s in SPECTRAL_TYPES), F.lit(False))
    measured = F.coalesce(any_of(F.contains(unit, F.lit(s)) for s in SPECTRAL_UNITS), F.lit(False)) & cdelt.isNotNull()
    return F.when(typed | measured, True).when(planes <= 4, False).when(cdelt.isNotNull() & crval.isNotNull(), True).otherwise(planes > 10)


def wavelength(i: Column | str, crval: float, crpix: float, cdelt: float, unit: str = "NM") -> Column:
    factor = next((f for u, f, _ in UNITS if u == unit.upper()), 1.0)
    return (crval + (col(i) - crpix + 1) * cdelt) * factor


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def card_value(raw: Column | str) -> Column:
    """The value part of a header card: up to the next quote, right-trimmed, or else up to a slash, trimmed."""
    raw = F.trim(col(raw))
    return F.when(raw.startswith("'"), F.rtrim(F.regexp_extract(raw, "^'([^']*)", 1))).otherwise(F.trim(F.regexp_extract(raw, "^([^/]*)", 1)))


# Starts of the keys of world coordinates in exported headers; keys and starts of a solver's.
WCS_STARTS = ("CRPIX", "CRVAL", "CDELT", "CTYPE", "CUNIT", "CROTA", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "PC1_1", "PC1_2", "PC2_1", "PC2_2", "LONPOLE", "LATPOLE", "RADESYS", "EQUINOX", "EPOCH", "A_ORDER", "B_ORDER", "AP_ORDER", "BP_ORDER", "A_", "B_", "AP_", "BP_", "PV1_", "PV2_", "WCSAXES", "WCSNAME")
SOLVER_KEYS = ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "CDELT1", "CDELT2", "CROTA2", "CTYPE1", "CTYPE2", "CUNIT1", "CUNIT2", "IMAGEW", "IMAGEH", "A_ORDER", "B_ORDER", "AP_ORDER", "BP_ORDER")
SOLVER_TERMS = r"^(A|B|AP|BP)_[0-9_]+$"


def is_wcs_card(key: Column | str) -> Column:
    return any_of(col(key).startswith(s) for s in WCS_STARTS)


def is_solver_key(key: Column | str) -> Column:
    return col(key).isin(*SOLVER_KEYS) | col(key).rlike(SOLVER_TERMS)


def exported_cards(cards: Column, wcs: bool, metadata: bool) -> Column:
    """The cards (array of key, value) that an export keeps; null for none."""
    if wcs and metadata:
        return cards
    if not wcs and not metadata:
        return F.when(F.lit(False), cards)
    kept = F.filter(cards, lambda c: is_wcs_card(F.trim(c["key"])) if wcs else ~is_wcs_card(F.trim(c["key"])))
    return F.when(F.size(kept) > 0, kept)


def with_card(cards: Column, key: str, value: Column) -> Column:
    """Cards with the value of a key replaced where it stands first, or added at the end."""
    one = F.struct(F.lit(key).alias("key"), value.alias("value"))
    at = F.array_position(F.transform(cards, lambda c: c["key"]), F.lit(key))
    return F.when(at > 0, F.transform(cards, lambda c, i: F.when(i + 1 == at, one).otherwise(c))).otherwise(F.concat(cards, F.array(one)))


def number_card(x: Column | str) -> Column:
    """A number as headers write it: 14 decimals and an exponent without plus and leading zeros."""
    return F.regexp_replace(F.format_string("%.14E", col(x).cast("double")), r"E\+?(-?)0*(\d)", "E$1$2")


def card_number(cards: Column, key: str) -> Column:
    """The last value of a key as a number, null where it is none."""
    return F.trim(F.try_element_at(F.filter(cards, lambda c: c["key"] == key), F.lit(-1))["value"]).try_cast("double")
