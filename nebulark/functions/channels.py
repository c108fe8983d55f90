"""Filters, channels, palettes and names of reference files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulark.functions.validity import col

# Wavelengths of filters in nm, channels of filter names, patterns of filter and file names, palettes.
FILTER_NM = {
    "F070W": 700, "F090W": 900, "F115W": 1150, "F140M": 1400, "F150W": 1500, "F162M": 1620, "F164N": 1640, "F150W2": 1500, "F182M": 1820, "F187N": 1870,
    "F200W": 2000, "F210M": 2100, "F212N": 2120, "F250M": 2500, "F277W": 2770, "F300M": 3000, "F322W2": 3220, "F323N": 3230, "F335M": 3350, "F356W": 3560,
    "F360M": 3600, "F405N": 4050, "F410M": 4100, "F430M": 4300, "F444W": 4440, "F460M": 4600, "F466N": 4660, "F470N": 4700, "F480M": 4800,
}
CHANNEL_OF = {
    "Halpha": "ha", "Ha": "ha", "H_alpha": "ha", "H-alpha": "ha", "OIII": "oiii", "O3": "oiii", "[OIII]": "oiii", "SII": "sii", "S2": "sii", "[SII]": "sii", "NII": "nii",
    "Red": "r", "R": "r", "Green": "g", "G": "g", "V": "g", "Blue": "b", "B": "b", "Luminance": "l", "Lum": "l", "Clear": "l", "CLR": "l", "L": "l",
}
FILTER_PATTERNS = (
    ("ha", r"(?i)(?:H[\-_]?(?:alpha|a)|656\s*(?:nm)?|H_?α|F656N)"),
    ("oiii", r"(?i)(?:O\s*III|\[?OIII\]?|502\s*(?:nm)?|O3\b|F502N|F501N)"),
    ("sii", r"(?i)(?:S\s*II|\[?SII\]?|673\s*(?:nm)?|S2\b|F673N)"),
    ("r", r"(?i)\b(?:Red|R['_\-]?band|Sloan[_\-]?r|F444W|F410M|F356W)\b"),
    ("g", r"(?i)\b(?:Green|G['_\-]?band|Sloan[_\-]?g|V[_\-]?band|F200W|F277W)\b"),
    ("b", r"(?i)\b(?:Blue|B['_\-]?band|Sloan[_\-]?b|F115W|F090W|F150W)\b"),
    ("l", r"(?i)\b(?:Lum(?:inance)?|L['_\-]?band|Clear|CLR)\b"),
)
NAME_PATTERNS = (
    ("ha", r"(?i)(?:[_\-]HA[_\-.\s]|[_\-]HALPHA|[_\-]H_?ALPHA|656)"),
    ("oiii", r"(?i)(?:[_\-]OIII[_\-.\s]|[_\-]O3[_\-.\s]|502)"),
    ("sii", r"(?i)(?:[_\-]SII[_\-.\s]|[_\-]S2[_\-.\s]|673)"),
    ("r", r"(?i)(?:[_\-]RED[_\-.\s]|[_\-]R\.)"),
    ("g", r"(?i)(?:[_\-]GREEN[_\-.\s]|[_\-]G\.)"),
    ("b", r"(?i)(?:[_\-]BLUE[_\-.\s]|[_\-]B\.)"),
    ("l", r"(?i)(?:[_\-]LUM[_\-.\s]|[_\-]L\.|[_\-]CLEAR)"),
)
SLOT_PATTERNS = {
    "L": (r"(?i)[_-]l[._-]", r"(?i)luminance|lum|clear"),
    "R": (r"(?i)[_-]r[._-]", r"(?i)ha|h.?alpha|red", r"(?i)f444w|f410m|f356w"),
    "G": (r"(?i)[_-]g[._-]", r"(?i)oiii|o3|green", r"(?i)f200w|f277w"),
    "B": (r"(?i)[_-]b[._-]", r"(?i)sii|s2|blue", r"(?i)f115w|f090w|f150w"),
}
PALETTES = {"SHO": "SHO", "HUBBLE": "SHO", "HOO": "HOO", "HOS": "HOS", "NATURAL": "NaturalColor", "NATURALCOLOR": "NaturalColor", "NATURAL_COLOR": "NaturalColor", "CUSTOM": "Custom"}
REFERENCE_FILE = r"(?i)^jwst_[a-z]+_(distortion|filteroffset|sirskernel|photom|flat|dark|bias|readnoise|gain|linearity|saturation|superbias|ipc|area|specwcs|regions|wavelengthrange|trappars|mask|drizpars|throughput|psfmask)_\d+\.asdf$"
REFERENCE_KINDS = ("distortion", "filteroffset", "sirskernel", "photom", "flat", "dark", "bias", "readnoise", "gain", "linearity", "saturation", "superbias", "ipc", "area", "specwcs", "regions", "wavelengthrange", "trappars", "mask", "drizpars", "throughput", "psfmask")


def looked_up(table: dict, key: Column) -> Column:
    """The value that a literal table has for a key, else null."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.when(key.isNotNull(), F.try_element_at(pairs, key))


def filter_wavelength(name: Column | str) -> Column:
    """Nanometres of a space telescope's filter."""
    return looked_up(FILTER_NM, F.upper(F.trim(col(name))))


def first_of(text: Column, patterns) -> Column:
    """The name of the first pattern that a text has."""
    return F.coalesce(*(F.when(text.rlike(p), name) for name, p in patterns))


def channel_of_header(value: Column | str) -> Column:
    """By a filter's exact name, then its pattern, then its wavelength: up to 1200 nm blue, up to 2500 nm green, else red."""
    value = F.trim(col(value))
    nm = looked_up(FILTER_NM, F.upper(value))
    return F.coalesce(looked_up(CHANNEL_OF, value), first_of(value, FILTER_PATTERNS), F.when(nm <= 1200, "b").when(nm <= 2500, "g").when(nm.isNotNull(), "r"))


def channel_of_name(name: Column | str) -> Column:
    return first_of(col(name), NAME_PATTERNS)


def channel(value: Column | str, name: Column | str) -> Column:
    """Of the header's filter, else of the file's name."""
    return F.coalesce(channel_of_header(value), channel_of_name(name))


def fits_slot(name: Column | str, slot: str) -> Column:
    """Whether a file's name suits the slot L, R, G or B."""
    out = F.lit(False)
    for p in SLOT_PATTERNS[slot]:
        out = out | F.coalesce(col(name).rlike(p), F.lit(False))
    return out


def palette(name: Column | str) -> Column:
    """A palette by any of its names; SHO for others."""
    return F.coalesce(looked_up(PALETTES, F.upper(col(name))), F.lit("SHO"))


def is_reference_file(name: Column | str) -> Column:
    """Whether a name is that of a calibration reference file, by its whole form."""
    return col(name).rlike(REFERENCE_FILE)


def holds_reference(name: Column | str) -> Column:
    """The looser guard of the reader: a name that starts and ends like one and has the kind anywhere."""
    found = F.lit(False)
    for kind in REFERENCE_KINDS:
        found = found | F.contains(col(name), F.lit(kind))
    return col(name).startswith("jwst_") & col(name).endswith(".asdf") & found


def url_decoded(text: Column | str) -> Column:
    """Escapes of two hex digits decoded as UTF-8; plus signs and broken escapes stay."""
    kept = F.regexp_replace(F.regexp_replace(col(text), r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.url_decode(kept)
