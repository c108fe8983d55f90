"""Registered queries of composites, files and buffers, and the SQL that each is held against."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions import color
from nebulark.operators import compose
from nebulark.operators.lineage import checkpoint_folder
from nebulark.plans import views
from nebulark.plans.fields import composite
from nebulark.plans.queries import FRAME_STATS, MTF, OK, STF, query, rounded
from nebulark.plans.views import SQL, using
from nebulark.sources import asdf, buffers, datasource, fits

CHANNELS = f"{SQL['img']}, ch AS (SELECT 'r' AS frame, y, x, v FROM img UNION ALL SELECT 'g', y, x, v * v FROM img UNION ALL SELECT 'b', y, x, v + 0.1 FROM img)"
#: Statistics before, factors, samples after white balance.
BALANCE = f"""{FRAME_STATS.replace('FROM frames', 'FROM ch').replace('s0 AS', 'a0 AS').replace('s AS (', 'a AS (').replace('JOIN s0', 'JOIN a0')}, w0 AS (SELECT frame, med, mad / med AS noise, CASE frame WHEN 'r' THEN 0 WHEN 'g' THEN 1 ELSE 2 END AS k FROM a),
wb AS (SELECT w0.frame, greatest(1e-6, f.med / w0.med) AS factor FROM w0, (SELECT med FROM w0 ORDER BY noise, k LIMIT 1) f), frames AS MATERIALIZED (SELECT frame, y, x, v * factor AS v FROM ch JOIN wb USING (frame))"""
PIVOT = "px AS (SELECT y, x, max(u) FILTER (frame = 'r') AS r, max(u) FILTER (frame = 'g') AS g, max(u) FILTER (frame = 'b') AS b FROM u GROUP BY y, x)"


@query(f"""WITH {CHANNELS}, {BALANCE}, {FRAME_STATS}, {STF}, u AS (SELECT frame, y, x, CASE WHEN {OK} THEN {MTF} ELSE 0 END AS u FROM (SELECT frame, y, x, v, mid, least(greatest(((v - lo) / (hi - lo) - shadow) / (1 - shadow), 0), 1) AS t FROM frames JOIN stf USING (frame))), {PIVOT}
SELECT y, x, round(r, 5) + 0.0 AS r, round(least(g, (r + b) / 2), 5) + 0.0 AS g, round(b, 5) + 0.0 AS b FROM px""")
def compose_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compose.composed(compose.long(composite(spark, sf))), "r", "g", "b", to=5)


LINKED = f"""mean AS (SELECT 'm' AS frame, y, x, sum(v) * (1.0 / 3) AS v FROM frames GROUP BY y, x), {FRAME_STATS.replace('FROM frames', 'FROM mean').replace('s0 AS', 'l0 AS').replace('s AS (', 'l AS (').replace('JOIN s0', 'JOIN l0')}, {STF.replace('FROM s)', 'FROM l)')}"""


@query(f"""WITH {CHANNELS}, frames AS MATERIALIZED (SELECT frame, y, x, v * CASE frame WHEN 'r' THEN 1.0 WHEN 'g' THEN 1.5 ELSE 0.75 END AS v FROM ch), {FRAME_STATS}, {LINKED}, u AS (SELECT frame, y, x, CASE WHEN {OK} THEN {MTF} ELSE 0 END AS u FROM (SELECT f.frame, y, x, v, mid, least(greatest(((v - s.lo) / (s.hi - s.lo) - shadow) / (1 - shadow), 0), 1) AS t FROM frames f JOIN s USING (frame), stf)), {PIVOT}
SELECT y, x, round(r, 5) + 0.0 AS r, round(g, 5) + 0.0 AS g, round(b, 5) + 0.0 AS b FROM px""")
def compose_rgb_linked(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compose.composed(compose.long(composite(spark, sf)), (1.0, 1.5, 0.75), linked=True, green=None), "r", "g", "b", to=5)


@query(f"""{using('img')}, c AS (SELECT y, x, v AS r, v * v AS g, v + 0.1 AS b FROM img), m AS (SELECT least(min(r) FILTER (r > 1e-7), min(g) FILTER (g > 1e-7), min(b) FILTER (b > 1e-7)) AS lo, greatest(max(r), max(g), max(b)) AS hi FROM c)
SELECT y, x, """ + ", ".join(f"round(pow(asinh(least(greatest(({c} - lo) / (hi - lo), 0), 1) * 30) / asinh(30), 0.8), 6) + 0.0 AS {c}" for c in "rgb") + " FROM c, m")
def arcsinh_composite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(compose.arcsinh_composite(composite(spark, sf), 30.0, 0.8), "r", "g", "b")


@query(f"""{using('img')}, c AS (SELECT y, x, v AS r, v * v AS g, v + 0.1 AS b, 1 - v AS l FROM img), n AS (SELECT y, x, """ + ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in "rgbl") + """ FROM c), k AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lum FROM n)
SELECT y, x, """ + ", ".join(f"round(least(greatest({c} * CASE WHEN lum <= 1e-10 THEN 1 ELSE l / lum END, 0), 1), 5) + 0.0 AS {c}" for c in "rgb") + " FROM k")
def compose_masters(spark: SparkSession, sf: str) -> DataFrame:
    rows = compose.long(composite(spark, sf)).unionByName(views.img(spark, sf).select(F.lit("L").alias("channel"), "y", "x", (1 - F.col("v")).alias("v")))
    return rounded(compose.from_masters(rows.withColumn("channel", F.upper("channel"))), "r", "g", "b", to=5)


NARROW = ("sii", "ha", "oiii")


def blend_sql(preset: str) -> str:
    of = {"sii": "v", "ha": "v * v", "oiii": "v + 0.1", "r": "0", "g": "0", "b": "0"}
    mix = lambda k: " + ".join(f"{w[k]} * ({of[name]})" for name, *w in color.PRESETS[preset])
    return f"SELECT '{preset}' AS preset, y, x, " + ", ".join(f"round({mix(k)}, 6) + 0.0 AS {c}" for k, c in enumerate("rgb")) + " FROM img"


@query(f"{using('img')} " + " UNION ALL ".join(blend_sql(p) for p in color.PRESETS if p != "rgb"))
def blend_presets(spark: SparkSession, sf: str) -> DataFrame:
    rows = compose.long(composite(spark, sf)).withColumn("channel", F.element_at(F.create_map(*(F.lit(x) for pair in zip("rgb", NARROW) for x in pair)), F.col("channel")))
    parts = [compose.blended(rows, p).select(F.lit(p).alias("preset"), "y", "x", "r", "g", "b") for p in color.PRESETS if p != "rgb"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return rounded(out, "r", "g", "b")


@query(f"""{using('stars')} SELECT star_id, round(greatest(-0.3, least(4, 1 / sqrt(greatest(0.1, least(100, (abs(flux) + 1) / (x + 1)))) + 0.1 * greatest(-2, least(5, y / 100 - 3)))), 6) AS bp_rp FROM stars""")
def synthetic_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    index = compose.colour_index(F.abs("flux") + 1, F.col("x") + 1, F.col("y") / 100)
    return rounded(views.stars(spark, sf).select("star_id", index.alias("bp_rp")), "bp_rp")


#: Rows of a file: tables are written as many files of this height, so that no task holds an image.
BAND = 64
#: The bands of img and cube, as SQL: band, row in it, x and v.
BANDS = f"img_band AS (SELECT 'band' || CAST(y // {BAND} AS VARCHAR) AS file, CAST(y % {BAND} AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v FROM img)"
CUBE_BANDS = f"cube_band AS (SELECT 'band' || CAST(y // {BAND} AS VARCHAR) AS file, CAST(z AS INTEGER) AS z, CAST(y % {BAND} AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v FROM cube)"


def banded(rows: DataFrame, name: str = "frame") -> DataFrame:
    """Rows (y, x, v) as frames of BAND rows each."""
    band = F.floor(F.col("y") / BAND)
    return rows.withColumns({name: F.concat(F.lit("band"), band.cast("string")), "y": (F.col("y") - band * BAND).cast("int"), "x": F.col("x").cast("int")})


def files_of(spark: SparkSession, sf: str, name: str, bitpix: int = -32) -> DataFrame:
    rows = views.img(spark, sf) if name == "img" else views.cube(spark, sf)
    return fits.to_files(banded(rows), "frame", bitpix)


def folder_of(spark: SparkSession, files: DataFrame, extension: str = "fits") -> str:
    """A new shared folder with the files."""
    folder = f"{checkpoint_folder(spark)}/files/{uuid.uuid4().hex}"
    fits.save(files, folder, extension)
    return folder


def stem(c: str = "file"):
    """A file's name without folder and extension; cut from its end, as a pattern that is tried from each character on takes
    longer than reading a sample."""
    own = F.substring_index(c, "/", -1)
    return F.when(F.contains(own, F.lit(".")), F.substring(own, F.lit(1), F.length(own) - F.length(F.substring_index(own, ".", -1)) - 1)).otherwise("").alias("file")


@query(f"{using('img')}, {BANDS} SELECT file, y, x, v FROM img_band")
def fits_image(spark: SparkSession, sf: str) -> DataFrame:
    return fits.read_pixels(spark, folder_of(spark, files_of(spark, sf, "img")), 0).select(stem(), "y", "x", "v")


@query(f"{using('img')}, {BANDS}, q AS (SELECT file, min(v) AS lo, (max(v) - min(v)) / 65535 AS s FROM img_band GROUP BY file), r AS (SELECT file, y, x, least(greatest((v - (lo + s * 32768)) / s, -32768), 32767) AS q, lo, s FROM img_band JOIN q USING (file)) SELECT file, y, x, round(trunc(q + CASE WHEN q < 0 THEN -0.5 ELSE 0.5 END) * s + lo + s * 32768, 6) + 0.0 AS v FROM r")
def fits_image_16_bits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fits.read_pixels(spark, folder_of(spark, files_of(spark, sf, "img", 16))).select(stem(), "y", "x", "v"), "v")


@query(f"{using('cube')}, {CUBE_BANDS}, n AS (SELECT file, max(z) + 1 AS d, max(y) + 1 AS h, max(x) + 1 AS w FROM cube_band GROUP BY file) SELECT file, CAST(0 AS INTEGER) AS hdu, CAST(pos AS INTEGER) AS pos, key, value FROM (SELECT file, unnest(range(0, 6)) AS pos, unnest(['SIMPLE', 'BITPIX', 'NAXIS', 'NAXIS1', 'NAXIS2', 'NAXIS3']) AS key, unnest(['T', '-32', '3', CAST(w AS VARCHAR), CAST(h AS VARCHAR), CAST(d AS VARCHAR)]) AS value FROM n)")
def fits_header_cards(spark: SparkSession, sf: str) -> DataFrame:
    return fits.read_headers(spark, folder_of(spark, files_of(spark, sf, "cube"))).withColumn("file", stem())


@query(f"{using('cube')}, {CUBE_BANDS} SELECT file, 6 AS cards, '-32' AS bitpix, CAST(max(y) + 1 AS VARCHAR) AS height FROM cube_band GROUP BY file")
def fits_merged_header(spark: SparkSession, sf: str) -> DataFrame:
    found = fits.merged_header(fits.read_headers(spark, folder_of(spark, files_of(spark, sf, "cube"))), 0)
    return found.select(stem(), (F.size("header") + 1).alias("cards"), F.col("header")["BITPIX"].alias("bitpix"), F.col("header")["NAXIS2"].alias("height"))


@query(f"{using('cube')}, {CUBE_BANDS} SELECT file, z, y, x, v FROM cube_band")
def fits_cube(spark: SparkSession, sf: str) -> DataFrame:
    return fits.read_pixels(spark, folder_of(spark, files_of(spark, sf, "cube"))).select(stem(), "z", "y", "x", "v").where(~F.isnan("v"))


def saved_cube(spark: SparkSession, sf: str) -> DataFrame:
    return fits.open_cubes(spark, folder_of(spark, files_of(spark, sf, "cube")))


@query(f"{using('cube')}, {CUBE_BANDS} SELECT file, z, y, x, v FROM cube_band WHERE z % 3 = 1")
def lazy_cube_frames(spark: SparkSession, sf: str) -> DataFrame:
    return fits.read_frames(saved_cube(spark, sf), F.col("z") % 3 == 1, 7).select(stem(), "z", "y", "x", "v").where(~F.isnan("v"))


@query(f"{using('cube')}, {CUBE_BANDS} SELECT file, z, v FROM cube_band WHERE y = 3 AND x = 7")
def lazy_cube_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return fits.read_spectra(saved_cube(spark, sf), 3, 7).select(stem(), "z", "v").where(~F.isnan("v"))


@query(f"{using('cube')}, {CUBE_BANDS} SELECT file, z, y, x, v FROM cube_band WHERE z IN (1, 4) AND y >= 2 AND y < 40")
def fits_source(spark: SparkSession, sf: str) -> DataFrame:
    """Spark's own reader of the files, some planes and rows of each."""
    datasource.register(spark)
    rows = spark.read.format("fits").option("split", 1 << 15).load(folder_of(spark, files_of(spark, sf, "cube")))
    return rows.where(F.col("z").isin(1, 4) & (F.col("y") >= 2) & (F.col("y") < 40) & ~F.isnan("v")).select(stem(), "z", "y", "x", "v")


#: How the files of a band are written: kind of samples and compression, by the band's number.
WRITTEN = (("<f8", ""), (">f8", "zlib"), ("<f4", "bzp2"), (">f4", ""))


def asdf_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = banded(views.img(spark, sf))
    number = F.regexp_extract("frame", "[0-9]+", 0).cast("int") % len(WRITTEN)
    pick = lambda k: F.element_at(F.array(*(F.lit(w[k]) for w in WRITTEN)), number + 1)
    return asdf.to_files(rows.withColumns({"kind": pick(0), "compression": pick(1)}), "frame")


@query(f"{using('img')}, {BANDS} SELECT file, y, x, v FROM img_band")
def asdf_image(spark: SparkSession, sf: str) -> DataFrame:
    """Both byte orders, two kinds of samples, plain and compressed blocks."""
    return asdf.read_images(spark, folder_of(spark, asdf_files(spark, sf), "asdf")).select(stem(), "y", "x", "v")


@query(f"{using('img')}, {BANDS} SELECT file, 'data' AS name, max(y) + 1 AS height, max(x) + 1 AS width, CAST(max(y) + 1 AS VARCHAR) AS naxis2, file AS frame FROM img_band GROUP BY file")
def asdf_header(spark: SparkSession, sf: str) -> DataFrame:
    opened = asdf.open_arrays(asdf.listed(spark, folder_of(spark, asdf_files(spark, sf), "asdf")))
    return opened.select(stem(), "name", "height", "width", F.col("header")["NAXIS2"].alias("naxis2"), F.col("header")["META_FRAME"].alias("frame"))


@query(f"{using('img')}, {BANDS}, m AS (SELECT file, min(v) AS lo, max(v) - min(v) AS span FROM img_band GROUP BY file), q AS (SELECT file, y, x, CAST(floor((v - lo) / span * 65535) AS INTEGER) AS q FROM img_band JOIN m USING (file)) SELECT file AS frame, base64(unhex(string_agg(printf('%02X%02X', q % 256, q // 256), '' ORDER BY y, x))) AS text FROM q GROUP BY file")
def preview_u16(spark: SparkSession, sf: str) -> DataFrame:
    return buffers.preview_u16(banded(views.img(spark, sf)), "frame")


@query(f"{using('img')}, {BANDS}, q AS (SELECT file, y, x, " + ", ".join(f"CAST(floor(least(greatest({e}, 0), 1) * 255) AS INTEGER) AS {c}" for c, e in zip("rgb", ("v", "v * v", "v + 0.1"))) + " FROM img_band) SELECT file AS frame, base64(unhex(string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY y, x))) AS text FROM q GROUP BY file")
def preview_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return buffers.preview_rgb(banded(composite(spark, sf)), "frame")


@query(f"{using('img')}, {BANDS}, n AS (SELECT file, max(x) + 1 AS width, max(y) + 1 AS height FROM img_band GROUP BY file) SELECT file AS frame, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(v, 9) + 0.0 AS v FROM img_band JOIN n USING (file)")
def pixel_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Buffers, and the samples read back from their bytes."""
    found = buffers.raw(banded(views.img(spark, sf)), "frame")
    byte = lambda at: F.hex(F.substr("content", at.cast("int"), F.lit(1)))
    number = lambda at: F.conv(F.concat(*(byte(at + k) for k in (3, 2, 1, 0))), 16, 10).cast("long")  # noqa: E731  little-endian
    rows = found.withColumns({"width": number(F.lit(1)), "height": number(F.lit(5))}).withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("(octet_length(content) - 16) div 4 - 1").cast("int"))))
    rows = rows.withColumn("bits", number(17 + 4 * F.col("k")))
    power, part = F.shiftright("bits", 23).bitwiseAND(F.lit(255)), F.col("bits").bitwiseAND(F.lit(0x7FFFFF))
    size = F.when(power == 0, part * F.pow(F.lit(2.0), F.lit(-149))).otherwise((1 + part / (1 << 23)) * F.pow(F.lit(2.0), power - 127))
    value = F.when(F.shiftright("bits", 31) == 1, -size).otherwise(size)
    return rounded(rows.select("frame", "width", "height", F.floor(F.col("k") / F.col("width")).alias("y"), (F.col("k") % F.col("width")).alias("x"), value.alias("v")), "v", to=9)


@query(f"{using('stars')} SELECT star_id || ',' || printf('%.4f', x) || ',' || printf('%.4f', y) || ',0.0000,' || printf('%.4f', flux) || ',5778.0000' AS line FROM stars")
def star_catalogue_lines(spark: SparkSession, sf: str) -> DataFrame:
    return buffers.star_catalogue(views.stars(spark, sf).withColumns({"z": F.lit(0.0), "temperature": F.lit(5778.0)}))


def bundled(files: DataFrame) -> DataFrame:
    """Each file in a bundle of its own within a bundle, beside one that is broken and one of another kind."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            for name, content in zip(pdf["frame"], pdf["content"]):
                z.writestr(f"{name}.fits", bytes(content))
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr("deep/inner.zip", inner.getvalue())
            z.writestr("broken.zip", b"no bundle")
            z.writestr("notes.txt", b"text")
        return pd.DataFrame({"name": [f"{pdf['frame'].iloc[0]}.zip"], "content": [outer.getvalue()]})

    return files.groupBy("frame").applyInPandas(build, "name string, content binary")


@query(f"{using('img')}, {BANDS} SELECT file || '.zip/deep/inner.zip/' || file || '.fits' AS file, y, x, v FROM img_band")
def zip_input(spark: SparkSession, sf: str) -> DataFrame:
    return fits.pixels_of(fits.first_of_bundle(fits.expanded(bundled(files_of(spark, sf, "img"))))).select("file", "y", "x", "v")
