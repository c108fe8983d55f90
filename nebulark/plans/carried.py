"""Registered queries of images with headers and of measures of world coordinates, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions import headers as cards
from nebulark.functions.sky import Wcs
from nebulark.operators import headed
from nebulark.plans import views
from nebulark.plans.queries import query, rounded
from nebulark.plans.views import using

#: Header of plane z: a matrix for even planes, steps for odd ones.
SIZES = "n AS (SELECT z, max(y) + 1 AS h, max(x) + 1 AS w FROM cube GROUP BY z)"


def planes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = views.cube(spark, sf).select(F.col("z").alias("frame"), "y", "x", "v")
    z = F.col("frame")
    text = lambda c: c.cast("double").cast("string")
    common = {"CRPIX1": text(10 + z), "CRPIX2": text(20.5 + z), "CRVAL1": F.lit("150.0"), "OBJECT": F.lit("M 42")}
    matrix = {"CD1_1": text(-0.001 * (z + 1)), "CD1_2": F.lit("1e-5"), "CD2_1": F.lit("2e-5"), "CD2_2": text(0.001 * (z + 1))}
    step = {"CDELT1": text(-0.002 * (z + 1)), "CDELT2": text(0.003 * (z + 1))}
    as_map = lambda values: F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v)))
    header = F.when(z % 2 == 0, as_map(common | matrix)).otherwise(as_map(common | step))
    return rows.select("frame").distinct().select("frame", header.alias("header")), rows


def shown(found: DataFrame, *keys: str) -> DataFrame:
    out = found.select("frame", F.col("header")["OBJECT"].alias("object"), *(headed.number(F.col("header"), k).alias(k.lower()) for k in keys))
    return rounded(out, *(k.lower() for k in keys))


@query(f"""{using('cube')}, {SIZES}, s AS (SELECT z, h / 50.0 AS sy, w / 40.0 AS sx FROM n) SELECT z AS frame, 'M 42' AS object, round((10 + z - 0.5) / sx + 0.5, 6) AS crpix1, round((20.5 + z - 0.5) / sy + 0.5, 6) AS crpix2, CASE WHEN z % 2 = 0 THEN round(-0.001 * (z + 1) * sx, 6) END AS cd1_1,
CASE WHEN z % 2 = 0 THEN round(0.001 * (z + 1) * sy, 6) END AS cd2_2, CASE WHEN z % 2 = 1 THEN round(-0.002 * (z + 1) * sx, 6) END AS cdelt1, CASE WHEN z % 2 = 1 THEN round(0.003 * (z + 1) * sy, 6) END AS cdelt2, 40.0 AS naxis1, 50.0 AS naxis2 FROM s""")
def resampled_headers(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = headed.resampled(*planes(spark, sf), 50, 40)
    return shown(found, "CRPIX1", "CRPIX2", "CD1_1", "CD2_2", "CDELT1", "CDELT2", "NAXIS1", "NAXIS2")


@query(f"{using('cube')}, {SIZES} SELECT z AS frame, 'M 42' AS object, CAST(10 + z - 7 AS DOUBLE) AS crpix1, CAST(20.5 + z - 5 AS DOUBLE) AS crpix2, CAST(least(60, w) - 7 AS DOUBLE) AS naxis1, CAST(greatest(0, least(45, h) - 5) AS DOUBLE) AS naxis2, c.n AS samples FROM n JOIN (SELECT z, count(*) AS n FROM cube WHERE y >= 5 AND y < 45 AND x >= 7 AND x < 60 GROUP BY z) c USING (z)")
def cropped_headers(spark: SparkSession, sf: str) -> DataFrame:
    found, pixels = headed.cropped(*planes(spark, sf), 5, 7, 45, 60)
    return shown(found, "CRPIX1", "CRPIX2", "NAXIS1", "NAXIS2").join(pixels.groupBy("frame").agg(F.count("*").alias("samples")), "frame")


@query("""WITH s AS (SELECT c_custkey AS id, c_custkey * 7919 % 36000 / 100.0 AS ra, c_custkey * 104729 % 17000 / 100.0 - 85 AS dec, 0.5 + c_custkey % 7 * 0.1 AS scale, radians(c_custkey % 360) AS t, 100 + c_custkey % 50 AS w FROM customer)
SELECT id, printf('%.8f', ra) AS crval1, printf('%.8f', dec) AS crval2, printf('%.1f', w / 2) AS crpix1, round(-scale / 3600 * cos(t), 9) + 0.0 AS cd1_1, round(scale / 3600 * sin(t), 9) + 0.0 AS cd1_2, round(-scale / 3600 * sin(t), 9) + 0.0 AS cd2_1, round(scale / 3600 * cos(t), 9) + 0.0 AS cd2_2 FROM s""")
def solution_headers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    side = (100 + k % 50).cast("double")
    found = headed.solution_cards(k * 7919 % 36000 / 100, k * 104729 % 17000 / 100 - 85, 0.5 + k % 7 * 0.1, (k % 360).cast("double"), side, side)
    rows = views.table(spark, sf, "customer").select(k.alias("id"), found.alias("h"))
    terms = [headed.number(F.col("h"), x).alias(x.lower()) for x in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]
    return rounded(rows.select("id", *(F.col("h")[x].alias(x.lower()) for x in ("CRVAL1", "CRVAL2", "CRPIX1")), *terms), "cd1_1", "cd1_2", "cd2_1", "cd2_2", to=9)


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 5 AS k, p_size AS s FROM part) SELECT id, CASE k WHEN 0 THEN 'Ha' WHEN 1 THEN 'OIII' WHEN 2 THEN 'SII' WHEN 3 THEN 'Ha' END AS filter, CASE k WHEN 0 THEN 'High' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' END AS confidence,
CASE k WHEN 0 THEN 'FILTER' WHEN 1 THEN 'MYBAND' WHEN 2 THEN 'WAVELEN' WHEN 3 THEN 'filename' END AS keyword, CASE k WHEN 0 THEN 'G' WHEN 1 THEN 'B' WHEN 2 THEN 'R' WHEN 3 THEN 'G' END AS channel FROM r""")
def filters_of_headers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    card = lambda key, value: F.array(F.struct(F.lit(key).alias("key"), value.alias("value")))
    size = F.col("p_size").cast("string")
    own = F.when(k == 0, card("FILTER", F.concat(F.lit("H-alpha "), size, F.lit("nm")))).when(k == 1, card("MYBAND", F.lit("OIII"))).when(k == 2, card("WAVELEN", F.lit("673.0"))).otherwise(card("GAIN", size))
    name = F.when(k == 3, F.concat(F.lit("shot"), size, F.lit("_HA.fits"))).otherwise("plain.fits")
    found = cards.filter_of_header(own, name)
    rows = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), found.alias("f"))
    return rows.select("id", "f.filter", "f.confidence", "f.keyword", cards.channel_of_filter("f.filter").alias("channel"))


@query("SELECT n_nationkey AS id, round((sqrt(pow(a, 2) + pow(c, 2)) + sqrt(pow(b, 2) + pow(d, 2))) / 2 * 3600, 6) AS scale, round(1000 * sqrt(pow(a, 2) + pow(c, 2)) * 60, 6) AS wide, round(800 * sqrt(pow(b, 2) + pow(d, 2)) * 60, 6) AS high FROM (SELECT n_nationkey, -0.001 * (n_nationkey + 1) AS a, 1e-5 * n_nationkey AS b, 2e-5 * n_nationkey AS c, 0.002 * (n_nationkey + 1) AS d FROM nation)")
def wcs_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel scale and field of view of a transform for each nation: a driver's worth of numbers, from the table."""
    rows = []
    for r in views.table(spark, sf, "nation").select("n_nationkey").collect():  # 25 transforms
        k = r.n_nationkey
        wcs = Wcs((1.0, 1.0), (0.0, 0.0), (-0.001 * (k + 1), 1e-5 * k, 2e-5 * k, 0.002 * (k + 1)))
        rows.append((k, wcs.pixel_scale(), *wcs.field_of_view(1000, 800)))
    return rounded(spark.createDataFrame(rows, "id int, scale double, wide double, high double"), "scale", "wide", "high")
