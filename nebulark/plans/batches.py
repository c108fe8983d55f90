"""Registered queries of pipelines from files, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.operators import pipelines
from nebulark.plans import views
from nebulark.plans.composites import CUBE_BANDS, folder_of, saved_cube, stem
from nebulark.plans.queries import median_clip_sql, query, rounded
from nebulark.plans.views import using
from nebulark.sources import fits

#: Rows of a frame: the vectors are written as frames of this height.
HEIGHT = 50
#: What each folder's frames hold, of a component v.
FOLDERS = {"bias": "0.1 + 0.01 * v", "dark": "0.3 + 0.02 * v * v", "flat": "1.5 + 0.3 * v", "R": "v + 2", "G": "2 + v * v", "B": "3 - v"}
MIDDLE = "list_sort(list({e}))[count(*) // 2 + 1]"
CALIBRATED = f"""fr AS (SELECT y // {HEIGHT} AS f, y % {HEIGHT} AS y, x, v FROM img), bias AS (SELECT y, x, {MIDDLE.format(e=FOLDERS['bias'])} AS b FROM fr GROUP BY y, x),
dark AS (SELECT y, x, {MIDDLE.format(e=FOLDERS['dark'] + ' - b')} AS d FROM fr JOIN bias USING (y, x) GROUP BY y, x), flat0 AS (SELECT y, x, {MIDDLE.format(e=FOLDERS['flat'] + ' - b - d')} AS f0 FROM fr JOIN bias USING (y, x) JOIN dark USING (y, x) GROUP BY y, x),
flat AS (SELECT y, x, CASE WHEN f0 > 0 THEN f0 / (SELECT avg(f0) FROM flat0 WHERE f0 > 0) ELSE 1 END AS w FROM flat0),
lights AS ({' UNION ALL '.join(f"SELECT '{c}' AS channel, f, y, x, {FOLDERS[c]} AS v FROM fr" for c in 'RGB')}),
cal AS (SELECT channel, f, y, x, greatest(CASE WHEN abs(w) > 1e-4 THEN (v - b - d) / w ELSE v - b - d END, 0) AS v FROM lights JOIN bias USING (y, x) JOIN dark USING (y, x) JOIN flat USING (y, x))"""


def folders(spark: SparkSession, sf: str, names: tuple[str, ...] = tuple(FOLDERS)) -> dict[str, str]:
    """A folder of files for each of names, which are in FOLDERS, a file a frame."""
    rows = views.img(spark, sf)
    frame = F.floor(F.col("y") / HEIGHT)
    rows = rows.withColumns({"frame": F.concat(F.lit("f"), frame.cast("string")), "y": (F.col("y") - frame * HEIGHT).cast("int"), "x": F.col("x").cast("int")})
    return {name: folder_of(spark, fits.to_files(rows.withColumn("v", F.expr(e)), "frame", -64)) for name, e in FOLDERS.items() if name in names}


def made(spark: SparkSession, at: dict[str, str]) -> pipelines.Masters:
    return pipelines.masters(spark, at["bias"], at["dark"], at["flat"])


@query(f"{using('img')}, {CALIBRATED} SELECT 'f' || f AS file, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(v, 6) + 0.0 AS v FROM cal WHERE channel = 'R'")
def calibrate_files(spark: SparkSession, sf: str) -> DataFrame:
    at = folders(spark, sf, ("bias", "dark", "flat", "R"))
    return rounded(pipelines.calibrated(spark, at["R"], made(spark, at)).select(stem("frame"), "y", "x", "v"), "v")


@query(f"{using('img')}, {CALIBRATED}, stack AS (SELECT channel || ' ' || y || ' ' || x AS pixel, v / avg(v) OVER (PARTITION BY channel, f) AS v FROM cal), {median_clip_sql(1.2, 1.5, 3)}")
def batch_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    at = folders(spark, sf)
    stack, _, _ = pipelines.batch(spark, {c: at[c] for c in "RGB"}, made(spark, at), 1.2, 1.5, 3, uneven=True)  # the last frame has the rows that are left
    return rounded(stack.select(F.concat_ws(" ", "channel", "y", "x").alias("pixel"), F.col("v").alias("result"), "rejected", "n"), "result")


def collapse_sql(how: str) -> str:
    return f"{using('cube')}, {CUBE_BANDS} SELECT file, y, x, round(coalesce({how}, 0), 6) + 0.0 AS v FROM cube_band GROUP BY file, y, x"


@query(collapse_sql("avg(v) FILTER (v <> 0)"))
def lazy_collapse_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fits.collapse(saved_cube(spark, sf), "mean", 1 << 10).withColumn("file", stem()), "v")


@query(collapse_sql("list_sort(list(v) FILTER (v <> 0))[count(*) FILTER (v <> 0) // 2 + 1]"))
def lazy_collapse_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fits.collapse(saved_cube(spark, sf), "median", 1 << 10).withColumn("file", stem()), "v")
