"""Registered queries of tile pyramids, previews, bundles and samples, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.operators import sampling, spatial, stats
from nebulark.plans import views
from nebulark.plans.composites import BANDS, files_of, folder_of
from nebulark.plans.fields import composite
from nebulark.plans.queries import OK, query, rounded
from nebulark.plans.views import using
from nebulark.sources import bundles, fits, png

#: Side of tiles, and levels that the SQL is written out for.
SIDE, LEVELS = 16, 14


def levels_sql(values: str, byte: str) -> str:
    """The levels of a pyramid over l0 (y, x, values), as SQL: a table px of level, y, x and bytes."""
    names = [v.strip() for v in values.split(",")]
    mean = ", ".join(f"coalesce(avg({v}) FILTER (isfinite({v})), 0) AS {v}" for v in names)
    out = "".join(f", l{k} AS MATERIALIZED (SELECT y // 2 AS y, x // 2 AS x, {mean} FROM l{k - 1} GROUP BY y // 2, x // 2)" for k in range(1, LEVELS))
    out += f", n AS (SELECT greatest(0, CAST(ceil(log2(greatest(max(y) + 1, max(x) + 1) / {SIDE})) AS BIGINT)) AS n FROM l0), px AS ("
    return out + " UNION ALL ".join(f"SELECT n - {k} AS level, y, x, {byte} FROM l{k}, n WHERE n >= {k}" for k in range(LEVELS)) + ")"


BOUNDS = f"q AS (SELECT l[least(CAST(floor(len(l) * 0.001) AS BIGINT), len(l) - 1) + 1] AS lo, l[least(CAST(floor(len(l) * 0.999) AS BIGINT), len(l) - 1) + 1] AS hi FROM (SELECT list_sort(list(v) FILTER ({OK})) AS l FROM img))"
GREY = "CAST(round(least(greatest((v - (SELECT lo FROM q)) * (255 / greatest((SELECT hi - lo FROM q), 1e-10)), 0), 255)) AS INTEGER) AS v"
COLOURS = ", ".join(f"CAST(round(least(greatest({c}, 0), 1) * 255) AS INTEGER) AS {c}" for c in "rgb")


@query(f"{using('img')}, {BOUNDS}, l0 AS (SELECT y, x, v FROM img){levels_sql('v', GREY)} SELECT CAST(level AS INTEGER) AS level, y, x, v FROM px")
def tile_pyramid(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.img(spark, sf)
    return png.pyramid(rows, SIDE).withColumn("v", png.byte_of("v", *png.percentile_bounds(rows)))


@query(f"{using('img')}, l0 AS (SELECT y, x, v AS r, v * v AS g, v + 0.1 AS b FROM img){levels_sql('r, g, b', COLOURS)} SELECT CAST(level AS INTEGER) AS level, CAST(y // {SIDE} AS INTEGER) AS ty, CAST(x // {SIDE} AS INTEGER) AS tx, count(*) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM px GROUP BY ALL")
def tile_pyramid_rgb(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles as PNG, and the sums of the bytes read back from them."""
    made = png.tiles_rgb(composite(spark, sf), SIDE)
    n = png.pyramid(composite(spark, sf), SIDE, ("r", "g", "b")).groupBy("level", F.floor(F.col("y") / SIDE).cast("int").alias("ty"), F.floor(F.col("x") / SIDE).cast("int").alias("tx")).agg(F.count("*").alias("n"))
    sums = made.mapInPandas(png.byte_sums, "level int, ty int, tx int, r long, g long, b long")
    return sums.join(n, ["level", "ty", "tx"])


@query(f"{using('img')}, n AS (SELECT greatest(max(y) + 1, max(x) + 1) AS most, max(y) + 1 AS h, max(x) + 1 AS w FROM img), s AS (SELECT h, w, greatest(1, CAST(floor(h * 100 / most + 0.5) AS BIGINT)) AS ph, greatest(1, CAST(floor(w * 100 / most + 0.5) AS BIGINT)) AS pw FROM n), "
       "c AS (SELECT dy, unnest(range(0, pw)) AS dx, h, w, ph, pw FROM (SELECT *, unnest(range(0, ph)) AS dy FROM s)) "
       "SELECT dy AS y, dx AS x, " + ", ".join(f"CAST(round(least(greatest({e}, 0), 1) * 255) AS INTEGER) AS {c}" for c, e in {"r": "2 * v", "g": "1 - v * v", "b": "v + 0.1"}.items()) + " FROM c JOIN img ON y = least(floor(dy * (h / ph)), h - 1) AND x = least(floor(dx * (w / pw)), w - 1)")  # fmt: skip
def preview_rgb_rendered(spark: SparkSession, sf: str) -> DataFrame:
    return png.preview_rgb(composite(spark, sf), 100, {"r": lambda c: 2 * c, "g": lambda c: 1 - c, "b": lambda c: c})


@query(f"{using('img')}, {BANDS}, n AS (SELECT file, max(x) + 1 AS w, max(y) + 1 AS h FROM img_band GROUP BY file) SELECT 'shots/' || file || '.fits' AS name, 2880 + CAST(ceil(w * h * 4 / 2880) AS BIGINT) * 2880 AS size FROM n")
def zip_members(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.listed(spark, exported(spark, sf)).select("name", "size")


@query(f"{using('img')}, {BANDS} SELECT 'shots/' || file || '.fits' AS file, y, x, v FROM img_band")
def zip_export(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle written by tasks, and the samples of its members read back."""
    return fits.pixels_of(bundles.contents(bundles.listed(spark, exported(spark, sf)))).select("file", "y", "x", "v")


def exported(spark: SparkSession, sf: str) -> str:
    folder = folder_of(spark, files_of(spark, sf, "img").where("frame IS NULL")) + "/bundle"
    bundles.export(files_of(spark, sf, "img").select(F.concat(F.lit("shots/"), "frame", F.lit(".fits")).alias("name"), "content"), f"{folder}/all.zip")
    return folder


@query(f"{using('img')}, {BANDS}, n AS (SELECT file, max(x) + 1 AS w, max(y) + 1 AS h FROM img_band GROUP BY file) SELECT CAST(sum(2880 + CAST(ceil(w * h * 4 / 2880) AS BIGINT) * 2880) AS BIGINT) AS bytes, count(*) AS files FROM n")
def output_folder_info(spark: SparkSession, sf: str) -> DataFrame:
    return fits.folder_info(spark, folder_of(spark, files_of(spark, sf, "img")))


@query(f"{using('frames')}, m AS (SELECT frame, avg(v) AS mean, stddev_samp(v) AS sigma, max(v) AS peak FROM frames WHERE isfinite(v) GROUP BY frame) SELECT frame, round(mean, 6) AS mean, round(sigma, 6) AS sigma, round((peak - mean) / sigma, 6) AS snr FROM m")
def mean_sigma_snr(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.frames(spark, sf)
    found = stats.mean_sigma(rows, ["frame"]).join(rows.groupBy("frame").agg(F.max("v").alias("peak")), "frame")
    return rounded(found.select("frame", "mean", "sigma", stats.peak_snr(F.col("peak"), F.col("mean"), F.col("sigma")).alias("snr")), "mean", "sigma", "snr")


@query(f"{using('img', 'stars')}, n AS (SELECT max(y) AS h, max(x) AS w FROM img), p AS (SELECT star_id, greatest(0, least(h, round(s.y / 3 - 5))) AS py, greatest(0, least(w, round(s.x / 13 - 2))) AS px FROM stars s, n) SELECT star_id AS id, v FROM p JOIN img ON img.y = py AND img.x = px")
def nearest_samples(spark: SparkSession, sf: str) -> DataFrame:
    points = views.stars(spark, sf).select(F.col("star_id").alias("id"), (F.col("y") / 3 - 5).alias("y"), (F.col("x") / 13 - 2).alias("x"))
    return sampling.nearest_sample(views.img(spark, sf), points)


@query(f"{using('img')}, n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM img), o AS (SELECT oy, ox, CAST(floor(oy * (h / 37)) AS BIGINT) AS y0, CAST(floor((oy + 1) * (h / 37)) AS BIGINT) AS y1, CAST(floor(ox * (w / 23)) AS BIGINT) AS x0, CAST(floor((ox + 1) * (w / 23)) AS BIGINT) AS x1 FROM n, (SELECT unnest(range(0, 37)) AS oy), (SELECT unnest(range(0, 23)) AS ox)) "
       "SELECT oy AS y, ox AS x, round(avg(v), 6) + 0.0 AS v FROM o JOIN img ON img.y >= y0 AND img.y < y1 AND img.x >= x0 AND img.x < x1 GROUP BY oy, ox")  # fmt: skip
def area_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.area_means(views.img(spark, sf), [], 37, 23), "v")
