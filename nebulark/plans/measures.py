"""Registered queries of point-spread functions and photometric calibration on a planted star field over the given vectors,
and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions.sky import Wcs
from nebulark.operators import photometry, psf
from nebulark.plans import views
from nebulark.plans.fields import detect_sql
from nebulark.plans.queries import query, rounded
from nebulark.plans.views import SQL

#: Rules for an image of 64 columns.
RULES = psf.Rules(margin=12, radius=7, moments=9, ring=8, centre=0.9, stars=25)
#: A star in each 40 rows, off the middle of its field by parts of a sample, of several brightnesses and widths.
STAR_SQL = "A * exp(-(pow(y - y0, 2) + pow(x - x0, 2)) / (2 * s * s))"
FIELD = f"""{SQL['img']}, banded AS (SELECT y, x, v, y // 40 AS k FROM img), planted AS (SELECT y, x, v, k, 40 * k + 20 + (k * 7 % 5 - 2) * 0.2 AS y0, 32 + (k * 3 % 7 - 3) * 0.15 AS x0, 1 + k % 4 * 0.5 AS A, 1.6 + k % 3 * 0.2 AS s FROM banded),
f AS MATERIALIZED (SELECT y, x, 0.5 + 0.01 * v + {STAR_SQL} AS v FROM planted)"""


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """y, x, v (the vector's component) and star, the light of the star planted there."""
    k = F.floor(F.col("y") / 40)
    y0, x0 = 40 * k + 20 + (k * 7 % 5 - 2) * 0.2, 32 + (k * 3 % 7 - 3) * 0.15
    s = 1.6 + k % 3 * 0.2
    return views.img(spark, sf).withColumns({"k": k, "star": (1 + k % 4 * 0.5) * F.exp(-(F.pow(F.col("y") - y0, 2) + F.pow(F.col("x") - x0, 2)) / (2 * s * s))})


def star_field(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("y", "x", (0.5 + 0.01 * F.col("v") + F.col("star")).alias("v"))


def nine_sql(y: str, x: str) -> str:
    return ", ".join(f"max(f.v) FILTER (f.y = {y} + {i - 1} AND f.x = {x} + {j - 1}) AS v{i}{j}" for i in range(3) for j in range(3))


#: The paraboloid's greatest value, as SQL over a table t with v00 to v22: t with top.
def peak_sql(t: str) -> str:
    return f"""(SELECT *, CASE WHEN det >= 1e-12 AND abs(sx) <= 1 AND abs(sy) <= 1 THEN v11 + 0.5 * (gx * sx + gy * sy) ELSE v11 END AS top FROM (SELECT *, -(yy * gx - xy * gy) / det AS sx, -(xx * gy - xy * gx) / det AS sy FROM
    (SELECT *, xx * yy - xy * xy AS det FROM (SELECT *, 0.5 * (v12 - v10) AS gx, 0.5 * (v21 - v01) AS gy, v12 + v10 - 2 * v11 AS xx, v21 + v01 - 2 * v11 AS yy, 0.25 * (v22 + v00 - v02 - v20) AS xy FROM {t}))))"""


def middle_sql(x: str) -> str:
    return f"coalesce(list_avg({x}[len({x}) // 4 + 1 : greatest(3 * len({x}) // 4, len({x}) // 4 + 1)]), 0)"


R = RULES
PSF = f"""lv AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w, stddev_pop(v) AS dev, max(v) AS most, list_sort(list(v))[count(*) // 2 + 1] AS med FROM f),
lit AS MATERIALIZED (SELECT f.* FROM f, lv WHERE v >= med + {R.sigma} * dev),
top0 AS (SELECT a.y, a.x FROM lit a, lv WHERE a.y >= {R.margin} AND a.y < h - {R.margin} AND a.x >= {R.margin} AND a.x < w - {R.margin}
  AND NOT EXISTS (SELECT 1 FROM lit b WHERE abs(b.y - a.y) <= {R.search} AND abs(b.x - a.x) <= {R.search} AND (b.v > a.v OR (b.v = a.v AND (b.y < a.y OR (b.y = a.y AND b.x < a.x)))))),
c0 AS (SELECT t.y, t.x, sum(f.y * f.v) / sum(f.v) AS cy, sum(f.x * f.v) / sum(f.v) AS cx, {nine_sql('t.y', 't.x')} FROM top0 t JOIN f ON abs(f.y - t.y) <= {R.centroid} AND abs(f.x - t.x) <= {R.centroid} GROUP BY t.y, t.x),
c1 AS (SELECT y, x, cy, cx, round(cy) AS iy, round(cx) AS ix, top AS peak FROM {peak_sql('c0')}),
w0 AS (SELECT c.y, c.x, c.cy, c.cx, c.iy, c.ix, c.peak, list({{'y': f.y - cy, 'x': f.x - cx, 'v': f.v}}) AS win,
  list_sort(list(f.v) FILTER (pow(f.y - iy, 2) + pow(f.x - ix, 2) BETWEEN {(0.6 * R.ring) ** 2} AND {R.ring ** 2})) AS ring, {nine_sql('c.iy', 'c.ix')} FROM c1 c JOIN f ON abs(f.y - iy) <= {R.moments} AND abs(f.x - ix) <= {R.moments} GROUP BY ALL),
w1 AS (SELECT *, {middle_sql('ring')} AS bg FROM {peak_sql('w0')}),
w2 AS (SELECT y, x, cy, cx, iy, ix, peak, top, bg, p.v - bg AS w, p.y AS py, p.x AS px FROM (SELECT *, unnest(win) AS p FROM w1) WHERE p.v >= bg + (top - bg) * 0.5),
w3 AS (SELECT y, x, cy, cx, iy, ix, peak, sum(py * py * w) / sum(w) AS yy, sum(px * px * w) / sum(w) AS xx, sum(px * py * w) / sum(w) AS xy FROM w2 GROUP BY ALL),
w4 AS (SELECT *, least(greatest(2 * sqrt(2 * ln(2)) * sqrt(greatest((xx + yy + r) / 2, 0)), 1), 30) AS a, least(greatest(2 * sqrt(2 * ln(2)) * sqrt(greatest((xx + yy - r) / 2, 0)), 1), 30) AS b FROM (SELECT *, sqrt(greatest(pow(xx + yy, 2) - 4 * (xx * yy - xy * xy), 0)) AS r FROM w3)),
w5 AS (SELECT *, (a + b) / 2 AS fwhm, 1 - b / a AS ellipticity FROM w4),
a0 AS (SELECT s.*, coalesce(sum(f.v) FILTER (d2 <= pow(1.5 * fwhm, 2)), 0) AS flux, list_sort(list(f.v) FILTER (d2 BETWEEN pow(2 * fwhm, 2) AND pow(3 * fwhm, 2))) AS ring
  FROM (SELECT s.y, s.x, f.v, pow(f.y - cy, 2) + pow(f.x - cx, 2) AS d2 FROM w5 s JOIN f ON abs(f.y - cy) <= 3 * fwhm + 1 AND abs(f.x - cx) <= 3 * fwhm + 1) f JOIN w5 s USING (y, x) GROUP BY ALL),
a1 AS (SELECT a0.*, h, w, most, y * w + x AS star, CASE WHEN bg > 0 THEN flux / sqrt(bg) ELSE flux END AS snr, sqrt(pow(cx - w / 2, 2) + pow(cy - h / 2, 2)) AS distance FROM (SELECT *, {middle_sql('ring')} AS bg FROM a0) a0, lv),
star AS MATERIALIZED (SELECT * FROM a1 WHERE fwhm > {R.widths[0]} AND fwhm < {R.widths[1]} AND snr > {R.signal})"""
#: The best stars and their kernel, as SQL: tables best and kernel.
KERNEL = f"""best AS MATERIALIZED (SELECT * FROM (SELECT *, 0.35 * (1 - ellipticity) + 0.3 * least(snr / 100, 1) + 0.15 / (1 + distance / 500) + 0.2 / (1 + abs(fwhm - 4) / 4) AS score, count(*) OVER () AS candidates FROM star
  WHERE cx >= {R.margin} AND cy >= {R.margin} AND cx < w - {R.margin} AND cy < h - {R.margin} AND peak / most < {R.peaks[1]} AND peak / most > {R.peaks[0]} AND ellipticity < {R.ellipticity} AND distance < sqrt(pow(w / 2, 2) + pow(h / 2, 2)) * {R.centre}) ORDER BY score DESC, star LIMIT {R.stars}),
k0 AS (SELECT star, f.y - iy + {R.radius} AS y, f.x - ix + {R.radius} AS x, f.v FROM best b JOIN f ON abs(f.y - iy) <= {R.radius} AND abs(f.x - ix) <= {R.radius} WHERE iy >= {R.radius} AND ix >= {R.radius} AND iy + {R.radius} < h AND ix + {R.radius} < w),
k1 AS (SELECT star, {R.radius} - sum(y * v) / sum(v) AS dy, {R.radius} - sum(x * v) / sum(v) AS dx FROM k0 GROUP BY star),
k2 AS (SELECT star, y, x, y - dy AS sy, x - dx AS sx FROM k1, (SELECT DISTINCT y, x FROM k0)), k3 AS (SELECT k2.star, k2.y, k2.x, sum(v * (CASE WHEN k0.y = floor(sy) THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE WHEN k0.x = floor(sx) THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END)) AS v
  FROM k2 JOIN k0 ON k0.star = k2.star AND k0.y - floor(sy) IN (0, 1) AND k0.x - floor(sx) IN (0, 1) GROUP BY ALL),
k4 AS (SELECT star, y, x, v / sum(v) OVER (PARTITION BY star) AS v FROM k3), k5 AS (SELECT y, x, sum(v) AS v FROM k4 GROUP BY y, x), kernel AS MATERIALIZED (SELECT y, x, v / sum(v) OVER () AS v FROM k5)"""


@query(f"WITH {FIELD}, {PSF} SELECT CAST(star AS BIGINT) AS star, round(cy, 5) AS y, round(cx, 5) AS x, round(peak, 5) AS peak, round(flux, 4) AS flux, round(fwhm, 5) AS fwhm, round(ellipticity, 5) + 0.0 AS ellipticity, round(distance, 4) AS distance, round(snr, 4) AS snr FROM star")
def psf_stars(spark: SparkSession, sf: str) -> DataFrame:
    found = psf.measured(star_field(spark, sf), [], RULES).select("star", "y", "x", "peak", "flux", "fwhm", "ellipticity", "distance", "snr")
    return rounded(rounded(found, "y", "x", "peak", "fwhm", "ellipticity", to=5), "flux", "distance", "snr", to=4)


@query(f"WITH {FIELD}, {PSF}, {KERNEL} SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(v, 7) + 0.0 AS v FROM kernel")
def psf_kernel(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(psf.estimated(star_field(spark, sf), [], RULES)[0].select("y", "x", "v"), "v", to=7)


@query(f"""WITH {FIELD}, {PSF}, {KERNEL} SELECT round(avg(fwhm), 5) AS fwhm, round(avg(ellipticity), 5) AS ellipticity, (SELECT count(*) FROM k1) AS stars, any_value(candidates) - (SELECT count(*) FROM k1) AS rejected,
(SELECT round(sqrt(sum((pow(y - {R.radius}, 2) + pow(x - {R.radius}, 2)) * v) / sum(v)), 5) FROM kernel) AS spread FROM best""")
def estimate_psf(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(psf.estimated(star_field(spark, sf), [], RULES)[1], "fwhm", "ellipticity", "spread", to=5)


#: Where the field lies in the sky, and its composite: each star with a colour of its own.
WCS = Wcs((32.5, 100.5), (150.0, 20.0), (-2e-4, 0.0, 0.0, 2e-4))
COLOURS = {"r": "1", "g": "(0.6 + 0.1 * (k % 5))", "b": "(0.3 + 0.15 * (k % 4))"}
COMPOSITE = f"{FIELD.replace('f AS MATERIALIZED', 'mono AS')}, rgb AS MATERIALIZED (SELECT y, x, " + ", ".join(f"0.5 + 0.01 * v + {STAR_SQL} * {e} AS {c}" for c, e in COLOURS.items()) + " FROM planted), f AS MATERIALIZED (SELECT y, x, 0.2126 * r + 0.7152 * g + 0.0722 * b AS v FROM rgb)"


def coloured(spark: SparkSession, sf: str) -> DataFrame:
    return planted(spark, sf).select("y", "x", *((0.5 + 0.01 * F.col("v") + F.col("star") * F.expr(e)).alias(c) for c, e in COLOURS.items()))


def world_sql(x: str, y: str) -> str:
    """Right ascension and declination of a pixel, as SQL, by the angles of a tangent plane."""
    xi, eta = f"radians(-2e-4 * ({x} + 1 - 32.5))", f"radians(2e-4 * ({y} + 1 - 100.5))"
    rho = f"sqrt(pow({xi}, 2) + pow({eta}, 2))"
    c = f"atan({rho})"
    dec = f"degrees(asin(cos({c}) * sin(radians(20)) + {eta} * sin({c}) * cos(radians(20)) / greatest({rho}, 1e-300)))"
    return f"150 + degrees(atan2({xi} * sin({c}), {rho} * cos(radians(20)) * cos({c}) - {eta} * sin(radians(20)) * sin({c}))) AS ra, {dec} AS dec"


def planck_sql(t: str) -> str:
    """Light of a temperature at the three wavelengths over the greatest, as SQL."""
    e = [f"2 * 6.626e-34 * pow(2.998e8, 2) / pow({nm}e-9, 5) / (exp(6.626e-34 * 2.998e8 / ({nm}e-9 * 1.381e-23 * ({t}))) - 1)" for nm in (640, 530, 460)]
    return ", ".join(f"{x} / greatest({', '.join(e)}) AS e{c}" for c, x in zip("rgb", e))


KELVIN = "CASE WHEN c < 0 THEN 10000 - c * 20000 WHEN c < 0.5 THEN 7500 + (0.5 - c) * 5000 WHEN c < 1 THEN 5800 + (1 - c) * 3400 WHEN c < 1.5 THEN 4500 + (1.5 - c) * 2600 WHEN c < 2.5 THEN 3500 + (2.5 - c) * 1000 ELSE 2800 + (5 - c) * 280 END"


def calibration_sql(indexed: str) -> str:
    """The calibration, as SQL; indexed makes a table ix of good stars with bp_rp."""
    flux = lambda c: f"greatest(sum({c}) FILTER (d2 <= r2) - coalesce(avg({c}) FILTER (d2 > r2 AND d2 BETWEEN 1.44 * r2 AND 3.24 * r2), 0) * pi() * any_value(r2), 0) AS {c}"
    mean = lambda c: f"sum(e{c} / (er + eg + eb) / ({c} / (r + g + b)) * sqrt(r + g + b)) / sum(sqrt(r + g + b)) * w{c} AS {c}"
    return f"""{detect_sql(COMPOSITE, 5.0)}, good AS MATERIALIZED (SELECT id, x, y, flux, peak, fwhm FROM (SELECT s.*, peak / sig AS snr FROM s SEMI JOIN kept USING (id), bg), size
  WHERE snr >= 20 AND peak < 0.9 * (SELECT max(v) FROM f) AND x >= 10 AND y >= 10 AND x < w - 10 AND y < h - 10 ORDER BY snr DESC, id LIMIT 200), {indexed},
ap AS (SELECT id, any_value(bp_rp) AS bp_rp, {', '.join(map(flux, 'rgb'))} FROM (SELECT id, bp_rp, r, g, b, pow(rgb.y - i.y, 2) + pow(rgb.x - i.x, 2) AS d2, pow(greatest(3, 1.5 * fwhm), 2) AS r2 FROM ix i JOIN rgb ON abs(rgb.y - i.y) <= 2 + 2.7 * greatest(fwhm, 2) AND abs(rgb.x - i.x) <= 2 + 2.7 * greatest(fwhm, 2)) GROUP BY id),
ex AS (SELECT *, {planck_sql('t')} FROM (SELECT *, {KELVIN} AS t FROM (SELECT *, greatest(-0.5, least(5, bp_rp)) AS c FROM ap WHERE r > 0 AND g > 0 AND b > 0))),
wr AS (SELECT er * 0.98 AS wr, eg AS wg, eb * 1.02 AS wb FROM (SELECT {planck_sql('5500')})),
fa AS (SELECT {', '.join(map(mean, 'rgb'))}, any_value(n) AS matched, any_value(ci) AS ci FROM ex, wr, (SELECT count(*) AS n, avg(bp_rp) AS ci FROM ex) GROUP BY wr, wg, wb)
SELECT round(r / g, 5) AS r_factor, 1.0 AS g_factor, round(b / g, 5) AS b_factor, round(ci, 5) AS color_index, matched, (SELECT count(*) FROM good) AS stars FROM fa"""


@query(calibration_sql("ix AS (SELECT *, least(4, greatest(-0.3, 1 / sqrt(greatest(0.1, least(100, flux / peak))) + 0.1 * greatest(-2, least(5, fwhm - 3)))) AS bp_rp FROM good)"))
def photometric_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Colours guessed from the stars' shapes."""
    return rounded(photometry.calibrated(coloured(spark, sf), WCS), "r_factor", "g_factor", "b_factor", "color_index", to=5)


@query(calibration_sql(f"""ct AS (SELECT k AS cat_id, 0.2 + 0.3 * (k % 6) AS bp_rp, {world_sql('x0', 'y0')} FROM (SELECT DISTINCT k, x0, y0 FROM planted)), gw AS (SELECT *, {world_sql('x', 'y')} FROM good),
ix AS (SELECT id, any_value(x) AS x, any_value(y) AS y, any_value(fwhm) AS fwhm, arg_min(bp_rp, d) AS bp_rp FROM (SELECT g.*, c.bp_rp, sqrt(pow((g.ra - c.ra) * cos(radians(g.dec)), 2) + pow(g.dec - c.dec, 2)) AS d FROM gw g JOIN ct c ON abs(g.dec - c.dec) < 1e-3) WHERE d <= 3 * 2e-4 GROUP BY id)"""))
def photometric_calibration_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Colours of a catalogue, met by place in the sky."""
    k = F.col("k")
    places = planted(spark, sf).select("k").distinct().withColumns({"y": 40 * k + 20 + (k * 7 % 5 - 2) * 0.2, "x": 32 + (k * 3 % 7 - 3) * 0.15})
    ra, dec = WCS.to_world("x", "y")
    catalog = places.select(k.alias("cat_id"), ra.alias("ra"), dec.alias("dec"), (0.2 + 0.3 * (k % 6)).alias("bp_rp"))
    return rounded(photometry.calibrated(coloured(spark, sf), WCS, catalog), "r_factor", "g_factor", "b_factor", "color_index", to=5)
