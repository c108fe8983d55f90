"""Registered queries of backgrounds, detection, masks, denoising, drizzle and curves, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions import stretch
from nebulark.operators import background, detection, masked, spatial, stacking, stars, stats
from nebulark.plans import views
from nebulark.plans.queries import OK, UPPER, query, rounded
from nebulark.plans.views import SQL, using


def upper(x: str) -> str:
    return f"list_sort(list({x}))[count(*) // 2 + 1]"


def clipped_sql(source: str, keys: str, kappa: float, passes: int, name: str) -> str:
    """Clipped statistics of a table (keys, v), as SQL: median and sigma of what passes leave."""
    out, last = [], source
    for k in range(passes):
        out.append(f"{name}m{k} AS (SELECT {keys}, median(v) AS m, count(*) AS n FROM {last} GROUP BY {keys})")
        out.append(f"{name}d{k} AS (SELECT {keys}, v, m, n, median(abs(v - m)) OVER (PARTITION BY {keys}) AS d FROM {last} JOIN {name}m{k} USING ({keys}))")
        out.append(f"{name}r{k} AS (SELECT {keys}, v FROM {name}d{k} WHERE n < 3 OR abs(v - m) <= {kappa} * greatest(d * 1.4826, 1e-10))")
        last = f"{name}r{k}"
    out.append(f"{name}e AS (SELECT {keys}, median(v) AS m FROM {last} GROUP BY {keys})")
    out.append(f"{name} AS (SELECT {keys}, any_value(m) AS m, greatest(median(abs(v - m)) * 1.4826, 1e-10) AS s FROM {last} JOIN {name}e USING ({keys}) GROUP BY {keys})")
    return ", ".join(out)


#: Tiles of 32 to 256 samples of a view f (y, x, v), and the background that they give.
TILES = f"""size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM f), side AS (SELECT greatest(32, least(256, least(h, w) // 8)) AS t FROM size),
t0 AS (SELECT y // t AS ty, x // t AS tx, v FROM f, side WHERE {OK}), t1 AS (SELECT * FROM t0 SEMI JOIN (SELECT ty, tx FROM t0 GROUP BY ty, tx HAVING count(*) >= 8) USING (ty, tx)), {clipped_sql('t1', 'ty, tx', 3.0, 2, 'tile')},
bg AS (SELECT coalesce({upper('m')}, 0) AS med, greatest(coalesce({upper('s')}, 1), 1e-10) AS sig, count(*) AS tiles FROM tile)"""


def components_sql(condition: str) -> str:
    """Components of samples of f, and bg and size, that meet a condition: a table p of label, y, x and v."""
    return f"""b AS MATERIALIZED (SELECT y, x, v FROM f, bg WHERE isfinite(v) AND {condition}),
r(root, y, x) AS (SELECT y * w + x, y, x FROM b, size UNION SELECT r.root, b.y, b.x FROM r, (SELECT unnest([-1, 0, 1]) AS dy) i, (SELECT unnest([-1, 0, 1]) AS dx) j JOIN b ON b.y = r.y + dy AND b.x = r.x + dx),
l AS (SELECT y, x, min(root) AS label FROM r GROUP BY y, x), inside AS (SELECT label FROM l, size GROUP BY label HAVING bool_or(y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2)),
p AS (SELECT label, y, x, v FROM l SEMI JOIN inside USING (label) JOIN b USING (y, x))"""


#: Moments of components p0 (label, y, x, f), as SQL.
MOMENTS = """m AS (SELECT label, sum(f) AS flux, max(f) AS peak, count(*) AS npix, sum(f * y) / sum(f) AS cy, sum(f * x) / sum(f) AS cx FROM p0 GROUP BY label HAVING sum(f) > 0),
q AS (SELECT label, flux, peak, npix, cy, cx, sum((x - cx) * (x - cx) * f) / flux AS ixx, sum((y - cy) * (y - cy) * f) / flux AS iyy, sum((x - cx) * (y - cy) * f) / flux AS ixy FROM p0 JOIN m USING (label) GROUP BY label, flux, peak, npix, cy, cx),
e AS (SELECT *, (ixx + iyy) / 2 + sqrt(pow(ixx - iyy, 2) / 4 + ixy * ixy) AS big, greatest((ixx + iyy) / 2 - sqrt(pow(ixx - iyy, 2) / 4 + ixy * ixy), 0) AS small FROM q),
star AS (SELECT label, cx AS x, cy AS y, flux, peak, npix, 2.3548200450309493 * sqrt((ixx + iyy) / 2) AS fwhm, CASE WHEN big > 1e-10 THEN sqrt(greatest(0, 1 - small / big)) ELSE 0 END AS eccentricity FROM e)"""


def apart_sql(source: str, radius: float) -> str:
    """Of a table (id, x, y, flux), brightest first, ids that no kept one is too near to: a table kept (id)."""
    return f"""o AS (SELECT *, row_number() OVER (ORDER BY flux DESC, id) AS i FROM {source}),
g(i, k) AS (SELECT 0, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) UNION ALL
SELECT o.i, CASE WHEN len(list_filter(k, lambda z: pow(z.x - o.x, 2) + pow(z.y - o.y, 2) < {radius * radius})) > 0 THEN k ELSE list_append(k, {{'id': o.id, 'x': o.x, 'y': o.y}}) END FROM g JOIN o ON o.i = g.i + 1),
kept AS (SELECT unnest(list_transform(k, lambda z: z.id)) AS id FROM (SELECT arg_max(k, i) AS k FROM g))"""


FIELD = f"{SQL['img']}, f AS (SELECT y, x, v FROM img)"


@query(f"WITH {FIELD}, {TILES} SELECT round(med, 6) AS background, round(sig, 6) AS sigma, tiles FROM bg")
def tile_background(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(background.tile_background(views.img(spark, sf), []), "background", "sigma")


@query(f"WITH RECURSIVE {FIELD}, size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM f), bg AS (SELECT 0 AS med), {components_sql('v > 0.15')} SELECT label, count(*) AS npix, round(sum(v), 6) AS flux FROM p GROUP BY label")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.labelled(views.img(spark, sf), [], 0.15).groupBy("label").agg(F.count("*").alias("npix"), F.round(F.sum("v"), 6).alias("flux"))


STAR_COLS = ("x", "y", "flux", "peak", "fwhm", "eccentricity")
ROUNDED = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in STAR_COLS)


@query(f"WITH RECURSIVE {FIELD}, size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM f), bg AS (SELECT 0 AS med), {components_sql('v > 0.15')}, p0 AS (SELECT label, y, x, v AS f FROM p), {MOMENTS} SELECT label, npix, {ROUNDED} FROM star")
def component_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.component_moments(spatial.labelled(views.img(spark, sf), [], 0.15), []), *STAR_COLS, to=4)


def detect_sql(field: str, sigma: float) -> str:
    return f"""WITH RECURSIVE {field}, {TILES}, {components_sql(f'v > med + {sigma} * sig')}, p0 AS (SELECT label, y, x, greatest(v - med, 0) AS f FROM p, bg), {MOMENTS},
s AS (SELECT label AS id, x, y, flux, peak, npix, fwhm, eccentricity FROM star WHERE npix BETWEEN 3 AND 5000 AND fwhm BETWEEN 0.5 AND 30), {apart_sql('s', 3.0)}"""


@query(f"{detect_sql(FIELD, 1.5)} SELECT id AS star_id, npix, {ROUNDED}, round(peak / sig, 4) AS snr FROM s SEMI JOIN kept USING (id), bg")
def detect_stars(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.detected(views.img(spark, sf), [], 1.5)
    return rounded(found.select("star_id", "npix", *STAR_COLS, "snr"), *STAR_COLS, "snr", to=4)


COMPOSITE = f"{SQL['img']}, light AS (SELECT y, x, 0.2126 * v + 0.7152 * (v * v) + 0.0722 * (v + 0.1) AS v FROM img), f AS (SELECT y, x, (v - (SELECT min(v) FROM light)) / ((SELECT max(v) FROM light) - (SELECT min(v) FROM light)) AS v FROM light)"


def composite(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    return views.img(spark, sf).select("y", "x", v.alias("r"), (v * v).alias("g"), (v + 0.1).alias("b"))


@query(f"{detect_sql(COMPOSITE, 2.0)} SELECT id AS star_id, npix, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(flux, 4) + 0.0 AS flux FROM s SEMI JOIN kept USING (id) ORDER BY flux DESC, id LIMIT 200")
def detect_stars_composite(spark: SparkSession, sf: str) -> DataFrame:
    found = detection.brightest(detection.detected_composite(composite(spark, sf), [], 2.0))
    return rounded(found.select("star_id", "npix", "x", "y", "flux"), "x", "y", "flux", to=4)


@query(f"WITH RECURSIVE {SQL['stars']}, s AS (SELECT star_id AS id, x, y, flux FROM stars), {apart_sql('s', 20.0)} SELECT id AS star_id, x, y, flux FROM s SEMI JOIN kept USING (id)")
def star_dedup_grid(spark: SparkSession, sf: str) -> DataFrame:
    return stars.deduplicated(views.stars(spark, sf), 20.0)


APERTURES = """a AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 64 AS DOUBLE) AS sx, CAST(s_suppkey * 13 % 500 AS DOUBLE) AS sy FROM supplier), n AS (SELECT id, v, pow(x - sx, 2) + pow(y - sy, 2) AS r2 FROM a JOIN img ON abs(x - sx) <= 6 AND abs(y - sy) <= 6),
u AS (SELECT id, coalesce(sum(v) FILTER (r2 <= 9), 0) AS total, count(*) FILTER (r2 <= 9) AS npix, list_sort(list(v) FILTER (r2 BETWEEN 16 AND 36)) AS ring FROM n WHERE r2 <= 36 GROUP BY id),
w AS (SELECT *, coalesce(list_avg(ring[len(ring) // 4 + 1 : len(ring) // 4 + greatest(1, len(ring) * 3 // 4 - len(ring) // 4)]), 0) AS back FROM u)"""


@query(f"{using('img')}, {APERTURES} SELECT id AS star_id, round(total, 6) + 0.0 AS total, CAST(npix AS BIGINT) AS npix, round(back, 6) + 0.0 AS background, round(total - back * npix, 6) + 0.0 AS flux FROM w")
def aperture_flux(spark: SparkSession, sf: str) -> DataFrame:
    own = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("star_id"), (F.col("s_suppkey") * 7 % 64).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 500).cast("double").alias("y"))
    return rounded(stars.aperture_flux(own, views.img(spark, sf), 3.0, 4.0, 6.0).withColumn("npix", F.col("npix").cast("long")), "total", "background", "flux")


BACKGROUND = """f AS (SELECT y, x, v + 1 + y / 1000 AS v FROM img), size AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM f), c0 AS (SELECT floor(y / (h / 8)) AS gy, floor(x / (w / 8)) AS gx, v, y, x, h / 8 AS cy, w / 8 AS cx FROM f, size),
c1 AS (SELECT gy, gx, median(v) FILTER (isfinite(v) AND v > 0) AS v, avg(CASE WHEN isfinite(v) AND v > 0 THEN 1 ELSE 0 END) AS part FROM c0 WHERE y >= gy * cy + cy / 4 AND y < (gy + 1) * cy - cy / 4 AND x >= gx * cx + cx / 4 AND x < (gx + 1) * cx - cx / 4 GROUP BY gy, gx),
k0 AS (SELECT (gy + 0.5) / 8 - 0.5 AS y, (gx + 0.5) / 8 - 0.5 AS x, v FROM c1 WHERE part >= 0.7)""" + "".join(
    f""", k{i + 1} AS (SELECT y, x, v FROM k{i} WHERE abs(v - (SELECT median(v) FROM k{i})) <= 2.5 * greatest((SELECT median(abs(v - m)) FROM k{i}, (SELECT median(v) AS m FROM k{i})) * 1.4826, 1e-10))""" for i in range(3)
) + """, z AS (SELECT count(*) + 1e-8 AS a, sum(y) AS b, sum(x) AS c, sum(y * y) + 1e-8 AS d, sum(y * x) AS e, sum(x * x) + 1e-8 AS f, sum(v) AS p, sum(y * v) AS q, sum(x * v) AS r FROM k3),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM z),
co AS (SELECT (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS c0, (a * (q * f - e * r) - p * (b * f - c * e) + c * (b * r - c * q)) / det AS cy, (a * (d * r - q * e) - b * (b * r - c * q) + p * (b * e - c * d)) / det AS cx FROM det),
mo AS (SELECT f.y, f.x, v, c0 + cy * (f.y / h - 0.5) + cx * (f.x / w - 0.5) AS bg FROM f, size, co)"""


@query(f"{using('img')}, {BACKGROUND} SELECT y, x, round(v - bg + (SELECT median(bg) FROM mo WHERE bg > 0), 5) + 0.0 AS v FROM mo")
def background_poly(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.img(spark, sf).withColumn("v", F.col("v") + 1 + F.col("y") / 1000)
    return rounded(background.corrected(background.model(rows, background.fit(background.samples(rows, 8), 1), 1)), "v", to=5)


@query(f"{using('img')}, {BACKGROUND} SELECT (SELECT count(*) FROM k3) AS n, round(sqrt(avg(pow(v - (c0 + cy * y + cx * x), 2))), 6) AS rms FROM k3, co")
def background_residual(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.img(spark, sf).withColumn("v", F.col("v") + 1 + F.col("y") / 1000)
    found = background.samples(rows, 8)
    return rounded(background.residual(found, background.fit(found, 1), 1), "rms")


def smoothed_sql(source: str, name: str, step: int) -> str:
    taps = lambda axis, of: f"(SELECT y, x, w, least(greatest({axis} + o * {step}, 0), m{axis}) AS t FROM {of}, k, n)"
    return f"""{name}y AS MATERIALIZED (SELECT c.y, c.x, sum(w * s.v) AS v FROM {taps('y', source)} c JOIN {source} s ON s.x = c.x AND s.y = c.t GROUP BY c.y, c.x),
{name} AS MATERIALIZED (SELECT c.y, c.x, sum(w * s.v) AS v FROM {taps('x', name + 'y')} c JOIN {name}y s ON s.y = c.y AND s.x = c.t GROUP BY c.y, c.x)"""


def denoise_sql(scales: int) -> str:
    chain = ", ".join(smoothed_sql("s0" if i == 0 else f"s{i}", f"s{i + 1}", 1 << i) for i in range(scales))
    noise = (0.8908, 0.2007, 0.0856, 0.0413, 0.0205)
    cut = lambda i: f"CASE WHEN abs(s{i}.v - s{i + 1}.v) <= {(3, 2.5, 2, 1.5, 1)[i]} * sg * {noise[i]} THEN 0 ELSE sign(s{i}.v - s{i + 1}.v) * (abs(s{i}.v - s{i + 1}.v) - {(3, 2.5, 2, 1.5, 1)[i]} * sg * {noise[i]}) END"
    joins = " ".join(f"JOIN s{i + 1} USING (y, x)" for i in range(scales))
    return f"""k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o, unnest([1, 4, 6, 4, 1]) / 16 AS w), n AS (SELECT max(y) AS my, max(x) AS mx FROM img), s0 AS MATERIALIZED (SELECT y, x, v FROM img), {chain},
sg AS (SELECT median(abs(s0.v - s1.v)) * 1.4826 AS sg FROM s0 JOIN s1 USING (y, x)), d AS (SELECT y, x, s{scales}.v + {' + '.join(map(cut, range(scales)))} AS v FROM s0 {joins}, sg)"""


@query(f"{using('img')}, {denoise_sql(4)} SELECT y, x, CASE WHEN round(v, 5) > 0 THEN round(v, 5) ELSE 0 END AS v FROM d")
def wavelet_denoise(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(spatial.denoised(views.img(spark, sf), [], 4), "v", to=5)


#: The mask of stars s of a field f and of its bright samples, as SQL: f with mask.
STAR_MASK = """disc AS (SELECT f.y, f.x, max(CASE WHEN d2 <= ri THEN 1 ELSE 1 - pow((d2 - ri) / (ro - ri), 2) * (3 - 2 * ((d2 - ri) / (ro - ri))) END) AS mask FROM (SELECT f.y, f.x, pow(f.x - s.x, 2) + pow(f.y - s.y, 2) AS d2, pow(s.fwhm * 2.5, 2) AS ri, pow(s.fwhm * 2.5 + 4, 2) AS ro
  FROM (SELECT * FROM s SEMI JOIN kept USING (id) WHERE fwhm BETWEEN 1.5 AND 30) s JOIN f ON abs(f.y - s.y) <= s.fwhm * 2.5 + 4 AND abs(f.x - s.x) <= s.fwhm * 2.5 + 4) f WHERE d2 <= ro GROUP BY f.y, f.x),
lit AS (SELECT f.y, f.x, v, coalesce(mask, 0) AS m0, least(greatest((v - 0.85) / (1 - 0.85), 0), 1) AS e FROM f LEFT JOIN disc USING (y, x)),
masked AS MATERIALIZED (SELECT y, x, v, CASE WHEN v > 0.85 AND m0 < 1 THEN greatest(m0, e * e * (3 - 2 * e)) ELSE m0 END AS mask FROM lit)"""

BRIGHT = f"{SQL['img']}, f AS (SELECT y, x, 2 * v AS v FROM img)"


@query(f"{detect_sql(BRIGHT, 3.5)}, {STAR_MASK} SELECT y, x, round(mask, 5) + 0.0 AS mask FROM masked WHERE mask > 1e-9")
def star_mask(spark: SparkSession, sf: str) -> DataFrame:
    f = views.img(spark, sf).withColumn("v", 2 * F.col("v"))
    return rounded(masked.protected(f, masked.star_mask(detection.detected(f, [], 3.5))).where("mask > 1e-9").select("y", "x", "mask"), "mask", to=5)


def stretch_sql(rounds: int) -> str:
    """Rounds of the masked stretch of a table masked (y, x, v, mask), as SQL: a table w with the last state."""
    out = f"""lh AS (SELECT min(v) AS lo, max(v) AS hi FROM masked WHERE {OK}), w0 AS MATERIALIZED (SELECT y, x, mask, CASE WHEN NOT isfinite(v) OR v <= 0 THEN 0 ELSE least(greatest((v - lo) / (hi - lo), 0), 1) END AS v FROM masked, lh), b0 AS (SELECT NULL AS before, false AS stop, 0 AS run, false AS hit)"""
    for k in range(rounds):
        out += f""", u{k} AS MATERIALIZED (SELECT {upper('v')} AS bg FROM w{k} WHERE mask < 0.5 AND v > 0),
b{k + 1} AS MATERIALIZED (SELECT CASE WHEN stop THEN before ELSE bg END AS before, stop OR abs(bg - 0.25) < 1e-5 OR ({k} > 0 AND abs(bg - before) < 1e-6) AS stop, CASE WHEN stop THEN run ELSE {k + 1} END AS run, CASE WHEN stop THEN hit ELSE abs(bg - 0.25) < 1e-5 END AS hit FROM b{k}, u{k}),
q{k} AS (SELECT stop, least(greatest(bg * (0.25 - 1) / (2 * 0.25 * bg - 0.25 - bg), 1e-4), 0.9999) AS mid FROM u{k}, b{k + 1}),
w{k + 1} AS MATERIALIZED (SELECT y, x, mask, CASE WHEN stop THEN v ELSE v * (mask * 0.85) + (CASE WHEN v <= 0 THEN 0 WHEN v >= 1 THEN 1 ELSE least(greatest((mid - 1) * v / ((2 * mid - 1) * v - mid), 0), 1) END) * (1 - mask * 0.85) END AS v FROM w{k}, q{k})"""
    return out


@query(f"{detect_sql(BRIGHT, 3.5)}, {STAR_MASK}, {stretch_sql(10)} SELECT y, x, round(v, 5) + 0.0 AS v, CAST(run AS INTEGER) AS rounds, round((SELECT {upper('v')} FROM w10 WHERE mask < 0.5 AND v > 0), 5) AS background, hit AS converged FROM w10, b10")
def masked_stretch(spark: SparkSession, sf: str) -> DataFrame:
    f = views.img(spark, sf).withColumn("v", 2 * F.col("v"))
    return rounded(masked.stretched(masked.protected(f, masked.star_mask(detection.detected(f, [], 3.5)))), "v", "background", to=5)


RGB_FIELD = f"{SQL['img']}, f AS (SELECT y, x, 0.2126 * v + 0.7152 * (v * v) + 0.0722 * (v + 0.1) AS v FROM img)"


@query(f"{detect_sql(RGB_FIELD, 4.0)}, {STAR_MASK.replace('masked AS MATERIALIZED', 'shared AS MATERIALIZED')}, masked AS MATERIALIZED (SELECT y, x, img.v * img.v AS v, mask FROM shared JOIN img USING (y, x)), {stretch_sql(10)} SELECT y, x, round(v, 5) + 0.0 AS g FROM w10")
def masked_stretch_rgb(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(masked.masked_stretch_rgb(composite(spark, sf), 4.0).select("y", "x", "g"), "g", to=5)


def drizzle_sql(kernel: str = "square") -> str:
    """Cells' samples, as SQL, over the cube as frames: tables hit (oy, ox, v, w) and a, its sums."""
    sinc = lambda t: f"CASE WHEN {t} < 1e-12 THEN 1 WHEN {t} >= 3 THEN 0 ELSE sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} / 3) END"
    weight = {
        "square": "greatest(least(cy + 0.8, oy + 1) - greatest(cy - 0.8, oy), 0) * greatest(least(cx + 0.8, ox + 1) - greatest(cx - 0.8, ox), 0)",
        "gaussian": "exp(-(pow(oy + 0.5 - cy, 2) + pow(ox + 0.5 - cx, 2)) / (2 * 0.8 * 0.8))",
        "lanczos3": f"({sinc('abs(oy + 0.5 - cy)')}) * ({sinc('abs(ox + 0.5 - cx)')})",
    }[kernel]
    cells = lambda c, side: f"unnest(range(CAST(least(greatest(floor({c} - 0.8), 0), {side} - 1) AS BIGINT), CAST(least(greatest(ceil({c} + 0.8), 0), {side} - 1) AS BIGINT) + 1))"
    return f"""n AS (SELECT 2 * (max(y) + 1) AS oh, 2 * (max(x) + 1) AS ow FROM cube), p AS (SELECT v, (y + z * CAST(0.3 AS DOUBLE)) * 2 AS cy, (x - z * CAST(0.2 AS DOUBLE)) * 2 AS cx, oh, ow FROM cube, n),
c AS (SELECT oy, {cells('cx', 'ow')} AS ox, v, cy, cx FROM (SELECT *, {cells('cy', 'oh')} AS oy FROM p)), w AS (SELECT oy, ox, v, {weight} AS w FROM c),
hit AS (SELECT oy, ox, v, w FROM w WHERE w > 1e-12), a AS (SELECT oy, ox, sum(w) AS weight, count(*) AS n FROM hit GROUP BY oy, ox)"""


DRIZZLED = "SELECT oy AS y, ox AS x, round(avg(v), 6) + 0.0 AS value, round(sum(w), 6) AS weight, count(*) AS n FROM hit GROUP BY oy, ox"


def drizzled(spark: SparkSession, sf: str, kernel: str) -> DataFrame:
    rows, offsets = drizzle_input(spark, sf)
    return rounded(stacking.drizzle(rows, offsets, 2.0, 0.8, kernel), "value", "weight")


@query(f"{using('cube')}, {drizzle_sql()} {DRIZZLED}")
def drizzle_square(spark: SparkSession, sf: str) -> DataFrame:
    return drizzled(spark, sf, "square")


@query(f"{using('cube')}, {drizzle_sql('gaussian')} {DRIZZLED}")
def drizzle_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    return drizzled(spark, sf, "gaussian")


@query(f"{using('cube')}, {drizzle_sql('lanczos3')} {DRIZZLED}")
def drizzle_lanczos(spark: SparkSession, sf: str) -> DataFrame:
    return drizzled(spark, sf, "lanczos3")


def drizzle_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = views.cube(spark, sf).select(F.col("z").alias("frame"), "y", "x", "v")
    return rows, rows.select("frame").distinct().select("frame", (F.col("frame") * 0.3).alias("dy"), (F.col("frame") * -0.2).alias("dx"))


def drizzle_clip_sql(low: float, high: float, passes: int) -> str:
    """Clipping of cells by averaged medians, while three samples are left, as SQL: a table r with what passes leave."""
    out = "r0 AS MATERIALIZED (SELECT oy, ox, v FROM hit)"
    for k in range(passes):
        out += f""", m{k} AS (SELECT oy, ox, median(v) AS m, count(*) AS n FROM r{k} GROUP BY oy, ox), d{k} AS (SELECT oy, ox, v, m, n, greatest(median(abs(v - m)) OVER (PARTITION BY oy, ox) * 1.4826, 1e-10) AS s FROM r{k} JOIN m{k} USING (oy, ox)),
r{k + 1} AS MATERIALIZED (SELECT oy, ox, v FROM d{k} WHERE n < 3 OR (v - m >= {-low} * s AND v - m <= {high} * s))"""
    return out


@query(f"{using('cube')}, {drizzle_sql()}, {drizzle_clip_sql(2.0, 2.0, 3)}, z AS (SELECT oy, ox, avg(v) AS value, count(*) AS stay FROM r3 GROUP BY oy, ox), e AS (SELECT oy, ox, avg(v) AS whole FROM hit GROUP BY oy, ox) SELECT oy AS y, ox AS x, round(coalesce(value, whole), 6) + 0.0 AS value, round(weight, 6) AS weight, n, n - coalesce(stay, 0) AS rejected FROM a JOIN e USING (oy, ox) LEFT JOIN z USING (oy, ox)")
def drizzle_clipped(spark: SparkSession, sf: str) -> DataFrame:
    rows, offsets = drizzle_input(spark, sf)
    return rounded(stacking.drizzle_clipped(rows, offsets, 2.0, 0.8, 2.0, 2.0, 3), "value", "weight")


#: The monotone cubic through (0, 0), (0.25, 0.15), (0.75, 0.88) and (1, 1), piece by piece, as SQL over i, its sample's number.
CURVE = """k AS (SELECT 0.6 AS d0, 1.46 AS d1, 0.48 AS d2), g AS (SELECT d0, d1, d2, d0 AS m0, (d0 + d1) / 2 AS m1, (d1 + d2) / 2 AS m2, d2 AS m3 FROM k),
f0 AS (SELECT *, pow(m0 / d0, 2) + pow(m1 / d0, 2) AS t FROM g), f1 AS (SELECT d0, d1, d2, CASE WHEN t > 9 THEN 3 / sqrt(t) * m0 ELSE m0 END AS m0, CASE WHEN t > 9 THEN 3 / sqrt(t) * m1 ELSE m1 END AS m1, m2, m3 FROM f0),
f2 AS (SELECT *, pow(m1 / d1, 2) + pow(m2 / d1, 2) AS t FROM f1), f3 AS (SELECT d0, d1, d2, m0, CASE WHEN t > 9 THEN 3 / sqrt(t) * m1 ELSE m1 END AS m1, CASE WHEN t > 9 THEN 3 / sqrt(t) * m2 ELSE m2 END AS m2, m3 FROM f2),
f4 AS (SELECT *, pow(m2 / d2, 2) + pow(m3 / d2, 2) AS t FROM f3), f5 AS (SELECT m0, m1, CASE WHEN t > 9 THEN 3 / sqrt(t) * m2 ELSE m2 END AS m2, CASE WHEN t > 9 THEN 3 / sqrt(t) * m3 ELSE m3 END AS m3 FROM f4),
pieces AS (SELECT unnest([0.0, 0.25, 0.75]) AS x0, unnest([0.25, 0.75, 1.0]) AS x1, unnest([0.0, 0.15, 0.88]) AS y0, unnest([0.15, 0.88, 1.0]) AS y1, unnest([m0, m1, m2]) AS ta, unnest([m1, m2, m3]) AS tb, unnest([0, 1, 2]) AS piece FROM f5)"""


def toned(c: str) -> str:
    h, t = "(x1 - x0)", f"((floor(least(greatest({c}, 0), 1) * 4095) / 4095 - x0) / (x1 - x0))"
    return f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, r, g, b, y0 * (1 + 2 * {t}) * pow(1 - {t}, 2) + {h} * ta * {t} * pow(1 - {t}, 2) + y1 * pow({t}, 2) * (3 - 2 * {t}) + {h} * tb * pow({t}, 2) * ({t} - 1) AS v FROM rgb JOIN pieces ON piece = CASE WHEN floor(least(greatest({c}, 0), 1) * 4095) / 4095 <= 0.25 THEN 0 WHEN floor(least(greatest({c}, 0), 1) * 4095) / 4095 <= 0.75 THEN 1 ELSE 2 END"


@query(f"{using('rgb')}, {CURVE} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, r, g, b, round(least(greatest(v, 0), 1), 6) AS toned FROM ({toned('r')})")
def tone_curve(spark: SparkSession, sf: str) -> DataFrame:
    lut = stretch.curve_lut([(0.25, 0.15), (0.75, 0.88)])
    return rounded(views.rgb(spark, sf).withColumn("toned", stretch.apply_curve("r", lut)), "toned")


def rank_sql(hist: str, rank: str) -> str:
    """The bin of a rank in a histogram (frame, bin, cnt, and what the rank reads), as SQL."""
    return f"SELECT *, upto - cnt AS under, 1 - (upto - {rank}) / cnt AS frac FROM (SELECT *, sum(cnt) OVER (PARTITION BY frame ORDER BY bin) AS upto FROM {hist}) WHERE upto >= {rank} AND upto - cnt < {rank}"


HIST_STATS = f"""fx AS (SELECT frame, min(v) AS lo, max(v) AS hi, avg(v) AS mean, count(*) AS n, greatest(max(v) - min(v), 1e-30) AS rng, ceil(count(*) * 0.5) AS half FROM frames WHERE {OK} GROUP BY frame),
h1 AS (SELECT frame, half, lo, rng, least(floor((v - lo) * 65536 / rng), 65535) AS bin, count(*) AS cnt FROM frames JOIN fx USING (frame) WHERE {OK} GROUP BY ALL), c1 AS (SELECT frame, half, under, rng / 65536 AS w, rng, lo + bin * (rng / 65536) AS mlo, lo + (bin + frac) * (rng / 65536) AS near FROM ({rank_sql('h1', 'half')})),
h2 AS (SELECT frame, half - under AS r, mlo, w, least(floor((v - mlo) * 65536 / w), 65535) AS bin, count(*) AS cnt FROM frames JOIN c1 USING (frame) WHERE {OK} AND v >= mlo AND v < mlo + w GROUP BY ALL), c2 AS (SELECT frame, mlo + (bin + frac) / 65536 * w AS med FROM ({rank_sql('h2', 'r')})),
h3 AS (SELECT frame, half, w, least(floor(abs(v - near) * 65536 / rng), 65535) AS bin, count(*) AS cnt FROM frames JOIN c1 USING (frame) WHERE {OK} GROUP BY ALL), c3 AS (SELECT frame, half, greatest(bin - 1, 0) * w AS d0, least(bin + 2, 65536) * w AS d1 FROM ({rank_sql('h3', 'half')})),
dv AS (SELECT frame, abs(v - med) AS d, d0, d1, half FROM frames JOIN c2 USING (frame) JOIN c3 USING (frame) WHERE {OK}), be AS (SELECT frame, count(*) FILTER (d < d0) AS below FROM dv GROUP BY frame),
h4 AS (SELECT frame, half - below AS r, d0, d1, least(floor((d - d0) * 65536 / (d1 - d0)), 65535) AS bin, count(*) AS cnt FROM dv JOIN be USING (frame) WHERE d >= d0 AND d < d1 GROUP BY ALL), c4 AS (SELECT frame, d0 + (bin + frac) / 65536 * (d1 - d0) AS mad FROM ({rank_sql('h4', 'r')}))"""


@query(f"{using('frames')}, {HIST_STATS} SELECT frame, round(lo, 5) AS min, round(hi, 5) AS max, round(mean, 5) AS mean, round(med, 5) AS median, round(mad, 5) AS mad, round(mad * 1.4826, 5) AS sigma, n AS valid_count FROM fx JOIN c2 USING (frame) JOIN c4 USING (frame)")
def histogram_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.histogram_stats(views.frames(spark, sf), ["frame"]), "min", "max", "mean", "median", "mad", "sigma", to=5)
