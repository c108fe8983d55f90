"""Registered queries of resampling, registration, projections and lists of files, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions import color, headers, sky, stretch
from nebulark.functions.validity import finite, valid
from nebulark.operators import cubes, frames, registration, sampling
from nebulark.plans import views
from nebulark.plans.queries import query, rounded
from nebulark.plans.views import using

#: The cubic kernel at distance t, as SQL.
CUBIC = "CASE WHEN t < 1 THEN (1.5 * t - 2.5) * t * t + 1 WHEN t < 2 THEN ((2.5 - 0.5 * t) * t - 4) * t + 2 ELSE 0 END"


def taps_sql(name: str, axis: str, count: str, at: str, inside: bool) -> str:
    """A table of o, i and w: what cells of an axis read, as SQL."""
    weight = f"CASE WHEN p >= -0.5 AND p <= n - 0.5 THEN {CUBIC} ELSE 0 END" if inside else CUBIC
    return f"""{name} AS (SELECT o, greatest(0, least(k, n - 1)) AS i, {weight} AS w FROM (SELECT o, n, p, k, abs(p - k) AS t FROM (SELECT o, n, p, CAST(floor(p) AS BIGINT) + unnest([-1, 0, 1, 2]) AS k
FROM (SELECT o, n, {at} AS p FROM (SELECT n, unnest(range(0, CAST({count} AS BIGINT))) AS o FROM (SELECT max({axis}) + 1 AS n FROM img))))))"""


GATHER = "SELECT ty.o AS y, tx.o AS x, round(sum(v * ty.w * tx.w), 6) + 0.0 AS v FROM img JOIN ty ON ty.i = y JOIN tx ON tx.i = x GROUP BY ty.o, tx.o"


@query(f"{using('img')}, {taps_sql('ty', 'y', '37', 'CAST(o + 0.5 AS DOUBLE) * n / 37 - 0.5', False)}, {taps_sql('tx', 'x', '90', 'CAST(o + 0.5 AS DOUBLE) * n / 90 - 0.5', False)} {GATHER}")
def bicubic_resample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampling.resized(views.img(spark, sf), [], 37, 90), "v")


@query(f"{using('img')}, {taps_sql('ty', 'y', 'n', 'CAST(o AS DOUBLE) + 0.4', True)}, {taps_sql('tx', 'x', 'n', 'CAST(o AS DOUBLE) - 1.3', True)} {GATHER}")
def subpixel_shift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampling.shifted(views.img(spark, sf), [], 0.4, -1.3), "v")


@query(f"""{using('img')}, n AS (SELECT max(y) AS h, max(x) AS w FROM img), p AS (SELECT c_custkey AS id, greatest(0, least(c_custkey * 37 % 1000 / 20.0 - 2, h)) AS py, greatest(0, least(c_custkey * 53 % 1000 / 14.0 - 3, w)) AS px FROM customer, n)
SELECT id, round(sum(v * (1 - abs(py - y)) * (1 - abs(px - x))), 6) + 0.0 AS v FROM p JOIN img ON y IN (floor(py), floor(py) + 1) AND x IN (floor(px), floor(px) + 1) GROUP BY id""")
def bilinear_sample(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    points = views.table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 1000 / 20.0 - 2).alias("y"), (k * 53 % 1000 / 14.0 - 3).alias("x"))
    return rounded(sampling.bilinear(views.img(spark, sf), points), "v")


@query(f"""{using('img')}, d AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d), t AS (SELECT y + 1 AS y, x - 2 AS x, v * 2 + 0.1 AS v FROM img)
SELECT a.d AS dy, b.d AS dx, round(corr(img.v, t.v), 6) + 0.0 AS score, count(*) AS n FROM t, d a, d b JOIN img ON img.y = t.y - a.d AND img.x = t.x - b.d GROUP BY a.d, b.d""")
def correlation_offsets(spark: SparkSession, sf: str) -> DataFrame:
    reference = views.img(spark, sf)
    target = reference.select((F.col("y") + 1).alias("y"), (F.col("x") - 2).alias("x"), (F.col("v") * 2 + 0.1).alias("v"))
    return rounded(sampling.offset_scores(reference, target), "score")


@query(f"""{using('stars')}, p AS (SELECT star_id % 5 AS k, x, y, cos(0.1) * x - sin(0.1) * y + 5 + sin(star_id) AS u, sin(0.1) * x + cos(0.1) * y - 7 + cos(star_id) AS w FROM stars), m AS (SELECT k, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(w) AS mw, count(*) AS n FROM p GROUP BY k),
s AS (SELECT k, n, mx, my, mu, mw, atan2(sum((x - mx) * (w - mw) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (w - mw))) AS t FROM p JOIN m USING (k) GROUP BY ALL)
SELECT k, n, round(degrees(t), 6) AS rotation, round(mu - cos(t) * mx + sin(t) * my, 6) AS tx, round(mw - sin(t) * mx - cos(t) * my, 6) AS ty FROM s""")
def rigid_least_squares(spark: SparkSession, sf: str) -> DataFrame:
    x, y, k = F.col("x"), F.col("y"), F.col("star_id")
    c, s = F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    pairs = views.stars(spark, sf).select((k % 5).alias("k"), "x", "y", (c * x - s * y + 5 + F.sin(k)).alias("u"), (s * x + c * y - 7 + F.cos(k)).alias("w"))
    return rounded(registration.rigid_fit(pairs, ["k"]), "rotation", "tx", "ty")


@query(f"""{using('stars')}, t AS (SELECT * FROM stars ORDER BY flux DESC, x, y LIMIT 120)
SELECT count(*) AS total, count(*) FILTER (star_id % 4 <> 0) AS n, CAST(1.02 AS DOUBLE) AS a, CAST(-0.03 AS DOUBLE) AS b, CAST(5 AS DOUBLE) AS tx, CAST(0.03 AS DOUBLE) AS c, CAST(0.98 AS DOUBLE) AS d, CAST(-7 AS DOUBLE) AS ty, true AS plausible FROM t""")
def ransac_affine(spark: SparkSession, sf: str) -> DataFrame:
    """A planted transform, with each fourth match thrown elsewhere."""
    x, y, k = F.col("x"), F.col("y"), F.col("star_id")
    wrong = F.when(k % 4 == 0, 40 + k % 97).otherwise(0)
    matches = views.stars(spark, sf).select("x", "y", (1.02 * x - 0.03 * y + 5 + wrong).alias("u"), (0.03 * x + 0.98 * y - 7 - wrong).alias("w"), "flux")
    found = registration.robust_affine(matches, -F.col("flux"))
    found = found.withColumn("plausible", registration.plausible(1000, 1000)).withColumns({c: F.col(c).cast("long") for c in ("total", "n")})
    return rounded(found, "a", "b", "tx", "c", "d", "ty", to=5)


@query(f"""{using('stars')}, p AS (SELECT star_id % 5 AS k, x, y, 1.02 * x - 0.03 * y + 5 + sin(star_id) AS u, 0.03 * x + 0.98 * y - 7 + cos(star_id) AS w FROM stars)
SELECT k, round(avg(sqrt(pow(u - (x + 5), 2) + pow(w - (y - 7), 2))), 6) AS residual FROM p GROUP BY k""")
def mean_residual(spark: SparkSession, sf: str) -> DataFrame:
    x, y, k = F.col("x"), F.col("y"), F.col("star_id")
    pairs = views.stars(spark, sf).select((k % 5).alias("k"), "x", "y", (1.02 * x - 0.03 * y + 5 + F.sin(k)).alias("u"), (0.03 * x + 0.98 * y - 7 + F.cos(k)).alias("w"))
    shift = {"a": 1.0, "b": 0.0, "tx": 5.0, "c": 0.0, "d": 1.0, "ty": -7.0}
    fits = pairs.select("k").distinct().select("k", *(F.lit(v).alias(c) for c, v in shift.items()))
    return rounded(registration.mean_residual(pairs, fits, ["k"]), "residual")


@query("""WITH s AS (SELECT event_id AS id, value / 50 AS fwhm, value / 600 AS ellipticity, value / 10 AS snr, event_id % 700 AS distance, value / 500 AS peak FROM events)
SELECT id, round(0.35 * (1 - ellipticity) + 0.3 * least(snr / 100, 1) + 0.15 / (1 + distance / 500) + 0.2 / (1 + abs(fwhm - 4) / 4), 6) AS score FROM s WHERE peak > 0.1 AND peak < 0.95 AND ellipticity < 0.3""")
def psf_star_score(spark: SparkSession, sf: str) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    s = views.table(spark, sf, "events").where((v / 500 > 0.1) & (v / 500 < 0.95) & (v / 600 < 0.3))
    return rounded(s.select(k.alias("id"), registration.psf_score(1 - v / 600, v / 10, (k % 700).cast("double"), v / 50).alias("score")), "score")


PROJECTIONS = ("TAN", "SIN", "ARC", "CAR")


@query(f"{using('img')} SELECT projection, y, x, CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py FROM img, (SELECT unnest({list(PROJECTIONS)}) AS projection)")
def wcs_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels to the sky and back by each projection."""
    rows = None
    for name in PROJECTIONS:
        wcs = sky.Wcs((100.0, 100.0), (83.633, 22.014), (-7.27778e-05, 0.0, 0.0, 7.27778e-05), name)
        ra, dec = wcs.to_world("x", "y")
        px, py = wcs.to_pixel("ra", "dec")
        one = views.img(spark, sf).select(F.lit(name).alias("projection"), "y", "x", ra.alias("ra"), dec.alias("dec")).select("projection", "y", "x", px.alias("px"), py.alias("py"))
        rows = one if rows is None else rows.unionByName(one)
    return rounded(rows, "px", "py", to=2)


@query("""WITH s AS (SELECT c_custkey AS star_id, CAST(c_custkey * 7919 % 36000 / 100 AS DOUBLE) AS ra, CAST(c_custkey * 104729 % 17000 / 100 - 85 AS DOUBLE) AS dec FROM customer),
p AS (SELECT star_id, ra / 15 AS h, abs(dec) AS d, CASE WHEN dec < 0 THEN '-' ELSE '+' END AS s FROM s), q AS (SELECT *, (h - floor(h)) * 60 AS hm, (d - floor(d)) * 60 AS dm FROM p)
SELECT star_id, printf('%02dh %02dm %05.2fs', CAST(floor(h) AS BIGINT), CAST(floor(hm) AS BIGINT), (hm - floor(hm)) * 60) AS ra, printf('%s%02d° %02d'' %04.1f"', s, CAST(floor(d) AS BIGINT), CAST(floor(dm) AS BIGINT), (dm - floor(dm)) * 60) AS dec FROM q""")
def sexagesimal(spark: SparkSession, sf: str) -> DataFrame:
    s = views.sky(spark, sf, "customer", "c_custkey", "star_id", 7919, 104729)
    ra, dec = sky.sexagesimal("ra", "dec")
    return s.select("star_id", ra.alias("ra"), dec.alias("dec"))


@query(f"{using('frames')} SELECT frame, count(*) FILTER (isfinite(v)) < 16 OR max(v) - min(v) < 1e-10 AS flat FROM frames GROUP BY frame")
def constant_frames(spark: SparkSession, sf: str) -> DataFrame:
    some = F.when(finite("v"), F.col("v"))
    return views.frames(spark, sf).groupBy("frame").agg(((F.count(some) < 16) | (F.max(some) - F.min(some) < 1e-10)).alias("flat"))


@query(f"{using('cube')} SELECT y, x, round(coalesce(avg(v) FILTER (isfinite(v) AND v > 1e-7), 0), 6) + 0.0 AS v FROM cube GROUP BY y, x")
def cube_collapse_mean_valid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cubes.collapsed(views.cube(spark, sf), ok=valid).drop("cube"), "v").withColumn("y", F.col("y").cast("long"))


@query(f"""{using('rgb')}, c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN r END AS r, CASE WHEN l_linenumber % 3 = 0 THEN g END AS g, CASE WHEN l_linenumber % 5 = 0 THEN b END AS b FROM rgb)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(r, (g + b) / 2, g, b, 0), 6) AS r FROM c""")
def missing_channel(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = views.rgb(spark, sf).withColumns({c: F.when(n % k == 0, F.col(c)) for c, k in zip("rgb", (2, 3, 5))})
    return rounded(rows.withColumn("r", color.channel_or_synth(F.col("r"), F.col("g"), F.col("b"))).drop("g", "b"), "r")


@query(f"{using('rgb')} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(least(r * 1.1, greatest(greatest(r * 0.9, 0), g)), 6) AS deringed, round(least(greatest((0.2 - 1) * r / ((2 * 0.2 - 1) * r - 0.2), 0), 1), 6) + 0.0 AS stretched FROM rgb")
def deringing_and_masked_mtf(spark: SparkSession, sf: str) -> DataFrame:
    r, g = F.col("r"), F.col("g")
    out = views.rgb(spark, sf).withColumns({"deringed": stretch.deringed(g, r, 0.1), "stretched": stretch.masked_mtf(r, F.lit(0.2))})
    return rounded(out.drop("r", "g", "b"), "deringed", "stretched")


FILE_NAMES = ("m42_Ha_300s.fits", "ngc-oiii-1.fit", "x_S2.fits", "veil_656.fts", "plain.fits", "a_O3.asdf")


@query("WITH n AS (SELECT p_partkey AS id, [" + ", ".join(f"'{x}'" for x in FILE_NAMES) + """][p_partkey % 6 + 1] AS name FROM part)
SELECT id, name, CASE p % 6 WHEN 0 THEN 'Ha' WHEN 1 THEN 'OIII' WHEN 2 THEN 'SII' WHEN 3 THEN 'Ha' WHEN 5 THEN 'OIII' END AS filter, replace(replace(replace(replace(name, '.fits', ''), '.fit', ''), '.fts', ''), '.asdf', '') AS stem FROM (SELECT id, name, id AS p FROM n)""")
def filename_filter(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, FILE_NAMES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    files = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))
    return files.withColumns({"filter": headers.filter_of_name("name"), "stem": headers.stem("name")})


@query("""WITH f AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 > 0 THEN p_size % 4 END AS slot, ['High', 'Medium', 'Low'][p_partkey * 7 % 3 + 1] AS confidence FROM part)
SELECT slot, id FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY CASE confidence WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, id) AS k FROM f WHERE slot IS NOT NULL) WHERE k = 1""")
def palette_slots(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    confidence = F.element_at(F.array(*map(F.lit, ("High", "Medium", "Low"))), (k * 7 % 3 + 1).cast("int"))
    files = views.table(spark, sf, "part").select(k.alias("id"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") % 4).alias("slot"), confidence.alias("confidence"))
    return frames.best_of_slot(files, "slot", "confidence", "id")


@query("SELECT star_id FROM (SELECT c_custkey AS star_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 120")
def alignment_stars(spark: SparkSession, sf: str) -> DataFrame:
    return views.stars(spark, sf).orderBy(F.desc("flux"), "star_id").limit(registration.STARS).select("star_id")
