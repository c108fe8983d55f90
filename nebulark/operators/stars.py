"""Star catalogues: cross-matching, deduplication, triangles, photometry and frame quality.

Range conditions become equi joins on grid cells; a cell meets its neighbours, never every cell.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions.sky import color_temperature, planck_rgb
from nebulark.functions.validity import finite
from nebulark.operators.lineage import checkpointed
from nebulark.operators.stats import join_keys

#: Square degrees of the sky, and entries within the first radius of a cross-match.
SKY, FEW = 41253.0, 4.0
#: Side of the cells in which stars meet pixels.
CELL = 16
#: Least side of a triangle, stars that form triangles, tolerance of ratios of sides.
LEAST_SIDE, TRIANGLE_STARS, TOLERANCE = 15.0, 60, 0.02
#: Weights of fwhm, eccentricity, signal and noise in a frame's quality.
QUALITY = (1.0, 0.5, 1.0, 0.3)


def around(a: str, b: str) -> Column:
    """The nine cells around (a, b), as structs of y and x."""
    return F.array(*(F.struct((F.col(a) + i).alias("y"), (F.col(b) + j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Arc seconds between two directions in degrees."""
    p1, p2 = F.radians(dec1), F.radians(dec2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * 3600


def cross_match(stars: DataFrame, catalog: DataFrame, radius: float) -> DataFrame:
    """Each star (star_id, ra, dec) with its nearest catalogue entry (cat_id, ra, dec) within radius arc seconds, if any.

    Ties, to a millionth of an arc second, go to the smaller cat_id, so of entries at one place only the smallest counts. A
    first radius holds a few entries on average over the sky; stars that find none within it look again within twice as
    much, up to the whole radius. So the pairs grow with the stars, not with stars times entries.
    """
    entries = checkpointed(catalog.groupBy("ra", "dec").agg(F.min("cat_id").alias("cat_id")))
    density = max(entries.count(), 1) / SKY
    reach = radius
    while reach > 1 and density * pi * (reach / 3600) ** 2 > FEW:
        reach /= 2
    asked, parts = checkpointed(stars.select("star_id", "ra", "dec")), []
    while True:
        found = checkpointed(matched_within(asked, entries, reach))
        # What lies farther than a rounded tie from the edge has no rival beyond it.
        parts.append(found if reach >= radius else found.where(F.col("sep") < reach - 1e-5))
        if reach >= radius:
            break
        asked = checkpointed(asked.join(parts[-1].select("star_id"), "star_id", "left_anti"))
        reach = min(2 * reach, radius)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def matched_within(stars: DataFrame, catalog: DataFrame, radius: float) -> DataFrame:
    """star_id, cat_id and sep of each star's nearest entry within a radius.

    The sky is cut into bands of declination and, in them, cells of right ascension that are at least a radius wide at
    the band's edge nearest to a pole; a star looks into nine cells.
    """
    step = max(radius / 3600, 1e-6)
    bands = lambda dec: F.floor((dec + 90) / step)

    def cells(band: Column) -> Column:
        """Cells of right ascension in a band."""
        edge = F.greatest(F.abs(band * step - 90), F.abs((band + 1) * step - 90))
        return F.greatest(F.lit(1.0), F.floor(360 * F.cos(F.radians(F.least(F.lit(90.0), edge))) / step)).cast("long")

    cell = lambda ra, band: F.least(F.floor(F.pmod(ra, F.lit(360.0)) * cells(band) / 360), cells(band) - 1)
    entries = catalog.select("cat_id", F.col("ra").alias("cra"), F.col("dec").alias("cdec"), bands(F.col("dec")).alias("cy")).withColumn("cx", cell(F.col("cra"), F.col("cy")))
    asked = stars.select("star_id", "ra", "dec", F.explode(F.array(*(bands(F.col("dec")) + k for k in (-1, 0, 1)))).alias("cy"))
    asked = asked.withColumn("at", cell(F.col("ra"), F.col("cy"))).withColumn("cx", F.explode(F.array_distinct(F.array(*(F.pmod(F.col("at") + k, cells(F.col("cy"))) for k in (-1, 0, 1))))))
    near = asked.join(entries, ["cy", "cx"]).withColumn("sep", separation(F.col("ra"), F.col("dec"), F.col("cra"), F.col("cdec"))).where(F.col("sep") <= radius)
    return near.groupBy("star_id").agg(F.min(F.struct(F.round("sep", 6).alias("about"), "cat_id", "sep")).alias("m")).select("star_id", F.col("m.cat_id").alias("cat_id"), F.col("m.sep").alias("sep"))


def deduplicated(stars: DataFrame, radius: float = 3.0, keys: list[str] = ()) -> DataFrame:
    """Stars (keys, star_id, x, y, flux) without those within radius of a brighter one, of the same keys, that stays; ties
    go to the smaller id, null counts as the least flux.

    Cells are so small that one star of each stays at most. In a round, the brightest open star of a cell stays if no open
    star around is brighter, and those around it go; rounds go on until none is open. Only brightest stars of cells meet the
    others, in 25 cells, so the work grows with the stars, however many are near each other. A star without a finite place
    is near none.
    """
    keys, cell = list(keys), ["gy", "gx"]
    placed = finite("x") & finite("y")
    side = radius / 1.5
    rank = F.struct("flux", (-F.col("star_id")).alias("first"))
    rows = stars.where(placed).select(*keys, F.col("star_id").alias("id"), "x", "y", rank.alias("rank"), F.floor(F.col("y") / side).alias("gy"), F.floor(F.col("x") / side).alias("gx"))
    near = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) < radius * radius

    def reach(tops: DataFrame) -> DataFrame:
        """tops once for each cell that they reach into."""
        steps = F.array(*(F.struct(F.lit(i).alias("y"), F.lit(j).alias("x")) for i in range(-2, 3) for j in range(-2, 3)))
        return tops.withColumn("c", F.explode(steps)).select(*keys, (F.col("gy") + F.col("c.y")).alias("gy"), (F.col("gx") + F.col("c.x")).alias("gx"), F.col("id").alias("by"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("rank").alias("prank"))

    still, kept = checkpointed(rows.withColumn("own", F.lit(None).cast("boolean")).repartition(*keys, *cell)), []  # own: whether it goes by itself, as it stays
    while not still.where("own IS NULL").isEmpty():
        still = still.where("own IS NULL").drop("own")
        tops = still.groupBy(*keys, *cell).agg(F.max_by(F.struct("id", "x", "y"), "rank").alias("t"), F.max("rank").alias("rank")).select(*keys, *cell, "t.*", "rank")
        beaten = join_keys(still, reach(tops), [*keys, *cell]).where(near & (F.col("rank") > F.col("prank"))).select(*keys, F.col("by").alias("id")).distinct()
        stay = join_keys(tops, beaten.withColumn("b", F.lit(True)), [*keys, "id"], "left").where("b IS NULL")
        gone = join_keys(still, reach(stay), [*keys, *cell]).where(near).groupBy(*keys, "id").agg(F.max(F.col("id") == F.col("by")).alias("own"))
        still = checkpointed(join_keys(still, gone, [*keys, "id"], "left").where("own IS NULL OR own"))
        kept.append(still.where("own").select(*keys, "id"))
    found = stars.where(~F.coalesce(placed, F.lit(False))).select(*keys, F.col("star_id").alias("id"))
    for one in kept:
        found = found.unionByName(one)
    return join_keys(stars, found.withColumnRenamed("id", "star_id"), [*keys, "star_id"])


def triangles(stars: DataFrame, n: int = TRIANGLE_STARS) -> DataFrame:
    """Triangles of the n brightest stars (star_id, x, y, flux): a < b < c and the ratios of the two shorter sides to the
    longest. n bounds the result."""
    top = stars.orderBy(F.desc("flux"), "star_id").limit(n)
    one = lambda k: top.select(F.col("star_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    three = one("a").join(F.broadcast(one("b")), F.col("a") < F.col("b")).join(F.broadcast(one("c")), F.col("b") < F.col("c"))  # n rows
    side = lambda p, q: F.hypot(F.col(f"x{p}") - F.col(f"x{q}"), F.col(f"y{p}") - F.col(f"y{q}"))
    s = three.withColumn("s", F.array_sort(F.array(side("a", "b"), side("b", "c"), side("a", "c"))))
    s = s.where(F.col("s")[0] >= LEAST_SIDE)
    return s.select("a", "b", "c", (F.col("s")[0] / F.col("s")[2]).alias("r1"), (F.col("s")[1] / F.col("s")[2]).alias("r2"))


def triangle_matches(one: DataFrame, two: DataFrame, tolerance: float = TOLERANCE, keys: list[str] = ()) -> DataFrame:
    """Pairs of triangles with both ratios within the tolerance, by cells of ratios; keys of the second, a, b, c and a2, b2, c2."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    asked = one.withColumns({"gy": cell("r1"), "gx": cell("r2")}).withColumn("n", F.explode(around("gy", "gx"))).withColumns({"gy": F.col("n.y"), "gx": F.col("n.x")}).drop("n")
    other = two.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("a", "b", "c", "r1", "r2"))).withColumns({"gy": cell("r12"), "gx": cell("r22")})
    return asked.join(other, ["gy", "gx"]).where((F.abs(F.col("r1") - F.col("r12")) <= tolerance) & (F.abs(F.col("r2") - F.col("r22")) <= tolerance)).select(*keys, "a", "b", "c", "a2", "b2", "c2")


def affine_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of u = a x + b y + tx and w = c x + d y + ty per key, from sums alone; null where it isn't determined.

    Coordinates are taken about their means, so that the normal equations are two by two.
    """
    means = pairs.groupBy(*keys).agg(*(F.avg(c).alias(f"m{c}") for c in "xyuw"), F.count("*").alias("n"))
    x, y, u, w = (F.col(c) - F.col(f"m{c}") for c in "xyuw")
    s = join_keys(pairs, means, keys).groupBy(*keys, *(f"m{c}" for c in "xyuw"), "n").agg(F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), *(F.sum(p * q).alias(f"{i}{j}") for i, p in (("x", x), ("y", y)) for j, q in (("u", u), ("w", w))))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda t: ((F.try_divide(F.col("yy") * F.col(f"x{t}") - F.col("xy") * F.col(f"y{t}"), det)), (F.try_divide(F.col("xx") * F.col(f"y{t}") - F.col("xy") * F.col(f"x{t}"), det)))
    (a, b), (c, d) = solve("u"), solve("w")
    return s.select(*keys, "n", a.alias("a"), b.alias("b"), (F.col("mu") - a * F.col("mx") - b * F.col("my")).alias("tx"), c.alias("c"), d.alias("d"), (F.col("mw") - c * F.col("mx") - d * F.col("my")).alias("ty"))


def aperture_flux(stars: DataFrame, pixels: DataFrame, radius: float, inner: float, outer: float) -> DataFrame:
    """Per star (star_id, x, y) the sum within radius less the background of the ring, the mean of its middle half.

    A star meets the pixels of the cells that its circle reaches into; only cells are exploded, so that its table stays
    small if it is broadcast.
    """
    around_star = stars.select("star_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    for c, at in (("cy", "sy"), ("cx", "sx")):
        around_star = around_star.withColumn(c, F.explode(F.sequence(F.floor((F.col(at) - outer) / CELL), F.floor((F.col(at) + outer) / CELL))))
    r2 = F.pow(F.col("ix") - F.col("sx"), 2) + F.pow(F.col("iy") - F.col("sy"), 2)
    placed = pixels.select(F.col("y").alias("iy"), F.col("x").alias("ix"), "v", F.floor(F.col("y") / CELL).alias("cy"), F.floor(F.col("x") / CELL).alias("cx"))
    met = around_star.join(placed, ["cy", "cx"]).withColumn("r2", r2).where(F.col("r2") <= outer * outer)
    ring = F.array_sort(F.collect_list(F.when((F.col("r2") >= inner * inner), F.col("v"))))  # a ring's pixels: few
    s = met.groupBy("star_id").agg(F.sum(F.when(F.col("r2") <= radius * radius, F.col("v"))).alias("total"), F.sum((F.col("r2") <= radius * radius).cast("int")).alias("npix"), ring.alias("ring"))
    n = F.size("ring")
    middle = F.slice("ring", (n / 4).cast("int") + 1, F.greatest(F.lit(1), (n * 3 / 4).cast("int") - (n / 4).cast("int")))
    background = F.when(n > 0, F.aggregate(middle, F.lit(0.0), lambda a, b: a + b) / F.size(middle)).otherwise(0.0)
    return s.select("star_id", F.coalesce("total", F.lit(0.0)).alias("total"), "npix", background.alias("background"), (F.coalesce("total", F.lit(0.0)) - background * F.col("npix")).alias("flux"))


def frame_quality(stars: DataFrame, noise: DataFrame, weights: tuple = QUALITY) -> DataFrame:
    """Per frame n, medians of fwhm, eccentricity and snr, weight, relative weight and whether it is accepted."""
    s = stars.groupBy("frame").agg(F.count("*").alias("n"), *(F.median(c).alias(c) for c in ("fwhm", "eccentricity", "snr")))
    wf, we, ws, wn = weights
    j = s.join(noise, "frame", "left")
    score = (wf * F.try_divide(F.lit(1.0), F.col("fwhm")) + we * (1 - F.col("eccentricity")) + ws * F.greatest(F.coalesce(F.ln(F.when(F.col("snr") > 0, F.col("snr"))), F.lit(0.0)), F.lit(0.0)) + wn / (1 + 10 * F.coalesce("noise", F.lit(0.0)))) / sum(weights)
    j = j.withColumn("weight", F.coalesce(score, F.lit(0.0)))
    top = j.agg(F.max("weight").alias("top"))
    ok = (F.col("n") >= 5) & (F.col("fwhm") <= 8) & (F.col("eccentricity") <= 0.7) & (F.col("snr") >= 5)
    return j.crossJoin(F.broadcast(top)).withColumn("relative", F.coalesce(F.try_divide(F.col("weight"), F.col("top")), F.lit(0.0))).withColumn("accepted", ok).drop("top", "noise")


def color_factors(matched: DataFrame, white: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """One row: factors of red, green (1) and blue that take measured to expected shares of matched stars.

    matched: r, g, b and bp_rp of each star; a star weighs by the root of its flux.
    """
    expected = planck_rgb(color_temperature("bp_rp"))
    total = F.col("r") + F.col("g") + F.col("b")
    whole = expected[0] + expected[1] + expected[2]
    s = matched.where((F.col("r") > 0) & (F.col("g") > 0) & (F.col("b") > 0)).withColumn("w", F.sqrt(total))
    mean = lambda x: F.sum(x * F.col("w")) / F.sum("w")
    f = s.agg(*(mean(F.try_divide(e / whole, F.col(c) / total)).alias(f"f{c}") for c, e in zip("rgb", expected)), F.avg("bp_rp").alias("color_index"), F.count("*").alias("n"))
    scaled = [F.col(f"f{c}") * w for c, w in zip("rgb", white)]
    return f.select(*(F.try_divide(x, scaled[1]).alias(f"{c}_factor") for c, x in zip("rgb", scaled)), "color_index", "n")
