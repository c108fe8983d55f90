"""Combining frames sample by sample: one group a pixel, whose samples are one array through all passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions.sky import lanczos3
from nebulark.functions.validity import finite, positive
from nebulark.operators.spatial import size_of
from nebulark.operators.stats import MAD_SIGMA, join_keys, upper_median


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def middle(values: Column) -> Column:
    """The upper median of a sorted array."""
    return F.element_at(values, (F.size(values) / 2).cast("int") + 1)


def averaged_middle(values: Column) -> Column:
    """The median of a sorted array, the mean of the middle two of an even number."""
    half = (F.size(values) / 2).cast("int")
    return F.when(F.size(values) % 2 == 1, F.element_at(values, half + 1)).otherwise((F.element_at(values, F.greatest(half, F.lit(1))) + F.element_at(values, half + 1)) / 2)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def sample_arrays(stack: DataFrame, pixel: list[str], ok: Column, v: str) -> DataFrame:
    """Per pixel vs, its samples in order: one shuffle, one row a pixel, which a stack has as many samples as frames for."""
    return stack.where(ok).groupBy(*pixel).agg(F.array_sort(F.collect_list(F.col(v).cast("double"))).alias("vs"))


def within(values: Column, centre: Column, sigma: Column, low: float, high: float) -> Column:
    return F.filter(values, lambda x: (x - centre >= -low * sigma) & (x - centre <= high * sigma))


def about_mean(values: Column, low: float, high: float) -> Column:
    """Of a sorted array of two or more c, its mean, and lo and hi, so many sample deviations (1e-10 at least) from it.

    Sums are of offsets from the upper median, and the root is taken last, of all factors. So while samples are whole numbers
    (or multiples of a power of 2) and the sums below 2^53, a limit that is met exactly has no rounding in it.
    """
    n = F.size(values).cast("double")
    total = lambda of: F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))
    reach = lambda k, square: F.sqrt(F.greatest(k * k * square / (n - 1), k * k * 1e-20 * n * n))
    limits = lambda m, s, square: F.struct((m + s / n).alias("c"), (m + (s - reach(low, square)) / n).alias("lo"), (m + (s + reach(high, square)) / n).alias("hi"))
    squares = lambda m, s: n * (n * total(lambda x: (x - m) * (x - m)) - s * s)
    return bound(middle(values), lambda m: bound(total(lambda x: x - m), lambda s: bound(squares(m, s), lambda square: limits(m, s, square))))


def sigma_clip(stack: DataFrame, pixel: list[str], low: float = 3.0, high: float = 3.0, passes: int = 5, v: str = "v") -> DataFrame:
    """Per pixel result, rejected and n: the mean of finite samples left by clipping.

    The first pass is about the upper median with 1.4826 times the upper median deviation, later ones about the mean
    with the sample deviation; samples on the limit stay; a pixel stops once nothing goes or fewer than two are left. If
    all went, the last centre is the result. The passes go over a pixel's array of samples, which is made once.
    """
    rows = sample_arrays(stack, pixel, finite(v), v)
    floor = lambda s: F.greatest(s, F.lit(1e-10))
    spread = lambda vs, m: floor(middle(F.array_sort(F.transform(vs, lambda x: F.abs(x - m)))) * MAD_SIGMA)
    first = lambda vs: bound(middle(vs), lambda m: bound(spread(vs, m), lambda s: F.struct(m.alias("c"), within(vs, m, s, low, high).alias("left"))))
    later = lambda vs: bound(about_mean(vs, low, high), lambda a: F.struct(a["c"].alias("c"), F.filter(vs, lambda x: (x >= a["lo"]) & (x <= a["hi"])).alias("left")))
    state = lambda vs, done, centre: F.struct(vs.alias("vs"), done.alias("done"), centre.alias("centre"))
    none = F.lit(None).cast("double")

    def step(acc, k):
        go = ~acc["done"] & (F.size(acc["vs"]) >= 2)
        about = F.when(k == 1, first(acc["vs"])).otherwise(later(acc["vs"]))
        clip = bound(about, lambda a: state(a["left"], F.size(a["left"]) == F.size(acc["vs"]), a["c"]))
        return F.when(go, clip).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(passes)) if passes else F.array().cast("array<int>")
    rows = rows.withColumn("end", F.aggregate(steps, state(F.col("vs"), F.lit(False), none), step))
    left = F.col("end.vs")
    result = F.when(F.size(left) > 0, mean_of(left)).otherwise(F.col("end.centre"))
    return rows.select(*pixel, result.alias("result"), (F.size("vs") - F.size(left)).cast("long").alias("rejected"), F.size("vs").cast("long").alias("n"))


def clipped_stats(samples: DataFrame, keys: list[str], kappa: float = 3.0, passes: int = 2, v: str = "v", least: int = 1) -> DataFrame:
    """Per key of at least so many samples median, sigma and n of samples after symmetric clipping by averaged median and deviation, while three or more are left."""
    rows = sample_arrays(samples, keys, finite(v), v).where(F.size("vs") >= least)
    sigma = lambda vs, m: F.greatest(averaged_middle(F.array_sort(F.transform(vs, lambda x: F.abs(x - m)))) * MAD_SIGMA, F.lit(1e-10))
    step = lambda vs, k: F.when(F.size(vs) < 3, vs).otherwise(bound(averaged_middle(vs), lambda m: bound(sigma(vs, m), lambda s: within(vs, m, s, kappa, kappa))))
    rows = rows.withColumn("vs", F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("vs"), step) if passes else F.col("vs"))
    rows = rows.withColumn("median", averaged_middle(F.col("vs")))
    return rows.select(*keys, "median", sigma(F.col("vs"), F.col("median")).alias("sigma"), F.size("vs").cast("long").alias("n"))


def master(frames: DataFrame, pixel: list[str], v: str = "v") -> DataFrame:
    """The upper median of finite samples of each pixel: a master bias, or a dark or flat before its corrections."""
    return frames.where(finite(v)).groupBy(*pixel).agg(upper_median(f"cast({v} AS double)").alias("v"))


def subtracted(frames: DataFrame, masters: DataFrame | None, pixel: list[str], ratio: float = 1.0) -> DataFrame:
    """Samples less a master's, times ratio; without a master, or where it has no sample, unchanged."""
    if masters is None:
        return frames
    joined = join_keys(frames, masters.select(*pixel, F.col("v").alias("w")), pixel, "left")
    return joined.withColumn("v", F.col("v") - F.coalesce(F.col("w"), F.lit(0.0)) * ratio).drop("w")


def master_flat(flats: DataFrame, pixel: list[str], bias: DataFrame | None = None, dark: DataFrame | None = None) -> DataFrame:
    """A master of corrected flats over the mean of its positive samples; 1 where it isn't positive."""
    flat = master(subtracted(subtracted(flats, bias, pixel), dark, pixel), pixel)
    mean = flat.where(positive("v")).agg(F.avg("v").alias("mean"))
    x = F.try_divide(F.col("v"), F.col("mean"))
    return join_keys(flat, mean, []).select(*pixel, F.coalesce(F.when(positive("v"), x), F.lit(1.0)).alias("v"))


def divided(frames: DataFrame, flat: DataFrame, pixel: list[str]) -> DataFrame:
    joined = join_keys(frames, flat.select(*pixel, F.col("v").alias("w")), pixel, "left")
    return joined.withColumn("v", F.when(finite("w") & (F.abs("w") > 1e-4), F.try_divide(F.col("v"), F.col("w"))).otherwise(F.col("v"))).drop("w")


def calibrated(lights: DataFrame, pixel: list[str], bias: DataFrame | None = None, dark: DataFrame | None = None, flat: DataFrame | None = None, ratio: float = 1.0) -> DataFrame:
    """Lights less bias and dark, over the flat; negative results are 0, NaN stays."""
    out = subtracted(subtracted(lights, bias, pixel), dark, pixel, ratio)
    out = divided(out, flat, pixel) if flat is not None else out
    return out.withColumn("v", F.when(F.col("v") < 0, 0.0).otherwise(F.col("v")))


def frame_normalized(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Samples over their frame's mean, where that is positive."""
    means = frames.groupBy(*keys).agg(F.avg("v").alias("mean"))
    return join_keys(frames, means, keys).withColumn("v", F.when(F.col("mean") > 0, F.try_divide(F.col("v"), F.col("mean"))).otherwise(F.col("v"))).drop("mean")


def drizzle_hits(frames: DataFrame, offsets: DataFrame, scale: float, shrink: float, kernel: str = "square") -> DataFrame:
    """y, x, v and w: each finite sample spread over the cells of a grid `scale` times finer that its shrunken footprint, about
    (y + dy, x + dx) times scale, reaches; the grid ends with the largest frame. frames: frame, y, x, v; offsets: frame, dy, dx.

    The weight of a cell is the overlap (square), falls off as a Gaussian of half the footprint (gaussian), or is the
    product of windowed sincs (lanczos3); cells that get next to nothing or less are left out.
    """
    sides = size_of(frames, []).select(F.ceil(F.col("h") * scale).alias("oh"), F.ceil(F.col("w") * scale).alias("ow"))
    joined = join_keys(frames.where(finite("v")).join(offsets, "frame", "left"), sides, [])
    half = shrink * scale / 2
    place = lambda a: ((F.col(a) + F.coalesce(F.col(f"d{a}"), F.lit(0.0))) * scale).alias(f"c{a}")
    cells = joined.select("v", place("y"), place("x"), "oh", "ow")
    kept = lambda c, side: F.greatest(F.lit(0).cast("long"), F.least(c, F.col(side) - 1))
    for a, side in (("y", "oh"), ("x", "ow")):
        cells = cells.withColumn(f"o{a}", F.explode(F.sequence(kept(F.floor(F.col(f"c{a}") - half), side), kept(F.ceil(F.col(f"c{a}") + half), side))))
    if kernel == "square":
        shared = lambda a: F.greatest(F.least(F.col(f"c{a}") + half, F.col(f"o{a}") + 1) - F.greatest(F.col(f"c{a}") - half, F.col(f"o{a}")), F.lit(0.0))
        weight = shared("y") * shared("x")
    else:
        off = lambda a: F.col(f"o{a}") + 0.5 - F.col(f"c{a}")
        weight = F.exp(-(off("y") * off("y") + off("x") * off("x")) / (2 * max(half, 0.5) ** 2)) if kernel == "gaussian" else lanczos3(F.abs(off("y"))) * lanczos3(F.abs(off("x")))
    return cells.withColumn("w", weight).where("w > 1e-12").select(F.col("oy").alias("y"), F.col("ox").alias("x"), "v", "w")


def drizzle(frames: DataFrame, offsets: DataFrame, scale: float = 2.0, shrink: float = 0.8, kernel: str = "square") -> DataFrame:
    """Cells (y, x) with value, weight and n: the plain mean of a cell's samples; cells without any don't appear."""
    return drizzle_hits(frames, offsets, scale, shrink, kernel).groupBy("y", "x").agg(F.avg("v").alias("value"), F.sum("w").alias("weight"), F.count("*").alias("n"))


def drizzle_clipped(frames: DataFrame, offsets: DataFrame, scale: float = 2.0, shrink: float = 0.8, low: float = 3.0, high: float = 3.0, passes: int = 3, kernel: str = "square") -> DataFrame:
    """Cells (y, x) with value, weight, n and rejected: the mean of a cell's samples without those that passes about the
    averaged median, with 1.4826 times the averaged deviation, find beyond the limits, while three or more are left; the mean
    of all if none is left. The weights are of all samples."""
    cells = drizzle_hits(frames, offsets, scale, shrink, kernel).groupBy("y", "x").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.sum("w").alias("weight"))

    def step(vs, k):
        spread = lambda m: F.greatest(averaged_middle(F.array_sort(F.transform(vs, lambda x: F.abs(x - m)))) * MAD_SIGMA, F.lit(1e-10))
        return F.when(F.size(vs) < 3, vs).otherwise(bound(averaged_middle(vs), lambda m: bound(spread(m), lambda s: within(vs, m, s, low, high))))

    left = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("vs"), step) if passes else F.col("vs")
    cells = cells.withColumn("left", left)
    return cells.select("y", "x", F.when(F.size("left") > 0, mean_of(F.col("left"))).otherwise(mean_of(F.col("vs"))).alias("value"), "weight", F.size("vs").cast("long").alias("n"), (F.size("vs") - F.size("left")).cast("long").alias("rejected"))


def median_clip(stack: DataFrame, pixel: list[str], low: float = 2.5, high: float = 3.0, passes: int = 5, v: str = "v") -> DataFrame:
    """Per pixel result, rejected and n: like sigma_clip, but every pass is about the upper median with 1.4826 times the
    upper median deviation, limits are exclusive, and a pixel stops below three samples or without any deviation."""
    rows = sample_arrays(stack, pixel, F.col(v).isNotNull(), v)

    def step(vs, k):
        kept = lambda m, s: F.when(s < 1e-10, vs).otherwise(F.filter(vs, lambda x: (x - m > -low * s) & (x - m < high * s)))
        spread = lambda m: middle(F.array_sort(F.transform(vs, lambda x: F.abs(x - m)))) * MAD_SIGMA
        return F.when(F.size(vs) < 3, vs).otherwise(bound(middle(vs), lambda m: bound(spread(m), lambda s: kept(m, s))))

    left = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.col("vs"), step) if passes else F.col("vs")
    rows = rows.withColumn("left", left)
    return rows.select(*pixel, mean_of(F.col("left")).alias("result"), (F.size("vs") - F.size("left")).cast("long").alias("rejected"), F.size("vs").cast("long").alias("n"))
