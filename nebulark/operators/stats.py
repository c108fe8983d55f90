"""Robust statistics of frames: grouped aggregates over a long table of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.functions.validity import col, finite, positive, valid
from nebulark.operators.lineage import checkpointed

#: Sigma of a normal distribution over its median absolute deviation; bins of histograms.
MAD_SIGMA, BINS, DISPLAY_BINS = 1.4826, 65536, 512
#: Accuracy of the sketch that brackets a median: its error is n / SKETCH ranks at most. The bracket reaches BRACKET times that.
SKETCH, BRACKET = 10_000, 5
#: Rows of a table of frames up to which it is broadcast, about 6 MB.
FEW_FRAMES = 100_000


def upper_median(v: str) -> Column:
    """Aggregate of an SQL expression: the element at n / 2, rounded down, of its sorted values; null for none.

    percentile_disc takes the lower middle, so it counts from above. Values are held as counts, partial first.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {v} DESC)")


def medians(rows: DataFrame, keys: list[str], upper: bool = False, **more: Column) -> DataFrame:
    """Per frame n, the aggregates of `more` and the exact median of v, doubles without null or NaN; for frames of any size.

    A mergeable sketch brackets the middle, so only samples of the bracket, about a thousandth of a large frame, are counted
    by value and ranked; those below it are one count. An even median is averaged, or with `upper` the greater of both.
    """
    around = F.percentile_approx("v", [0.5 - BRACKET / SKETCH, 0.5 + BRACKET / SKETCH], SKETCH)
    facts = rows.groupBy(*keys).agg(F.count("*").alias("n"), around.alias("ends"), *(a.alias(name) for name, a in more.items()))
    facts = each_frame(facts)
    met = join_keys(rows.select(*keys, "v"), facts.select(*keys, "n", "ends"), keys).where(F.col("v") <= F.col("ends")[1])
    counted = met.groupBy(*keys, "n", F.when(F.col("v") >= F.col("ends")[0], F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counted.withColumn("upto", F.sum("c").over(own.orderBy(F.asc_nulls_first("v"))))
    beyond = lambda rank: F.col("upto") > rank
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = lambda rank: F.when(~F.bool_or(F.col("v").isNull() & beyond(rank)), F.min(F.when(beyond(rank), F.col("v"))))
    middle = ranked.groupBy(*keys).agg((at(high) if upper else 0.5 * at(low) + 0.5 * at(high)).alias("median"))
    out = join_keys(facts.drop("ends"), middle, keys, "left") if keys else join_keys(facts.drop("ends"), middle, keys)
    missed = F.raise_error(F.lit("a sketch missed the median")).cast("double")
    return out.withColumn("median", F.when(F.col("n") > 0, F.coalesce("median", missed)))


def image_stats(pixels: DataFrame, keys: list[str], v: str = "v", ok=valid) -> DataFrame:
    """Per frame min, max, mean, median, mad, sigma and valid_count of valid samples; zeros for a frame without any.

    The deviations need the median, so samples meet their frame's median in a join. No task holds a frame's samples or
    their distinct values: see `medians`.
    """
    some = pixels.where(ok(v)).select(*keys, F.col(v).cast("double").alias("v"))
    first = each_frame(medians(some, keys, min=F.min("v"), max=F.max("v"), mean=F.avg("v")).withColumnRenamed("n", "valid_count"))
    away = join_keys(some, first.select(*keys, "median"), keys).select(*keys, F.abs(F.col("v") - F.col("median")).alias("v"))
    both = join_keys(first, medians(away, keys).select(*keys, F.col("median").alias("mad")), keys)
    out = join_keys(pixels.select(*keys).distinct(), both, keys, "left") if keys else both
    stat = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    sigma = F.when(F.col("mad").isNull(), 0.0).otherwise(F.greatest(F.col("mad") * MAD_SIGMA, F.lit(1e-30)))
    return out.select(*keys, *map(stat, ("min", "max", "mean", "median", "mad")), sigma.alias("sigma"), F.coalesce("valid_count", F.lit(0)).alias("valid_count"))


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi join on keys, which stand once in the result; for no keys b is one row, added to each of a."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    right = b.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in b.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(right, on, how).drop(*(f"__{k}" for k in keys))


def each_frame(table: DataFrame) -> DataFrame:
    """A table of a row a frame, to be broadcast while it has few rows: a join by shuffles would put each frame's samples
    into one task."""
    table = checkpointed(table)
    return F.broadcast(table) if table.count() <= FEW_FRAMES else table


def order_stats(pixels: DataFrame, keys: list[str], fractions: dict[str, float], v: str = "v", ok=valid, bins: int = 65536) -> DataFrame:
    """Per frame the samples at trunc(f * n) of the sorted valid ones, at most the last; exact, for frames of any size.

    Counts of bins, partial first, tell in which bin each rank lies; only the samples of those bins are counted by value.
    """
    some = pixels.where(ok(v)).select(*keys, F.col(v).cast("double").alias("v"))
    facts = some.groupBy(*keys).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("n")).where("n > 0")
    facts = each_frame(facts)
    place = F.coalesce(bin_of("v", F.col("min"), F.col("max"), bins), F.lit(0))
    rows = join_keys(some, facts, keys).select(*keys, "v", "n", place.alias("bin"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    counted = rows.groupBy(*keys, "n", "bin").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(own.orderBy("bin")))  # `bins` rows a frame at most
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.least(F.floor(F.lit(f) * F.col("n")), F.col("n") - 1).alias("k")) for name, f in fractions.items())))
    asked = counted.withColumn("r", ranks).where((F.col("upto") > F.col("r.k")) & (F.col("upto") - F.col("c") <= F.col("r.k")))
    asked = asked.select(*keys, "bin", "r.name", (F.col("r.k") - (F.col("upto") - F.col("c"))).alias("left"))
    values = join_keys(rows.drop("n"), each_frame(asked), [*keys, "bin"]).groupBy(*keys, "name", "left", "v").agg(F.count("*").alias("c"))
    within = Window.partitionBy(*keys, "name").orderBy("v")
    first = values.withColumn("upto", F.sum("c").over(within)).where(F.col("upto") > F.col("left"))
    return first.groupBy(*keys).agg(*(F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions))


def mean_sigma(pixels: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """Per frame mean and sample deviation of finite samples; 0 for none, and a deviation of 0 for one."""
    x = F.when(finite(v), F.col(v).cast("double"))
    return pixels.groupBy(*keys).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sigma"))


def peak_snr(peak: Column, mean: Column, sigma: Column) -> Column:
    """A peak above the mean over the deviation; 0 without one."""
    return F.when(F.abs(sigma) < 1e-15, 0.0).otherwise(F.try_divide(peak - mean, sigma))


def bin_of(v: Column | str, low: Column, high: Column, bins: int) -> Column:
    """The bin of a sample; the last has the greatest sample too; null where the range is too small for bins."""
    return F.when(high - low >= 1e-10, F.least(F.floor((col(v) - low) * bins / (high - low)), F.lit(bins - 1)).cast("int"))


def histogram(pixels: DataFrame, stats: DataFrame, keys: list[str], bins: int = BINS, v: str = "v") -> DataFrame:
    """Per frame and bin that has samples: bin, lo, hi and cnt, within the range that stats gives."""
    joined = join_keys(pixels.where(valid(v)), stats.select(*keys, "min", "max"), keys)
    low, width = F.col("min"), (F.col("max") - F.col("min")) / bins
    counted = joined.groupBy(*keys, "min", "max", bin_of(v, F.col("min"), F.col("max"), bins).alias("bin")).agg(F.count("*").alias("cnt")).where("bin IS NOT NULL")
    return counted.select(*keys, "bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), "cnt")


def downsampled(hist: DataFrame, keys: list[str], bins: int = BINS, to: int = DISPLAY_BINS) -> DataFrame:
    """Sums over bins / to neighbouring bins each."""
    return hist.groupBy(*keys, F.floor(F.col("bin") / (bins // to)).cast("int").alias("bin")).agg(F.sum("cnt").alias("cnt"))


def masked_median(pixels: DataFrame, keys: list[str], v: str = "v", mask: str = "mask") -> DataFrame:
    """The upper median of positive samples where the mask is below one half."""
    some = pixels.where(positive(v) & (F.col(mask) < 0.5)).select(*keys, F.col(v).cast("double").alias("v"))
    return medians(some, keys, upper=True).select(*keys, "median", "n")


def normalized(pixels: DataFrame, keys: list[str], how: str, v: str = "v", to: str = "norm") -> DataFrame:
    """Finite samples as min-max, z-score (sample deviation) or unit energy within the frame; the others 0."""
    ok = finite(v)
    x = F.when(ok, F.col(v).cast("double"))
    if how == "minmax":
        own = pixels.groupBy(*keys).agg(F.min(x).alias("a"), F.max(x).alias("b"))
        y = F.when(F.col("b") - F.col("a") < 1e-15, 0.0).otherwise(F.try_divide(x - F.col("a"), F.col("b") - F.col("a")))
    elif how == "zscore":
        own = pixels.groupBy(*keys).agg(F.avg(x).alias("a"), F.stddev_samp(x).alias("b"), F.count(x).alias("n"))
        y = F.when(F.col("n") < 2, x).when(F.col("b") < 1e-15, 0.0).otherwise(F.try_divide(x - F.col("a"), F.col("b")))
    else:
        own = pixels.groupBy(*keys).agg(F.sqrt(F.sum(x * x)).alias("a"))
        y = F.when(F.col("a") < 1e-15, x).otherwise(F.try_divide(x, F.col("a")))
    extra = [c for c in own.columns if c not in keys]
    return join_keys(pixels, own, keys).withColumn(to, F.coalesce(F.when(ok, y), F.lit(0.0))).drop(*extra)


def at_rank(hist: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Per key of a histogram (keys, bin, cnt, and what rank reads) the bin in which a rank lies: bin, before (how many lie
    below it) and frac, how far into the bin the rank is. A window over a histogram's bins, whose number is fixed."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ranked = hist.withColumn("upto", F.sum("cnt").over(own.orderBy("bin"))).withColumn("rank", rank)
    found = ranked.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("cnt") < F.col("rank")))
    return found.select(*keys, "bin", (F.col("upto") - F.col("cnt")).alias("before"), (1 - (F.col("upto") - F.col("rank")) / F.col("cnt")).alias("frac"))


def histogram_stats(pixels: DataFrame, keys: list[str], v: str = "v", ok=valid, bins: int = BINS) -> DataFrame:
    """Per frame min, max, mean, median, mad, sigma and valid_count from histograms alone, for frames of any size.

    The median's bin is split into as many again, and so are the bins about that of the deviations' median, in which the
    ranks are interpolated; so both are within the range over the square of the bins. No task holds samples or their
    distinct values: each pass is counts of bins, partial first. Frames without valid samples have no row.
    """
    some = pixels.where(ok(v)).select(*keys, F.col(v).cast("double").alias("v"))
    facts = some.groupBy(*keys).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.count("*").alias("n"))
    facts = facts.withColumn("range", F.greatest(F.col("max") - F.col("min"), F.lit(1e-30))).withColumn("half", F.ceil(F.col("n") * 0.5)).where("n > 0")
    own = [c for c in facts.columns if c not in keys]
    rows = join_keys(some, facts, keys)
    slot = lambda x, width: F.least(F.floor(x * bins / width), F.lit(bins - 1))
    counted = lambda df, *more: df.groupBy(*keys, *own, *more, "bin").agg(F.count("*").alias("cnt"))
    coarse = at_rank(counted(rows.withColumn("bin", slot(F.col("v") - F.col("min"), F.col("range")))), keys, F.col("half"))
    width = F.col("range") / bins
    coarse = join_keys(facts, coarse, keys).select(*keys, *own, "before", (F.col("min") + F.col("bin") * width).alias("lo"), (F.col("min") + (F.col("bin") + F.col("frac")) * width).alias("near"))
    rows = join_keys(some, coarse, keys)
    inner = rows.where((F.col("v") >= F.col("lo")) & (F.col("v") < F.col("lo") + width)).withColumn("bin", slot(F.col("v") - F.col("lo"), width))
    fine = at_rank(counted(inner, "before"), keys, F.col("half") - F.col("before"))
    spread = at_rank(counted(rows.withColumn("bin", slot(F.abs(F.col("v") - F.col("near")), F.col("range")))), keys, F.col("half"))
    fine = fine.select(*keys, ((F.col("bin") + F.col("frac")) / bins).alias("part"))
    spread = spread.select(*keys, F.greatest(F.col("bin") - 1, F.lit(0)).alias("from"), F.least(F.col("bin") + 2, F.lit(bins)).alias("to"))
    found = join_keys(join_keys(coarse, fine, keys, "left"), spread, keys)
    found = found.select(*keys, *own, (F.col("lo") + F.coalesce("part", F.lit(0.0)) * width).alias("median"), (F.col("from") * width).alias("d0"), (F.col("to") * width).alias("d1"))
    rows = join_keys(some, found, keys).withColumn("d", F.abs(F.col("v") - F.col("median")))
    below = rows.groupBy(*keys).agg(F.sum((F.col("d") < F.col("d0")).cast("long")).alias("below"))
    region = rows.where((F.col("d") >= F.col("d0")) & (F.col("d") < F.col("d1"))).withColumn("bin", slot(F.col("d") - F.col("d0"), F.greatest(F.col("d1") - F.col("d0"), F.lit(1e-30))))
    mad = at_rank(join_keys(counted(region), below, keys), keys, F.col("half") - F.col("below")).select(*keys, ((F.col("bin") + F.col("frac")) / bins).alias("part"))
    out = join_keys(found, mad, keys, "left")
    value = F.col("d0") + F.coalesce("part", F.lit(0.0)) * F.greatest(F.col("d1") - F.col("d0"), F.lit(1e-30))
    return out.select(*keys, "min", "max", "mean", "median", value.alias("mad"), F.greatest(value * MAD_SIGMA, F.lit(1e-30)).alias("sigma"), F.col("n").alias("valid_count"))
