"""Composites from channels: sizes, white balance, stretches and green, over one long table of samples.

Channels are rows (channel, y, x, v), channel being r, g or b (or l), so that each step is one aggregate or join for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nebulark.functions import color, stretch
from nebulark.operators import sampling, stats
from nebulark.operators.lineage import checkpointed
from nebulark.operators.spatial import size_of

#: Fixed value: the greatest ratio of two channels' sizes.
MOST_RATIO = 8.0
NEUTRAL = {"shadow": 0.0, "midtone": 0.5, "highlight": 1.0}


def harmonised(channels: DataFrame) -> DataFrame:
    """Channels resampled to the greatest height and width among them; an error where one is more than 8 times another.

    The driver learns each channel's size. Channels that have it stay as they are.
    """
    sizes = {r.channel: (r.h, r.w) for r in size_of(channels, ["channel"]).collect()}  # a row a channel
    if not sizes:
        return channels
    height, width = (max(s[k] for s in sizes.values()) for k in (0, 1))
    if max(height / min(h for h, _ in sizes.values()), width / min(w for _, w in sizes.values())) > MOST_RATIO:
        raise ValueError("channels differ too much in size")
    other = [c for c, s in sizes.items() if s != (height, width)]
    if not other:
        return channels
    resampled = sampling.resized(channels.where(F.col("channel").isin(other)), ["channel"], height, width)
    return channels.where(~F.col("channel").isin(other)).select("channel", "y", "x", "v").unionByName(resampled)


def cropped_to_least(channels: DataFrame) -> DataFrame:
    """Channels cut to the least height and width among them."""
    least = size_of(channels, ["channel"]).agg(F.min("h").alias("h"), F.min("w").alias("w"))
    return stats.join_keys(channels, least, []).where("y < h AND x < w").drop("h", "w")


def wide(channels: DataFrame) -> DataFrame:
    """One row a pixel with r, g and b; a missing channel is made of the others."""
    out = channels.groupBy("y", "x").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in "rgb"))
    r, g, b = (F.col(c) for c in "rgb")
    made = {"r": color.channel_or_synth(r, g, b), "g": color.channel_or_synth(g, r, b), "b": color.channel_or_synth(b, r, g)}
    return out.select("y", "x", *(made[c].alias(c) for c in "rgb"))


def long(rgb: DataFrame) -> DataFrame:
    return rgb.select("y", "x", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "rgb"))).alias("s")).select("s.channel", "y", "x", "s.v")


def multiplied(channels: DataFrame, factors: DataFrame) -> DataFrame:
    """Samples times their channel's factor (channel, factor)."""
    return channels.join(F.broadcast(factors), "channel").withColumn("v", F.col("v") * F.col("factor")).drop("factor")  # three rows


def balanced(channels: DataFrame) -> DataFrame:
    """Factors (channel, factor) that take the medians to that of the channel with the least relative noise."""
    s = stats.image_stats(channels, ["channel"]).groupBy().pivot("channel", list("rgb")).agg(F.first("median").alias("med"), F.first("mad").alias("mad"))
    f = color.white_balance({c: F.col(f"{c}_med") for c in "rgb"}, {c: F.col(f"{c}_mad") for c in "rgb"})
    return s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), f[c].alias("factor")) for c in "rgb"))).alias("s")).select("s.*")


def composed(channels: DataFrame, balance: str | tuple[float, float, float] | None = "auto", auto_stretch: bool = True, linked: bool = False, green: tuple[str, float, bool] | None = ("average", 1.0, False), align: str | None = None) -> DataFrame:
    """A composite (y, x, r, g, b) in 0 to 1 from two or three channels; fewer are an error.

    Sizes are made equal; with align (phase or affine) channels are moved onto the first that there is of red, green and
    blue; a missing channel is made up; then white balance (auto, three factors or none), a stretch
    (automatic for each channel, linked: from the mean of the channels with each channel's own range, or neutral), and
    less green (method, amount, whether luminance is kept).
    """
    there = sorted((r.channel for r in channels.select("channel").distinct().collect()), key="rgbl".find)  # a row a channel
    if len(set(there) & set("rgb")) < 2:
        raise ValueError("a composite needs two channels or more")
    rows = harmonised(channels)
    if align:
        from nebulark.operators.align import aligned_channels

        rows = aligned_channels(rows, there[0], align)
    rows = checkpointed(long(wide(rows)))
    if balance is not None:
        factors = balanced(rows) if balance == "auto" else channels.sparkSession.createDataFrame(list(zip("rgb", map(float, balance))), "channel string, factor double")
        rows = checkpointed(multiplied(rows, factors))
    own = stats.image_stats(rows, ["channel"])
    params = lambda s: {n: c.alias(n) for n, c in stretch.auto_stf(F.col("median"), F.col("sigma"), F.col("min"), F.col("max")).items()}
    if not auto_stretch:
        own = own.select("channel", "min", "max", *(F.lit(v).alias(n) for n, v in NEUTRAL.items()))
    elif linked:
        mean = rows.groupBy("y", "x").agg((F.sum("v") * (1.0 / 3.0)).alias("v"))
        own = stats.join_keys(own.select("channel", "min", "max"), stats.image_stats(mean, []).select(*params(mean).values()), [])
    else:
        own = own.select("channel", "min", "max", *params(own).values())
    out = rows.join(F.broadcast(own), "channel").withColumn("v", stretch.apply_stf("v", F.col("shadow"), F.col("midtone"), F.col("highlight"), F.col("min"), F.col("max")))  # three rows
    out = out.groupBy("y", "x").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in "rgb"))
    if green is None:
        return out
    method, amount, keep = green
    r, g, b = color.scnr(F.col("r"), F.col("g"), F.col("b"), amount, method, keep)
    return out.select("y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def arcsinh_composite(rgb: DataFrame, factor: float, gamma: float = 1.0) -> DataFrame:
    """r, g and b stretched by one range, the least and greatest valid sample of all three."""
    rows = long(rgb)
    span = stats.image_stats(rows, []).select("min", "max")
    return stats.join_keys(rgb, span, []).select("y", "x", *(stretch.arcsinh(c, F.col("min"), F.col("max"), factor, gamma).alias(c) for c in "rgb"))


def from_masters(masters: DataFrame) -> DataFrame:
    """A composite (y, x, r, g, b) of masters labelled R, G, B and perhaps L, in either case, each scaled to 0 to 1.

    Masters of unequal sizes are cut to the least and L is left out; else colours take L's luminance.
    """
    rows = masters.select(F.lower("channel").alias("channel"), "y", "x", "v")
    sizes = size_of(rows.where("channel <> 'l'"), ["channel"]).agg(F.min("h").alias("h0"), F.min("w").alias("w0"), F.max("h").alias("h1"), F.max("w").alias("w1"), F.count("*").alias("n")).first()
    if sizes["n"] < 3:
        raise ValueError("red, green and blue are needed")
    equal = sizes["h0"] == sizes["h1"] and sizes["w0"] == sizes["w1"]
    light = size_of(rows.where("channel = 'l'"), []).first() if equal else None
    lit = light is not None and (light["h"], light["w"]) == (sizes["h0"], sizes["w0"])
    rows = rows.where("TRUE" if lit else "channel <> 'l'")
    rows = rows if equal else cropped_to_least(rows)
    scaled = stats.normalized(rows, ["channel"], "minmax").groupBy("y", "x").agg(*(F.max(F.when(F.col("channel") == c, F.col("norm"))).alias(c) for c in "rgbl"))
    r, g, b = (F.col(c) for c in "rgb")
    value = (lambda c: color.luminance_scaled(F.col(c), F.col("l"), r, g, b)) if lit else F.col
    return scaled.select("y", "x", *(value(c).alias(c) for c in "rgb"))


def blended(channels: DataFrame, preset: str) -> DataFrame:
    """r, g and b of a preset's weights of named channels (channel, y, x, v); a channel that isn't there counts as 0."""
    weights = color.PRESETS[preset]
    of = {name: F.coalesce(F.max(F.when(F.col("channel") == name, F.col("v"))), F.lit(0.0)) for name, *_ in weights}
    total = lambda k: sum((of[name] * w[k] for name, *w in weights), F.lit(0.0))
    return channels.groupBy("y", "x").agg(*(total(k).alias(c) for k, c in enumerate("rgb")))


def white_reference(name: str, custom: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[Column, Column, Column]:
    """What white is: a star of 5778 K, a spiral's light, flat, or given factors."""
    from nebulark.functions.sky import planck_rgb

    if name == "g2v":
        return planck_rgb(F.lit(5778.0))
    if name == "spiral":
        return tuple(c * k for c, k in zip(planck_rgb(F.lit(5500.0)), (0.98, 1.0, 1.02)))
    return tuple(map(F.lit, custom if name == "custom" else (1.0, 1.0, 1.0)))


def colour_index(flux: Column, peak: Column, fwhm: Column) -> Column:
    """A stand-in for a star's colour index, from its shape alone."""
    ratio = stretch.clamp(F.try_divide(flux, peak), 0.1, 100.0)
    return stretch.clamp(1 / F.sqrt(ratio) + 0.1 * stretch.clamp(fwhm - 3, -2.0, 5.0), -0.3, 4.0)
