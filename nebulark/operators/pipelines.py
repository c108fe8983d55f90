"""From folders of frames to images: masters, calibrated lights, stacks, drizzled images and the batch of all channels.

Frames are read by range (see sources.fits), so a folder of any size goes through the operators as one table, keyed by file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.operators import align, compose, stacking
from nebulark.operators.lineage import checkpointed
from nebulark.operators.spatial import size_of
from nebulark.sources import fits

PIXEL = ["y", "x"]
#: Limits and passes of the batch's stack.
LOW, HIGH, PASSES = 2.5, 3.0, 5


@dataclass
class Masters:
    bias: DataFrame | None = None
    dark: DataFrame | None = None
    flat: DataFrame | None = None

    def applied(self, lights: DataFrame, ratio: float = 1.0) -> DataFrame:
        return stacking.calibrated(lights, PIXEL, self.bias, self.dark, self.flat, ratio)


def frames_of(spark: SparkSession, path: str) -> DataFrame:
    """The images of the files under a path: frame (the file's name), y, x and v; of cubes the first plane."""
    return fits.read_frames(fits.images(fits.open_units(fits.listed(spark, path))), F.col("z") == 0).select(F.col("file").alias("frame"), "y", "x", "v")


def masters(spark: SparkSession, bias: str | None = None, dark: str | None = None, flat: str | None = None) -> Masters:
    """Masters of folders of frames; darks lose the bias, flats bias and dark."""
    made = Masters()
    if bias:
        made.bias = checkpointed(stacking.master(frames_of(spark, bias), PIXEL))
    if dark:
        made.dark = checkpointed(stacking.master(stacking.subtracted(frames_of(spark, dark), made.bias, PIXEL), PIXEL))
    if flat:
        made.flat = checkpointed(stacking.master_flat(frames_of(spark, flat), PIXEL, made.bias, made.dark))
    return made


def calibrated(spark: SparkSession, lights: str, made: Masters | None = None, ratio: float = 1.0) -> DataFrame:
    """Frames of a folder, calibrated."""
    rows = frames_of(spark, lights)
    return (made.applied(rows, ratio) if made else rows).select("frame", "y", "x", "v")


def first_of(rows: DataFrame):
    name = rows.agg(F.min("frame")).first()[0]
    if name is None:
        raise ValueError("there are no frames")
    return name


def stacked(spark: SparkSession, lights: str, made: Masters | None = None, **options) -> DataFrame:
    """One image of a folder's calibrated frames, aligned to the first by name (see align.stacked)."""
    rows = checkpointed(calibrated(spark, lights, made))
    return align.stacked(rows, first_of(rows), **options)


def drizzled(spark: SparkSession, lights: str, made: Masters | None = None, **options) -> DataFrame:
    """One image on a finer grid of a folder's calibrated frames, placed by the first by name (see align.drizzle_stack)."""
    rows = checkpointed(calibrated(spark, lights, made))
    return align.drizzle_stack(rows, first_of(rows), **options)


def drizzled_rgb(spark: SparkSession, channels: dict[str, str], made: Masters | None = None, **options) -> DataFrame:
    """A composite of drizzled channels, each from a folder of its own."""
    parts = {c: checkpointed(calibrated(spark, path, made)) for c, path in channels.items()}  # a few channels
    rows = None
    for c, part in parts.items():
        own = part.withColumn("channel", F.lit(c))
        rows = own if rows is None else rows.unionByName(own)
    return align.drizzle_rgb(rows, {c: first_of(part) for c, part in parts.items()}, **options)


def batch(spark: SparkSession, channels: dict[str, str], made: Masters, low: float = LOW, high: float = HIGH, passes: int = PASSES, normalise: bool = True, uneven: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Masters of channels (channel, y, x, v, rejected, n), facts of each (channel, lights, mean, stddev, rejected), and their
    composite where R, G and B are there.

    channels: a folder of lights for each label. All lights go through one table: calibrated, over their frame's mean, and
    stacked pixel by pixel with clipping about medians. A channel without lights is an error, and so are lights of several sizes
    unless they may be `uneven`: then a pixel's stack has the samples of the frames that reach it.
    """
    if not channels:
        raise ValueError("no channels")
    rows = None
    for c, path in channels.items():  # a few channels
        own = frames_of(spark, path).withColumn("channel", F.lit(c))
        rows = own if rows is None else rows.unionByName(own)
    rows = checkpointed(rows)
    sizes = size_of(rows, ["channel", "frame"]).groupBy("channel").agg(F.count("*").alias("lights"), F.count_distinct("h", "w").alias("sizes"))
    found = {r.channel: r for r in sizes.collect()}  # a row a channel
    for c in channels:
        if c not in found:
            raise ValueError(f"channel {c} has no lights")
        if found[c].sizes > 1 and not uneven:
            raise ValueError(f"channel {c} has frames of several sizes")
    lights = made.applied(rows).select("channel", "frame", "y", "x", "v")
    lights = stacking.frame_normalized(lights, ["channel", "frame"]) if normalise else lights
    stack = checkpointed(stacking.median_clip(lights, ["channel", "y", "x"], low, high, passes).withColumnRenamed("result", "v"))
    facts = stack.groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.sum("rejected").alias("rejected"))
    facts = sizes.select("channel", "lights").join(facts, "channel")
    labels = {c.upper() for c in channels}
    rgb = compose.from_masters(stack.select("channel", "y", "x", "v")) if {"R", "G", "B"} <= labels else None
    return stack, facts, rgb
