"""Frame lists: assignment to channels, set differences, groups and progress, as joins and aggregates over file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.functions.channels import fits_slot
from nebulark.functions.validity import col
from nebulark.operators.lineage import checkpointed

# Bins, presets and filters of narrowband work; candidates for red, green and blue.
NARROWBAND_BINS = ("ha", "sii", "nii", "oiii", "hb")
NARROWBAND_PRESETS = ("sho", "hoo", "dynamic_hoo", "foraxx", "hubble_legacy")
NARROWBAND_FILTERS = ("Hα (656nm)", "[OIII] (502nm)", "[SII] (673nm)")
RGB_BINS = {"r": ("r", "sii", "ha"), "g": ("g", "ha", "oiii"), "b": ("b", "oiii", "sii")}


def without(files: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Files that aren't excluded."""
    return files.join(excluded.select(key).distinct(), key, "left_anti")


def channels_by_wavelength(files: DataFrame, group: list[str], wavelength: str) -> DataFrame:
    """Files of a group with channel: R for the longest wavelength, B for the shortest, G for the middle one of three or
    more, null for others. A group is a set of filters, so small."""
    own = Window.partitionBy(*group)
    ranked = files.withColumn("rank", F.row_number().over(own.orderBy(F.desc(wavelength)))).withColumn("n", F.count("*").over(own))
    middle = (F.col("n") >= 3) & (F.col("rank") == F.floor(F.col("n") / 2) + 1)
    channel = F.when(F.col("rank") == 1, "R").when((F.col("rank") == F.col("n")) & (F.col("n") > 1), "B").when(middle, "G")
    return ranked.withColumn("channel", channel).drop("rank", "n")


def matching(files: DataFrame, text: str, *cols: str) -> DataFrame:
    """Files that have a text in one of some columns, in either case."""
    return matching_any(files, dict.fromkeys(cols, text))


def matching_any(files: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Files that have its text in one of the columns, in either case: one scan."""
    found = F.lit(False)
    for c, text in texts.items():
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return files.where(found)


def progress(files: DataFrame, state: str, size: str, *keys: str) -> DataFrame:
    """Per key total, done, failed, bytes and per cent done."""
    of = lambda s: F.sum((F.col(state) == s).cast("int"))
    return files.groupBy(*keys).agg(F.count("*").alias("total"), of("done").alias("done"), of("failed").alias("failed"), F.sum(size).alias("bytes"), (100 * of("done") / F.count("*")).alias("percent"))


def best_of_slot(files: DataFrame, slot: str, confidence: str, order: str) -> DataFrame:
    """The file of each slot with the best confidence (High, Medium, Low), the first of equal ones."""
    rank = F.when(F.col(confidence) == "High", 0).when(F.col(confidence) == "Medium", 1).otherwise(2)
    best = files.where(F.col(slot).isNotNull()).groupBy(slot).agg(F.min(F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("b"))
    return best.select(slot, F.col("b.o").alias(order))


def reflected(i: Column | str, n: int) -> Column:
    """An index mirrored at both edges, which aren't repeated."""
    period = max(2 * (n - 1), 1)
    k = F.pmod(col(i), F.lit(period))
    return F.when(k < n, k).otherwise(period - k)


def clamped(i: Column | str, n: int) -> Column:
    """An index kept at the edge beyond it."""
    return F.greatest(F.lit(0), F.least(F.lit(max(n - 1, 0)), col(i)))


def wrapped(i: Column | str, n: int) -> Column:
    """An index that goes around."""
    return F.pmod(col(i), F.lit(max(n, 1)))


def bounded(i: Column | str, n: int, mode: str) -> Column:
    return {"clamp": clamped, "wrap": wrapped, "reflect": reflected}[mode](i, n)


def mapped_by_name(files: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """Per group the file, by `order`, of the slots L, R, G and B: in that order each takes the first file whose name suits
    it and that no slot before has. All slots are windows over one partitioning."""
    own, taken = Window.partitionBy(*group), F.lit(False)
    rows = files.select(*group, F.col(order).alias("__o"), *(fits_slot(name, s).alias(f"is_{s}") for s in "LRGB"))
    for s in "LRGB":
        rows = rows.withColumn(s, F.min(F.when(F.col(f"is_{s}") & ~taken, F.col("__o"))).over(own))
        taken = taken | F.coalesce(F.col(s) == F.col("__o"), F.lit(False))
    return rows.select(*group, *"LRGB").distinct()


def is_narrowband(bins: DataFrame, detections: DataFrame, presets: DataFrame, key: str) -> DataFrame:
    """Per workflow whether it is narrowband: by the id of a bin with files (key, bin, file), by its preset (key, preset), or
    by the filter (file, filter) detected in one of those files. Each side is one equi join."""
    found = bins.where(F.col("file").isNotNull()).join(detections.where(F.col("filter").isin(*NARROWBAND_FILTERS)).select("file", F.lit(True).alias("hit")).distinct(), "file", "left")
    by = found.groupBy(key).agg(F.max(F.col("bin").isin(*NARROWBAND_BINS) | F.coalesce("hit", F.lit(False))).alias("n"))
    rows = bins.select(key).distinct().join(by, key, "left").join(presets.select(key, F.col("preset").isin(*NARROWBAND_PRESETS).alias("p")), key, "left")
    return rows.select(key, (F.coalesce("n", F.lit(False)) | F.coalesce("p", F.lit(False))).alias("narrowband"))


def resolved_weights(weights: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Per workflow the bins (key, bin, nm) that a preset's weights (channel, nm, r, g, b) fall to: those of the same name
    if there are any, else both sides by falling wavelength, if that gives two or more."""
    exact = bins.join(F.broadcast(weights), bins["bin"] == weights["channel"]).select(key, "bin", "r", "g", "b")  # a preset's few rows
    rest = bins.join(exact.select(key).distinct(), key, "left_anti")
    left = rest.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("nm"), "bin")))
    right = weights.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nm"), "channel"))).select("rank", "r", "g", "b")
    paired = left.join(F.broadcast(right), "rank").withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return exact.unionByName(paired.where("n >= 2").select(key, "bin", "r", "g", "b"))


def channel_paths(bins: DataFrame, stages: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per bin (keys, file: its first) the path that the latest stage (keys, path; latest first) has for it, else the file."""
    out, paths = bins, []
    for k, stage in enumerate(stages):
        out = out.join(stage.select(*keys, F.col("path").alias(f"p{k}")), keys, "left")
        paths.append(F.when(F.col(f"p{k}") != "", F.col(f"p{k}")))
    return out.select(*keys, F.coalesce(*paths, F.col("file")).alias("path"))


def rgb_bins(bins: DataFrame, key: str) -> DataFrame:
    """Per workflow the bins (key, bin) that stand for red, green and blue: each the first of its candidates that is there
    and not yet used; blue may use one again if it must."""
    has = bins.groupBy(key).agg(F.collect_set("bin").alias("has"))  # names of bins: few
    pick = lambda names, used: F.coalesce(*(F.when(F.array_contains("has", n) & ~F.coalesce(F.array_contains(used, n), F.lit(False)), n) for n in names))
    r = pick(RGB_BINS["r"], F.array().cast("array<string>"))
    g = pick(RGB_BINS["g"], F.array(F.col("r")))
    b = F.coalesce(pick(RGB_BINS["b"], F.array_compact(F.array("r", "g"))), pick(RGB_BINS["b"], F.array().cast("array<string>")))
    return has.withColumn("r", r).withColumn("g", g).withColumn("b", b).drop("has")


def resolution_groups(files: DataFrame, key: str, order: str, within: int = 10) -> DataFrame:
    """Files (key, order, width, height) with group_w and group_h: the size of the first file of their resolution group.

    In order, a file joins the first group whose first file differs by less than `within` each way, or starts one. Only
    distinct sizes of a queue are gone through in order.
    """
    sizes = files.groupBy(key, "width", "height").agg(F.min(order).alias("o"))
    listed = sizes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "width", "height"))).alias("sizes"))
    near = lambda g, s: (F.abs(g["width"] - s["width"]) < within) & (F.abs(g["height"] - s["height"]) < within)
    size = lambda s: F.struct(s["width"].alias("width"), s["height"].alias("height"))
    kind = f"array<struct<width:{files.schema['width'].dataType.simpleString()},height:{files.schema['height'].dataType.simpleString()}>>"
    groups = F.aggregate("sizes", F.array().cast(kind), lambda acc, s: F.when(F.exists(acc, lambda g: near(g, s)), acc).otherwise(F.concat(acc, F.array(size(s)))))
    own = F.filter("groups", lambda g: (F.abs(g["width"] - F.col("width")) < within) & (F.abs(g["height"] - F.col("height")) < within))
    out = files.join(listed.select(key, groups.alias("groups")), key).withColumn("g", F.get(own, F.lit(0)))
    return out.select(*files.columns, F.col("g.width").alias("group_w"), F.col("g.height").alias("group_h"))


def resample_targets(grouped: DataFrame, key: str, ratio: float = 1.5) -> DataFrame:
    """Per queue whether its groups' areas differ by `ratio` or more, and the smallest group, to which the others go."""
    area = F.col("group_w") * F.col("group_h")
    by = grouped.groupBy(key).agg(F.min(F.struct(area.alias("area"), F.col("group_w").alias("w"), F.col("group_h").alias("h"))).alias("s"), F.max(area).alias("most"))
    needed = F.col("most") >= ratio * F.col("s.area")
    return by.select(key, needed.alias("needed"), F.when(needed, F.col("s.w")).alias("target_w"), F.when(needed, F.col("s.h")).alias("target_h"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their position from 1 in an order: a range sort, counts of its parts, and positions in them, so that no
    task gets all rows."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    parts = checkpointed(parts.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))  # a row a task
    return parts.join(F.broadcast(ahead), "__part").select(*rows.columns, (F.col("__in") + F.col("__ahead")).alias(name))


def sorted_by(rows: DataFrame, group: str, metric: str, ascending: bool, tie: str) -> DataFrame:
    """Rows with their position in their group by a metric, either way; ties by another column."""
    own = Window.partitionBy(group).orderBy(F.col(metric).asc() if ascending else F.col(metric).desc(), tie)
    return rows.select(tie, group, F.row_number().over(own).alias("position"))
