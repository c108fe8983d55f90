"""Alignment and stacking of frames: star matches, transforms with fallbacks, and stacks of aligned frames.

Frames are rows (frame, y, x, v); every step is keyed by frame, so all frames go through the same jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.functions import stretch
from nebulark.operators import registration, spectral, stacking, tiles
from nebulark.operators.detection import brightest, detected
from nebulark.operators.lineage import checkpointed
from nebulark.operators.spatial import block_means, size_of
from nebulark.operators.stars import LEAST_SIDE, TRIANGLE_STARS, triangle_matches
from nebulark.operators.stats import each_frame, join_keys, order_stats

#: Stars and matches of a transform, confidence and part of a side of a shift, side of coarse images.
STARS, AFFINE, RIGID, CONFIDENCE, PART, COARSE = 120, 6, 4, 1.5, 0.4, 512
#: Fixed value: level of detection for alignment.
SIGMA = 3.5
#: Bounds of drizzle's scale and footprint, and by how much frames' sizes may differ.
SCALES, FOOTPRINTS, DIFFERENCE = (1.0, 4.0), (0.1, 1.0), 0.05


def for_detection(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Samples scaled to 0 to 1 between 1 % and 99.9 % of the finite ones; frames of less than 100 stay as they are."""
    ends = order_stats(pixels, keys, {"p1": 0.01, "p2": 0.999}, ok=lambda v: stretch.finite(v))
    counts = pixels.where(stretch.finite("v")).groupBy(*keys).agg(F.count("*").alias("n"))
    j = join_keys(join_keys(pixels, ends, keys), counts, keys)
    x = stretch.clamp(F.try_divide(F.col("v") - F.col("p1"), F.col("p2") - F.col("p1")))
    return j.select(*keys, "y", "x", F.when(F.col("n") < 100, F.col("v")).when(stretch.finite("v"), F.coalesce(x, F.lit(0.0))).otherwise(0.0).alias("v"))


def ordered_triangles(stars: DataFrame, n: int = TRIANGLE_STARS, keys: list[str] = ()) -> DataFrame:
    """Triangles of the n brightest stars (keys, star_id, x, y, flux) of each key: ratios r1 and r2 of the shorter sides to the
    longest, and a, b, c, the vertices opposite the sides from the shortest on. n bounds the result of a key."""
    keys = list(keys)
    top = ranked(stars, n, keys)
    one = lambda k: top.select(*(F.col(c).alias(c if k == "p" else f"{c}__{k}") for c in keys), F.col("star_id").alias(k), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    same = lambda k: [F.col(c).eqNullSafe(F.col(f"{c}__{k}")) for c in keys]
    three = one("p").join(F.broadcast(one("q")) if not keys else one("q"), [*same("q"), F.col("p") < F.col("q")])  # n rows a key
    three = three.join(F.broadcast(one("r")) if not keys else one("r"), [*same("r"), F.col("q") < F.col("r")])
    side = lambda a, b: F.hypot(F.col(f"x{a}") - F.col(f"x{b}"), F.col(f"y{a}") - F.col(f"y{b}"))
    opposite = F.array_sort(F.array(*(F.struct(side(*ends).alias("d"), F.col(v).alias("v")) for v, ends in (("r", "pq"), ("p", "qr"), ("q", "pr")))))
    s = three.withColumn("s", opposite).where(F.col("s")[0]["d"] >= LEAST_SIDE)
    return s.select(*keys, *(F.col("s")[k]["v"].alias(n) for k, n in enumerate("abc")), (F.col("s")[0]["d"] / F.col("s")[2]["d"]).alias("r1"), (F.col("s")[1]["d"] / F.col("s")[2]["d"]).alias("r2"))


def ranked(stars: DataFrame, n: int, keys: list[str] = ()) -> DataFrame:
    """The n brightest stars of each key."""
    if not keys:
        return brightest(stars, n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flux"), "star_id"))
    return stars.withColumn("place", place).where(F.col("place") <= n).drop("place")


def votes(one: DataFrame, two: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys of the second, a, b and votes: how many pairs of alike triangles have star a of the first list where the other has star b."""
    met = triangle_matches(one, two, keys=keys)
    pairs = F.explode(F.array(*(F.struct(F.col(k).alias("a"), F.col(f"{k}2").alias("b")) for k in "abc")))
    return met.select(*keys, pairs.alias("p")).groupBy(*keys, "p.a", "p.b").agg(F.count("*").alias("votes"))


def assigned(votes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pairs (keys, a, b, votes) that a greedy choice takes in each key: by falling votes, then a, then b, each a and each b once.

    In a round every pair that is the first of all left for both its sides is taken at once; the same pairs as one by one.
    """
    keys = list(keys)
    left, taken = checkpointed(votes), None
    first = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("votes"), "a", "b"))
    while True:
        best = checkpointed(left.withColumn("i", first("a")).withColumn("j", first("b")).where("i = 1 AND j = 1").select(*keys, "a", "b", "votes"))
        taken = best if taken is None else checkpointed(taken.unionAll(best))
        free = lambda side: [*keys, side]
        left = checkpointed(left.join(best.select(*free("a")), free("a"), "left_anti").join(best.select(*free("b")), free("b"), "left_anti").select(*keys, "a", "b", "votes"))
        if left.isEmpty():
            return taken


def matched_stars(reference: DataFrame, target: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Matches (keys of the targets, x, y of the reference, u, w of the target, votes) of star lists by votes of their triangles."""
    keys = list(keys)
    one, two = checkpointed(brightest(reference, STARS)), checkpointed(ranked(target, STARS, keys))
    pairs = assigned(votes(ordered_triangles(one), ordered_triangles(two, keys=keys), keys), keys)
    pairs = pairs.join(F.broadcast(one.select(F.col("star_id").alias("a"), "x", "y")), "a")  # STARS rows
    pairs = join_keys(pairs, two.select(*keys, F.col("star_id").alias("b"), F.col("x").alias("u"), F.col("y").alias("w")), [*keys, "b"])
    return pairs.select(*keys, "x", "y", "u", "w", "votes")


def phase_offsets(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """frame, dy, dx, confidence and doubtful of each frame's shift from the reference (y, x, v), from coarse to fine, all in one plan.

    Images beyond 512 samples are first averaged down to that side; then the middle 512 samples, moved by what was found,
    tell the rest. So a task holds two planes of that size at most.
    """
    size = size_of(reference, []).first()
    h, w = size["h"], size["w"]
    shift = lambda r, t: spectral.phase_correlation(t.select("frame", "y", "x", "v"), r, "frame")
    if max(h, w) <= COARSE:
        return shift(reference, frames)
    s = max(h, w) / COARSE
    coarse = checkpointed(shift(block_means(reference, [], s, s), block_means(frames, ["frame"], s, s)))
    moved = coarse.select("frame", F.round(F.col("dy") * s).alias("oy"), F.round(F.col("dx") * s).alias("ox"))
    fine = shift(centre(reference, h, w), centre(join_keys(frames, moved, ["frame"]), h, w, F.col("oy"), F.col("ox")))
    return join_keys(fine, moved, ["frame"]).select("frame", (F.col("oy") + F.col("dy")).alias("dy"), (F.col("ox") + F.col("dx")).alias("dx"), "confidence", "doubtful")


def centre(pixels: DataFrame, height: int, width: int, dy: Column | int = 0, dx: Column | int = 0, half: int = COARSE // 2) -> DataFrame:
    """The middle of an image, read at an offset."""
    top, left = max(height // 2 - half, 0) + F.lit(dy), max(width // 2 - half, 0) + F.lit(dx)
    inside = pixels.where(F.col("y").between(top, top + 2 * half - 1) & F.col("x").between(left, left + 2 * half - 1))
    return inside.select(*(c for c in ("frame",) if c in pixels.columns), (F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), "v")


#: What a transform is: it takes a reference's pixel (x, y) to a frame's (a x + b y + tx, c x + d y + ty).
TERMS = ("a", "b", "tx", "c", "d", "ty")


def shifts(frames: DataFrame, reference: DataFrame, height: int, width: int) -> DataFrame:
    """frame, method and TERMS of shifts by phase correlation; none where it is doubtful or moves by more than 40 % of a side."""
    found = phase_offsets(frames, reference)
    sure = (F.col("confidence") >= CONFIDENCE) & (F.abs("dy") <= PART * height) & (F.abs("dx") <= PART * width)
    move = lambda c: F.when(sure, F.col(f"d{c}")).otherwise(0.0).alias(f"t{c}")
    return found.select("frame", F.when(sure, "phase").otherwise("identity").alias("method"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), move("x"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), move("y"))


def star_transforms(frames: DataFrame, reference, height: int, width: int, sigma: float = SIGMA) -> DataFrame:
    """frame, method and TERMS of the frames whose stars match the reference's: affine from six or more matches that agree,
    else rigid from four; frames without a plausible one have no row."""
    stars = checkpointed(detected(for_detection(frames, ["frame"]), ["frame"], sigma))
    one, others = stars.where(F.col("frame") == F.lit(reference)), stars.where(F.col("frame") != F.lit(reference))
    found = checkpointed(matched_stars(one, others, ["frame"]))
    n = found.groupBy("frame").agg(F.count("*").alias("matches"))
    likely = registration.plausible(width, height)
    affine = registration.robust_affine(found, -F.col("votes"), keys=["frame"]).where((F.col("n") >= AFFINE) & (F.col("total") >= AFFINE) & likely)
    turn = F.radians("rotation")
    rigid = registration.rigid_fit(found, ["frame"]).where(F.col("n") >= RIGID).select("frame", F.cos(turn).alias("a"), (-F.sin(turn)).alias("b"), "tx", F.sin(turn).alias("c"), F.cos(turn).alias("d"), "ty").where(likely)
    both = join_keys(join_keys(n.select("frame"), affine.select("frame", F.struct(*TERMS).alias("affine")), ["frame"], "left"), rigid.select("frame", F.struct(*TERMS).alias("rigid")), ["frame"], "left")
    both = both.withColumn("t", F.coalesce("affine", "rigid")).where("t IS NOT NULL")
    return both.select("frame", F.when(F.col("affine").isNotNull(), "affine").otherwise("rigid").alias("method"), "t.*")


def transforms(frames: DataFrame, reference, method: str = "phase") -> DataFrame:
    """frame, method and TERMS of each frame on the reference frame; that of the reference itself moves nothing.

    By shifts, or (method affine) by stars, and by a shift where those don't do. All frames go through the same jobs, keyed
    by frame, so their number doesn't grow with the frames.
    """
    frames = checkpointed(frames.select("frame", "y", "x", "v"))
    base, others = frames.where(F.col("frame") == F.lit(reference)).select("y", "x", "v"), frames.where(F.col("frame") != F.lit(reference))
    size = size_of(base, []).first()
    kind = frames.schema["frame"].dataType.simpleString()
    own = frames.sparkSession.range(1).select(F.lit(reference).cast(kind).alias("frame"), F.lit("identity").alias("method"), *(F.lit(1.0 if c in "ad" else 0.0).alias(c) for c in TERMS))
    names = others.select("frame").distinct()
    if method == "phase":
        moved = shifts(others, base, size["h"], size["w"])
    else:
        by_stars = checkpointed(star_transforms(frames, reference, size["h"], size["w"]))
        rest = others.join(by_stars.select("frame"), "frame", "left_anti")
        moved = by_stars.unionByName(shifts(rest, base, size["h"], size["w"]))
    # A frame that shares no sample with the reference has no shift, either.
    left = join_keys(names, moved, ["frame"], "left")
    moved = left.select("frame", F.coalesce("method", F.lit("identity")).alias("method"), *(F.coalesce(c, F.lit(1.0 if c in "ad" else 0.0)).alias(c) for c in TERMS))
    return checkpointed(own.unionByName(moved))


def warped(frames: DataFrame, found: DataFrame) -> DataFrame:
    """Dense frames read through their transforms (frame and TERMS): cubic, 0 outside; a frame is split over tasks by tiles."""
    table = checkpointed(join_keys(found.select("frame", *TERMS), size_of(frames, ["frame"]), ["frame"]))
    return tiles.affine_reads(frames.select("frame", "y", "x", "v"), table, ["frame"])


def stacked(frames: DataFrame, reference, low: float = 3.0, high: float = 3.0, passes: int = 5, align: bool = True, method: str = "phase") -> DataFrame:
    """One image (y, x, result, rejected, n) of frames cut to the least size, aligned to the reference, and clipped."""
    least = size_of(frames, ["frame"]).agg(F.min("h").alias("h"), F.min("w").alias("w"))
    rows = checkpointed(join_keys(frames, least, []).where("y < h AND x < w").select("frame", "y", "x", "v"))
    rows = warped(rows, transforms(rows, reference, method)) if align else rows
    return stacking.sigma_clip(rows, ["y", "x"], low, high, passes)


def drizzle_stack(frames: DataFrame, reference, scale: float = 2.0, shrink: float = 0.8, low: float = 3.0, high: float = 3.0, passes: int = 3, method: str = "phase", kernel: str = "square") -> DataFrame:
    """One image of two or more frames on a finer grid, each placed by its offset from the reference, clipped by cell.

    Frames are cut to the least size; if their sides differ by more than 5 % of it, it is an error. Scale and footprint are
    kept within 1 to 4 and 0.1 to 1. By phase, a frame's offset is that of its shift, or of its stars where that is doubtful;
    no offset (method none) leaves all where they are.
    """
    size = size_of(frames, ["frame"]).agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "hw")).first()
    if size["n"] < 2 or any(size[f"max_{c}"] - size[f"min_{c}"] > int(DIFFERENCE * max(size["min_h"], size["min_w"])) for c in "hw"):
        raise ValueError("drizzle needs two frames or more of one size")
    rows = checkpointed(frames.where((F.col("y") < size["min_h"]) & (F.col("x") < size["min_w"])).select("frame", "y", "x", "v"))
    if method == "none":
        offsets = rows.select("frame").distinct().select("frame", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    else:
        offsets = frame_offsets(rows, reference, method)
    bounded = lambda x, ends: min(max(x, ends[0]), ends[1])
    return stacking.drizzle_clipped(rows, each_frame(offsets), bounded(scale, SCALES), bounded(shrink, FOOTPRINTS), low, high, passes, kernel)


def frame_offsets(frames: DataFrame, reference, method: str = "phase") -> DataFrame:
    """frame, dy and dx, by which each frame is moved onto the reference."""
    if method != "phase":
        return transforms(frames, reference, method).select("frame", (-F.col("ty")).alias("dy"), (-F.col("tx")).alias("dx"))
    base = frames.where(F.col("frame") == F.lit(reference)).select("y", "x", "v")
    found = checkpointed(phase_offsets(frames.where(F.col("frame") != F.lit(reference)), base))
    sure = found.where(~F.col("doubtful")).select("frame", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"))
    if found.where("doubtful").isEmpty():
        others = sure
    else:
        rest = frames.join(found.where("doubtful").select("frame"), "frame", "left_semi").unionByName(frames.where(F.col("frame") == F.lit(reference)))
        by_stars = transforms(rest, reference, "affine").where(F.col("frame") != F.lit(reference))
        others = sure.unionByName(by_stars.select("frame", (-F.col("ty")).alias("dy"), (-F.col("tx")).alias("dx")))
    return others.unionByName(frames.where(F.col("frame") == F.lit(reference)).select("frame").distinct().select("frame", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx")))


def aligned_channels(channels: DataFrame, reference: str = "r", method: str = "phase") -> DataFrame:
    """Channels (channel, y, x, v) of one size read through their transforms on the reference channel."""
    rows = checkpointed(channels.select(F.col("channel").alias("frame"), "y", "x", "v"))
    return warped(rows, transforms(rows, reference, method)).withColumnRenamed("frame", "channel")


def drizzle_rgb(frames: DataFrame, references: dict, **options) -> DataFrame:
    """A composite of drizzled channels: frames have a column channel, references name each channel's reference frame."""
    from nebulark.operators.compose import composed, cropped_to_least

    parts = [drizzle_stack(frames.where(F.col("channel") == c).drop("channel"), reference, **options).select(F.lit(c).alias("channel"), "y", "x", F.col("value").alias("v")) for c, reference in references.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return composed(cropped_to_least(rows))
