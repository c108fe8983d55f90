"""Mixing sources to target weights along a time-varying curriculum, by DataFrame functions alone.

Each source has a weight that changes with training time t from 0 to 1. Its integral is the source's cumulative token
demand; a document starts where the demand, inverted, has used up the tokens before it. Documents are sorted by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nebulark.llm.common import WORD, stash, text_key

#: Weights and slopes of the sources in order, repeating; with slope a the weight at t is 1 + a * (2t - 1) of the mean.
WEIGHTS, SLOPES = (3, 1, 2), (-0.5, 0.0, 0.5)
#: Words of the mix over words there are, and how often a source can be repeated.
SHARE, REPEATS = 1.5, 2
#: Rows of a block, about, if all were of one source; sizes are added up within blocks of a source, numbered by hashes.
BLOCK_ROWS = 50_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """Of each source: its number, words, weight and target. `sizes` has columns source and size.

    A source stops at `repeats` times its words; what it leaves goes to the others by weight, until none is above. The
    level of that filling is the greatest of the levels reached by taking the first sources, in order of words a
    weight, as full. One row a source goes through windows over all sources: what grows is their number, not the data.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy(F.col("words") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by = sizes.groupBy("source").agg(F.sum("size").alias("words")).withColumn("number", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("number") % len(weights) + 1).cast("double"))
    budget = share * F.sum("words").over(everything)
    before = F.coalesce(F.sum(repeats * F.col("words")).over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("reached", (budget - before) / rest).withColumn("level", F.max("reached").over(everything))
    return by.select("source", "number", "words", "weight", F.least((repeats * F.col("words")).cast("double"), F.col("weight") * F.col("level")).alias("target"))


def position(used: Column, slope: Column) -> Column:
    """The time at which a source with a slope has used up a fraction of its demand: t + slope * (t * t - t) = used."""
    b = 1 - slope
    return F.when(slope == 0, used).otherwise((F.sqrt(b * b + 4 * slope * used) - b) / (2 * slope))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per row of docs: its id, source, size (words), source_size, target, taken (words the mix takes) and position.

    A source's documents come in an order of hashes of ids, again and again up to the target in whole words, so that
    the last one may be taken in part; `positions` has the time at which each pass over a document starts, `position`
    the first of them; row is a hash of the text. Rows are sorted by position, those not taken last. Sizes are added up
    within blocks of a source by hash, whose number grows with the rows, and over blocks by one row a block, so no task
    gets a whole source; the blocks don't change the result. A null id counts by its text instead, so rows without ids
    spread over the blocks. Null texts have size 0 and are never taken; the null source is a source; repeated rows count
    each; an empty table gives no rows.
    """
    name = F.coalesce(F.col(id_col).cast("string"), text_key(text_col), F.lit(""))
    h = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    rows = stash(docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("row"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), h.alias("h")))
    digits = max(1, (max(1, rows.count() // BLOCK_ROWS) - 1).bit_length() + 3 >> 2)
    rows = rows.withColumn("block", F.substring("h", 1, digits))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    ahead = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("block0", F.coalesce(F.sum("block_size").over(ahead), F.lit(0))).drop("block_size")
    wanted = targets(rows, share, repeats).withColumn("slope", F.element_at(F.array(*map(F.lit, SLOPES)), F.col("number") % len(SLOPES) + 1)).drop("number", "weight")
    blocks = blocks.alias("b").join(wanted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source"))).select("b.*", "words", "target", "slope")
    within = Window.partitionBy("source", "block").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(within))
    r = rows.alias("r").join(blocks.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block"))).select("id", "row", "r.source", "size", "h", "words", "target", "slope", (F.col("block0") + F.col("end") - F.col("size")).alias("start"))
    want, size, start = F.floor(F.col("target") + 0.5), F.col("size"), F.col("start")
    passes = [F.greatest(F.lit(0), F.least(size, want - start - k * F.col("words"))) for k in range(repeats)]
    taken = sum(passes[1:], passes[0])
    at = [F.when(p > 0, F.round(position((start + k * F.col("words")) / F.col("target"), F.col("slope")), 9)) for k, p in enumerate(passes)]
    out = r.select("id", "row", "source", "size", F.col("words").alias("source_size"), "target", taken.cast("long").alias("taken"), at[0].alias("position"), F.array_compact(F.array(*at)).alias("positions"), "h")
    return out.orderBy(F.col("position").asc_nulls_last(), "h", "id").drop("h").withColumnsRenamed({"id": id_col, "source": source_col})


def mixed_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as often as the mix takes them, sorted by the positions of their passes.

    Rows stay whole: of a document that the mix takes in part, the pass counts if half of it or more is taken. Rows
    without words are kept once, first. Rows equal in id and text are taken alike. Written, the files' names and the rows
    in them are in training order (see sharding.written_order).
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    passes = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    at = F.when(F.col("size") == 0, F.array(F.lit(0.0))).otherwise(F.slice("positions", F.lit(1), passes))
    plan = plan.select(F.col(id_col).alias("__id"), F.col("row").alias("__row"), at.alias("__at")).where(F.size("__at") > 0).dropDuplicates(["__id", "__row"])
    joined = docs.join(plan, docs[id_col].eqNullSafe(plan["__id"]) & (F.hash(docs[text_col]) == plan["__row"]))
    return joined.select(*(docs[c] for c in docs.columns), F.explode("__at").alias("__position")).orderBy("__position", id_col).drop("__position")
