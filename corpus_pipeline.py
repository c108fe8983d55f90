"""A corpus pipeline of five stages, each a function of (spark, docs, sf_dir).

All but the last return the columns of documents; run() writes what each stage keeps and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.llm.common import documents, stash, text_key
from nebulark.llm.decontaminate import contamination
from nebulark.llm.language import identify
from nebulark.llm.mixing import mixed_copies
from nebulark.llm.neardup import one_of_each
from nebulark.llm.sharding import shard, written_order

#: Languages whose documents stay, as in the labels; None keeps all languages that are learned.
KEPT_LANGUAGES: tuple[str, ...] | None = None
#: Keys of texts that are broadcast, about 3 MB; beyond that a join shuffles.
BROADCAST_KEYS = 50_000


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the texts of bad, by their keys; null is a text. What is decided by text alone needs no more.

    The keys are written first, so that texts go to Python in batches of a bounded size and aren't written again.
    """
    keys = stash(bad.select(text_key().alias("__key")).distinct())
    few = keys.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(keys) if few else keys, text_key().eqNullSafe(F.col("__key")), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the languages to keep, lang replaced by the predicted language.

    Those go that have no letter, that no learned language explains, or whose predicted language isn't in KEPT_LANGUAGES.
    """
    found = identify(docs, docs.where(F.col("lang").isNotNull()))
    kept = F.col("explained") if KEPT_LANGUAGES is None else F.col("explained") & F.col("lang_pred").isin(*KEPT_LANGUAGES)
    return found.where(kept).select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a window of a benchmark item occurs."""
    found = contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where(F.size("spans") > 0))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, written in training order."""
    return mixed_copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row: the training order, as written, cut into shards of near equal bytes."""
    return shard(written_order(docs), order=("__file", "__row"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
