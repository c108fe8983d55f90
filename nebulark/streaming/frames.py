"""Frames that arrive as a stream: statistics by event-time window and the running best of each channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nebulark.functions.validity import valid


def read(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """Files of samples that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", glob).parquet(folder)


def windowed_stats(samples: DataFrame, keys: list[str], time: str = "ts", v: str = "v", late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Per key and window count, min, max, mean and deviation of valid samples; a window ends once `late` has passed."""
    some = samples.where(valid(v)).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = some.groupBy(F.window(time, every), *keys).agg(F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "min", "max", "mean", "sd")


def deduplicated(samples: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Samples without repeats of a key within the time that late ones have."""
    return samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drains what there is into a table in memory; for small results and tests."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
