"""Helpers that the text operators share: the shared scratch folder, written tables and token rules."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in the contracts that take words unchanged.
WORD = r"[^\x20\x09-\x0D]+"

#: Maps A-Z to a-z and every ASCII byte that is neither a digit nor a letter to a space; bytes of non-ASCII characters stay.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; in local mode a local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


#: Bytes of a batch that goes to a Python worker, while a table is written.
BATCH_BYTES = "8m"


def stash(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path, key = df.sparkSession, scratch(df.sparkSession), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(col: str = "text"):
    """A 128-bit content key of a text, null for null: equal texts have equal keys."""
    return F.md5(F.col(col).cast("binary"))


def folded_words(data: bytes) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and non-ASCII characters."""
    return data.translate(FOLD).split()


def slices(batches, col: int, most: int = 8 << 20):
    """Arrow batches cut so that the text column has about `most` bytes in each (a longer text stands alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for k, n in enumerate(size.tolist()):
            if total and total + n > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < len(size):
            yield batch.slice(start)


def kinds(df: DataFrame, cols: list[str]) -> str:
    """The schema of some columns, as DDL."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c.replace('`', '``')}` {types[c]}" for c in cols)
