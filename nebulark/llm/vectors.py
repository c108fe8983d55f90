"""Exact top-k search by inner product with vector-approximation files.

A table of cells, one byte a component, approximates every vector. Scanning it bounds each score from below and above;
exact vectors are then read in the order of their upper bounds until no further one can be among the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nebulark.llm.common import scratch, stash

#: Components of the queries that are broadcast for one scan of the cells, 16 MB; a larger query set takes several scans.
QUERY_COMPONENTS = 2 << 20
#: Queries and vectors of which the bounds are held at once.
BLOCK, ROWS = 512, 2048
#: Cells along a component.
CELLS = 256
#: Exact vectors that are read first for each of the k results; each further round reads four times as many.
FIRST = 3
#: Components are clamped to this size, up to which doubles hold every integer.
LARGEST = 1 << 53


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as floor(scale * x); vectors that are null or hold null or non-finite ones are left out."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * c.cast("double"))))
    return ok.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def inner(size: int, largest: int):
    """The exact inner product of q and v: as long while it fits, else as decimal."""
    kind = "long" if size * largest * largest < 1 << 62 else "decimal(38,0)"
    return F.aggregate(F.zip_with("q", "v", lambda a, b: (a.cast(kind) * b.cast(kind)).cast(kind)), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))


def top_k(vectors: DataFrame, k: int = 10, *, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products of each query with all other vectors.

    Queries are the vectors whose id is divisible by `every`; as many as QUERY_COMPONENTS allows are broadcast for one
    scan of all cells. Of the candidates that a scan leaves, the best by upper bound are scored exactly, then those that
    the k-th exact score so far doesn't exclude, in growing rounds, until none is left. Scores are exact integers; ties
    go to the smaller id. Only vectors with as many components are compared. Rows that repeat an id with the same vector
    count once; with another vector they are candidates of their own, but a query never meets its own id. Vectors that
    are null or hold null or non-finite components take no part. Scaled components beyond 2^53 count as that; scores
    that exceed a long are ranked by their exact values and returned as the nearest long.
    """
    spark = vectors.sparkSession
    v = stash(integers(vectors, id_col, vector_col).dropDuplicates(["vec_id", "v"]))
    is_query = F.col("vec_id") % every == 0
    facts = v.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.max(F.size("v")), F.sum(F.when(is_query, F.size("v")))).first()
    low, high, size, asked = (x or 0 for x in facts)
    step = (high - low) // CELLS + 1

    def approximate(batches):
        for b in batches:
            ids, offsets, flat = arrays(b)
            cells = ((flat - low) // step).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cells[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], names=["vec_id", "cells"])

    cells = stash(v.mapInArrow(approximate, "vec_id long, cells binary"))
    scans = max(1, -(-asked // QUERY_COMPONENTS))
    path, kind = scratch(spark), "query_id long, vec_id long, upper double"
    spark.createDataFrame([], kind).write.parquet(path)
    for scan in range(scans):
        table = v.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(scans)) == scan)).toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast([x for batch in table.to_batches() for x in blocks(*arrays(batch))])
        cells.mapInArrow(lambda batches, shared=shared: bounds(batches, shared.value, low, step, k), kind).write.mode("append").parquet(path)
        shared.unpersist()
    # Ranks by upper bound order the reading; equal pairs are rows that repeat an id with several vectors.
    pairs = spark.read.schema(kind).parquet(path).groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper"))
    pairs = stash(pairs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id"))))
    queries = v.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = inner(size, max(abs(low), abs(high)))
    best, begin, width = None, 0, FIRST * k
    while True:
        part = pairs.where((F.col("n") > begin) & (F.col("n") <= begin + width))
        if best is not None:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("kth"))
            part = stash(part.join(kth, "query_id").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).drop("kth"))
            if part.isEmpty():
                break
        scored = part.join(v, "vec_id").join(queries, "query_id").where(F.size("q") == F.size("v")).select("query_id", "vec_id", score.alias("score"))
        both = scored if best is None else best.unionAll(scored)
        best = stash(both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).drop("rank"))
        begin, width = begin + width, 4 * width
    most = F.lit((1 << 63) - 1)
    clamped = F.greatest(-most, F.least(most, F.col("score"))).cast("long")
    return best.select("query_id", F.row_number().over(rank).alias("rank"), "vec_id", clamped.alias("score"))


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and all components of a batch of vectors without nulls."""
    ids, lists = batch.column(0), batch.column(1)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return ids.to_numpy(zero_copy_only=False), offsets - offsets[0], flat


def blocks(ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray):
    """Blocks of queries with as many components: ids and a matrix."""
    size = np.diff(offsets)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        for s in range(0, len(own), BLOCK):
            part = own[s : s + BLOCK]
            yield ids[part], flat[offsets[part][:, None] + np.arange(n)].astype(np.float64)


def bounds(batches, queries: list, low: int, step: int, k: int):
    """Candidates among approximated vectors: those whose upper bound reaches the k-th best lower bound seen so far.

    Within a cell a component lies in [corner, corner + step - 1], so the bounds of a query are a fixed width apart.
    """
    best = [np.full((len(ids), k), -np.inf) for ids, _ in queries]
    for batch in batches:
        ids, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        flat = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        size = np.diff(offsets)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            for s in range(0, len(own), ROWS):
                part = own[s : s + ROWS]
                grid = flat[offsets[part][:, None] + np.arange(n)].astype(np.float64)
                for b, (query_ids, q) in enumerate(queries):
                    if q.shape[1] != n:
                        continue
                    slack = 1e-9 * np.abs(q).sum(axis=1) * (abs(low) + 256.0 * step)  # beyond any rounding of the sums
                    lower = q @ grid.T * step + (low * q.sum(axis=1) + np.minimum(q, 0).sum(axis=1) * (step - 1) - slack)[:, None]
                    lower[query_ids[:, None] == ids[part][None, :]] = -np.inf
                    best[b] = np.sort(np.concatenate((best[b], np.partition(lower, max(0, len(part) - k), axis=1)[:, -k:]), axis=1), axis=1)[:, -k:]
                    upper = lower + (np.abs(q).sum(axis=1) * (step - 1) + 2 * slack)[:, None]
                    i, j = np.nonzero((upper >= best[b][:, :1]) & (lower > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[i], pa.int64()), pa.array(ids[part][j], pa.int64()), pa.array(upper[i, j])], names=["query_id", "vec_id", "upper"])
