"""Sharding by a minimax contiguous partition.

Groups of equal texts are atomic. In the order of their keys they have sizes s1, s2, ...; the smallest capacity with
which a greedy fill needs no more than the wanted shards is found by binary search, and the order is cut there.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm.common import kinds, stash, text_key

#: Segments of the prefix sums that the driver holds at first, and those into which one is split where a cut may fall.
SEGMENTS, SPLIT = 1 << 15, 256


class Prefixes:
    """Prefix sums at the ends of groups, known to the driver by segments only, which are split where needed.

    A segment is (least end, greatest end); the ends lie in the column `end` of a table.
    """

    def __init__(self, ends: DataFrame):
        self.ends = ends
        self.total = ends.agg(F.max("end")).first()[0] or 0
        self.segments = self.summary([(0, self.total)], SEGMENTS)

    def summary(self, ranges: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
        """Segments of the ends in some ranges (from beyond the first number to the second), by one job."""
        width = [max(1, -(-(high - low) // parts)) for low, high in ranges]
        end = F.col("end")
        within = [(end > low) & (end <= high) for low, high in ranges]
        which = F.coalesce(*(F.when(x, F.lit(k)) for k, x in enumerate(within)))
        at = F.coalesce(*(F.when(x, F.floor((end - low - 1) / w)) for x, (low, _), w in zip(within, ranges, width)))
        rows = self.ends.where(reduce(lambda a, b: a | b, within)).groupBy(which.alias("which"), at.alias("at")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()
        return sorted((r.a, r.b) for r in rows)

    def split(self, unsure: set[tuple[int, int]]) -> None:
        """Split some segments, all by one job."""
        if unsure:
            parts = self.summary([(a - 1, b) for a, b in sorted(unsure)], SPLIT)
            self.segments = sorted([x for x in self.segments if x not in unsure] + parts)
        self.lows, self.highs = [a for a, _ in self.segments], [b for _, b in self.segments]

    def floor(self, x: int) -> tuple[int, int, tuple | None]:
        """Bounds of the greatest end up to x, and the segment that must be split to know it."""
        k = bisect_right(self.lows, x) - 1
        if k < 0:
            return 0, 0, None
        a, b = self.segments[k]
        return (b, b, None) if x >= b else (a, min(x, b - 1), (a, b)) if b - a > 1 else (a, a, None)

    def next(self, x: int) -> tuple[int, int, tuple | None]:
        """Bounds of the least end beyond x, likewise."""
        k = bisect_right(self.highs, x)
        if k == len(self.segments):
            return self.total, self.total, None
        a, b = self.segments[k]
        return (a, a, None) if a > x else (x + 1, b, (a, b)) if b - a > 1 else (b, b, None)

    def shards(self, capacity: int, most: int, start: int = 0, high: bool = False) -> tuple[int, set]:
        """Shards that a greedy fill from start needs, by the lower or upper bounds; a group above the capacity stands alone."""
        unsure, at, n, side = set(), start, 0, int(high)
        while at < self.total and n <= most:
            to = self.floor(at + capacity)
            unsure.add(to[2])
            if to[side] <= at:
                to = self.next(at)
                unsure.add(to[2])
            at, n = to[side], n + 1
        return n, unsure - {None}

    def exact(self, ask, x: int) -> int:
        while True:
            low, high, segment = ask(x)
            if segment is None:
                return low
            self.split({segment})

    def capacity(self, shards: int) -> int:
        """The smallest capacity with which the greedy fill needs no more shards."""
        self.split(set())
        low, high = 1, max(1, self.total)
        while low < high:
            bounds = []
            for upper in (True, False):  # no capacity below the first suffices, the second does for sure
                a, b = low, high
                while a < b:
                    mid = (a + b) // 2
                    a, b = (a, mid) if self.shards(mid, shards, high=upper)[0] <= shards else (mid + 1, b)
                bounds.append(a)
            low, high = bounds
            if low == high:
                break
            unsure = set().union(*(self.shards(c, shards, high=upper)[1] for c in (low, high - 1) for upper in (True, False)))
            if not unsure:  # exact for both: bisect between them
                mid = (low + high) // 2
                low, high = (low, mid) if self.shards(mid, shards)[0] <= shards else (mid + 1, high)
            else:
                self.split(unsure)
        return low

    def cuts(self, shards: int, alone: int = 0, barrier: int | None = None) -> list[int]:
        """The end of each shard; within the capacity, each takes its part of what is left as nearly as it can.

        From the prefix sum `barrier` on there are `alone` large groups, which count as a shard each.
        """
        capacity, at, out = self.capacity(shards), 0, []
        barrier = self.total if barrier is None else barrier
        for left in range(shards, 0, -1):
            part = (barrier - at) / max(1, left - alone) if at < barrier else (self.total - at) / left
            goal = at + min(capacity, part)
            first = self.exact(self.floor, int(goal))
            choice = sorted({first, self.exact(self.next, max(first, at))}, key=lambda e: abs(e - goal))
            full = max(self.exact(self.floor, at + capacity), at) if at < self.total else at
            full = self.exact(self.next, at) if full <= at else full
            at = next((e for e in choice if at < e <= max(full, at) and self.fits(capacity, left - 1, e)), full)
            out.append(at)
        return out

    def fits(self, capacity: int, shards: int, start: int) -> bool:
        while True:
            sure, unsure = self.shards(capacity, shards, start)
            hope, more = self.shards(capacity, shards, start, True)
            if sure <= shards or hope > shards:
                return sure <= shards
            self.split(unsure | more)


def written_order(docs: DataFrame) -> DataFrame:
    """docs, just read from the files of one written table, with __file and __row, by which its rows stand as written.

    A task writes its rows in order to a file of its own, whose name starts with the task's number, and a sort numbers
    the tasks in its order.
    """
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return docs.select("*", F.coalesce(number, F.lit(0)).alias("__file"), F.col("_metadata.row_index").alias("__row"))


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", order: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: its id, size, text_crc32, shard (0 to shards - 1) and slot in the shard (gapless from 0).

    Size: UTF-8 bytes plus 8; the sizes of the shards are as near equal as whole groups allow. Without `order` groups are
    equal texts, put in order of (hash of the text, id), groups above their share at the end. With columns `order`, by
    which no two rows are equal, each row is a group, and shards and slots follow that order. Rows are sorted by a range
    partition; tasks add up their own rows, and one sum a task gives the prefix sums. The driver sees a bounded summary of
    them. Null texts have no bytes, each id a group of its own; repeated rows are kept, and spread over tasks; an empty
    table gives no rows; fewer groups than shards leave shards empty.
    """
    null_text = F.md5(F.concat(F.lit("null:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    key = F.struct(*order) if order else F.coalesce(text_key(text_col), null_text)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    spread = (F.rand(1) * (1 << 16)).cast("int")  # of rows equal in key and id
    rows = stash(docs.select(F.col(id_col).alias("id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("crc"), key.alias("key"), spread.alias("spread")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large, left = [], total
    if not order:  # groups larger than their share come last, so that the others divide evenly
        for k, n in rows.groupBy("key").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "key").limit(shards - 1).collect():
            if n * (shards - len(large)) <= left:
                break
            large.append(k)
            left -= n
        rows = rows.withColumn("key", F.when(F.col("key").isin(large), F.concat(F.lit("~"), "key")).otherwise(F.col("key")))

    def running(frames):
        task, n, end = TaskContext.get().partitionId(), 0, 0
        for x in frames:
            sums = x["size"].to_numpy(np.int64).cumsum() + end
            yield x.assign(task=task, rank=np.arange(n, n + len(x)), end=sums)
            n, end = n + len(x), int(sums[-1]) if len(x) else end

    by = ["key", "id", "size", "spread"]
    group = F.col("key").cast("string").alias("key") if order else F.col("key")
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("id", "size", "crc", group)
    placed = stash(sorted_rows.mapInPandas(running, f"{kinds(sorted_rows, sorted_rows.columns)}, task int, rank long, end long"))
    tasks = placed.groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).toPandas().sort_values("task")
    base = pd.DataFrame({"task": tasks["task"], "rank0": tasks["n"].cumsum() - tasks["n"], "end0": tasks["bytes"].cumsum() - tasks["bytes"]})
    spark = docs.sparkSession
    offsets = spark.createDataFrame(base, "task int, rank0 long, end0 long") if len(base) else spark.createDataFrame([], "task int, rank0 long, end0 long")
    placed = placed.join(F.broadcast(offsets), "task").select("id", "size", "crc", "key", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("end") + F.col("end0")).alias("end"))
    ends = stash(placed.groupBy("key").agg(F.max("end").alias("end"), (F.max("rank") + 1).alias("rows")).select("end", "rows"))
    cuts = Prefixes(ends).cuts(shards, len(large), left)
    rank_at = {0: 0} | {r.end: r.rows for r in ends.where(F.col("end").isin(cuts)).collect()}
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("end") > c).cast("int")
    starts = F.array(*(F.lit(rank_at.get(c, 0)).cast("long") for c in [0, *cuts[:-1]]))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), number.alias("shard"), (F.col("rank") - F.element_at(starts, number + 1)).alias("slot"))
