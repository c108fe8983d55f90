"""Sharding against a direct minimax partition."""

import random
import zlib

from nebulark.llm.common import stash
from nebulark.llm.sharding import Prefixes, shard, written_order
from tests.llm import odd


def need(sizes, capacity):
    """Shards of a greedy fill; a group above the capacity stands alone."""
    n, fill = 1, 0
    for s in sizes:
        if fill and fill + s > capacity:
            n, fill = n + 1, 0
        fill += s
    return n


def test_capacity_is_the_smallest(spark):
    rng = random.Random(1)
    for n, shards in ((1, 3), (5, 3), (40, 7), (400, 24), (3000, 24)):
        sizes = [rng.choice([1, 9, 50, 4000 if rng.random() < 0.02 else 7]) + 8 for _ in range(n)]
        ends, total = [], 0
        for s in sizes:
            total += s
            ends.append((total,))
        p = Prefixes(spark.createDataFrame(ends, "end long"))
        got = p.capacity(shards)
        low, high = 1, total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if need(sizes, mid) <= shards else (mid + 1, high)
        assert got == low
        cuts = p.cuts(shards)
        assert len(cuts) == shards and cuts[-1] == total and cuts == sorted(cuts) and {(c,) for c in cuts} <= set(ends) | {(0,)}


def test_awkward_rows(spark):
    got = shard(odd.table(spark)).collect()
    assert len(got) == len(odd.rows())
    by_text, slots = {}, {}
    text_of = {r[0]: r[1] for r in odd.rows()}
    for r in got:
        text = text_of[r.doc_id] if r.doc_id is not None else odd.texts()[5]
        data = (text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        if text is not None:
            by_text.setdefault(text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert shard(odd.empty(spark)).count() == 0


def test_shards_are_near_equal(spark):
    rng = random.Random(5)
    rows = [(i, f"{i} " + "x" * rng.randint(1, 400)) for i in range(4000)] + [(10_000 + i, "hot copy " * 3) for i in range(1500)]
    sizes = {}
    for r in shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    rest = sorted(sizes.values())[:-1]  # the copies stand alone
    assert len(sizes) == 24 and max(rest) - min(rest) <= 900


def test_written_order(spark):
    """Rows keep the order of a sorted table, in contiguous shards of the smallest capacity."""
    rng = random.Random(6)
    rows = [(i, rng.random(), "x" * rng.choice([0, 5, 90, 400])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, at double, text string").repartition(7).orderBy("at")
    got = sorted(shard(written_order(stash(docs)), 7, order=("__file", "__row")).collect(), key=lambda r: (r.shard, r.slot))
    want = sorted(rows, key=lambda r: r[1])
    assert [r.doc_id for r in got] == [r[0] for r in want]
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(7)]
    least = next(c for c in range(sum(sizes) // 7, sum(sizes)) if need([len(t) + 8 for _, _, t in want], c) <= 7)
    assert max(sizes) <= least and [r.slot for r in got] == [k for n in range(7) for k in range(sum(r.shard == n for r in got))]


def test_equal_rows_spread(spark):
    rows = [(None, "same")] * 4000 + [(None, None)] * 500
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s in range(3) for k in range(sum(r.shard == s for r in got))) and len(got) == 4500
