"""Benchmark decontamination by an FM-index per training shard.

Test phrases (windows of benchmark words) are counted and located in every shard by backward search through the ranks
of a wavelet matrix; suffix positions are sampled; the word spans found are merged per document.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm.common import folded_words, kinds, slices, stash, text_key

#: Text bytes of benchmark items that are broadcast at once; a larger benchmark is searched in several passes.
BLOCK_BYTES = 8 << 20
#: Texts with hits that are broadcast to be merged, some tens of MB; beyond that a join shuffles.
BROADCAST_TEXTS = 50_000
#: Bytes of text whose words a task holds at a time; some 20 bytes of objects stand for each.
TEXT_BYTES = 2 << 20
#: Symbols of one FM-index.
SHARD_SYMBOLS = 1 << 19
#: Every so many suffix positions are kept.
SAMPLE = 8

SCHEMA = "n_words long, spans array<int>, items array<string>"


class FMIndex:
    """Over an array of integers: 0 is the sentinel, which must stand at the end alone."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        sa, self.n = suffix_array(text), n
        bwt = text[sa - 1]
        self.c = np.concatenate(([0], np.cumsum(np.bincount(text)))).astype(np.int64)
        self.bwt, self.levels = bwt, []
        seq = bwt
        for shift in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            bit = (seq >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32)
            self.levels.append((shift, n - int(ones[-1]), ones))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))
        self.sampled = np.where(sa % SAMPLE == 0, sa, -1)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i symbols of the transform, for arrays of both."""
        lo = np.zeros_like(i)
        for shift, zeros, ones in self.levels:
            bit = (c >> shift) & 1 == 1
            lo, i = np.where(bit, zeros + ones[lo], lo - ones[lo]), np.where(bit, zeros + ones[i], i - ones[i])
        return i - lo

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, which are right-aligned rows of a matrix."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (lo[live] < hi[live])]
            c = phrases[live, -back]
            known = c < len(self.c) - 1
            lo[live[~known]], hi[live[~known]] = 0, 0
            live, c = live[known], c[known]
            lo[live] = self.c[c] + self.rank(c, lo[live])
            hi[live] = self.c[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, live, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            at = self.sampled[rows[live]]
            out[live[at >= 0]] = at[at >= 0] + steps
            live, steps = live[at < 0], steps + 1
            c = self.bwt[rows[live]]
            rows[live] = self.c[c] + self.rank(c, rows[live])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    n, k, rank = len(text), 1, text.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (n + int(text.max()) + 2) + after
        sa = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate(([0], np.diff(key[sa]) != 0)))
        rank[sa] = new
        if new[-1] == n - 1:
            return sa
        k *= 2


def phrases_of(items: list[tuple[str, bytes]], window: int) -> dict:
    """Vocabulary, distinct phrases and their items, for one block of the benchmark."""
    vocab: dict[bytes, int] = {}
    phrases: dict[tuple, set] = {}
    for item, text in items:
        ids = tuple(vocab.setdefault(w, len(vocab) + 2) for w in folded_words(text))
        for i in range(max(1, len(ids) - window + 1)) if ids else ():
            phrases.setdefault(ids[i : i + window], set()).add(item)
    width = max(map(len, phrases), default=1)
    matrix = np.zeros((len(phrases), width), np.int64)
    for k, p in enumerate(phrases):
        matrix[k, width - len(p) :] = p
    owners = [sorted(x) for x in phrases.values()]
    lengths = np.array([len(p) for p in phrases], np.int64)
    return {"vocab": vocab, "matrix": matrix, "lengths": lengths, "owners": owners, "least": int(lengths.min(initial=window))}


def find(words: list[list[bytes]], block: dict) -> list[tuple[list[tuple[int, int]], set]]:
    """For each document the occurrences (start, end) of phrases and the items they belong to.

    Words that no phrase has can't be part of an occurrence: they end a run, and only runs as long as the shortest
    phrase enter the index.
    """
    found: list[tuple[list, set]] = [([], set()) for _ in words]
    if not len(block["matrix"]):
        return found
    get, zero, least = block["vocab"].get, repeat(0), block["least"]
    parts, origin, size = [], [], 0

    def flush():
        text = np.concatenate([*parts, np.zeros(1, np.int64)])
        fm = FMIndex(text)
        present = np.zeros(len(block["vocab"]) + 2, bool)
        present[text] = True  # 0, the padding of phrases, is the sentinel's number
        some = np.flatnonzero(present[block["matrix"]].all(axis=1))  # phrases of which every word is in this index
        lo, hi = fm.search(block["matrix"][some], block["lengths"][some])
        which = some[np.repeat(np.arange(len(lo)), hi - lo)]
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        at = fm.locate(rows)
        start = np.array([o[0] for o in origin])
        run = np.searchsorted(start, at, side="right") - 1
        for p, q, r in zip(which.tolist(), at.tolist(), run.tolist()):
            first, doc, offset = origin[r]
            spans, items = found[doc]
            spans.append((q - first + offset, q - first + offset + int(block["lengths"][p])))
            items.update(block["owners"][p])

    for doc, ws in enumerate(words):
        if len(ws) < least:
            continue
        ids = np.fromiter(map(get, ws, zero), np.int64, len(ws))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0]))))
        for s, e in edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= least]:
            parts += [ids[s:e], np.ones(1, np.int64)]
            origin.append((size, doc, int(s)))
            size += int(e - s) + 1
        if size >= SHARD_SYMBOLS:
            flush()
            parts, origin, size = [], [], 0
    if parts:
        flush()
    return found


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Start and end, alternating, of the union of spans."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int):
    items, size = [], 0
    rows = benchmark.select(benchmark[id_col].cast("string"), benchmark[text_col].cast("binary"))
    for item, text in rows.toLocalIterator():
        if item is None or text is None:
            continue
        items.append((item, bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield phrases_of(items, window)
            items, size = [], 0
    yield phrases_of(items, window)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (start and end word of hit runs, alternating) and items (ids, sorted as strings).

    Each batch of a partition is a shard with an index of its own. A benchmark of up to block_bytes is broadcast and
    found in one pass without a shuffle. A larger one is searched block by block: each pass writes what it finds in
    texts that have hits, and its broadcast is released before the next; what was found is then merged by text. Null
    texts have no words; items without id or text, or without words, take no part; repeated rows are judged alike;
    columns of docs stay, in front, and those named as the result are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    docs, at = docs.select(*keep), keep.index(text_col)
    found, block = None, None
    for block, last in with_last(blocks_of(benchmark, item_id, item_text, window, block_bytes)):
        if last and found is None:
            return docs.mapInArrow(search(spark.sparkContext.broadcast(block), at, keep), f"{kinds(docs, keep)}, {SCHEMA}")
        shared = spark.sparkContext.broadcast(block)
        hits = docs.select(F.col(text_col).alias("text")).mapInArrow(search(shared, 0, ["text"]), f"text string, {SCHEMA}").where(F.size("spans") > 0)
        part = stash(hits.select(text_key().alias("__key"), "spans", "items").dropDuplicates(["__key"]))
        shared.unpersist()
        found = part if found is None else found.unionAll(part)
    # A text has one row a block in which it has hits.
    found = stash(found.groupBy("__key").agg(F.collect_list("spans").alias("__spans"), F.collect_list("items").alias("__items")))
    few = found.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    joined = docs.join(F.broadcast(found) if few else found, text_key(text_col).eqNullSafe(F.col("__key")), "left").select(*(docs[c] for c in keep), "__spans", "__items")

    def merge(batches):
        for batch in slices(batches, at, TEXT_BYTES):
            words = [len(folded_words(x)) if x else 0 for x in batch.column(at).cast(pa.binary()).to_pylist()]
            spans = [merged([x for one in of or () for x in zip(one[::2], one[1::2])]) for of in batch.column(len(keep)).to_pylist()]
            items = [sorted(set().union(*(of or ()))) for of in batch.column(len(keep) + 1).to_pylist()]
            yield result(batch, keep, words, spans, items)

    return joined.mapInArrow(merge, f"{kinds(docs, keep)}, {SCHEMA}")


def with_last(blocks):
    """Each block, and whether it is the last."""
    blocks = iter(blocks)
    one = next(blocks)
    for following in blocks:
        yield one, False
        one = following
    yield one, True


def search(shared, at: int, keep: list[str]):
    """A function for mapInArrow that finds a broadcast block's phrases in the texts of column `at`."""

    def scan(batches):
        for batch in slices(batches, at, TEXT_BYTES):
            words = [folded_words(x) if x else [] for x in batch.column(at).cast(pa.binary()).to_pylist()]
            found = find(words, shared.value)
            yield result(batch, keep, map(len, words), [merged(x) for x, _ in found], [sorted(x) for _, x in found])

    return scan


def result(batch: pa.RecordBatch, keep: list[str], words, spans: list, items: list) -> pa.RecordBatch:
    made = [pa.array(words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + made, names=[*keep, "n_words", "spans", "items"])
