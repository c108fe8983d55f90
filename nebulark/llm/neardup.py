"""Near-duplicate detection with BagMinHash.

A document is a multiset of word shingles. For each shingle and each interval of weights (0, 1], (1, 2], (2, 4], ...
a Poisson process, seeded by both, throws points at random times, weights and signature components; points above the
shingle's count don't count. A component keeps its earliest point, so two documents agree in one with the probability
of their weighted Jaccard similarity. Signatures are cut into bands; what shares a band is verified on the multisets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nebulark.llm.common import slices, stash, text_key
from nebulark.llm.substrings import Names, U, mix, window_prints

#: Bands and components of each: a pair at similarity 0.8 shares a band but for 3 in a million.
BANDS, ROWS = 32, 5
#: Pairs are verified if at least this part of the components agrees, nearly 5 standard deviations below 0.8.
HOPE = 0.65
#: Nodes of a bucket up to which all of its components are compared node by node.
SMALL = 32
#: Nodes of a block of a larger bucket, about, and shingles of which their counts are compared at a time.
BLOCK, COLUMNS = 256, 4096
#: Pairs of signatures that are compared at a time.
PAIRS = 1 << 15
#: Bytes of text that a task turns into shingles at a time; some 40 bytes of arrays stand for each.
TEXT_BYTES = 1 << 20
#: Rows of a table of two ids that are broadcast, about 3 MB; beyond that joins shuffle.
BROADCAST_ROWS = 200_000

ODD = U(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes], size: int, names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: number of the text, fingerprint, count. Texts with fewer words are one shingle."""
    words = [x.split() for x in texts]
    count = np.array([len(w) for w in words], np.int64)
    offset = np.cumsum(count) - count
    flat = names.of([x for w in words for x in w])
    n = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + offset[doc]
    prints = window_prints(flat, size)[at] if len(doc) else np.zeros(0, U)
    short = [d for d, c in enumerate(count.tolist()) if 0 < c < size]
    if short:
        fold = [reduce(lambda a, b: mix(a * ODD + b), np.split(flat[offset[d] : offset[d] + count[d]], count[d]), count[d : d + 1].astype(U)) for d in short]
        doc, prints = np.concatenate((doc, short)), np.concatenate((prints, *fold))
    _, first, weight = np.unique(prints ^ mix(doc.astype(U) + U(1 << 32)), return_index=True, return_counts=True)
    return doc[first], prints[first], weight


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit numbers."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, prints: np.ndarray, weight: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """A row of `size` 64-bit signature components for each document (zeros for one without shingles)."""
    low, high, part = [0], [1], [np.arange(len(doc))]
    while len(more := np.flatnonzero(weight > high[-1])):
        low.append(high[-1])
        high.append(2 * high[-1])
        part.append(more)
    own = np.concatenate(part)
    lo = np.repeat(np.array(low), [len(x) for x in part])
    length = np.repeat(np.array(high) - np.array(low), [len(x) for x in part])
    total = np.zeros(n_docs)
    np.add.at(total, doc, weight)
    least = np.full(n_docs * size, np.inf)
    seed, of, top, time, step = mix(prints[own] + lo.astype(U) * ODD), doc[own], weight[own] - lo, np.zeros(len(own)), np.zeros(len(own), U)
    time -= np.log(uniform(mix(seed))) / length
    limit = size * (np.log(size) + 1) / np.maximum(total, 1)
    active = np.arange(len(own))
    while len(active):
        now = active[time[active] <= limit[of[active]]]
        while len(now):
            r = mix(seed[now] + step[now] * ODD + U(1))
            component, level = (r & U(0xFFFFFFFF)) % U(size), (r >> U(32)) % length[now].astype(U)
            hit = level < top[now].astype(U)
            np.minimum.at(least, of[now[hit]] * size + component[hit].astype(np.int64), time[now[hit]])
            step[now] += U(1)
            time[now] -= np.log(uniform(mix(seed[now] + step[now] * ODD))) / length[now]
            now = now[time[now] <= limit[of[now]]]
        open_docs = np.isinf(least.reshape(n_docs, size)).any(axis=1)
        active = active[open_docs[of[active]]]
        limit = np.where(open_docs, limit * 1.5, limit)
    least[np.isinf(least)] = 0
    return mix(least.view(U)).reshape(n_docs, size)


def signature_table(texts: DataFrame, shingle: int) -> DataFrame:
    """node, t, sig (a byte a component) and bands (64-bit keys) of each text with words. texts: node, text, t."""

    def scan(batches):
        names = Names()
        for batch in slices(batches, 1, TEXT_BYTES):
            data = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            doc, prints, weight = shingles(data, shingle, names)
            some = np.unique(doc)
            sig = signatures(doc, prints, weight, len(data), BANDS * ROWS)[some]
            keys = np.zeros((len(some), BANDS), U)
            for band in range(BANDS):
                key = np.full(len(some), mix(np.array([band], U) + U(7))[0])
                for row in range(ROWS):
                    key = mix(key * ODD + sig[:, band * ROWS + row])
                keys[:, band] = key
            low = (sig & U(255)).astype(np.uint8)
            bands = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel().view(np.int64)))
            take = pa.array(some)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array([x.tobytes() for x in low], pa.binary()), bands], names=["node", "t", "sig", "bands"])

    return texts.select("node", "text", "t").mapInArrow(scan, "node long, t long, sig binary, bands array<long>")


def promising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures, bytes a component: which share a band and agree in enough components, and how far they agree."""
    agree = x == y
    guess = (agree.mean(axis=1) - 1 / 256) / (1 - 1 / 256)
    return (guess >= HOPE) & agree.reshape(-1, BANDS, ROWS).all(axis=2).any(axis=1), guess


def hopeful(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs (a, b) with guess, the part of agreeing components; only those worth verifying."""
    joined = pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")

    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in (2, 3))
            good, guess = promising(x, y)
            yes = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(yes), batch.column(1).take(yes), pa.array(guess).take(yes)], names=["a", "b", "guess"])

    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, guess double")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """pairs (a, b) with similarity, the weighted Jaccard similarity of the shingles of both texts."""
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else (lambda x: x)
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y")).join(hint(pairs.select("a", "b")), "b")
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x")).join(hint(pairs.select("a").distinct()), "a")

    def compare(batches):
        names = Names()
        for batch in slices(batches, 3, TEXT_BYTES // 2):
            a, b = ([t or b"" for t in batch.column(k).cast(pa.binary()).to_pylist()] for k in (2, 3))
            doc, prints, weight = shingles(a + b, shingle, names)
            pair = doc % len(a)
            total = np.bincount(pair, weight, len(a))
            key = prints ^ mix(pair.astype(U) + U(1 << 33))  # equal for equal shingles of one pair's texts
            order = np.argsort(key, kind="stable")
            twice = np.flatnonzero(key[order][1:] == key[order][:-1])
            common = np.bincount(pair[order][twice], np.minimum(weight[order][twice], weight[order][twice + 1]), len(a))
            both = np.maximum(total - common, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common / both)], names=["a", "b", "similarity"])

    return right.join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, similarity double")


def repeats(doc: np.ndarray, prints: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with the k-th repeat of one in a text as one of its own, so that common ones add up to multiset overlap."""
    doc, prints = np.repeat(doc, weight), np.repeat(prints, weight)
    return doc, prints ^ mix((np.arange(len(doc)) - np.repeat(np.cumsum(weight) - weight, weight)).astype(U) + U(1 << 34))


def still_apart(members: DataFrame) -> DataFrame:
    """Of members (key, node, root), the keys that hold several components."""
    return stash(members.join(members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key"), "key"))


def dealt_buckets(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components in buckets of up to SMALL nodes, and the members of larger buckets.

    All nodes outside a bucket's largest component meet those of others; of two outside, once is enough.
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    facts = stash(sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), (F.sum("n") <= SMALL).alias("small")))
    outside = members.join(facts.where("small"), "key").where("root <> largest").select("key", "largest", F.col("node").alias("p"), F.col("root").alias("pr"))
    met = members.join(outside, "key").where("root <> pr AND (root = largest OR p < node)")
    return met.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct(), members.join(facts.where("NOT small").select("key"), "key")


def linked_blocks(members: DataFrame, texts: DataFrame, sigs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Links (a, b, similarity) between nodes of different components in large buckets. members: key, node, root.

    Buckets that share nodes form a cluster; its largest component and the rest are dealt into blocks of nodes by hash.
    Every block of the rest meets every other block once, in a task of its own that holds two blocks of texts and
    compares them exactly, so nothing is a row for a pair of nodes; blocks of the largest component needn't meet. As
    everywhere, only pairs that share a band and agree in enough components are links. A task returns one link for each
    two components that it joins.
    """
    lead = members.groupBy("key").agg(F.min("node").alias("a"))
    edges = members.join(lead, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    own = members.select("node", "root").distinct().join(components(edges).withColumnRenamed("root", "cluster"), "node")
    sizes = own.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    own = stash(own.join(main, "cluster").withColumns({"inner": F.col("root") == F.col("main"), "bi": F.ceil(F.col("n_main") / BLOCK), "bo": F.ceil((F.col("n") - F.col("n_main")) / BLOCK)}))
    # Blocks are numbered 0 to bo - 1 for the rest, bo and up for the largest component.
    block = F.when(F.col("inner"), F.col("bo") + F.pmod(F.xxhash64("node"), F.col("bi"))).otherwise(F.pmod(F.xxhash64("node"), F.greatest(F.col("bo"), F.lit(1))))
    own = own.where("bo > 0").withColumn("block", block)
    partners = F.when(F.col("inner"), F.sequence(F.lit(0), F.col("bo") - 1)).otherwise(F.sequence(F.lit(0), F.col("bo") + F.col("bi") - 1))
    dealt = own.select("cluster", "node", "root", "block", F.explode(partners).alias("other"))
    dealt = dealt.select("cluster", "node", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    involved = texts.join(F.broadcast(own.select("node")) if few else own.select("node"), "node", "left_semi")
    signed = stash(involved.join(sigs.select("node", "t", "sig"), ["node", "t"]).dropDuplicates(["node", "t"]))
    shipped = signed.join(dealt, "node").select("cluster", "x", "y", "block", "node", "root", "text", "sig")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        roots, nodes, first = frame["root"].to_numpy(), frame["node"].to_numpy(), (frame["block"] == frame["x"]).to_numpy()
        doc, prints, weight = shingles([t.encode() for t in frame["text"]], shingle, Names())
        total = np.bincount(doc, weight, len(frame))
        doc, prints = repeats(doc, prints, weight)
        _, column, n = np.unique(prints, return_inverse=True, return_counts=True)
        doc, column = doc[n[column] > 1], column[n[column] > 1]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        common = np.zeros((len(frame), len(frame)), np.float32)
        for c in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            s, e = np.searchsorted(column, (c, c + COLUMNS))
            part = np.zeros((len(frame), COLUMNS), np.float32)
            part[doc[s:e], column[s:e] - c] = 1
            common += part @ part.T
        similar = common >= threshold * (total[:, None] + total[None, :] - common) - 1e-6
        side = np.ones_like(similar) if (frame["x"] == frame["y"]).all() else first[:, None] != first[None, :]
        a, b = np.nonzero(np.triu(similar & side & (roots[:, None] != roots[None, :]) & (total > 0)[:, None], 1))
        exact = common[a, b] / (total[a] + total[b] - common[a, b])
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint8).reshape(-1, BANDS * ROWS)
        yes = np.concatenate([np.zeros(0, bool)] + [promising(sig[a[s : s + PAIRS]], sig[b[s : s + PAIRS]])[0] for s in range(0, len(a), PAIRS)]) & (exact >= threshold)
        links = pd.DataFrame({"a": nodes[a], "b": nodes[b], "similarity": exact.astype(float), "p": np.minimum(roots[a], roots[b]), "q": np.maximum(roots[a], roots[b])})[yes]
        return links.sort_values("similarity", ascending=False).drop_duplicates(["p", "q"])[["a", "b", "similarity"]]

    found = shipped.groupBy("cluster", "x", "y").applyInPandas(compare, "a long, b long, similarity double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for all nodes of edges (a, b).

    Each round hooks a node to its least neighbour below it and shortens the chains; then edges join roots only.
    """
    edges, known = edges.select("a", "b"), None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
        while True:
            further = up.alias("u").join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            further = stash(further)
            up = further.select("node", "root")
            if further.where("moved").isEmpty():
                break
        known = up if known is None else stash(known.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        name = lambda c: up.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        edges = stash(edges.join(name("a"), "a").join(name("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if edges.isEmpty():
            return known


def classes(docs: DataFrame, threshold: float = 0.8, *, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, class_id (the least id of its class), copy_of (the least id with an equal text), near_id and similarity.

    Classes are the connected parts under verified similarity of at least `threshold`, between texts that share a band
    and agree in enough components (see HOPE); one rule, whatever else a bucket holds. Equal texts go on as one node.
    Each node is first compared with the least node of each of its buckets, and one such pair verified, the most
    hopeful; that joins even a large group of near copies with one pair a node. In buckets that then still hold several
    components, all nodes but those of the bucket's largest one are compared with all of other components: pair by pair
    in buckets of up to SMALL nodes, in blocks of texts beyond that (see linked_blocks), which is only a matter of how
    they meet. near_id is the most similar document of a verified pair
    with the document or its equal text (copy_of itself for a copy), similarity how similar; null if there is none.
    Rows that share an id share a class. Null ids have no class; null texts are classes of their own; texts without words
    are near only to equal ones; an empty table gives no rows.
    """
    rows = stash(docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key")))
    reps = rows.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"))
    placed = stash(rows.join(reps, "key", "left").select("id", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")))
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t")).where("node IS NOT NULL AND text IS NOT NULL")
    sigs = stash(signature_table(texts, shingle).join(placed.select(F.col("rep").alias("node")).distinct(), "node", "left_semi"))
    banded = sigs.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot < most").drop("most")
    members = stash(banded.join(buckets, "key"))
    stars = members.where("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = hopeful(stars, sigs).groupBy("b").agg(F.max_by("a", F.struct("guess", "a")).alias("a"))
    tried = stash(verify(stash(first.select("a", "b")), texts, shingle).groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    links = tried.where(F.col("similarity") >= threshold)
    roots = components(links)

    apart = still_apart(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    pairs, large = dealt_buckets(apart)
    large = stash(large)
    blocks = None if large.isEmpty() else linked_blocks(large, texts, sigs, threshold, shingle)
    pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = verify(stash(hopeful(pairs, sigs).select("a", "b").distinct()), texts, shingle).where(F.col("similarity") >= threshold)
    more = stash(more if blocks is None else more.unionAll(blocks))
    if not more.isEmpty():
        links = links.unionAll(more)
        roots = components(links.select("a", "b").distinct())
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("near"), "similarity").unionAll(links.select("b", "a", "similarity"))
    nearest = both.groupBy("rep").agg(F.max_by("near", F.struct("similarity", -F.col("near"))).alias("near"), F.max("similarity").alias("similarity"))
    out = placed.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(nearest, "rep", "left")
    copy = F.col("id") != F.col("rep")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("root", "rep").alias("class_id"),
        F.col("rep").alias("copy_of"),
        F.when(copy, F.col("rep")).otherwise(F.col("near")).alias("near_id"),
        F.when(copy, 1.0).otherwise(F.col("similarity")).alias("similarity"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that have the least id of their class; of rows that repeat it, one with the least text.

    Rows with a null id stay. Ids to drop are broadcast only while they are few; else they meet the rows in a shuffle.
    """
    found = stash(classes(docs, threshold, id_col=id_col, text_col=text_col))
    gone = stash(found.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("__id")).distinct())
    twice = stash(found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).count().where("count > 1").select("__id"))
    hint = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    on = lambda ids: F.col(id_col).cast("long") == ids["__id"]
    kept = docs.join(hint(gone), on(gone), "left_anti")
    if twice.isEmpty():
        return kept
    order = Window.partitionBy(id_col).orderBy(text_col, F.xxhash64(*docs.columns))
    single = kept.join(hint(twice), on(twice), "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return kept.join(hint(twice), on(twice), "left_anti").unionByName(single)
