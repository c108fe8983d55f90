"""Alignment of two tokenizers by elementary intervals.

The ends of both tokenizers' tokens cut a text into intervals, each owned by one token of either side; ends that both
share close groups, and the product of a group's tokens links them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm.common import kinds, slices, stash

#: Bytes of text that are split at once, and characters of new words that are encoded at once.
TEXT_BYTES, PIECE = 2 << 20, 1 << 16
#: Words whose tokens a task remembers at a time, beside those of the texts at hand.
REMEMBERED = 400_000
#: Links that are held at once.
LINKS = 1 << 20
#: Products beyond this are made from the distinct tokens of a group and their numbers.
LARGE_GROUP = 1 << 10
#: Pairs of ids whose counts are broadcast, 17 bytes each; beyond that links are joined with counts by a shuffle.
BROADCAST_PAIRS = 4 << 20
#: A space at which a text can be cut without changing any token, if no token of either side goes on from another character
#: to a space.
CUT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary(NamedTuple):
    """A tokenizer's file, read on the driver, so that tasks need no path."""

    kind: str
    data: bytes


def byte_level(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary("byte_level", f.read())


def pieces(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary("pieces", f.read())


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """An opened tokenizer: encode() for texts that start with a space, and the bytes of each token."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.kind == "byte_level":
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(vocabulary.data.decode())
            model.encode_special_tokens = True
            alphabet = byte_alphabet()
            entries = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
            self.bytes = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
            self.encode = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.data)
            entries = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(e[3:5], 16)]) if model.is_byte(i) else e.replace("▁", " ").encode() for i, e in enumerate(entries)]
            self.encode = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)  # it adds the space itself
        self.cuts = not any(re.search(r"\S ", x.decode("utf-8", "replace")) for x in self.bytes)
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def spells(self, ids: list[int], text: str) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == text.encode()


class Encoder:
    """Both tokenizers' ids and groups of texts, by their words: where texts can be cut, a word's tokens are the same in
    every text, and its end is an end of both sides. New words are encoded together, as one text.

    Words are numbered; what is known of them stands in four arrays (ids of either side, tokens of either side in each
    group), one word after another.
    """

    def __init__(self, one: Side, two: Side):
        self.sides = one, two
        self.cuts = one.cuts and two.cuts
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in range(4)]
        self.starts = [np.zeros(1, np.int64) for _ in range(4)]
        self.spelled = np.zeros(0, bool)

    def aligned(self, words: list[str]) -> list[tuple]:
        """The four arrays of some words, and where each word's part of them ends, in pieces; None for words that either side doesn't spell."""
        text = "".join(" " + w for w in words)
        ids = [np.array(side.encode([text])[0], np.int64) for side in self.sides]
        if all(side.spells(x.tolist(), text) for side, x in zip(self.sides, ids)):
            ends = [np.cumsum(side.length[x]) for side, x in zip(self.sides, ids)]
            cuts, *sizes = groups(*ends)
            stops = np.cumsum([len(w.encode()) + 1 for w in words])
            if (cuts[np.searchsorted(cuts, stops)] == stops).all():
                at = [np.searchsorted(x, stops) + 1 for x in (*ends, cuts)]
                return [(words, (*ids, *sizes), (*at, at[2]))]
        return [(words, None, None)] if len(words) == 1 else [x for w in words for x in self.aligned([w])]

    def learn(self, words: set[str]) -> None:
        """Number new words, about PIECE characters of them at a time; those with white space at an end stand alone."""
        parts, waiting, held = [], [], 0
        for word in words:
            if word in self.seen:
                continue
            if not self.cuts or word.strip() != word or not word:
                parts += self.aligned([word])
                continue
            waiting.append(word)
            held += len(word)
            if held > PIECE:
                parts += self.aligned(waiting)
                waiting, held = [], 0
        if waiting:
            parts += self.aligned(waiting)
        for own, arrays, _ in parts:
            self.seen |= zip(own, range(len(self.seen), len(self.seen) + len(own)))
        none = np.zeros(0, np.int32)
        self.spelled = np.concatenate([self.spelled, *(np.full(len(own), arrays is not None) for own, arrays, _ in parts)])
        for k in range(4):
            base, starts = len(self.flat[k]), [self.starts[k]]
            for own, arrays, ends in parts:
                starts.append(base + ends[k] if arrays else np.full(len(own), base))
                base += len(arrays[k]) if arrays else 0
            self.flat[k] = np.concatenate([self.flat[k], *(arrays[k].astype(np.int32) if arrays else none for _, arrays, _ in parts)])
            self.starts[k] = np.concatenate(starts)

    def tokens(self, texts: list[str]) -> list[list | None]:
        """Of each text, with a space before it, its four arrays; None where either side doesn't spell it."""
        split = [CUT.split(t) if self.cuts else [t] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.forget()
        self.learn({w for words in split for w in words})
        at = np.cumsum([0, *map(len, split)])
        word = np.fromiter((k for words in split for k in map(self.seen.__getitem__, words)), np.int64, int(at[-1]))
        whole = np.minimum.reduceat(self.spelled[word], at[:-1]) if len(texts) else []
        columns = []
        for flat, starts in zip(self.flat, self.starts):
            n = starts[word + 1] - starts[word]
            done = np.concatenate(([0], np.cumsum(n)))
            columns.append((flat[np.repeat(starts[word] - done[:-1], n) + np.arange(done[-1])], done[at].tolist()))
        return [[x[ends[k] : ends[k + 1]] for x, ends in columns] if whole[k] else None for k in range(len(texts))]


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shared ends, which close groups, and the tokens of either side in each group, from the ascending ends of both
    sides' tokens, which have the same last end."""
    ends = np.union1d(ends_a, ends_b)  # an elementary interval ends at each
    is_a = ends_a[np.searchsorted(ends_a, ends)] == ends  # its owner ends with it
    is_b = ends_b[np.searchsorted(ends_b, ends)] == ends
    closes = is_a & is_b
    group = np.cumsum(closes) - closes
    n = int(closes.sum())
    return ends[closes], np.bincount(group[is_a], minlength=n), np.bincount(group[is_b], minlength=n)


def products(group_a, a, weight_a, group_b, b, weight_b, n: int):
    """(group, id a, id b, number of links) of every pair within groups, about LINKS at a time; both sides sorted by group."""
    size = np.bincount(group_b, minlength=n)
    first = np.cumsum(size) - size
    times = size[group_a]
    done = np.cumsum(times)
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + LINKS, "right")))
        t = times[start:stop]
        own = np.repeat(np.arange(start, stop), t)
        other = first[group_a[own]] + np.arange(len(own)) - np.repeat(np.cumsum(t) - t, t)
        yield group_a[own], a[own], b[other], weight_a[own] * weight_b[other]
        start = stop


def links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
    """(group, id a, id b, number of links); a pair comes several times in a small group, once in a large one."""
    n = len(size_a)
    alone = (size_a == 1) & (size_b == 1)
    at = np.flatnonzero(alone)
    if len(at):
        yield at, a[(np.cumsum(size_a) - 1)[at]], b[(np.cumsum(size_b) - 1)[at]], np.ones(len(at), np.int64)
    large = size_a * size_b > LARGE_GROUP
    sides = []
    for ids, size in ((a, size_a), (b, size_b)):
        group = np.repeat(np.arange(n), size)
        big, few = large[group], ~(large | alone)[group]
        base = int(ids.max(initial=0)) + 1
        key, count = np.unique(group[big] * base + ids[big], return_counts=True)
        sides.append(((group[few], ids[few], np.ones(int(few.sum()), np.int64)), (key // base, key % base, count)))
    for k in range(2):
        yield from products(*sides[0][k], *sides[1][k], n)


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, each as wide as the largest needs, after a byte with the width."""
    width = 1 if (most := int(values.max(initial=0))) < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed ones, and the offsets of its rows."""
    rows = [np.frombuffer(x, f"<u{x[0]}", offset=1) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.cumsum([0, *map(len, rows)])


def encoded(docs: DataFrame, first: Vocabulary, second: Vocabulary, text_col: str) -> DataFrame:
    """The columns of docs but the text, with the packed ids of both sides (a, b), the tokens of either in each group (size_a,
    size_b), and n, the tokens of both sides."""
    shared = docs.sparkSession.sparkContext.broadcast((first, second))
    made = ["a", "b", "size_a", "size_b", "n"]
    keep = [c for c in docs.columns if c != text_col]

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder, none = Encoder(*map(Side, shared.value)), [np.zeros(0, np.int64)] * 4
        for batch in slices(batches, 0, TEXT_BYTES):
            texts = batch.column(0).to_pylist()
            some = [k for k, t in enumerate(texts) if t]
            rows = [none] * len(texts)
            for k, found in zip(some, encoder.tokens([texts[k] for k in some])):
                if found:
                    rows[k] = found
            cols = [pa.array([packed(r[j]) for r in rows], pa.binary()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols, pa.array([len(r[0]) + len(r[1]) for r in rows], pa.int64())], names=[*keep, *made])

    kind = ", ".join([*filter(None, [kinds(docs, keep)]), *(f"{c} binary" for c in made[:4]), "n long"])
    return docs.select(text_col, *keep).mapInArrow(run, kind)


def opened(batch: pa.RecordBatch, base: int):
    """The four columns of a batch, the offsets of its documents in them, and the links as (document, pair, number) by chunks."""
    (a, at_a), (b, at_b), (size_a, at), (size_b, _) = (unpacked(batch.column(batch.schema.get_field_index(c))) for c in ("a", "b", "size_a", "size_b"))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    chunks = ((doc[g], x * base + y, n) for g, x, y, n in links(a, b, size_a, size_b))
    return a, b, size_a, size_b, at_a, at_b, at, chunks


def distinct_links(chunks, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, pairs and numbers of links, one a document and pair."""
    parts: list = []
    held = 0

    def merged():
        key = np.concatenate([p[0] for p in parts])
        unique, inverse = np.unique(key, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, np.concatenate([p[1] for p in parts]))
        return unique, total

    for doc, pair, n in chunks:
        parts.append((doc * n_pairs + pair, n))
        held += len(pair)
        if held > 4 * LINKS:
            parts[:] = [merged()]
            held = 0
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    key, total = merged()
    return key // n_pairs, key % n_pairs, total


def pair_counts(tokens: DataFrame, base: int, n_pairs: int) -> DataFrame:
    """pair, n (documents that hold it linked) and best (n is the highest of the pair's first id)."""

    def run(batches):
        for batch in pieces_of(batches):
            *_, chunks = opened(batch, base)
            pair, n = np.unique(distinct_links(chunks, n_pairs)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = stash(tokens.select("a", "b", "size_a", "size_b", F.col("n")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    own = F.expr(f"pair div {base}")
    most = counts.groupBy(own.alias("own")).agg(F.max("n").alias("most"))
    return stash(counts.withColumn("own", own).join(most, "own").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def described(batch: pa.RecordBatch, base: int, n_a: int, names: list[bytes]):
    """Sizes of each document (tokens of both sides, groups, links), its groups as text, and its links by chunks."""
    a, b, size_a, size_b, at_a, at_b, at, chunks = opened(batch, base)
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    total = np.concatenate(([0], np.cumsum(size_a * size_b)))
    group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
    code = np.empty(len(a) + len(b), np.int64)  # tokens in the order of the text of groups, each with the mark that follows
    k, j = np.arange(len(a)), np.arange(len(b))
    code[k + (end_b - size_b)[group_a]] = 2 * a + (k + 1 == end_a[group_a])
    code[j + end_a[group_b]] = 2 * (n_a + b) + (j + 1 == end_b[group_b])
    text = [b"".join(map(names.__getitem__, code[s:e].tolist()))[:-1] for s, e in zip((at_a + at_b)[:-1].tolist(), (at_a + at_b)[1:].tolist())]
    sizes = [np.diff(at_a), np.diff(at_b), np.diff(at), total[at[1:]] - total[at[:-1]]]
    return sizes, text, chunks


def align(docs: DataFrame, first: Vocabulary, second: Vocabulary, *, text_col: str = "text") -> DataFrame:
    """The columns of docs but the text, with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups (string).

    Space and text are encoded by both tokenizers, without special tokens; byte offsets at which tokens of both end cut
    the tokens into groups, given as a1,a2|b1;a3|b2,b3. A link is a pair of tokens of one group; the count of a pair of
    ids is the number of documents (rows) that hold it linked; n_best counts the links whose count is the highest of
    their first id, ties included; count_sum adds the counts of all links. Null and empty texts and those that either
    side's tokens don't spell have no tokens: zeros and an empty string. Repeated rows count each. Columns of docs that
    are named as the result are replaced.

    Ids are written once and read twice, so texts are encoded once. Counts are broadcast to the second reading while
    there are few (BROADCAST_PAIRS); beyond that each document's distinct pairs are joined with them.
    """
    spark = docs.sparkSession
    result = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    made = ["a", "b", "size_a", "size_b", "n", "__row"]
    keep = [c for c in docs.columns if c not in (text_col, *result)]
    plain = {f"__{k}": c for k, c in enumerate(keep)}  # names that can't clash
    one, two = Side(first), Side(second)
    n_a, base = len(one.bytes), len(two.bytes)
    n_pairs = n_a * base
    tokens = encoded(docs.select(F.col(text_col).alias("__text"), *(F.col(c).alias(k) for k, c in plain.items())), first, second, "__text")
    tokens = stash(tokens.withColumn("__row", F.monotonically_increasing_id()))
    counts = pair_counts(tokens, base, n_pairs)
    few = counts.count() <= BROADCAST_PAIRS
    table = None
    if few:
        found = counts.toArrow()
        pair = found.column("pair").to_numpy()
        order = np.argsort(pair)
        table = spark.sparkContext.broadcast((pair[order], found.column("n").to_numpy()[order], found.column("best").to_numpy()[order]))

    def run(batches):
        names = [f"{i}{mark}".encode() for n, marks in ((n_a, ",|"), (base, ",;")) for i in range(n) for mark in marks]
        for batch in pieces_of(batches):
            sizes, text, chunks = described(batch, base, n_a, names)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            if few:
                pair_of, n_of, best_of = table.value
                for doc, pair, n in chunks:
                    at = np.searchsorted(pair_of, pair)
                    np.add.at(total, doc, n_of[at] * n)
                    np.add.at(best, doc, best_of[at] * n)
            cols = [pa.array(x, pa.int64()) for x in (*sizes, best, total)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*plain, "__row")), *cols, pa.array(text, pa.binary()).cast(pa.string())], names=[*plain, "__row", *result])

    kind = kinds(tokens, [*plain, "__row"]) + ", " + ", ".join(f"{c} long" for c in result[:-1]) + ", groups string"
    out = tokens.select(*plain, *made).mapInArrow(run, kind)
    if not few:

        def held(batches):
            for batch in pieces_of(batches):
                doc, pair, n = distinct_links(opened(batch, base)[-1], n_pairs)
                rows = batch.column(batch.schema.get_field_index("__row")).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(rows[doc]), pa.array(pair), pa.array(n)], names=["__row", "pair", "links"])

        own = tokens.select("a", "b", "size_a", "size_b", "n", "__row").mapInArrow(held, "__row long, pair long, links long")
        sums = own.join(counts, "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        out = out.drop("n_best", "count_sum").join(sums, "__row", "left").withColumns({c: zero(c) for c in ("n_best", "count_sum")})
    return out.select(*(F.col(k).alias(c) for k, c in plain.items()), *result)


def pieces_of(batches, most: int = 1 << 20):
    """Batches cut so that each has about `most` tokens; a longer text stands alone."""
    for batch in batches:
        start, total = 0, 0
        for k, n in enumerate(batch.column(batch.schema.get_field_index("n")).to_pylist()):
            if total and total + n > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
