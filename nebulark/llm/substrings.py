"""Substring dedup by recompression.

Words become symbols; in each round runs of equal symbols and then pairs of neighbours get new symbols, whose names
depend on nothing but what they stand for. So wherever a passage occurs, its inside gets the same symbols. A symbol of
the highest level that lies safely inside a window stands for the window; windows can be equal only where those are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nebulark.llm.common import kinds, slices, stash

#: Rounds of recompression at most; a round shortens a text by about a quarter.
ROUNDS = 14
#: Names of words that a task remembers at a time.
REMEMBERED = 300_000

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Names(dict):
    """64-bit names of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def window_prints(names: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit fingerprint of every `size` words in a row, by doubling."""
    n, out, at, width, power = len(names) - size + 1, None, 0, 1, names
    while True:
        if size & width:
            part = power[at : at + n]
            out = mix(part + U(width)) if out is None else mix(out * U(0x9E3779B97F4A7C15) + part)
            at += width
        if width * 2 > size:
            return out
        power = mix(mix(power[:-width]) * U(0xD6E8FEB86659FD93) + power[width:])
        width *= 2


def anchors(names: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `size` words, given by its first, the name of its anchor and the word at which that starts.

    In a round, runs of equal symbols are named first, of those symbols whose turn it is (one in eight, by name and
    round); then neighbours are paired where the left one is of the left class and the right one is not. What a window
    doesn't show of its surroundings changes only its outermost symbols: a run of a symbol whose turn it is may go on
    outside; a first symbol of the right class and a last one of the left class may be paired outwards. Those are
    dropped. While symbols are left, the first of them, which the window's words alone decide, is the anchor; the last
    level at which there is one counts.
    """
    first, last, live = windows.copy(), windows + size, np.arange(len(windows))
    symbols, starts = names, np.arange(len(names) + 1)
    name, at = symbols[first], first.copy()
    for level in range(ROUNDS):
        for runs in (True, False):
            a, b, m = first[live], last[live], len(symbols)
            if runs:
                turn = mix(symbols + U(2 * level + 1)) >> U(61) == 0
                inner = np.concatenate(([False], turn[1:] & (symbols[1:] == symbols[:-1])))
            else:
                left = mix(symbols + U(2 * level + 2)) >> U(63) == 0
                inner = np.concatenate(([False], left[:-1] & ~left[1:]))
            begin = np.flatnonzero(~inner)
            index, end = np.cumsum(~inner) - 1, np.append(begin[1:], m)
            length = end - begin
            made = symbols[begin]
            many = np.flatnonzero(length > 1)
            if runs:
                a = np.where(turn[a], end[index[a]], a)
                b = np.where(turn[b - 1], begin[index[b - 1]], b)
                made[many] = mix(made[many] + mix(length[many].astype(U) + U(1 << 40)))
            else:
                a, b = a + ~left[a], b - left[b - 1]
                made[many] = mix(mix(made[many]) * U(0x9E3779B97F4A7C15) + symbols[begin[many] + 1])
            some = a < b
            live, a, b = live[some], a[some], b[some]
            if not len(live):
                return name, at
            first[live], last[live] = index[a], index[b - 1] + 1
            symbols, starts = made, starts[np.append(begin, m)]
        name[live], at[live] = symbols[first[live]], starts[first[live]]
    return name, at


def span_prints(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of stretches of words, by prefix sums of a polynomial modulo 2^64."""
    base = 0x2545F4914F6CDD1D
    up = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(len(names), base, U))))
    down = np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(len(names), pow(base, -1, 1 << 64), U))))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(names) * up[:-1], dtype=U)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def occurrences(texts: list[bytes], size: int, names: Names):
    """Stretches of windows with one anchor: document, anchor's name, print of the stretch, the anchor's word, words of
    the stretch before that and from there on."""
    words = [x.split() for x in texts]
    count = np.array([len(w) for w in words], np.int64)
    offset = np.cumsum(count + 1) - (count + 1)  # a separator follows each document
    all_names = np.zeros(int((count + 1).sum()), U)
    for o, w in zip(offset.tolist(), words):
        all_names[o : o + len(w)] = names.of(w)
    all_names[offset + count] = mix(np.arange(len(words)).astype(U) + U(1 << 50))
    n = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(words)), n)
    windows = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + offset[doc]
    if not len(windows):
        return (np.zeros(0, np.int64),) * 6
    name, at = anchors(all_names, windows, size)
    head = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]))))
    tail = np.append(head[1:], len(doc)) - 1
    start, end, where = windows[head], windows[tail] + size, at[head]
    prints = mix(span_prints(all_names, start, end) + (where - start).astype(U))
    return doc[head], name[head].view(np.int64), prints.view(np.int64), where - offset[doc[head]], where - start, end - where


def dedup(docs: DataFrame, size: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept (the words that stay, joined by one space), n_words and n_removed.

    A word goes if it is covered by a window of `size` words that starts also in a document with a smaller id; windows
    are judged on the input. Windows are equal only if their anchors are, so the stretches of windows around anchors that
    several documents share are compared, whole first: a stretch that a smaller document has too goes; of stretches seen
    first in a document, the windows are compared one by one with those of other stretches around the same anchor. Equal
    means two 64-bit values of the words, the anchor's name and the stretch's or window's print; no false match is
    expected below some 10^18 pairs. Copies are reduced to the smallest document before every shuffle by key, and no list
    grows beyond a document's own length. Texts that are null, empty or shorter than a window keep all words; a null id
    is neither smaller nor larger than another; rows that repeat an id are told apart by a 64-bit hash of the text and
    don't remove each other's words; columns of docs stay, those named as the result are replaced.
    """
    made = ["kept", "n_words", "n_removed"]
    keep = [c for c in docs.columns if c not in made]
    docs = docs.select(*keep)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).where(F.col("doc").isNotNull() & (F.octet_length("text") >= 2 * size - 1))

    def scan(batches):
        names = Names()
        for batch in slices(batches, 2):
            d, name, span, at, before, after = occurrences(batch.column(2).cast(pa.binary()).to_pylist(), size, names)
            take = pa.array(d)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(name), pa.array(span), *(pa.array(x.astype(np.int32)) for x in (at, before, after))], names=["doc", "row", "name", "span", "at", "before", "after"])

    found = stash(texts.mapInArrow(scan, "doc long, row long, name long, span long, at int, before int, after int"))
    names = found.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("span").alias("a"), F.max("span").alias("b"))
    # Written, so that the join below starts from two plain exchanges and Spark can split a name that many texts have.
    names = stash(names.where("least < most").select("name", "least", (F.col("a") != F.col("b")).alias("several")))
    shared = stash(found.join(names, "name").where("several OR doc > least"))
    several = shared.where("several")
    leaders = stash(several.groupBy("name", "span").agg(F.min(F.struct("doc", "row", "at", "before", "after")).alias("x"), F.min("least").alias("least")).select("name", "span", "least", "x.*"))
    asked = leaders.groupBy("doc", "row").agg(F.collect_list(F.struct("name", "span", "at", "before", "after")).alias("spans"))

    def expand(batches):
        names = Names()
        for batch in slices(batches, 0):
            out: list[list] = [[], [], [], [], []]
            for text, doc, spans in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                prints = window_prints(names.of(text.split()), size).view(np.int64)
                for x in spans:
                    n = x["before"] + x["after"] - size + 1
                    for col, value in zip(out, (x["name"], x["span"], doc)):
                        col.append(np.full(n, value))
                    out[3].append(prints[x["at"] - x["before"] : x["at"] - x["before"] + n])
                    out[4].append(np.arange(n, dtype=np.int32) - np.int32(x["before"]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["name", "span", "doc", "print", "off"])

    windows = stash(texts.join(asked, ["doc", "row"]).select("text", "doc", "spans").mapInArrow(expand, "name long, span long, doc long, print long, off int"))
    firsts = windows.groupBy("name", "print").agg(F.min("doc").alias("least"))
    again = windows.join(firsts, ["name", "print"]).where("least < doc").groupBy("name", "span").agg(F.collect_set("off").alias("offs"))
    whole = shared.where("NOT several").select("doc", "row", "at", "before", "after").unionAll(
        several.join(leaders.select("name", "span", F.col("doc").alias("leader")), ["name", "span"]).where("doc > leader").select("doc", "row", "at", "before", "after")
    )
    part = several.join(leaders.where("doc > least").select("name", "span", "doc"), ["name", "span", "doc"]).join(again, ["name", "span"])
    cuts = whole.select("doc", "row", (F.col("at") - F.col("before")).alias("s"), (F.col("at") + F.col("after")).alias("e")).unionAll(
        part.select("doc", "row", "at", F.explode("offs").alias("off")).select("doc", "row", (F.col("at") + F.col("off")).alias("s"), (F.col("at") + F.col("off") + size).alias("e"))
    )
    cuts = stash(cuts.groupBy("doc", "row").agg(F.collect_set(F.struct("s", "e")).alias("cuts")))
    own = docs.alias("d").join(cuts.alias("c"), (F.col(f"d.{id_col}").cast("long") == F.col("c.doc")) & (F.xxhash64(f"d.{text_col}") == F.col("c.row")), "left")
    joined = own.select("d.*", "c.cuts")

    def cut(batches):
        for batch in slices(batches, keep.index(text_col)):
            kept, n_words, n_removed = [], [], []
            for text, gone in zip(batch.column(keep.index(text_col)).cast(pa.binary()).to_pylist(), batch.column(len(keep)).to_pylist()):
                words = (text or b"").split()
                edge = np.zeros(len(words) + 1, np.int32)
                for x in gone or ():
                    edge[x["s"]] += 1
                    edge[x["e"]] -= 1
                stays = (np.cumsum(edge[:-1]) == 0).tolist()
                left = [w for w, s in zip(words, stays) if s] if gone else words
                kept.append(b" ".join(left))
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*keep, *made])

    return joined.mapInArrow(cut, f"{kinds(docs, keep)}, kept string, n_words long, n_removed long")
