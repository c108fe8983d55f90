"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it. A text is parsed greedily into
the longest phrases that the automaton knows; the language that needs the fewest phrases a character wins.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nebulark.llm.common import kinds, slices

#: Characters of labelled text in each language's automaton, labelled documents and characters of each to take them
#: from: together they bound what is fitted and broadcast.
SAMPLE_CHARS, SAMPLE_DOCS, DOC_CHARS = 40_000, 400, 400
#: Bytes of all dense transition tables; letters of a language that don't fit its share are looked up in sorted transitions.
DENSE_BYTES = 256 << 20
#: Labelled texts of a language, other than those in its automaton, that set its threshold; characters that a text needs to be judged.
HELD_DOCS, SHORT_CHARS = 100, 20
#: Highest threshold, in mean characters of a phrase; in languages of an alphabet, texts have about six.
LEAST_PHRASE = 2.0
#: Bytes of text that a task parses at a time; some 15 bytes of arrays stand for each.
TEXT_BYTES = 2 << 20
#: Characters of the pieces of a long text that are parsed side by side, before the parse is carried over their ends.
PIECE = 1024


def automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text, by state; state 0 is the start."""
    edges: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        new, p = len(edges), last
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and ch not in edges[p]:
            edges[p][ch] = new
            p = link[p]
        if p >= 0:
            q = edges[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and edges[p].get(ch) == q:
                    edges[p][ch] = twin
                    p = link[p]
        last = new
    return edges


def normal(text: str) -> str:
    """Lower case; each run of what is not a letter is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


@cache
def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter and its lower case (its own, where that is several characters: none is learned)."""
    every = list(map(chr, range(0x110000)))
    return np.array([c.isalpha() for c in every]), np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every], np.int32)


def fit(rows: list[tuple[str, list[str]]]) -> dict:
    """The model of (language, sample texts): a symbol for each letter that any sample has, transitions for each language.

    Symbol 0: letters that no sample has; 1: all that isn't a letter. A language has a column for each of its most frequent
    symbols: 0 for what it lacks, 1 for its other symbols, whose transitions are sorted by state and symbol.
    """
    texts = {lang: "\n".join(filter(None, map(normal, sample)))[:SAMPLE_CHARS] for lang, sample in rows}
    texts = {lang: x for lang, x in sorted(texts.items()) if x}
    letters = sorted({ch for x in texts.values() for ch in x if ch.isalpha()})
    known = {c: k + 2 for k, c in enumerate(letters)} | {" ": 1}
    kind = np.uint8 if len(known) < 255 else np.uint16 if len(known) < 65_535 else np.uint32
    of = np.zeros(0x110000, kind)
    of[[ord(c) for c in letters]] = [known[c] for c in letters]
    alpha, lower = characters()
    symbol = np.where(alpha, of[lower], kind(1))
    tables = [transitions(x, known, DENSE_BYTES // len(texts)) for x in texts.values()]
    return {"langs": list(texts), "symbol": symbol, "tables": tables, "least": np.array([0.0] * len(texts))}


def transitions(text: str, known: dict[str, int], most: int) -> dict:
    """The automaton of text: column of each symbol, table of the columns, and sorted keys and targets of the other symbols."""
    edges, size, count = automaton(text), len(known) + 1, {}
    for ch in text:
        if ch in known:
            count[ch] = count.get(ch, 0) + 1
    frequent = sorted(count, key=lambda c: (-count[c], c))[: max(1, most // (4 * len(edges)) - 2)]
    column, first = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    for ch in count:
        column[known[ch]] = 1
        first[known[ch]] = edges[0][ch]
    for k, ch in enumerate(frequent):
        column[known[ch]] = k + 2
    table, rare = np.full((len(edges), len(frequent) + 2), -1, np.int32), []
    for state, to in enumerate(edges):
        for ch, q in to.items():
            if ch in known:
                if (c := column[known[ch]]) > 1:
                    table[state, c] = q
                else:
                    rare.append((state * size + known[ch], q))
    rare = np.array(sorted(rare), np.int64).reshape(-1, 2)
    return {"column": column, "first": first, "table": table, "keys": rare[:, 0].copy(), "to": rare[:, 1].astype(np.int32)}


def with_thresholds(model: dict, held: list[tuple[str, list[str]]]) -> dict:
    """The model with the mean phrase below which it explains no text, for each language.

    It lies halfway between 1, what noise has, and what 95 % of the language's held-out texts exceed, LEAST_PHRASE at most;
    without held-out texts it is 0.
    """
    held, least = dict(held), []
    for k, lang in enumerate(model["langs"]):
        total, lengths = phrases(model, held.get(lang, []))
        judged = lengths >= SHORT_CHARS
        least.append(min(LEAST_PHRASE, 0.5 + np.quantile(lengths[judged] / total[judged, k], 0.05) / 2) if judged.any() else 0.0)
    return model | {"least": np.array(least)}


def parts(texts: list[str]) -> tuple[list[str], list[str]]:
    """Sample texts for the automaton, and those held out: what its characters leave over, else each fifth."""
    sizes = np.cumsum([len(normal(x)) + 1 for x in texts])
    used = int(np.searchsorted(sizes, SAMPLE_CHARS)) + 1
    return (texts[:used], texts[used : used + HELD_DOCS]) if used < len(texts) else ([x for k, x in enumerate(texts) if k % 5 != 4], texts[4::5][:HELD_DOCS])


def learned(rows: list[tuple[str, list[str]]]) -> dict:
    """The model of all samples, with thresholds from models that haven't seen the texts held out."""
    model, least = fit(rows), {}
    for lang, texts in rows:
        seen, held = parts(texts)
        one = with_thresholds(fit([(lang, seen)]), [(lang, held)])
        least |= dict(zip(one["langs"], one["least"]))
    return model | {"least": np.array([least.get(lang, 0.0) for lang in model["langs"]])}


def symbols(model: dict, text: str) -> np.ndarray:
    """What normal() gives, as symbols."""
    x = model["symbol"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = x == 1
    x = x[~(gap & np.concatenate(([True], gap[:-1])))] if len(x) else x
    return x[:-1] if len(x) and x[-1] == 1 else x


def phrases(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that each language's parse of each whole text has, and the texts' lengths.

    Texts are cut into pieces that advance side by side, a character at a time. A piece is first parsed as if a phrase
    began at it; then those into which the piece before carries a phrase are parsed again from there, until that parse
    meets the first one, and so on until no piece's entry changes. So the cuts leave no trace in the counts.
    """
    codes = [symbols(model, x) for x in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    pieces = [(d, s) for d, c in enumerate(codes) for s in range(0, len(c), PIECE)]
    total = np.zeros((len(texts), len(model["langs"])), np.int64)
    if not pieces:
        return total, lengths
    doc = np.array([d for d, _ in pieces])
    size = np.array([min(PIECE, len(codes[d]) - s) for d, s in pieces])
    order = np.argsort(-size, kind="stable")
    place = np.argsort(order, kind="stable")  # of a piece, its column in the grid
    before = np.where(np.concatenate(([False], doc[1:] == doc[:-1])), np.concatenate(([0], place[:-1])), -1)[order]
    grid = np.zeros((int(size.max()), len(pieces)), model["symbol"].dtype)
    for col, k in enumerate(order.tolist()):
        d, s = pieces[k]
        grid[: size[k], col] = codes[d][s : s + PIECE]
    size, doc = size[order], doc[order]
    long = np.flatnonzero(before >= 0)
    for k, of in enumerate(model["tables"]):
        columns = of["column"][grid]
        entry = np.zeros(len(size), np.int32)
        trace = np.zeros(grid.shape, np.int32) if len(long) else None
        begun = np.zeros(grid.shape, np.int16) if len(long) else None
        made, last = parse(of, grid, columns, size, trace, begun)
        while len(late := long[last[before[long]] != entry[long]]):
            entry[late] = last[before[late]]
            reparse(of, grid, columns, size, late, entry[late], made, last, trace, begun)
        np.add.at(total[:, k], doc, made)
    return total, lengths


def advance(of: dict, state: np.ndarray, made: np.ndarray, zero: np.ndarray, cols: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after a character, and which of them are 0, between phrases; adds up the phrases that begin, in place.

    zero: which of the states are 0 before it.
    """
    made[zero] += 1
    to = of["table"].ravel()[state * np.int64(of["table"].shape[1]) + cols]
    end = np.flatnonzero(to < 0)
    if len(end) and len(of["keys"]):
        rare = end[cols[end] == 1]
        key = state[rare].astype(np.int64) * len(of["first"]) + symbol[rare]
        at = np.minimum(np.searchsorted(of["keys"], key), len(of["keys"]) - 1)
        to[rare] = np.where(of["keys"][at] == key, of["to"][at], -1)
        end = end[to[end] < 0]
    made[end] += state[end] > 0  # a phrase ends here, the next begins at this character; in state 0 it is one of its own
    again = of["first"][symbol[end]]
    to[end] = np.maximum(again, 0)
    return to, end[again < 0]


def parse(of: dict, grid: np.ndarray, columns: np.ndarray, size: np.ndarray, trace: np.ndarray | None, begun: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each piece, longest first, where none is carried into it, and the state at its end.

    trace and begun get the state and the number of phrases after each character.
    """
    state, made, zero = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32), np.arange(len(size))
    for t, n in enumerate(np.searchsorted(-size, -np.arange(len(grid)), side="left").tolist()):  # n: pieces longer than t
        state[:n], zero = advance(of, state[:n], made[:n], zero[zero < n], columns[t, :n], grid[t, :n])
        if trace is not None:
            trace[t, :n], begun[t, :n] = state[:n], made[:n]
    return made.astype(np.int64), state


def reparse(of: dict, grid: np.ndarray, columns: np.ndarray, size: np.ndarray, which: np.ndarray, state: np.ndarray, made: np.ndarray, last: np.ndarray, trace: np.ndarray, begun: np.ndarray) -> None:
    """Parse the pieces of `which` again, entered in `state`, until the state is that of the parse before; mends its results."""
    count, zero = np.zeros(len(which), np.int32), np.flatnonzero(state == 0)
    for t in range(len(grid)):
        state, zero = advance(of, state, count, zero, columns[t, which], grid[t, which])
        met, over = trace[t, which] == state, size[which] == t + 1
        by = count - begun[t, which]
        trace[t, which], begun[t, which] = state, count
        if met.any():  # from here on nothing but the counts differs
            mended = met & (by != 0)
            begun[t + 1 :, which[mended]] += by[mended].astype(np.int16)
            made[which[met]] += by[met]
        gone = over & ~met
        made[which[gone]], last[which[gone]] = count[gone], state[gone]
        if (go := ~(met | over)).all():
            continue
        which, state, count = which[go], state[go], count[go]
        if not len(which):
            return
        zero = np.flatnonzero(state == 0)


def labelled_sample(labelled: DataFrame, text_col: str, lang_col: str, key: str) -> list[tuple[str, list[str]]]:
    """Of each language the documents with the smallest hashes, as many as SAMPLE_DOCS; each of them cut to DOC_CHARS."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    ranked = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key).alias("h"), F.substring(F.trim(text_col), 1, DOC_CHARS).alias("x"))
    first = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))).where(F.col("rn") <= SAMPLE_DOCS)
    sample: dict[str, list[tuple[int, str]]] = {}
    for r in first.collect():
        sample.setdefault(r.lang, []).append((r.rn, r.x))
    return [(lang, [x for _, x in sorted(found)]) for lang, found in sorted(sample.items())]


def identify(docs: DataFrame, labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id") -> DataFrame:
    """docs with lang_pred, score (0 to 1), phrase_chars (mean characters of a phrase) and explained, found from the whole text alone.

    `und`, score 0, for texts that are null or have no letter, and for all where nothing is labelled. Ties go to the
    language first in code point order. Score: 1 - best / second best number of phrases, 1 if only one is learned.
    explained: whether phrases are as long as the predicted language's threshold, or the text too short to judge.
    No shuffle beyond the bounded sample; columns of docs stay, those named as the result are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(learned(labelled_sample(labelled, text_col, lang_col, key)))
    made = ["lang_pred", "score", "phrase_chars", "explained"]
    keep = [c for c in docs.columns if c not in made]

    def scan(batches):
        langs, least = np.array([*model.value["langs"], "und"], object), np.append(model.value["least"], np.inf)
        for batch in slices(batches, keep.index(text_col), TEXT_BYTES):
            texts = [x or "" for x in batch.column(keep.index(text_col)).to_pylist()]
            total, lengths = phrases(model.value, texts)
            some = (lengths > 0) & (len(langs) > 1)
            best, score, mean = np.full(len(texts), len(langs) - 1), np.zeros(len(texts)), np.zeros(len(texts))
            if some.any():
                best[some] = total[some].argmin(axis=1)
                two = np.sort(total[some], axis=1)[:, :2]
                score[some] = 1 - two[:, 0] / two[:, 1] if two.shape[1] > 1 else 1.0
                mean[some] = lengths[some] / two[:, 0]
            explained = some & ((mean >= least[best]) | (lengths < SHORT_CHARS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs[best], pa.string()), pa.array(score), pa.array(mean), pa.array(explained)], names=[*keep, *made])

    return docs.select(*keep).mapInArrow(scan, f"{kinds(docs, keep)}, lang_pred string, score double, phrase_chars double, explained boolean")
