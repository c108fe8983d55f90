"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries the best
score, and with it only the number of pieces, never the pieces themselves.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nebulark.llm.common import kinds, slices

#: Marks the start of a word in piece vocabularies.
MARK = "▁"
#: What an unknown character costs below the worst piece, in public unigram tokenizers.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers at a time.
REMEMBERED = 400_000


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram scores; read on the driver.

    Control, unknown and byte pieces are left out, and pieces with a word mark after their first character, as words
    are scored one at a time. The file's scores are ranks of merges, so a piece of rank r gets the log of Zipf's law,
    1 / (r + 3), over its sum.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    pieces = [p for p in pieces if MARK not in p[1:]]
    weight = 1 / (np.arange(len(pieces)) + 3.0)
    return list(zip(pieces, np.log(weight / weight.sum()).tolist()))


class Counter:
    """Counts pieces of words.

    Tie rule, that of the public unigram tokenizers: of paths with equal scores the one whose last piece starts first
    stays; an unknown character is tried last, where no piece of one character matches; unknowns in a row count once.
    """

    def __init__(self, vocab: list[tuple[str, float]]):
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.find = ahocorasick.Automaton()
        for piece, score in vocab:
            self.find.add_word(piece, (len(piece), score))
        if vocab:
            self.find.make_automaton()
        self.seen: dict[bytes, tuple[int, int, float]] = {}

    def pieces(self, text: str) -> tuple[int, int, float]:
        """Number of pieces, of them unknown, and the best score."""
        n = len(text)
        best, count, lost, loose = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends: dict[int, list] = {}
        for end, hit in self.find.iter(text) if len(self.find) else ():
            ends.setdefault(end + 1, []).append(hit)
        for e in range(1, n + 1):
            top, start, single = None, 0, False
            for size, score in ends.get(e, ()):  # longest first
                single |= size == 1
                if top is None or best[e - size] + score > top:
                    top, start = best[e - size] + score, e - size
            if not single and (top is None or best[e - 1] + self.unknown > top):
                fused = loose[e - 1]
                best[e], count[e], lost[e], loose[e] = best[e - 1] + self.unknown, count[e - 1] + (not fused), lost[e - 1] + (not fused), True
            else:
                best[e], count[e], lost[e] = top, count[start] + 1, lost[start]
        return count[n], lost[n], best[n]

    def word(self, word: bytes) -> tuple[int, int, float]:
        if (got := self.seen.get(word)) is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            got = self.seen[word] = self.pieces(MARK + word.decode("utf-8", "replace"))
        return got

    def text(self, data: bytes) -> tuple[int, int, int, float]:
        """Words, tokens, unknown tokens and the score of a text."""
        words = data.split()
        found = list(map(self.word, words))
        if not found:
            return 0, 0, 0, 0.0
        tokens, lost, score = zip(*found)
        return len(words), sum(tokens), sum(lost), float(sum(score))


def count_tokens(docs: DataFrame, vocab: list[tuple[str, float]], *, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_tokens, n_unknown (long) and log_prob (double) of each whole text.

    Words are runs of other than ASCII white space, each counted with a word mark in front. No shuffle: the vocabulary,
    whose size is fixed, goes to the tasks. Null, empty and blank texts have no tokens; columns of docs stay, those
    named as the result are replaced.
    """
    shared, made = docs.sparkSession.sparkContext.broadcast(vocab), ["n_words", "n_tokens", "n_unknown", "log_prob"]
    keep = [c for c in docs.columns if c not in made]

    def scan(batches):
        counter = Counter(shared.value)
        for batch in slices(batches, keep.index(text_col)):
            found = [counter.text(x) if x else (0, 0, 0, 0.0) for x in batch.column(keep.index(text_col)).cast(pa.binary()).to_pylist()]
            cols = [pa.array([x[k] for x in found], pa.float64() if k == 3 else pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*keep, *made])

    return docs.select(*keep).mapInArrow(scan, f"{kinds(docs, keep)}, n_words long, n_tokens long, n_unknown long, log_prob double")
