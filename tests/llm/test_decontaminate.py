"""Decontamination against a direct reading of its contract, and the index against counting."""

import random
import re

import numpy as np

from nebulark.llm.decontaminate import FMIndex, contamination
from tests.conftest import SMALL
from tests.llm import odd

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def expected(docs, items, size=10):
    phrases = []
    for item, text in items:
        w = words_of(text)
        if item is not None:
            phrases += [(str(item), w[i : i + size]) for i in range(max(1, len(w) - size + 1)) if w]
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        starts = {}
        for i, x in enumerate(w):
            starts.setdefault(x, []).append(i)
        for item, p in phrases:
            for i in starts.get(p[0], ()):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r["items"]) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    docs = [r[:2] for r in odd.rows()]
    text = odd.texts()
    items = [(1, " ".join(text[21].split()[5:40])), (2, "A, B! c"), (3, None), (4, ""), (None, "one"), (10, "na na na"), (9, "ÉTÉ naïve café 中文"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = odd.table(spark)
    want = expected(docs, items)
    assert found(contamination(df, bench)) == want
    assert found(contamination(df, bench, block_bytes=10)) == want  # several passes
    assert contamination(odd.empty(spark), bench).count() == 0
    assert all(not r.spans for r in contamination(df, bench.limit(0)).collect())


def test_driver_table(spark):
    df, bench = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "benchmark"))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert found(contamination(df, bench)) == expected(docs, [tuple(r) for r in bench.collect()])


def test_index_counts_and_locates():
    rng = random.Random(6)
    for _ in range(20):
        text = np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 300))] + [0])
        fm = FMIndex(text)
        phrases = [[rng.randint(1, 6) for _ in range(rng.randint(1, 4))] for _ in range(30)]
        matrix = np.zeros((30, 4), np.int64)
        for k, p in enumerate(phrases):
            matrix[k, 4 - len(p) :] = p
        lo, hi = fm.search(matrix, np.array([len(p) for p in phrases]))
        for k, p in enumerate(phrases):
            want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
            assert sorted(fm.locate(np.arange(lo[k], hi[k])).tolist()) == want
