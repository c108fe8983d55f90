"""Substring dedup against a direct reading of its contract."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nebulark.llm.substrings import Names, anchors, dedup, window_prints
from tests.llm import odd


def expected(rows, size):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - size + 1 if doc is not None else 0):
            k = tuple(words[i : i + size])
            first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - size + 1 if doc is not None else 0):
            if first[tuple(words[i : i + size])] < doc:
                gone.update(range(i, i + size))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(df, size):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in dedup(df, size).collect()), key=repr)


def test_awkward_rows(spark):
    rows = [r[:2] for r in odd.rows()]
    got = dedup(odd.table(spark))
    assert got.columns == [c for c in odd.NAMES if c != "n_words"] + ["kept", "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr) == expected(rows, 50)
    assert dedup(odd.empty(spark)).count() == 0


def test_random_repeats(spark):
    rng = random.Random(3)
    for size, letters in ((4, "ab"), (6, "abc"), (9, "abcdefgh")):
        parts = [[rng.choice(letters) for _ in range(rng.randint(1, 40))] for _ in range(12)]
        rows = [(rng.randint(0, 40), " ".join(w for _ in range(rng.randint(0, 5)) for w in rng.choice(parts))) for _ in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(df, size) == expected(rows, size)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=12, max_size=60), st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_equal_windows_have_equal_anchors(window, before, after):
    names, size = Names(), len(window)
    seen = set()
    for left, right in (((), ()), (before, after), (after, before)):
        words = [w.encode() for w in (*left, *window, *right)]
        x = names.of(words)
        name, at = anchors(x, np.arange(len(words) - size + 1), size)
        seen.add((int(name[len(left)]), int(at[len(left)]) - len(left), int(window_prints(x, size)[len(left)])))
    assert len(seen) == 1
