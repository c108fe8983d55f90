"""Near-duplicates against brute force, and signatures against exact similarities."""

import random
from collections import Counter

import numpy as np
import pytest

from nebulark.llm import neardup
from nebulark.llm.neardup import classes, one_of_each, shingles, signatures
from nebulark.llm.substrings import Names
from tests.conftest import SMALL
from tests.llm import odd


def bag(text, n=5):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else Counter()


def similarity(x, y):
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def expected(rows):
    rows = [(d, t) for d, t in rows if d is not None]
    bags = [bag(t) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(rows):
        for j, (b, t) in enumerate(rows[:i]):
            if t is not None and (s == t or (bags[i] and similarity(bags[i], bags[j]) >= 0.8)):
                a2, b2 = sorted((root(a), root(b)))
                parent[b2] = a2
    return {d: root(d) for d in parent}


def test_awkward_rows(spark):
    want = expected([r[:2] for r in odd.rows()])
    got = classes(odd.table(spark)).collect()
    assert len(got) == len(odd.rows())
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.class_id is None for r in got if r.doc_id is None)
    kept = one_of_each(odd.table(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert classes(odd.empty(spark)).count() == 0 and one_of_each(odd.empty(spark)).count() == 0


def test_driver_table(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: r.class_id for r in classes(df).collect()} == expected(rows)


@pytest.mark.parametrize("block", [256, 20])
def test_large_groups(spark, monkeypatch, block):
    """A dense group of near copies, and documents that share a passage with it without being near."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(2)
    words = [f"v{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join([*base[:60], *(rng.choice(words) for _ in range(60))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in classes(df).collect()} == expected(rows)


@pytest.mark.parametrize("small", [32, 4, 0])
def test_templates(spark, monkeypatch, small):
    """Many texts that share most of a template, some of them near: classes don't depend on how buckets are dealt."""
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(12)
    words = [f"v{i}" for i in range(3000)]
    template = [rng.choice(words) for _ in range(130)]
    rows = []
    for i in range(120):
        own = [rng.choice(words) for _ in range(60)]
        rows.append((i, " ".join(template + own)))
        if i % 10 == 0:
            rows += [(1000 + 10 * i + k, " ".join(template + own[: 60 - k])) for k in (1, 2)]
            rows.append((5000 + i, rows[-1][1]))
    texts = dict(rows)
    got = {r.doc_id: r for r in classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.class_id for d, r in got.items()} == expected(rows)
    for d, r in got.items():
        assert (r.near_id is None) == (sum(x.class_id == r.class_id for x in got.values()) == 1)
        assert r.near_id is None or abs(r.similarity - similarity(bag(texts[d]), bag(texts[r.near_id]))) < 1e-6


def test_signatures_are_unbiased():
    rng = random.Random(4)
    errors = []
    for _ in range(30):
        common = [rng.choice("abcdefghij") for _ in range(rng.randint(20, 200))]
        texts = [" ".join(common + [rng.choice("klmnopqrst") for _ in range(rng.randint(0, 60))]) for _ in range(2)]
        doc, prints, weight = shingles([t.encode() for t in texts], 1, Names())
        sig = signatures(doc, prints, weight, 2, 1024)
        errors.append((sig[0] == sig[1]).mean() - similarity(bag(texts[0], 1), bag(texts[1], 1)))
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.06
