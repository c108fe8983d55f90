"""Cross-parsing against a direct parse, and held-out accuracy."""

import random

import numpy as np
import pytest

import corpus_pipeline
from nebulark.llm import language
from nebulark.llm.queries import op5_language_id
from tests.conftest import SMALL
from tests.llm import odd


def parse(sample, text):
    """Phrases of the greedy parse of the whole text into substrings of sample."""
    n = 0
    while text:
        k = 1
        while k < len(text) and text[: k + 1] in sample:
            k += 1
        n, text = n + 1, text[k:]
    return n


@pytest.mark.parametrize("piece", [1, 3, 17, 1024])
def test_phrases(monkeypatch, piece):
    """Counts are those of the whole text, wherever it is cut."""
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    samples = {"a": [" ".join(word("abcde") for _ in range(60)) for _ in range(3)], "b": [" ".join(word("defgé") for _ in range(60)) for _ in range(3)]}
    model = language.fit(list(samples.items()))
    texts = [" ".join(word("abcdefgé") for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["", "z", "!!", "É, d\n\ng 7", "zzzz zzz", samples["a"][0], samples["b"][1] * 3]
    total, _ = language.phrases(model, texts)
    for k, lang in enumerate(model["langs"]):
        joined = "\n".join(map(language.normal, samples[lang]))[: language.SAMPLE_CHARS]
        assert total[:, k].tolist() == [parse(joined, language.normal(t)) for t in texts]


def test_automaton_knows_all_substrings():
    text = "abcbcabbac"
    edges = language.automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for x in {a + b for a in subs for b in "abc"} | subs:
        state = 0
        for ch in x:
            state = edges[state].get(ch, -1) if state >= 0 else -1
        assert (state >= 0) == (x in subs)


def test_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = op5_language_id(spark, SMALL).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    df = odd.table(spark)
    got = language.identify(df, df).collect()
    assert len(got) == len(odd.rows())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in ("en", "fr") for r in got if any(c.isalpha() for c in r.text or ""))
    assert {r.lang_pred for r in language.identify(df, odd.empty(spark)).collect()} == {"und"}
    assert language.identify(odd.empty(spark), df).count() == 0


def scripts(n, seed=3):
    """Labelled texts of ideographs, and of many languages with alphabets of their own."""
    rng = random.Random(seed)
    han = [chr(0x4E00 + k) for k in range(2400)]
    ranks = [1 / (k + 1) for k in range(1200)]
    rows = [(f"han{k}", "".join(rng.choices(han[k * 1200 : (k + 1) * 1200], ranks, k=300))) for k in range(2) for _ in range(n)]
    starts = [0x61, 0x3B1, 0x430, 0x561, 0x5D0, 0x10D0, 0x905, 0x995]
    for k in range(70):
        letters = rng.sample([chr(starts[k % 8] + j) for j in range(20)], 9)
        words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(30)]
        rows += [(f"x{k:02}", " ".join(rng.choices(words, k=50))) for _ in range(8)]
    return rows


def test_all_letters_and_languages(spark, monkeypatch):
    rows = [(k, lang, text) for k, (lang, text) in enumerate(scripts(60))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    alike = spark.createDataFrame([(9001, None, "\u4e00\u4e01"), (9002, None, "".join(chr(0xAC00 + k) for k in range(500)))], df.schema)
    got = {}
    for share in (language.DENSE_BYTES, 0):  # dense tables as far as they go, and hardly any
        monkeypatch.setattr(language, "DENSE_BYTES", share)
        got[share] = {r.doc_id: r for r in language.identify(df.union(alike), df).collect()}
        assert np.mean([got[share][k].lang_pred == lang for k, lang, _ in rows]) > 0.99
        assert all(got[share][k].explained for k, _, _ in rows) and got[share][9001].explained and not got[share][9002].explained
    assert len({tuple(sorted((k, r.lang_pred, r.phrase_chars) for k, r in x.items())) for x in got.values()}) == 1
    pipeline_kept = corpus_pipeline.language_id(spark, df, SMALL).count()
    assert pipeline_kept == len(rows)
