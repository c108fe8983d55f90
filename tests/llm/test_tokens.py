"""Token counts against the public unigram implementation."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer, models

from nebulark.llm.tokens import MARK, Counter, count_tokens, vocabulary
from tests.llm import odd

FILE = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    vocab = vocabulary(FILE)
    return Counter(vocab), Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False))


def reference(tokenizer, vocab_min, word):
    return tokenizer.encode(word, add_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeinorsté中文\U0001f600Жxyzq-_.0123"), min_size=1, max_size=30))
def test_pieces_of_words(both, word):
    counter, tokenizer = both
    got = tokenizer.encode(MARK + word, add_special_tokens=False)
    count, unknown, _ = counter.pieces(MARK + word)
    assert count == len(got.ids)
    assert unknown == got.ids.count(0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab"), min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0])), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.text(st.sampled_from("abc"), min_size=1, max_size=12))
def test_ties(vocab, text):
    counter = Counter(vocab)
    got = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False)).encode(text, add_special_tokens=False)
    assert counter.pieces(text)[0] == len(got.ids)


def test_awkward_rows(spark):
    vocab = vocabulary(FILE)
    counter = Counter(vocab)
    got = count_tokens(odd.table(spark), vocab)
    assert got.columns == [c for c in odd.NAMES if c != "n_words"] + ["n_words", "n_tokens", "n_unknown", "log_prob"]
    for r in got.collect():
        words = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(counter.pieces(MARK + w.decode())[0] for w in words))
    assert count_tokens(odd.empty(spark), vocab).count() == 0
    assert count_tokens(odd.table(spark), []).count() == len(odd.rows())
