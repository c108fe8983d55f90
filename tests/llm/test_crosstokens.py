"""Alignment of two tokenizers against links listed one by one."""

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
import sentencepiece
from public_tokenizers import path
from tokenizers import Tokenizer

from nebulark.llm import crosstokens, queries
from nebulark.llm.crosstokens import align, byte_level, pieces
from tests.conftest import SMALL
from tests.llm import odd

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")


def expected(texts):
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    decode = first.decoder
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    docs, pairs = [], []
    for text in texts:
        groups = []
        if text:
            a = first.encode(" " + text, add_special_tokens=False)
            b = second.encode(text)
            # Byte by byte: the byte-level decoder of the library itself, on one token at a time.
            bytes_a = [token_bytes(first.id_to_token(i)) for i in a.ids]
            bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in zip(b, map(second.id_to_piece, b))]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b, at = set(), set(), 0
                for x in bytes_a:
                    ends_a.add(at := at + len(x))
                at = 0
                for x in bytes_b:
                    ends_b.add(at := at + len(x))
                cuts = sorted(ends_a & ends_b)
                i = j = at_a = at_b = 0
                for cut in cuts:
                    own = ([], [])
                    while at_a < cut:
                        own[0].append(a.ids[i])
                        at_a, i = at_a + len(bytes_a[i]), i + 1
                    while at_b < cut:
                        own[1].append(b[j])
                        at_b, j = at_b + len(bytes_b[j]), j + 1
                    groups.append(own)
        docs.append(groups)
        pairs.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
    assert decode is not None
    count = Counter(p for c in pairs for p in c)
    most: dict = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for groups, links in zip(docs, pairs):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(n for p, n in links.items() if count[p] == most[p[0]])
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), best, sum(count[p] * n for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@lru_cache(None)
def token_bytes(token):
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in shown]
    return bytes(ord(c) if ord(c) < 256 else other[ord(c) - 256] for c in token)


TEXTS = [
    None, "", " ", "a", "  a  b ", "<|endoftext|> <s> </s> <0x41> <unk>", "\u2581x", "été \U0001f600\U0001f469\u200d\U0001f52c 中文字 \u0e01\u0e33", "\t\n\n  x\r\n", "a\u0300" * 50, " " * 300, "\U0001f600" * 400, "x" * 5000,
    "0123456789" * 40, "can't won't I'll they've", "\x00\x01\x7f\x85\xa0", "na " * 900, "中" * 700, "the cat sat on the mat", "the cat sat on the mat", "  lead", "trail  ", "a \u3000 b\u2028c",
]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("pairs", [4 << 20, -1])
def test_align(spark, monkeypatch, small, pairs):
    """Also with texts cut into pieces, products in small chunks and from distinct ids, and counts that are joined."""
    monkeypatch.setattr(crosstokens, "BROADCAST_PAIRS", pairs)
    if small:
        for name, value in {"REMEMBERED": 9, "TEXT_BYTES": 64, "PIECE": 20, "LINKS": 7, "LARGE_GROUP": 2}.items():
            monkeypatch.setattr(crosstokens, name, value)
    texts = TEXTS + [t for t in odd.texts() if len(t or "") < 20_000]
    df = spark.createDataFrame([(i, t, "clash", 5, "clash") for i, t in enumerate(texts)] + [(None, texts[18], "clash", 5, None)], "doc_id long, text string, n_a string, a int, __row string")
    got = align(df.repartition(2), byte_level(A), pieces(B))
    assert got.columns == ["doc_id", "a", "__row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    want = expected([*texts, texts[18]])
    found = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in got.collect()}
    assert len(found) == len(texts) + 1
    for k, w in enumerate(want):
        assert found[k if k < len(texts) else None] == w, texts[k] if k < len(texts) else None


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = expected([r.text for r in docs])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_cross_tokenizer(spark, SMALL).collect()}
    assert got == {r.doc_id: w for r, w in zip(docs, want)}


def test_empty(spark):
    assert align(odd.empty(spark), byte_level(A), pieces(B)).count() == 0
    assert align(spark.createDataFrame([(None,)], "text string"), byte_level(A), pieces(B)).collect()[0].n_links == 0


def test_groups_and_products():
    cuts, size_a, size_b = crosstokens.groups(np.array([2, 3, 7]), np.array([1, 3, 5, 7]))
    assert cuts.tolist() == [3, 7] and size_a.tolist() == [2, 1] and size_b.tolist() == [2, 2]
    found = Counter()
    for g, x, y, n in crosstokens.links(np.array([5, 5, 6]), np.array([1, 1, 2, 3]), size_a, size_b):
        for k in zip(g.tolist(), x.tolist(), y.tolist(), n.tolist()):
            found[k[:3]] += k[3]
    assert found == {(0, 5, 1): 4, (1, 6, 2): 1, (1, 6, 3): 1}
