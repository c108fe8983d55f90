"""The conversation trie against direct sums over all prefixes."""

import hashlib
import random
import zlib

import pytest

from nebulark.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int, part string, up string, bytes string"


def expected(rows):
    turns: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members: dict = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    children: dict = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    sums: dict = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below = [sums[c] for c in children.get(p, [])]
        sums[p] = (sum(x for x, _ in below) or int(not below), own + sum(y for _, y in below))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows(seed=1):
    rng = random.Random(seed)
    said = ["", "hi", "hello", "é\U0001f600", None]
    out = []
    for c in [*range(60), -1, -2, -5, -7, 103, 1_000_004, -(2**62)]:
        for t in range(rng.choice([1, 1, 2, 3, 8, 12])):
            out.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(said)))
    out += [(c, t, "user", f"same {t}") for c in range(200, 290) for t in range(6)]  # one conversation, very often
    out += [(300, t, "user", f"turn {t}") for t in range(70)] + [(305, t, "user", f"turn {t}") for t in range(70)] + [(310, 0, "user", "again")] * 40
    return out + out[:7] + [(None, 0, "user", "nobody's"), (None, None, None, None)]


@pytest.mark.parametrize("block, listed, heavy", [(1024, 1 << 16, 1000), (4, 3, 20)])
def test_trie(spark, monkeypatch, tmp_path, block, listed, heavy):
    """Also with conversations over many blocks, ids over many lists and many keys looked up by broadcast."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    monkeypatch.setattr(conversations, "LISTED", listed)
    monkeypatch.setattr(conversations, "HEAVY", heavy)
    data = rows()
    spark.createDataFrame([(*r, "clash", 1, "clash", "clash", "clash") for r in data], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_trie(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(data)))


def test_few(spark, tmp_path):
    for k, data in enumerate([[], [(None, 1, "user", "x")], [(7, None, None, None)], [(3, 1, "user", "x")]]):
        spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        assert sorted(map(repr, map(tuple, queries.op12_conversation_trie(spark, f"{tmp_path}/{k}").collect()))) == sorted(map(repr, expected(data)))
