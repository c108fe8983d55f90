"""Awkward documents: nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, row int, size string, n_words string, spans string, shard string, bands string, key string, block string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def texts() -> list[str | None]:
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(300))
    near = long.split()
    near[10] = "other"
    passage = " ".join(rng.choice(words) for _ in range(70))
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [
        None, "", "   \n\t", "one", "a b c", long, long, " ".join(near), "na " * 200, "na " * 130, f"{fill(30)} {passage} {fill(30)}", f"{fill(80)} {passage}",
        fill(60), "été naïve café 中文 \U0001f600 " * 30, "x" * 50_000, fill(20_000), "token = abcdefghijklmnop and AKIA" + "A" * 20, None, "",
        "a b " * 100, "b a " * 100, passage, passage.upper(),
    ]


def rows() -> list[tuple]:
    out = []
    for i, text in enumerate(texts()):
        source = [None, "s1", "s2", "é"][i % 4]
        out.append((i, text, [None, "en", "fr"][i % 3], source, None if i % 5 == 0 else len(text or ""), *["clash"] * 1, 3, *["clash"] * 7))
    out.append((None, texts()[5], "en", "s1", 1, "clash", 3, *["clash"] * 7))
    out += [out[5], out[12]]  # repeated rows
    return out


def table(spark, keep=None):
    return spark.createDataFrame([r for r in rows() if keep is None or keep(r)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
