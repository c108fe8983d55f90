"""Each stage of the pipeline against brute force on its own input."""

import random
import struct

import numpy as np
import xxhash

import corpus_pipeline as pipeline
from nebulark.llm import language
from nebulark.llm.common import stash
from nebulark.llm.mixing import mix
from tests.conftest import SMALL
from tests.llm import odd
from tests.llm.test_decontaminate import expected as contaminated
from tests.llm.test_language import parse
from tests.llm.test_neardup import expected as near
from tests.llm.test_sharding import need


def languages(rows):
    """The language of each document by a direct parse, None for those that go."""
    sample = {}
    for r in rows:
        if r.lang is not None and any(c.isalpha() for c in r.text or ""):
            sample.setdefault(r.lang, []).append((xxhash64(r.doc_id), r.text.strip(" ")[: language.DOC_CHARS]))
    model = language.learned([(lang, [x for _, x in sorted(found)[: language.SAMPLE_DOCS]]) for lang, found in sorted(sample.items())])
    known = ["\n".join(filter(None, (language.normal(x) for _, x in sorted(sample[lang])[: language.SAMPLE_DOCS])))[: language.SAMPLE_CHARS] for lang in model["langs"]]
    out = {}
    for r in rows:
        text = language.normal(r.text or "")
        n = [parse(k, text) for k in known]
        best = int(np.argmin(n))
        out[r.doc_id] = model["langs"][best] if text and (len(text) < language.SHORT_CHARS or len(text) / n[best] >= model["least"][best]) else None
    return out


def xxhash64(number):
    """What Spark's hash of a long gives, for sorting."""
    x = xxhash.xxh64_intdigest(struct.pack("<q", number), seed=42)
    return x - (1 << 64) if x >> 63 else x


def capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(sizes, mid) <= shards else (mid + 1, high)
    return low


def test_language_stage(spark, monkeypatch):
    """Noise, texts without letters and other languages than the configured ones go; lang is the prediction."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(8)
    odd_rows = [(10_001, None, "en"), (10_002, "12 + 34 = ?", "fr"), (10_003, "".join(chr(0xAC00 + rng.randrange(9000)) for _ in range(300)), None), (10_004, "été", None)]
    odd_rows += [(20_000 + r.doc_id, r.text, None) for r in df.where("lang = 'de'").limit(5).collect()]
    docs = stash(df.unionAll(spark.createDataFrame(odd_rows, df.schema)))
    got = {r.doc_id: r.lang for r in pipeline.language_id(spark, docs, SMALL).collect()}
    assert not {10_001, 10_002, 10_003} & set(got) and {r.doc_id for r in df.collect()} | {10_004} <= set(got)
    assert {got[d] for d in got if d >= 20_000} == {"de"}
    monkeypatch.setattr(pipeline, "KEPT_LANGUAGES", ("de", "fr"))
    some = {r.doc_id: r.lang for r in pipeline.language_id(spark, docs, SMALL).collect()}
    assert some == {d: lang for d, lang in got.items() if lang in ("de", "fr")} and some


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs.collect()
    for name, stage in pipeline.STAGES:
        docs = stash(stage(spark, docs, SMALL))
        got, before, kept = docs.collect(), kept, docs.collect()
        if name == "sharding":
            placed = sorted(got, key=lambda r: (r.shard, r.slot))
            assert [r.doc_id for r in placed] == order
            sizes = [sum(r.size for r in got if r.shard == k) for k in range(24)]
            texts = {r.doc_id: len((r.text or "").encode()) + 8 for r in before}
            assert all(r.size == texts[r.doc_id] for r in got) and max(sizes) <= capacity([texts[d] for d in order], 24)
            break
        assert docs.columns == columns
        ids = sorted(r.doc_id for r in got)
        if name == "language_id":
            want = languages(before)
            assert {r.doc_id: r.lang for r in got} == {d: lang for d, lang in want.items() if lang}
        elif name == "near_dedup":
            assert ids == sorted(set(near([(r.doc_id, r.text) for r in before]).values()))
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            hit = {d for d, _, n, _ in contaminated([(r.doc_id, r.text) for r in before], items) if n}
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in hit)
        elif name == "mixing":
            assert {(r.doc_id, r.text) for r in got} <= {(r.doc_id, r.text) for r in before}
            words = lambda rows: sum(len((r.text or "").encode().split()) for r in rows)
            assert abs(words(got) / words(before) - 1.5) < 0.1
            plan = mix(spark.createDataFrame(before, docs.schema)).collect()
            size = {r.doc_id: r["size"] for r in plan}
            copies = [(at, r.doc_id) for r in plan for at in (r.positions[: int(r.taken / r["size"] + 0.5)] if r["size"] else [0.0])]
            order = [d for _, d in sorted(copies)]
            assert sorted(order) == ids and all(size[d] >= 0 for d in order)


def test_awkward_rows(spark):
    for table in (odd.table(spark), odd.empty(spark)):
        docs = table.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in pipeline.STAGES:
            docs = stash(stage(spark, docs, SMALL))
        assert set(docs.columns) == {"doc_id", "size", "text_crc32", "shard", "slot"}
