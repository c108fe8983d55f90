"""Tile pyramids, bundles and order statistics."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from nebulark.operators import sampling, stats
from nebulark.sources import bundles, png


def image(spark, plane):
    return spark.createDataFrame([(y, x, float(v)) for (y, x), v in np.ndenumerate(plane)], "y int, x int, v double")


def test_pyramid_of_uneven_sides(spark):
    plane = np.arange(15.0).reshape(5, 3)
    plane[0, 0] = np.nan
    plane[4, 2] = np.inf
    got = {(r.level, r.y, r.x): r.v for r in png.pyramid(image(spark, plane), 2).collect()}
    assert got[1, 0, 0] == pytest.approx((1 + 3 + 4) / 3) and got[1, 2, 0] == 12.5 and got[1, 2, 1] == 0.0  # nothing finite there
    assert got[0, 0, 0] == pytest.approx(np.mean([got[1, 0, 0], got[1, 0, 1], got[1, 1, 0], got[1, 1, 1]]))
    assert sum(k[0] == 2 for k in got) == 15 and {k[0] for k in got} == {0, 1, 2} == {x["level"] for x in png.levels(5, 3, 2)}
    assert [(x["width"], x["height"], x["cols"], x["rows"], x["scale"]) for x in png.levels(5, 3, 2)] == [(1, 2, 1, 1, 0.25), (2, 3, 1, 2, 0.5), (3, 5, 2, 3, 1.0)]
    tile = next(r.content for r in png.tiles(image(spark, plane), 2).collect() if (r.level, r.ty, r.tx) == (2, 2, 1))
    assert struct.unpack(">II", tile[16:24]) == (2, 2)  # padded


@pytest.mark.parametrize("packs", [True, False])
def test_bundle(spark, tmp_path, packs):
    rng = np.random.default_rng(1)
    rows = [(f"dir/{k:03d} é.bin", bytes(k % 7 for _ in range(300)) if packs else rng.bytes(300)) for k in range(40)] + [("empty", b"")]
    out = bundles.export(spark.createDataFrame(rows, "name string, content binary").repartition(7), f"{tmp_path}/out/all.zip").first()
    data = (tmp_path / "out" / "all.zip").read_bytes()
    assert (out.members, out.bytes) == (41, len(data)) and [p.name for p in (tmp_path / "out").iterdir()] == ["all.zip"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == sorted(n for n, _ in rows) and {n: z.read(n) for n in z.namelist()} == dict(rows)
    assert {r.name: bytes(r.content) for r in bundles.contents(bundles.listed(spark, f"{tmp_path}/out")).collect()} == dict(rows)
    with pytest.raises(ValueError, match="one name"):
        bundles.export(spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, content binary"), f"{tmp_path}/out/twice.zip")
    none = bundles.export(spark.createDataFrame([], "name string, content binary"), f"{tmp_path}/out/none.zip").first()
    assert none.members == 0 and zipfile.ZipFile(tmp_path / "out" / "none.zip").namelist() == []


def test_large_records():
    """Sizes and offsets beyond 32 bits stand in extra fields."""
    big = 5 << 32
    assert struct.unpack("<QQ", bundles.local_record("a", 1, big, 0, big)[-16:]) == (big, big)
    assert struct.unpack("<QQQ", bundles.central_record("a", 1, big, 0, big, big + 7)[-24:]) == (big, big, big + 7)
    assert len(bundles.end_record(70_000, 10, 20)) > len(bundles.end_record(7, 10, 20)) == 22


def test_order_stats_are_exact(spark):
    rng = np.random.default_rng(2)
    frames = {"a": rng.normal(size=5000) ** 2, "b": np.full(50, 3.0), "c": np.array([2.0]), "d": np.concatenate([rng.random(300) * 1e-5 + 1, [1e9]]), "e": np.array([-1.0, np.nan])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in frames.items() for v in vs], "frame string, v double")
    ask = {"low": 0.01, "mid": 0.5, "top": 0.999, "end": 1.0}
    got = {r.frame: r for r in stats.order_stats(df, ["frame"], ask).collect()}
    assert set(got) == set("abcd")
    for k in "abcd":
        vs = np.sort(frames[k][frames[k] > 1e-7])
        assert all(got[k][n] == vs[min(int(f * len(vs)), len(vs) - 1)] for n, f in ask.items())
    assert stats.order_stats(df.where("frame = 'a'"), [], {"mid": 0.5}).first()[0] == got["a"]["mid"] and stats.order_stats(df.limit(0), [], {"mid": 0.5}).first()[0] is None


def test_small_statistics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 5.0), ("c", float("inf"))], "frame string, v double")
    assert {r.frame: (r["mean"], r.sigma) for r in stats.mean_sigma(df, ["frame"]).collect()} == {"a": (2.0, 2**0.5), "b": (5.0, 0.0), "c": (0.0, 0.0)}
    assert df.select(stats.peak_snr(F.lit(5.0), F.lit(1.0), F.lit(2.0)), stats.peak_snr(F.lit(5.0), F.lit(1.0), F.lit(0.0))).first() == (2.0, 0.0)
    points = spark.createDataFrame([(0, 0.5, 1.4), (1, -9.0, 99.0), (2, 1.49, 0.0)], "id int, y double, x double")
    assert {r.id: r.v for r in sampling.nearest_sample(image(spark, np.arange(6.0).reshape(2, 3)), points).collect()} == {0: 4.0, 1: 2.0, 2: 3.0}
